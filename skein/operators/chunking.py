"""Pages to chunks: fixed and overlapping token windows, and clause structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import fold_nbsp, is_heading, is_numbered_clause, lines, model_tokens, strip

SIZE, OVERLAP, SHORT, RUNT = 500, 50, 100, 30


def fixed_windows(pages: DataFrame, size: int = SIZE) -> DataFrame:
    """pages (…, text) to one row per ``size`` tokens: seq, n_tokens, chunk. An empty text has none."""
    tok = pages.withColumn("__t", model_tokens(F.coalesce("text", F.lit(""))))
    starts = F.when(F.size("__t") > 0, F.sequence(F.lit(0), F.size("__t") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return _windows(tok, starts, size)


def overlapping_windows(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = 0) -> DataFrame:
    """Windows that share ``overlap`` tokens; none begins within the last window. Texts of fewer than ``least`` tokens have none."""
    stride = max(1, size - overlap)
    tok = pages.withColumn("__t", model_tokens(F.coalesce("text", F.lit(""))))
    last = F.greatest(F.lit(0), F.ceil((F.size("__t") - size) / stride).cast("int"))
    return _windows(tok, F.when(F.size("__t") >= least, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)), size)


def exploded(df: DataFrame, column: str, *names: str) -> DataFrame:
    """posexplode of a computed column. Of an inner one Spark would infer a filter on its size below and compute it twice."""
    return df.select("*", F.posexplode_outer(column).alias(*names)).where(F.col(names[0]).isNotNull())


def _windows(tok: DataFrame, starts: Column, size: int) -> DataFrame:
    cut = exploded(tok.withColumn("__n", F.size("__t")).withColumn("__s", starts), "__s", "seq", "start")
    piece = F.slice("__t", F.col("start") + 1, size)
    return cut.select(*[c for c in tok.columns if c not in ("__t", "text")], "seq", F.least(F.lit(size), F.col("__n") - F.col("start")).alias("n_tokens"), F.array_join(piece, "").alias("chunk"))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(text: Column) -> Column:
    """Trimmed segments: a blank line or a heading ends one; a heading begins the next."""

    def cut(ls: Column) -> Column:
        marked = F.filter(F.transform(ls, lambda x, i: F.when(~x.rlike(r"(?U)\S") | is_heading(x) | (i == 0), i)), lambda i: i.isNotNull())
        # a segment is the lines from one mark to the next; blank lines are all marks
        part = lambda at: F.transform(at, lambda i, k: strip(F.array_join(F.slice(ls, i + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - i), "\n")))
        return F.filter(bound(marked, part), lambda x: x != "")

    return bound(lines(text), cut)


def has_heading(text: Column) -> Column:
    return F.exists(lines(text), is_heading)


def merge_short(parts: Column, least: int = SHORT) -> Column:
    """Join runs of short segments with a blank line until they reach ``least`` tokens; a short tail joins what is before it.

    Tokens are counted once a segment; the fold runs over these counts and gives where each merged one ends."""
    counts = F.transform(parts, lambda x: F.size(model_tokens(x)))
    state = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s: Column, size: Column) -> Column:
        full = s["n"] + size >= least
        at = s["at"] + 1
        return F.struct(F.when(full, F.array_append(s["ends"], at)).otherwise(s["ends"]).alias("ends"), F.when(full, F.lit(0)).otherwise(s["n"] + size).alias("n"), at.alias("at"))

    def close(s: Column) -> Column:
        whole = F.size(s["ends"])
        tail = F.when(F.get(s["ends"], whole - 1) == s["at"], s["ends"]).otherwise(F.array_append(F.slice(s["ends"], 1, F.greatest(whole - 1, F.lit(0))), s["at"]))
        return F.when(s["at"] == 0, s["ends"]).when(whole == 0, F.array(s["at"])).otherwise(tail)

    ends = F.aggregate(counts, state, step, close)
    return bound(ends, lambda e: F.transform(e, lambda end, k: F.array_join(F.slice(parts, F.coalesce(F.get(e, k - 1), F.lit(0)) + 1, end - F.coalesce(F.get(e, k - 1), F.lit(0))), "\n\n")))


def structured_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = SHORT, runt: int = RUNT) -> DataFrame:
    """Clause-aware chunks of pages (…, text): folded spaces, segments, merged short ones, runts dropped, then windows."""
    folded = pages.withColumn("text", fold_nbsp(F.coalesce("text", F.lit(""))))
    cut = bound(segments(F.col("text")), lambda x: merge_short(x, least))
    parts = exploded(folded.select(*[c for c in pages.columns if c != "text"], cut.alias("__m")), "__m", "segment", "text").drop("__m")
    return overlapping_windows(parts, size, overlap, runt)


def page_flags(pages: DataFrame) -> DataFrame:
    """pages with empty and heading_found."""
    blank = ~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")
    return pages.withColumn("empty", blank).withColumn("heading_found", ~blank & has_heading(fold_nbsp(F.coalesce("text", F.lit("")))))


def coverage(pages: DataFrame, naive: DataFrame, structured: DataFrame) -> DataFrame:
    """One row: page flags, chunk counts and token sizes of both chunkings; empty inputs give nulls, not errors."""
    flags = page_flags(pages).agg(F.count("*").alias("pages"), F.count_if("empty").alias("empty_pages"), F.count_if("heading_found").alias("heading_pages"))

    def sizes(chunks: DataFrame, name: str) -> DataFrame:
        return chunks.agg(F.count("*").alias(f"{name}_chunks"), F.avg("n_tokens").alias(f"{name}_avg"), F.min("n_tokens").alias(f"{name}_min"), F.max("n_tokens").alias(f"{name}_max"))

    share = F.try_divide(100.0 * F.col("heading_pages"), (F.col("pages") - F.col("empty_pages")).cast("double"))
    return flags.crossJoin(sizes(naive, "naive")).crossJoin(sizes(structured, "structured")).withColumn("heading_share", share).withColumn("chunk_difference", F.col("structured_chunks") - F.col("naive_chunks"))


def committed(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the documents of which every page was read (extracted: source_file, page_number, error)."""
    failed = extracted.where("error IS NOT NULL").select("source_file").distinct()
    return pages.join(failed, "source_file", "left_anti")


def manifest(extracted: DataFrame) -> DataFrame:
    """One row: documents found, succeeded, failed, and the first error of each failed one."""
    per = extracted.groupBy("source_file").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("page_number", "error"))).alias("bad"))
    bad = F.struct("source_file", F.col("bad.error").alias("error"))
    return per.agg(F.count("*").alias("documents_found"), F.count_if(F.col("bad").isNull()).alias("documents_succeeded"), F.count_if(F.col("bad").isNotNull()).alias("documents_failed"), F.array_sort(F.collect_list(F.when(F.col("bad").isNotNull(), bad))).alias("failures"))


def pick_examples(chunks: DataFrame, keywords: list[str], wanted: int = 4, hint: str | None = None) -> DataFrame:
    """place, chunk_id, keyword, chunk of up to ``wanted`` numbered clauses for display: of each keyword the first that holds it and
    isn't used yet, then the first others. Chunks whose source_file holds ``hint`` come first, then those of lower chunk_id."""
    first = F.when(F.upper("source_file").contains(hint.upper()), F.lit(0)).otherwise(F.lit(1)) if hint else F.lit(0)
    base = chunks.where(is_numbered_clause(F.col("chunk"))).select("chunk_id", "chunk", first.alias("__o"), F.lower("chunk").alias("__l"))
    used: list[tuple] = []
    for word in [*keywords, None]:  # a few rows each
        some = base.where(F.col("__l").contains(word.lower())) if word else base
        left = [r[0] for r in some.orderBy("__o", "chunk_id").limit(wanted + len(used)).select("chunk_id").collect() if r[0] not in {u[0] for u in used}]
        used += [(x, word or "any numbered clause") for x in left[: 1 if word else wanted - len(used)]][: wanted - len(used)]
    picked = chunks.sparkSession.createDataFrame([(k, *u) for k, u in enumerate(used, 1)], f"place int, chunk_id {dict(chunks.dtypes)['chunk_id']}, keyword string")
    return chunks.join(F.broadcast(picked), "chunk_id").select("place", "chunk_id", "keyword", "chunk")


def search(chunks: DataFrame, phrase: str) -> DataFrame:
    """Chunks that hold a phrase, in any case."""
    return chunks.where(F.lower("chunk").contains(phrase.lower()))
