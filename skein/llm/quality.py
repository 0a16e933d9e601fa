"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Boolean SQL expression over measures of a text, true for a text to reject. On a
bounded sample, chosen by a hash, the cascade times each rule from the raw text and takes its share of
rejections; rules run in the order of rejections per cost, in one CASE. What only a later rule
measures isn't computed for a text that an earlier one rejects. Costs count as powers of four of the
dearest rule's, so that the noise of a clock changes the order
less often. The order changes the cost
only: the verdict is the same in any order.
"""

from __future__ import annotations

import math
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of the sample, and how often each is read to time a rule.
SAMPLE_ROWS, TIMES = 200, 1
SPACE = r"[\x20\x09-\x0D]"
#: White space for translate(): space, \t, \n, \x0B, \f, \r.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def window_hashes(w: str) -> str:
    """64-bit hashes of the 3-word windows of the array ``w``."""
    return f"CASE WHEN size({w}) >= 3 THEN transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))) ELSE array() END"


def repeated_words(h: str) -> str:
    """Words covered by windows whose hash occurs twice or more in ``h``.

    Most texts end at the first test. For the others windows are sorted by hash and place, those
    equal to a neighbour are kept, and each adds what lies before the next kept one, 3 at most."""
    pairs = f"array_sort(transform({h}, (x, i) -> struct(x AS x, i AS i)))"
    kept = "transform(filter(transform(s, (e, k) -> struct(e.i AS i, e.x <=> get(s, k - 1).x OR e.x <=> get(s, k + 1).x AS r)), e -> e.r), e -> e.i)"
    total = "aggregate(array_sort(p), struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"
    return (
        f"CASE WHEN size({h}) = size(array_distinct({h})) THEN 0L ELSE "
        f"get(transform(array({pairs}), s -> get(transform(array({kept}), p -> {total}), 0)), 0) END"
    )


def _bound(value: str, name: str, body: str) -> str:
    """body with ``name`` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


SQL_SPACES = r"concat(' \t\n', char(11), char(12), '\r')"
WORDS = rf"filter(split(__t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
LINES = f"filter(split(__t, '\\n'), x -> length(translate(x, {SQL_SPACES}, '')) > 0)"
#: Measures of a text __t that isn't null.
MEASURES: dict[str, str] = {
    "n_words": f"CAST(size({WORDS}) AS LONG)",
    "word_chars": f"CAST(length(translate(__t, {SQL_SPACES}, '')) AS LONG)",
    "n_symbols": f"CAST(length(__t) - length(translate(__t, '{SYMBOLS}', '')) AS LONG)",
    "n_dup_lines": f"CAST({_bound(LINES, 'l', 'size(l) - size(array_distinct(l))')} AS LONG)",
    "n_repeat_words": _bound(WORDS, "v", _bound(window_hashes("v"), "h", repeated_words("h"))),
    "n_shouts": "CAST(length(__t) - length(translate(__t, '!', '')) AS LONG)",
}

#: Rules over measures; true rejects. The first two are the contract's floor.
RULES: dict[str, str] = {
    "few_words": "{n_words} < 50",
    "repeated_windows": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbols": "20 * {n_symbols} > {n_words}",
    "shouting": "4 * {n_shouts} > {n_words}",
    "word_length": "{word_chars} < 2 * {n_words} OR {word_chars} > 16 * {n_words}",
    "duplicate_lines": "{n_dup_lines} >= 3 AND 20 * {n_dup_lines} > {n_words}",
}


def rule(text: str, ready: tuple[str, ...] = ()) -> Column:
    """A rule's column over __t; measures in ``ready`` are columns already. Unknown is not rejected."""
    return F.coalesce(F.expr(re.sub(r"\{(\w+)\}", lambda m: f"__{m[1]}" if m[1] in ready else f"({MEASURES[m[1]]})", text)), F.lit(False))


def order_rules(sample: DataFrame, rules: dict[str, str], times: int = TIMES) -> list[tuple[str, float, float]]:
    """(rule, share rejected, cost) over a stored sample of texts (__t), best rejection per cost first; ties by name.

    Each rule reads each text ``times`` times, in a round that warms up and in one that counts, less the
    time of reading the texts alone. Costs below a sixteenth of the largest are alike."""
    n = max(1, sample.count())
    every = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(found: Column) -> float:
        # the copy's number is part of the text, so that no copy is computed from another
        began = time.perf_counter()
        every.withColumn("__t", F.concat("__t", F.col("__k").cast("string"))).select(F.count_if(found)).first()
        return time.perf_counter() - began

    columns = {name: rule(text) for name, text in rules.items()} | {None: F.length("__t") < 0}
    rounds = [{name: seconds(c) for name, c in columns.items()} for _ in range(2)]
    taken = {name: min(r[name] for r in rounds[1:]) for name in columns}
    shares = sample.select(*(F.count_if(columns[name]).alias(f"s{k}") for k, name in enumerate(rules))).first()
    raw = {name: taken[name] - taken[None] for name in rules}
    most = max(1e-3, *raw.values())
    found = [(name, shares[k] / n, 4.0 ** round(math.log(max(raw[name] / most, 1 / 16), 4))) for k, name in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def verdict(order: list[str], rules: dict[str, str], ready: tuple[str, ...] = ()) -> Column:
    """Name of the first rule in ``order`` that rejects, or null; later rules aren't evaluated then."""
    chain = F.when(rule(rules[order[0]], ready), F.lit(order[0]))
    for name in order[1:]:
        chain = chain.when(rule(rules[name], ready), F.lit(name))
    return chain


def cascade(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = (), measures: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """Judge every text.

    docs: doc_id, text; ``keep`` names columns to pass through, others are ignored. One row per
    input row: doc_id, the kept columns, the ``measures`` asked for, of every text, rejected_by (a rule, null: none), kept. Rules take
    those measures as they are; what else they need is computed only where they run. A null text is empty: 0 words, rejected by the
    floor. Ids may be null or repeat; an empty table gives no row. About ``sample_rows`` rows, chosen by a hash of the
    text, decide the order of the rules only.
    """
    rules = rules or RULES
    base = docs.select("doc_id", *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(keep)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = base.select("__t").where(F.pmod(F.xxhash64("__t", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates().repartition(4).persist()
    try:
        order = [name for name, _, _ in order_rules(sample, rules)]
    finally:
        sample.unpersist()
    # words are split once for all measures that need them
    split = base.select("*", F.expr(WORDS).alias("__w")) if any(WORDS in MEASURES[m] for m in measures) else base
    known = split.select("*", *(F.expr(MEASURES[m].replace(WORDS, "__w")).alias(f"__{m}") for m in measures))
    judged = known.withColumn("__by", verdict(order, rules, measures))
    return judged.select("doc_id", *(F.col(f"__c{k}").alias(c) for k, c in enumerate(keep)), *(F.col(f"__{m}").alias(m) for m in measures), F.col("__by").alias("rejected_by"), F.col("__by").isNull().alias("kept"))
