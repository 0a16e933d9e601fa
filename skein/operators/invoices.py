"""Invoice reconciliation from a model's raw reply to the two destination tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.money import cents, differs, loose_number, printed
from skein.functions.text import strip
from skein.sources.sinks import append

TOLERANCE = 0.05
BOOKS = ["currency", "vendor", "invoice_date", "total", "vat_amount", "calculated_total"]


def unfenced(raw: Column) -> Column:
    """The reply without code fences and outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(raw, "```json\n?", ""), "```", ""))


def field(doc: Column, path: str) -> tuple[Column, Column]:
    """(text of a field, whether it is an explicit null); a missing field is null text and not explicit."""
    value = F.try_variant_get(doc, path, "variant")
    return F.try_variant_get(doc, path, "string"), F.coalesce(F.is_variant_null(value), F.lit(False))


def validate(replies: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """replies (…, raw) with the invoice's fields, calculated_total, needs_review, review_reason, raw_output.

    Not JSON: reviewed, with the raw reply. A null total or a null line is reviewed; a missing total, like
    any text that isn't a number, makes the comparison impossible and isn't flagged. A missing VAT isn't a
    number either, an explicit null is 0. Lines add up only where they are present; no lines add up to 0.
    """
    doc = F.try_parse_json(unfenced(F.col("raw")))
    d = replies.withColumn("__d", doc)
    v = F.col("__d")
    total, total_null = field(v, "$.total")
    vat, vat_null = field(v, "$.vat_amount")
    items = F.coalesce(F.try_variant_get(v, "$.line_items", "array<variant>"), F.array().cast("array<variant>"))
    line = F.transform(items, lambda x: F.try_variant_get(x, "$.line_total", "string"))
    nan = F.lit(float("nan"))
    d = d.withColumn("__lines", line)
    summed = F.aggregate("__lines", F.lit(0.0), lambda s, x: F.when(x.isNull(), s).otherwise(s + loose_number(x)))
    vat_number = F.when(vat_null, F.lit(0.0)).otherwise(F.coalesce(loose_number(vat), nan))
    stated = F.when(total_null, F.lit(None).cast("double")).otherwise(F.coalesce(loose_number(total), nan))
    d = d.withColumn("calculated_total", cents(summed + vat_number)).withColumn("__stated", stated)
    off = F.concat(F.lit("Line items sum to "), printed(F.col("calculated_total")), F.lit(" but stated total is "), printed(F.col("__stated")))
    reason = (
        F.when(v.isNull(), F.lit("Could not parse AI output as JSON"))
        .when(F.col("__stated").isNull(), F.lit("No total found on invoice"))
        .when(F.exists("__lines", lambda x: x.isNull()), F.lit("One or more line items missing values"))
        .when(differs(F.col("calculated_total"), F.col("__stated"), tolerance), off)
    )
    text = {c: F.try_variant_get(v, f"$.{c}", "string") for c in ("vendor", "invoice_date", "currency")}
    return d.select(
        *replies.columns,
        *[x.alias(c) for c, x in text.items()],
        total.alias("total"),
        vat.alias("vat_amount"),
        F.when(v.isNotNull(), F.col("calculated_total")).alias("calculated_total"),
        reason.isNotNull().alias("needs_review"),
        F.coalesce(reason, F.lit("")).alias("review_reason"),
        F.when(v.isNull(), F.col("raw")).alias("raw_output"),
    )


def target(checked: DataFrame) -> DataFrame:
    """checked with its destination, books or review. Store this once and split the stored table: a filter on an
    unstored one would be pushed below the checks and repeat them."""
    return checked.withColumn("target", F.when(F.col("needs_review"), F.lit("review")).otherwise(F.lit("books")))


def books(checked: DataFrame) -> DataFrame:
    """Rows for the books."""
    return checked.where("NOT needs_review").select(*BOOKS)


def review_queue(checked: DataFrame) -> DataFrame:
    """Rows for review; unlike a plain sheet, with the raw reply."""
    return checked.where("needs_review").select(*BOOKS, "review_reason", "raw_output")


def deliver(checked: DataFrame, root: str) -> None:
    """Append the rows of ``checked``, a stored table, to the two tables below ``root``."""
    append(books(checked), f"{root}/books")
    append(review_queue(checked), f"{root}/review_queue")
