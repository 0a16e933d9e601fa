"""Leads from several sources: one shape, cleanup, deduplication, score, routes, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import EMAIL_SAFE_PHONE, e164, strip
from skein.sources.sinks import append, outbox

FIELDS = ["name", "email", "phone", "company", "message"]
INTENT = ["quote", "pricing", "bulk", "demo", "buy"]


def normalised(source: DataFrame, mapping: dict[str, str], origin: str) -> DataFrame:
    """A source in the shared shape; ``mapping`` names its column for each field (names may have spaces), missing ones are null."""
    cols = [strip(F.col(f"`{mapping[f]}`").cast("string")).alias(f) if f in mapping else F.lit(None).cast("string").alias(f) for f in FIELDS]
    rest = [F.col(c) for c in source.columns if c in ("lead_id", "received_at")]
    return source.select(*rest, *cols, F.lit(origin).alias("origin"))


def needs_cleanup(phone: Column, company: Column) -> Column:
    return ~F.coalesce(phone, F.lit("")).rlike(EMAIL_SAFE_PHONE) | (F.coalesce(company, F.lit("")) == "")


def cleaned(leads: DataFrame, company: Callable[[Column], Column] = lambda message: F.lit(None).cast("string"), country: str = "234") -> DataFrame:
    """leads with needs_cleanup, cleaned_phone, cleaned_company. Only messy leads go through the extraction, as a costly
    model would; clean ones are joined on afterwards."""
    flagged = leads.withColumn("needs_cleanup", needs_cleanup(F.col("phone"), F.col("company")))
    own = F.nullif(F.col("company"), F.lit(""))
    messy = flagged.where("needs_cleanup").withColumn("cleaned_phone", e164(F.col("phone"), country)).withColumn("cleaned_company", F.coalesce(own, company(F.col("message"))))
    clean = flagged.where("NOT needs_cleanup").withColumn("cleaned_phone", F.col("phone")).withColumn("cleaned_company", own)
    return messy.unionByName(clean)


def deduplicated(leads: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The first lead (by ``order``) of each email, case folded, that isn't known yet. A lead without an email can't be a
    duplicate and stays; it is told apart from the others, so that no key collects them."""
    key = F.lower(F.col("email"))
    new = leads.withColumn("__k", key).where("__k IS NOT NULL AND __k <> ''")
    known = existing.select(F.lower("email").alias("__k")).where("__k IS NOT NULL").distinct()
    fresh = new.join(known, "__k", "left_anti")
    w = Window.partitionBy("__k").orderBy(*order)
    first = fresh.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__k")
    return first.unionByName(leads.where("email IS NULL OR email = ''"))


def scored(leads: DataFrame, intent: list[str] | None = None, weights: tuple[int, int, int] = (1, 1, 1), hot: int = 3, warm: int = 1) -> DataFrame:
    """leads with points (intent words, company, clean phone) and tier Hot, Warm or Junk."""
    text = F.lower(F.coalesce("message", F.lit("")))
    wants = text.rlike(r"\b(" + "|".join(intent or INTENT) + r")\b")
    parts = (wants, F.coalesce("cleaned_company", F.lit("")) != "", F.col("cleaned_phone").isNotNull())
    points = sum((F.when(p, F.lit(w)).otherwise(F.lit(0)) for p, w in zip(parts, weights, strict=True)), F.lit(0))
    return leads.withColumn("points", points).withColumn("tier", F.when(F.col("points") >= hot, F.lit("Hot")).when(F.col("points") >= warm, F.lit("Warm")).otherwise(F.lit("Junk")))


def routes(tier: Column) -> Column:
    """Destinations of a tier; every lead is recorded."""
    return F.when(tier == "Hot", F.array(F.lit("crm"), F.lit("alerts"), F.lit("records"))).when(tier == "Warm", F.array(F.lit("crm"), F.lit("records"))).otherwise(F.array(F.lit("records")))


def routed(leads: DataFrame) -> DataFrame:
    """One row per lead and destination."""
    return leads.withColumn("destination", F.explode(routes(F.col("tier"))))


def valid_or_dead(leads: DataFrame, stage: str, failed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that can be delivered, dead letters): a lead without an email fails alone and keeps its full context."""
    bad = F.coalesce("email", F.lit("")) == ""
    dead = leads.where(bad).select((failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"), F.lit(stage).alias("stage"), F.to_json(F.struct(*leads.columns)).alias("payload"), F.lit("missing required field: email").alias("error"))
    return leads.where(~bad), dead


def dead_letter_digest(dead: DataFrame) -> DataFrame:
    """day, stage, failures, first and last time."""
    return dead.groupBy(F.to_date("failed_at").alias("day"), "stage").agg(F.count("*").alias("failures"), F.min("failed_at").alias("first_failure"), F.max("failed_at").alias("last_failure"))


def deliver(routed_leads: DataFrame, root: str) -> None:
    """Append routed leads, one table a destination; a lead that can't be delivered is a dead letter instead."""
    good, dead = valid_or_dead(routed_leads, "deliver")
    outbox(good, f"{root}/outbox")
    append(dead, f"{root}/dead_letters")


def company_in(message: Column) -> Column:
    """A stand-in for a model that finds a company: the capitalised words after "from" or "at"; null if there are none."""
    return F.nullif(F.regexp_extract(message, r"\b(?:from|at)\s+((?:[A-Z][A-Za-z0-9&]*)(?:\s+[A-Z][A-Za-z0-9&]*)*)", 1), F.lit(""))
