"""Support tickets: gates, routes, order lookup, drafts, guardrails and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import order_number

CONFIDENCE = 0.6
#: Patterns that a draft of a branch must not contain; '*' holds for all.
FORBIDDEN = [
    ("order_status", r"\brefund"),
    ("return", r"\b(approved|confirmed)\b"),
    ("*", r"\bcompensat"),
    ("*", r"\bguarantee"),
]


def route(intent: Column, confidence: Column, gate: float = CONFIDENCE) -> Column:
    """order_status, return or escalate; an unknown confidence, or one below the gate, escalates."""
    return F.when(F.coalesce(confidence < gate, F.lit(True)), F.lit("escalate")).when(intent.isin("order_status", "return"), intent).otherwise(F.lit("escalate"))


def lookup(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """tickets (ticket_id, order_number, sender) with matches and the found order numbers.

    A ticket with an order number is looked up by it alone, also if nothing is found; others by sender."""
    by_number = tickets.where("order_number IS NOT NULL").join(orders.select("order_number", F.col("order_number").alias("found")), "order_number", "left")
    by_email = tickets.where("order_number IS NULL").join(orders.select(F.lower("email").alias("__e"), F.col("order_number").alias("found")), F.lower("sender") == F.col("__e"), "left").drop("__e")
    both = by_number.select(*tickets.columns, "found").unionByName(by_email.select(*tickets.columns, "found"))
    return both.groupBy(*tickets.columns).agg(F.count("found").alias("matches"), F.array_sort(F.collect_set("found")).alias("found"))


def drafted(looked: DataFrame, orders: DataFrame) -> DataFrame:
    """Draft replies: from the one order, a clarifying text that claims nothing, or the returns policy; none if escalated."""
    one = orders.select(F.col("order_number").alias("__o"), "item", "status", "carrier")
    j = looked.join(one, (F.col("route") == "order_status") & (F.col("matches") == 1) & (F.get("found", F.lit(0)) == F.col("__o")), "left")
    status = F.concat(F.lit("Order "), F.col("__o"), F.lit(" ("), F.col("item"), F.lit(") is "), F.lower("status"), F.lit(" with "), F.col("carrier"), F.lit("."))
    which = F.when(F.col("matches") > 1, F.concat(F.lit("Which order do you mean: "), F.array_join("found", ", "), F.lit("?"))).otherwise(F.lit("Please send us your order number."))
    draft = F.when(F.col("route") == "escalate", F.lit(None).cast("string")).when(F.col("route") == "return", F.lit("We have received your return request; a colleague will review it.")).when(F.col("matches") == 1, status).otherwise(which)
    return j.withColumn("draft", draft).drop("__o", "item", "status", "carrier")


def guardrail_hits(drafts: DataFrame, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Patterns, of the row's branch or of all, that the draft contains; an array, empty if clean."""
    low = F.lower(F.coalesce("draft", F.lit("")))
    tests = [F.when(low.rlike(p) & ((F.col("route") == b) | F.lit(b == "*")), F.lit(p)) for b, p in patterns or FORBIDDEN]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def outcome(drafts: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """drafts (route, matches, draft) with guardrail and outcome: escalate, hold, clarify or auto_send."""
    d = drafts.withColumn("guardrail", guardrail_hits(drafts, patterns))
    result = (
        F.when((F.col("route") == "escalate") | (F.size("guardrail") > 0), F.lit("escalate"))
        .when(F.col("route") == "return", F.lit("hold"))
        .when(F.col("matches") == 1, F.lit("auto_send"))
        .otherwise(F.lit("clarify"))
    )
    return d.withColumn("outcome", result)


def deflection(outcomes: DataFrame) -> DataFrame:
    """One row: tickets, deflected (sent without a person), rate; no tickets give a null rate."""
    solved = F.col("outcome").isin("auto_send", "clarify")
    return outcomes.agg(F.count("*").alias("tickets"), F.count_if(solved).alias("deflected"), F.avg(F.when(solved, F.lit(1.0)).otherwise(F.lit(0.0))).alias("rate"))


LABELS = ["intent", "urgency", "sentiment", "confidence", "order_number"]


def classified(tickets: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tickets (ticket_id, text, …) with the labels that ``classify`` gives; a missing order number is looked for in the text,
    and a confidence outside 0 to 1 is unknown."""
    out = classify(tickets)
    known = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return out.withColumn("confidence", known).withColumn("order_number", F.coalesce("order_number", order_number(F.col("text")))).select(*tickets.columns, *LABELS)


def by_keywords(tickets: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model that classifies tickets."""
    t = F.lower(F.coalesce("text", F.lit("")))
    intent = F.when(t.rlike(r"\b(return|exchange)"), F.lit("return")).when(t.rlike(r"\b(where|track|deliver|order)"), F.lit("order_status")).when(t.rlike(r"\b(angry|complain|terrible)"), F.lit("complaint")).otherwise(F.lit("other"))
    urgent = F.when(t.rlike(r"\b(urgent|today|now)\b"), F.lit("high")).otherwise(F.lit("normal"))
    mood = F.when(t.rlike(r"\b(angry|terrible|complain)"), F.lit("negative")).otherwise(F.lit("neutral"))
    sure = F.when(intent == "other", F.lit(0.3)).otherwise(F.lit(0.9))
    return tickets.select("*", intent.alias("intent"), urgent.alias("urgency"), mood.alias("sentiment"), sure.alias("confidence"), F.lit(None).cast("string").alias("order_number"))


def escalations(outcomes: DataFrame) -> DataFrame:
    """ticket_id and a summary for the person who takes each escalated ticket: why, what was found, which rules its draft broke."""
    broke = F.when(F.size("guardrail") > 0, F.concat(F.lit("draft broke "), F.size("guardrail").cast("string"), F.lit(" rules"))).otherwise(F.lit("no draft was sent"))
    unsure = F.when(F.coalesce(F.col("confidence") < CONFIDENCE, F.lit(True)), F.lit("unsure")).otherwise(F.lit("sure"))
    text = F.concat_ws("; ", F.concat(F.lit("intent "), F.coalesce("intent", F.lit("unknown")), F.lit(" ("), unsure, F.lit(")")), F.concat(F.col("matches").cast("string"), F.lit(" orders found")), broke)
    return outcomes.where("outcome = 'escalate'").select("ticket_id", text.alias("summary"))


def late(status: Column, expected: Column, as_of: Column, days: int = 7) -> Column:
    """Whether an undelivered order is past its date by more than ``days``."""
    return (status != "Delivered") & (F.datediff(as_of, expected) > days)


def window_closed(until: Column, as_of: Column) -> Column:
    return F.coalesce(until < as_of, F.lit(False))
