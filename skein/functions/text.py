"""Column functions on text: tokens, white space, clause markers, labels and contact data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKERS = sorted({"SECTION", "ARTICLE", "SCHEDULE", "ANNEX", "APPENDIX", "EXHIBIT"})
#: A clause number such as "7.", "7.1" or "7.1.", then white space and text.
NUMBERED = r"(?U)^\s*[0-9]+(\.[0-9]+)*\s*\.?\s+\S"
HEADING = r"(?iU)^\s*((" + "|".join(MARKERS) + r")\b|[0-9]+(\.[0-9]+)*\s*\.?\s+\S)"
#: Line breaks: the ASCII ones, and the next-line, line and paragraph separators.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
EMAIL_SAFE_PHONE = r"^\+[1-9][0-9]{7,14}$"


def search_terms(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order, with repeats; null gives null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def model_tokens(text: Column) -> Column:
    """Lossless pieces: white space with the word after it; stands in for a model's tokenizer."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))


#: Unicode white space, as (?U)\\s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only the space. Only the ends are read."""
    return F.trim(text, F.lit(BLANKS))


def fold_nbsp(text: Column) -> Column:
    """No-break spaces as plain ones."""
    return F.translate(text, "\u00a0", " ")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def is_numbered_clause(line: Column) -> Column:
    return line.rlike(NUMBERED)


def first_label(text: Column, labels: list[str], other: str = "UNKNOWN") -> Column:
    """The label contained in the text; longer labels are tried first, so none hides in another."""
    norm, out = F.upper(strip(text)), F.lit(other)
    for label in sorted(labels, key=lambda x: (len(x), x)):
        out = F.when(norm.contains(label), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def declines(reply: Column, answer: Column) -> Column:
    """Whether a classifier's reply says REFUSAL; that label wins over ANSWER, an empty answer is no refusal."""
    return (F.length(strip(F.coalesce(answer, F.lit("")))) > 0) & F.coalesce(F.upper(reply).contains("REFUSAL"), F.lit(False))


def page_list(cell: Column) -> Column:
    """Pages of a cell such as "3, 5–7" (en dash): [3, 5, 6, 7]."""

    def expand(part: Column) -> Column:
        ends = F.split(F.trim(part), "\u2013")
        return F.sequence(F.trim(ends[0]).cast("int"), F.trim(F.element_at(ends, -1)).cast("int"))

    return F.flatten(F.transform(F.split(cell, ","), expand))


def e164(phone: Column, country: str = "234") -> Column:
    """Phone in E.164: digits only, a leading 0 or 00 replaced; null if nothing plausible remains."""
    bare = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9+]", "")
    number = (
        F.when(bare.startswith("+"), bare)
        .when(bare.startswith("00"), F.concat(F.lit("+"), F.substring(bare, 3, 20)))
        .when(bare.startswith("0"), F.concat(F.lit("+" + country), F.substring(bare, 2, 20)))
        .otherwise(F.concat(F.lit("+" + country), bare))
    )
    return F.when(number.rlike(EMAIL_SAFE_PHONE), number)


def order_number(text: Column) -> Column:
    """First ORD-<digits> in the text; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"ORD-[0-9]+", 0), F.lit(""))


def retry_delay(hint: Column, default: float) -> Column:
    """Seconds of a hint such as "27s", plus one; the default if it isn't one."""
    return F.coalesce(F.try_add(F.regexp_extract(hint, r"^([0-9]+(\.[0-9]+)?)s$", 1).try_cast("double"), F.lit(1.0)), F.lit(default))


def error_class(message: Column) -> Column:
    """stop for an exhausted daily quota, slow_down for a rate limit, retry else."""
    return F.when(message.contains("PerDay"), F.lit("stop")).when(message.contains("429"), F.lit("slow_down")).otherwise(F.lit("retry"))


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


#: What a reader is told of each kind of refusal; no refusal is an answer.
OUTCOME_LABELS = {"content": "Declined: the passages do not hold the answer", "threshold": "Declined: no passage is close enough"}


def outcome_label(refusal_type: Column) -> Column:
    """A label for display."""
    out = F.lit("Answered")
    for kind, label in OUTCOME_LABELS.items():
        out = F.when(refusal_type == kind, F.lit(label)).otherwise(out)
    return out
