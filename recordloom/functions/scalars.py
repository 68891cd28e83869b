"""Scalar rules of the record model, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACEHOLDERS = ["", "--", "---"]
OWN_PROCEEDING_PREFIXES = ["AB"]
DOCKET = r"^([A-Za-z][A-Za-z0-9]*)_(\d+)(?:_(\d+))?(?:_([A-Za-z0-9]+))?$"
PRINTED_PREFIXES = "FD AB EP NOR MCF MCC NOM ISM IS SDM WB SO DOP STA WCC SUB FSB PCA".split()
NAMES_A_DOCUMENT = r"(?i)Decision No\.|slip op|served\s+\w+\.?\s+\d|\bDecision\s+\d{4,6}\b"
NAME_WORDS = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "railroad": "rr", "railway": "ry", "and": "&"}
BOTS = "bot crawl spider slurp curl wget python-requests headless".split()
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BRACKETED_PHONE = r"(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}"
CUED_PHONE = r"(?i)\b((?:tel|telephone|phone|fax|call|cell|mobile)\b[.:]?\s{0,3})\d{3}[ .-]\d{3}[ .-]\d{4}"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def or_null(cell: Column) -> Column:
    """A printed cell; a placeholder is absent."""
    return F.when(~F.trim(cell).isin(PLACEHOLDERS), F.trim(cell))


def printed_date(cell: Column) -> Column:
    """``M/D/YYYY`` as an ISO string by shape alone; the date may be impossible."""
    parts = [F.regexp_extract(cell, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", k) for k in (1, 2, 3)]
    return F.when(parts[2] != "", F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0")))


def written_date(text: Column) -> Column:
    """A date written as ISO, ``M/D/YYYY`` or with a month's name (``Sept.`` too); null if it isn't one."""
    named = [F.regexp_extract(text, r"(?i)^\s*([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})\s*$", k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(named[0]))
    spelled = F.when((named[2] != "") & (month > 0), F.concat_ws("-", named[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(named[1], 2, "0")))
    return F.coalesce(F.try_to_date(F.trim(text), "yyyy-MM-dd"), F.try_to_date(printed_date(text), "yyyy-MM-dd"), F.try_to_date(spelled, "yyyy-MM-dd"))


def docket(raw: Column) -> Column:
    """Prefix, sequence, sub-number (0 is none) and suffix of a docket id; null if it isn't one."""
    part = [F.nullif(F.regexp_extract(raw, DOCKET, k), F.lit("")) for k in range(1, 5)]
    return F.when(
        raw.rlike(DOCKET),
        F.struct(
            F.upper(part[0]).alias("prefix"),
            part[1].try_cast("long").alias("sequence"),
            F.nullif(part[2].try_cast("long"), F.lit(0)).alias("sub_sequence"),
            F.upper(part[3]).alias("suffix"),
        ),
    )


def canonical_docket(raw: Column) -> Column:
    d = docket(raw)
    return F.concat_ws("_", d["prefix"], d["sequence"].cast("string"), d["sub_sequence"].cast("string"), d["suffix"])


def printed_docket(prefix: Column, sequence: Column, sub: Column, suffix: Column) -> Column:
    """As cited: ``FD 36873``, ``FD 36873 (Sub-No. 1X)``."""
    inner = F.concat(F.coalesce(sub.cast("string"), F.lit("")), F.coalesce(suffix, F.lit("")))
    return F.when(inner == "", F.concat_ws(" ", prefix, sequence.cast("string"))).otherwise(
        F.concat(prefix, F.lit(" "), sequence.cast("string"), F.lit(" (Sub-No. "), inner, F.lit(")"))
    )


def family(parent: Column, own: Column) -> Column:
    return F.coalesce(parent, own)


def band(sequence: Column, width: int = 1000) -> Column:
    return (F.floor(sequence / width) * width).cast("long")


def letter(name: Column) -> Column:
    """A to Z, or 0 for names that begin with anything else."""
    first = F.upper(F.substring(name, 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("0")


def size_grain(size: Column, grain: int = 65536) -> Column:
    return (F.ceil(size / grain) * grain).cast("long")


def latency_bucket(ms: Column) -> Column:
    return F.when(ms < 100, "lt100").when(ms < 500, "lt500").when(ms < 2000, "lt2000").otherwise("ge2000")


def is_bot(agent: Column) -> Column:
    return F.coalesce(F.lower(agent).rlike("|".join(BOTS)), F.lit(False))


def ordered_rules(value: Column, rules: list[tuple[str, str]], otherwise: Column | str | None = None) -> Column:
    """The label of the first regular expression that is found."""
    out = F.lit(otherwise) if isinstance(otherwise, str) or otherwise is None else otherwise
    return reduce(lambda rest, rule: F.when(value.rlike(rule[0]), rule[1]).otherwise(rest), reversed(rules), out)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def no_control(text: Column) -> Column:
    """Without C0 controls other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def masked(text: Column) -> Column:
    """Page text as shown: addresses and telephone numbers hidden, a bare number only after a cue."""
    out = F.regexp_replace(text, EMAIL, "[email]")
    return F.regexp_replace(F.regexp_replace(out, BRACKETED_PHONE, "[phone]"), CUED_PHONE, "$1[phone]")


def normal_name(name: Column) -> Column:
    """A party's name for comparison: lower case, no punctuation but ``&``, long forms short."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"(?U)[^\w\s&]|\s+", " ")), " +")
    table = F.create_map(*[F.lit(x) for pair in NAME_WORDS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def doing_business_as(name: Column) -> Column:
    """Legal name and trade name of ``X d/b/a Y``; the trade name is null without one."""
    pattern = r"(?i)^(.*?),?\s+(?:d/b/a|dba|d\.b\.a\.)\s+(.*)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("legal"), F.regexp_extract(name, pattern, 2).alias("trade"))).otherwise(
        F.struct(name.alias("legal"), F.lit(None).cast("string").alias("trade"))
    )


def unrepeated(cell: Column) -> Column:
    """``X, X, X`` as ``X``."""
    return F.regexp_replace(cell, r"^(.+?)(?:, \1)+$", "$1")


def escaped_like(text: Column) -> Column:
    """User text for a LIKE pattern with a backslash as its escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def page_state(route: Column, text: Column) -> Column:
    """What a page shows: text, or why there is none."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) != "", "text").when(route == "tabular", "table").when(route == "blank", "blank").otherwise("unread")


def monday(date: Column) -> Column:
    return F.trunc(date, "week").cast("date")


def distance_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty readings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def character_error(truth: Column, output: Column) -> Column:
    """Character error rate, one at most; an empty truth has none."""
    return F.when(F.length(truth) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.levenshtein(truth, output) / F.length(truth)))


def flattened(text: Column) -> Column:
    """For comparing quotations: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))
