"""Sheets, registers, directories and look-ups of proceedings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.scalars import DOCKET, OWN_PROCEEDING_PREFIXES, ordered_rules, written_date

# Types of parties by their names, the first that is found; accents and their letters.
PARTY_TYPES = [
    (r"(?i)\b(?:rail(?:road|way)?s?|rr|ry)\b", "railroad"),
    (r"(?i)\b(?:department|commission|city|county|state|authority|district)\b", "government"),
    (r"(?i)\b(?:union|brotherhood|teamsters)\b", "labor"),
    (r"(?i)\b(?:association|council|coalition|institute|league)\b", "association"),
    (r"(?i)\b(?:inc|llc|corp|co|company|ltd|lp)\b\.?", "company"),
]
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def party_type(name: Column) -> Column:
    return ordered_rules(name, PARTY_TYPES, "individual")


def folded_letters(text: Column) -> Column:
    """Lower case without diacritics, for token equality."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def reading_label(channel: Column, agreement: Column) -> Column:
    """How a page's text was read, in words."""
    return (
        F.when(channel == "human", "read by a person")
        .when(channel == "text-layer", "the document's own text")
        .when(agreement.isNull(), "machine reading, not compared")
        .when(agreement <= 0.05, "machine reading, two agree")
        .otherwise("machine reading, two differ")
    )


def routed(regions: DataFrame, page: list[str]) -> DataFrame:
    """A page's route by its regions: blank, tabular with any table, graphic from half of the area in figures, else text."""
    figures = F.sum(F.when(F.col("kind") == "figure", F.col("area")).otherwise(0.0)) / F.sum("area")
    route = F.when(F.coalesce(F.sum("area"), F.lit(0.0)) == 0, "blank").when(F.count_if(F.col("kind") == "table") > 0, "tabular").when(figures >= 0.5, "graphic").otherwise("text")
    return regions.groupBy(*page).agg(route.alias("route"))


def owner_of_documents(sources: list[tuple[str, DataFrame]], document: str, record: str) -> DataFrame:
    """The record that shows a document: the first kind in order that holds it, its least record."""
    every = reduce(DataFrame.unionByName, [df.select(document, F.lit(n).alias("_rank"), F.lit(kind).alias("kind"), F.col(record).alias("record")) for n, (kind, df) in enumerate(sources)])
    return every.groupBy(document).agg(F.min(F.struct("_rank", "record", "kind")).alias("o")).select(document, "o.kind", "o.record")


def explained(dockets: DataFrame, prefix: str, sequence: str, kind: str) -> DataFrame:
    """Facts of each prefix: how many dockets, the range of numbers, counts of types as sorted text."""
    types = dockets.groupBy(prefix, kind).agg(F.count(F.lit(1)).alias("_n")).groupBy(prefix).agg(F.array_join(F.array_sort(F.collect_list(F.concat(kind, F.lit("="), "_n"))), ";").alias("types"))
    facts = dockets.groupBy(prefix).agg(F.count(F.lit(1)).alias("dockets"), F.min(sequence).alias("least"), F.max(sequence).alias("most"))
    return facts.join(types, prefix)


def directory(links: DataFrame, rep: str, record: str, family: str, most: int = 50) -> DataFrame:
    """Components by distinct records, the busiest first."""
    counts = links.groupBy(rep).agg(F.countDistinct(record).alias("records"), F.countDistinct(family).alias("families"))
    return counts.orderBy(F.desc("records"), F.asc(rep)).limit(most)


def place_of(prefix: Column, docket: Column, parent: Column) -> Column:
    """Where a party's filing counts: the family, but for prefixes whose sub-dockets stand alone."""
    return F.when(prefix.isin(OWN_PROCEEDING_PREFIXES), docket).otherwise(F.coalesce(parent, docket))


def attachments(observed: DataFrame, record: list[str], files: str) -> DataFrame:
    """Each record with the union of all files that any observation of it listed."""
    return observed.groupBy(*record).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(files)))).alias(files))


def asked_captions(params: DataFrame, names: Column, docket_field: str = "docket") -> DataFrame:
    """How often each docket's caption was asked for, from indexed form fields ``items[3][docket]``."""
    pair = params.select(F.explode(names).alias("p"))
    index = F.regexp_extract("p.name", r"^items\[(\d+)\]\[" + docket_field + r"\]$", 1)
    return pair.where(index != "").groupBy(F.col("p.value").alias("docket")).agg(F.count(F.lit(1)).alias("asked"))


def served_date(text: Column) -> Column:
    """The date of ``served <month> d, yyyy`` if a text names exactly one."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bserved\s+([A-Za-z]+\.?\s+\d{1,2},?\s+\d{4})"), F.lit(1)), lambda x: written_date(F.regexp_replace(x, r"\s+", " "))), lambda d: d.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def decided_dates(text: Column) -> Column:
    """Dates of lines that begin with ``Decided:``, also where the date stands on the next line."""
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^\s*Decided:[ \t]*(?:\r?\n[ \t]*)?([A-Za-z]+\.? \d{1,2},? \d{4})"), F.lit(1))
    return F.filter(F.transform(lines, written_date), lambda d: d.isNotNull())


def looked_up(queries: DataFrame, column: str, registry: DataFrame) -> DataFrame:
    """A typed docket number: the docket itself, else its family, if nothing else was typed."""
    typed = F.upper(F.regexp_replace(F.trim(F.regexp_replace(F.col(column), r"(?i)\b(?:docket|no\.?|sub-?no\.?)(?=\s|\d)", " ")), r"[\s_()-]+", "_"))
    typed = F.trim(typed, F.lit("_"))
    q = queries.withColumn("_exact", F.when(typed.rlike(DOCKET), typed)).withColumn("_family", F.substring_index("_exact", "_", 2))
    own, parent = registry.select(F.col("docket").alias("_d")), registry.select(F.col("docket").alias("_f"))
    joined = q.join(own, F.col("_exact") == F.col("_d"), "left").join(parent, F.col("_family") == F.col("_f"), "left")
    return joined.select(*queries.columns, F.coalesce("_d", "_f").alias("docket"))


def register(df: DataFrame, group: str, date: str, record: str) -> DataFrame:
    """Records of a register by docket, newest first, joined."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(date).cast("string").alias("d"), F.col(record).alias("r")))))
    return df.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["r"].cast("string")), ",").alias("records"), F.max(date).alias("newest"))


def is_first(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each event with whether it is its key's first."""
    first = events.groupBy(*key).agg(F.min(order).alias("_first"))
    return events.join(first, key).withColumn("first", F.col(order) == F.col("_first")).drop("_first")


def longest_unchecked(urls: DataFrame, fetches: DataFrame, url: str, at: str, limit: int) -> DataFrame:
    """URLs by how long ago they were fetched, those never fetched first."""
    last = fetches.groupBy(url).agg(F.max(at).alias("last"))
    return urls.join(last, url, "left").orderBy(F.asc_nulls_first("last"), F.asc(url)).limit(limit)
