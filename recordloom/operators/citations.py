"""Citations: found in page text, resolved against the registry, projected to edges."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.scalars import NAMES_A_DOCUMENT, PRINTED_PREFIXES

_PREFIX = "|".join(sorted(PRINTED_PREFIXES, key=len, reverse=True))
_NUMBER = re.compile(
    rf"\b(?:(?:Docket\s+)?(?:No\.\s*)?(?P<p>{_PREFIX})[\s-]+(?:No\.\s*)?|(?P<l>Finance\s+Docket|Ex\s+Parte)\s+Nos?\.\s*)(?P<n>\d{{1,6}})(?P<x>[A-Z])?(?![\d,]*\d)"
)
_SUB = re.compile(r"[ \t]*\(?[ \t]*(?:Sub-?[ \t]*Nos?\.?|Sub)[ \t]*(\d{0,4})([A-Z]{0,2})\b\)?|[ \t]*\([ \t]*(\d{1,4})([A-Z]?)[ \t]*\)|[ \t]*\([ \t]*([A-Z]{1,2})[ \t]*\)", re.I)
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")


def key_of(prefix: str, number: str, glued: str | None, sub: str | None, suffix: str | None) -> str:
    """``FD 36873``, ``EP 542 (32)``, ``AB 55 (5X)``; a sub-number of zero drops."""
    sub = (sub or "").lstrip("0")
    inner = sub + (suffix or "").upper() if sub or suffix else ""
    base = f"{prefix} {int(number)}{glued or ''}"
    return f"{base} ({inner})" if inner else base


def find_keys(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, raw, key)`` of docket numbers in a page; prefixes are case-sensitive, years are
    no sub-numbers, a sub-number stands right after its number."""
    plain = text.translate(_DASHES)
    found = []
    for m in _NUMBER.finditer(plain):
        prefix = m["p"] or ("FD" if m["l"].split()[0] == "Finance" else "EP")
        end, sub, suffix = m.end(), None, None
        s = _SUB.match(plain, end)
        if s and s.group().strip():
            number = s.group(1) or s.group(3)
            letters = s.group(2) or s.group(4) or s.group(5)
            if (number or letters) and not re.fullmatch(r"(?:19|20)\d\d", number or ""):
                end, sub, suffix = s.end(), number, letters
        found.append((m.start(), end, text[m.start() : end], key_of(prefix, m["n"], m["x"], sub, suffix)))
    return found


def normal_key(raw: str | None) -> str | None:
    """The key of one printed number, or null."""
    found = find_keys(unicodedata.normalize("NFKC", raw or ""))
    return found[0][3] if found else None


_FINDING = "document {0}, page long, key string, kind string, occurrences long, first_start long, quoted string"


def find_citations(pages: DataFrame) -> DataFrame:
    """One finding for each (document, page, key) of ``(document, page, text, own)``.

    ``own`` is the array of the document's own keys.  A finding is a citation if its key isn't
    one of them or a line it stands on names a document; else it is a caption.
    """
    names = re.compile(NAMES_A_DOCUMENT)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                text, own = r.text or "", set(r.own if r.own is not None else ())
                by_key: dict[str, list[tuple[int, int]]] = {}
                for start, end, _, key in find_keys(text):
                    by_key.setdefault(key, []).append((start, end))
                for key, at in by_key.items():
                    lines = [text[text.rfind("\n", 0, s) + 1 : (text.find("\n", e) + len(text) + 1) % (len(text) + 1)] for s, e in at]
                    kind = "citation" if key not in own or any(names.search(x) for x in lines) else "caption"
                    rows.append((r.document, r.page, key, kind, len(at), at[0][0], lines[0].strip()))
            yield pd.DataFrame(rows, columns=["document", "page", "key", "kind", "occurrences", "first_start", "quoted"])

    return pages.select("document", "page", "text", "own").mapInPandas(run, _FINDING.format(pages.schema["document"].dataType.simpleString()))


def resolve(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Keys against the registry ``(key, docket_id)``: held, or the five-digit repair, or unresolved.

    ``exposed`` marks a held bare key of four digits or fewer whose number less its last digit is
    held too.
    """
    bare = F.col("key").rlike(r"^[A-Z]+ \d+$")
    digits = F.length(F.regexp_extract("key", r"(\d+)$", 1))
    stripped = F.when(bare & (digits > 1), F.expr("substring(key, 1, length(key) - 1)"))
    own = registry.select("key", "docket_id")
    short = registry.select(F.col("key").alias("_short"), F.col("docket_id").alias("_short_id"))
    joined = keys.withColumn("_s", stripped).join(own, "key", "left").join(short, F.col("_s") == F.col("_short"), "left")
    held, repair = F.col("docket_id").isNotNull(), F.col("_short_id").isNotNull()
    rule = F.when(held, "held").when(bare & (digits == 5) & repair, "repaired").otherwise("unresolved")
    return joined.select(
        *keys.columns,
        F.when(held, F.col("docket_id")).when(rule == "repaired", F.col("_short_id")).alias("docket_id"),
        rule.alias("rule"),
        (held & bare & (digits <= 4) & repair).alias("exposed"),
    )


def duplicate_keys(registry: DataFrame) -> DataFrame:
    return registry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def works(decisions: DataFrame) -> DataFrame:
    """``(docket_id, served, decision_id)`` where a docket served exactly one decision that day."""
    return decisions.groupBy("docket_id", "served").agg(F.countDistinct("decision_id").alias("n"), F.min("decision_id").alias("decision_id")).where("n = 1").drop("n")


def project(
    citations: DataFrame, resolutions: DataFrame, judgements: DataFrame, ranks: DataFrame, least: float
) -> DataFrame:
    """Edges ``(document, docket_id)`` that may be shown.

    Of live resolutions of a key (measured, confident enough, not vetoed) the best-ranked method
    counts; candidates are filtered before they are ranked.  A key is then kept only if its
    span test passed, and dropped if it is exposed without a human confirmation or a human
    refused it; these suppressors count whatever their confidence.
    """
    key = ["document", "page", "key"]
    live = resolutions.where("superseded_by is null")
    vetoed = judgements.where("superseded_by is null and judgement = 'veto' and value").select(*key, F.col("method").alias("method"))
    candidates = live.where((F.col("confidence") >= least) & F.col("docket_id").isNotNull()).join(vetoed, [*key, "method"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("precedence", "method"))
    best = candidates.join(F.broadcast(ranks), "method").withColumn("_n", nth).where("_n = 1")  # ranks: a row for each method
    asked = judgements.where("superseded_by is null").groupBy(*key).agg(
        F.coalesce(F.bool_or((F.col("judgement") == "span") & F.col("value")), F.lit(False)).alias("span"),
        F.coalesce(F.bool_or((F.col("judgement") == "exposed") & F.col("value")), F.lit(False)).alias("exposed"),
        F.coalesce(F.bool_or((F.col("judgement") == "confirmed") & F.col("value")), F.lit(False)).alias("confirmed"),
        F.coalesce(F.bool_or((F.col("judgement") == "refused") & F.col("value")), F.lit(False)).alias("refused"),
    )
    shown = F.col("span") & (~F.col("exposed") | F.col("confirmed")) & ~F.col("refused")
    return citations.join(best, key).join(asked, key).where(shown).select("document", "docket_id").distinct()


def review_queue(resolved: DataFrame, ranges: DataFrame, answered: DataFrame) -> DataFrame:
    """Unresolved keys inside the range that is held for their prefix and not answered yet."""
    prefix, number = F.substring_index("key", " ", 1), F.regexp_extract("key", r"^[A-Z]+ (\d+)", 1).try_cast("long")
    open_ = resolved.where("rule = 'unresolved'").withColumns({"prefix": prefix, "number": number})
    inside = open_.join(F.broadcast(ranges), "prefix").where("number between lo and hi")  # a row for each prefix
    return inside.join(answered, ["document", "page", "key"], "left_anti").select("document", "page", "key")


def names_a_document(text: Column) -> Column:
    return F.coalesce(text.rlike(NAMES_A_DOCUMENT), F.lit(False))
