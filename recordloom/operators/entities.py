"""Parties: cells cut into names, names resolved to components, display names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.scalars import normal_name
from recordloom.operators.components import connected_components

# Words that belong to the name before them.
SUFFIXES = {"inc", "llc", "l.l.c", "ltd", "co", "corp", "lp", "l.p", "llp", "jr", "sr", "ii", "iii", "n.a", "et al"}
_SPAN = "array<struct<start:int,end:int,text:string,role:string,confidence:double>>"


def cut_cell(cell: str | None, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, float]]:
    """Names in a printed cell with their offsets, role and confidence.

    A cell that is a known name stays whole.  Items are parted at semicolons or commas (not
    before a suffix such as ``Inc.``), then at ``and`` unless the item is a known name.  An item whose
    ``and`` may belong to a name (one side has no space and no suffix) is kept whole, in doubt.
    What follows ``on behalf of`` is a principal.
    """
    if cell is None or not cell.strip():
        return []
    whole = cell.strip()
    at = cell.index(whole)
    if whole.lower() in known:
        return [(at, at + len(whole), whole, "party", 1.0)]
    out: list[tuple[int, int, str, str, float]] = []
    role_from = re.search(r"\bon behalf of\b", cell, re.I)

    def role(start: int) -> str:
        return "principal" if role_from and start >= role_from.end() else "representative" if role_from else "party"

    def add(lo: int, hi: int, confidence: float) -> None:
        text = cell[lo:hi]
        lead = len(text) - len(text.lstrip(" ,;"))
        text = text.strip(" ,;")
        if text:
            out.append((lo + lead, lo + lead + len(text), text, role(lo + lead), confidence))

    def items(lo: int, hi: int) -> None:
        start = lo
        for m in re.finditer(r";|,", cell[lo:hi]):
            after = re.match(r"\s*([\w.]+(?: al)?)", cell[lo + m.end() : hi])
            if m.group() == "," and after and after.group(1).lower().rstrip(".") in SUFFIXES:
                continue
            pairs(start, lo + m.start())
            start = lo + m.end()
        pairs(start, hi)

    def pairs(lo: int, hi: int) -> None:
        text = cell[lo:hi]
        text = re.sub(r"^\s*and\s+", lambda m: " " * len(m.group()), text)
        m = re.search(r"\s+and\s+", text)
        if not m or text.strip(" ,;").lower() in known:
            add(lo + len(text) - len(text.lstrip()), hi, 1.0)
            return
        left, right = text[: m.start()].strip(), text[m.end() :].strip()
        sure = all(" " in s or s.lower() in known for s in (left, right))
        if sure:
            add(lo, lo + m.start(), 1.0)
            pairs(lo + m.end(), hi)
        else:
            add(lo, hi, 0.6)

    if role_from:
        items(0, role_from.start())
        items(role_from.end(), len(cell))
    else:
        items(0, len(cell))
    return out


def cut_cells(cells: DataFrame, column: str, known: list[str] = ()) -> DataFrame:
    """``cells`` with ``spans``: the names in the column (see :func:`cut_cell`)."""
    names = frozenset(k.lower() for k in known)

    @F.pandas_udf(_SPAN)
    def cut(values: pd.Series) -> pd.Series:
        keys = ("start", "end", "text", "role", "confidence")
        return values.map(lambda v: [dict(zip(keys, s)) for s in cut_cell(v, names)])

    return cells.withColumn("spans", cut(F.col(column)))


def represented(parties: DataFrame, edges: DataFrame, key: str = "party_id") -> DataFrame:
    """Each party with the least id of its component over live same-as edges ``(a, b)``."""
    roots = connected_components(edges)
    joined = parties.join(roots, F.col(key) == F.col("node"), "left")
    return joined.withColumn("rep", F.coalesce("root", key)).drop("node", "root")


def display_names(names: DataFrame, reps: DataFrame) -> DataFrame:
    """One name for each component: display before legal before as filed, the newest of its kind,
    else the earliest of any kind."""
    rank = F.when(F.col("kind") == "display", 0).when(F.col("kind") == "legal", 1).when(F.col("kind") == "as_filed", 2).otherwise(3)
    age = F.when(rank == 3, F.col("name_id")).otherwise(-F.col("name_id"))
    return names.join(reps.select("party_id", "rep"), "party_id").groupBy("rep").agg(F.min_by("name", F.struct(rank, age)).alias("display_name"))


def resolve(spans: DataFrame, names: DataFrame, reps: DataFrame) -> DataFrame:
    """Each span's outcome by its normalised name: linked to the one component that bears it,
    ambiguous if several do; minted (one party for each new name) if it is certain, else left."""
    known = (
        names.join(reps.select("party_id", "rep"), "party_id")
        .groupBy(normal_name(F.col("name")).alias("norm"))
        .agg(F.countDistinct("rep").alias("bearers"), F.min("rep").alias("rep"))
    )
    spans = spans.withColumn("norm", normal_name(F.col("text")))
    sure = spans.groupBy("norm").agg(F.max(F.col("confidence") >= 1.0).alias("certain"))
    outcome: Column = (
        F.when(F.col("bearers") == 1, "linked").when(F.col("bearers") > 1, "ambiguous").when(F.col("certain"), "minted").otherwise("left")
    )
    joined = spans.join(known, "norm", "left").join(sure, "norm")
    return joined.select(*[c for c in spans.columns], outcome.alias("outcome"), F.when(outcome == "linked", F.col("rep")).alias("rep"))
