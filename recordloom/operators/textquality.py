"""Features and scores of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ranges import running_sum


def features(pages: DataFrame, column: str) -> DataFrame:
    """Lines, tokens, tokens a line, the median line, and shares of numeric and lettered tokens."""
    lines = F.filter(F.split(F.col(column), "\n"), lambda x: F.trim(x) != "")
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    base = pages.withColumns({"_l": F.coalesce(lines, F.array().cast("array<string>")), "_w": F.coalesce(words, F.array().cast("array<string>"))})
    lengths = F.array_sort(F.transform("_l", lambda x: F.length(x)))
    n = F.size("_l")
    median = F.when(n > 0, (F.get(lengths, ((n - 1) / 2).cast("int")) + F.get(lengths, (n / 2).cast("int"))) / 2.0).otherwise(0.0)
    count = F.size("_w")
    numeric = F.size(F.filter("_w", lambda w: w.rlike("[0-9]")))
    lettered = F.size(F.filter("_w", lambda w: w.rlike("[A-Za-z]")))
    return base.select(
        *pages.columns,
        n.cast("long").alias("lines"),
        count.cast("long").alias("tokens"),
        F.round(count / F.greatest(n, F.lit(1)), 6).alias("tokens_per_line"),
        median.alias("median_line"),
        F.round(numeric / F.greatest(count, F.lit(1)), 6).alias("numeric_share"),
        F.round(lettered / F.greatest(count, F.lit(1)), 6).alias("lettered_share"),
    )


def is_prose() -> Column:
    """The prose screen over :func:`features`."""
    return (F.col("tokens_per_line") >= 3) & (F.col("median_line") >= 12) & (F.col("numeric_share") < 0.25)


def lexicon(docs: DataFrame, key: str, column: str, least: int) -> DataFrame:
    """Words that at least ``least`` documents hold; ``docs`` has a row for each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn, precision and recall; rows without a truth are left out."""
    judged = df.where(truth.isNotNull())
    counts = judged.agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")
    )
    return counts.select(
        "*",
        F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"),
        F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"),
    )


def floor_quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """Quantiles that are values: the one at ``min(n - 1, floor(n * share))`` in ascending order.

    Values are counted first, so ranks are running sums over distinct values.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_hi": upto, "_n": F.sum("_c").over(w)})

    def at(q: float) -> Column:
        k = F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))
        return F.min(F.when(F.col("_hi") > k, F.col(value)))

    return placed.groupBy(by).agg(*[at(q).alias(f"q{round(q * 100):02d}") for q in shares])


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs that the score orders rightly, ties half.

    From counts by score: pairs are never made.
    """
    by = df.groupBy(score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    upto = running_sum(by, [F.col(score)], F.col("_q"), "_below")
    wins = upto.select("_p", "_q", (F.col("_p") * (F.col("_below") - F.col("_q") / 2.0)).alias("_w"))
    return wins.agg(F.round(F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0)), 6).alias("auc"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's interval."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def common_items(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    kinds = F.array_distinct(F.array_intersect(a, b))
    return F.aggregate(
        F.transform(kinds, lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))), F.lit(0), lambda s, n: s + n
    )


#: Short items that are looked for in every document, at most.
SHORT_ITEMS = 1000


def quoted(docs: DataFrame, doc_key: str, doc_text: Column, items: DataFrame, item_key: str, item_text: Column, block: int = 20) -> DataFrame:
    """Items found word for word in documents, both flattened.

    A document is cut into blocks of ``block`` characters.  Wherever an item of twice that length
    stands, it covers a whole block, which then is one of its own pieces at the first ``block``
    offsets: hashes are joined with ids alone, the texts of what that gives are fetched and the
    whole item is checked.  A few shorter items are looked for in every document; more of them
    are met by the hash of their first characters, as many as the shortest has.
    """
    quotes = items.select(F.col(item_key), item_text.alias("_q")).where(F.length("_q") > 0)
    long, short = quotes.where(F.length("_q") >= 2 * block), quotes.where(F.length("_q") < 2 * block)
    flat = docs.select(F.col(doc_key), doc_text.alias("_d"))

    def checked(keys: DataFrame, pieces: DataFrame) -> DataFrame:
        pairs = keys.join(pieces, "_k").select(doc_key, item_key).distinct()
        met = pairs.join(flat, doc_key).join(quotes, item_key)
        return met.where(F.col("_d").contains(F.col("_q"))).select(doc_key, item_key).distinct()

    blocks = flat.where(F.length("_d") >= block).select(doc_key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_d", F.lit(f"(?s).{{{block}}}"), F.lit(0)), lambda x: F.xxhash64(x)))).alias("_k"))
    pieces = long.select(item_key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(block)), lambda i: F.xxhash64(F.substring("_q", i, F.lit(block))))).alias("_k")).distinct()
    found = checked(blocks, pieces)
    n, least = short.agg(F.count(F.lit(1)), F.min(F.length("_q"))).first()
    if not n:
        return found
    if n <= SHORT_ITEMS:
        rest = flat.join(F.broadcast(short), F.col("_d").contains(F.col("_q"))).select(doc_key, item_key)
    else:
        chars = flat.where(F.length("_d") >= least).select(doc_key, F.split("_d", "").alias("_c"))
        starts = F.sequence(F.lit(0), F.size("_c") - least)
        grams = chars.select(doc_key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.concat(*[F.get("_c", i + k) for k in range(least)]))))).alias("_k"))
        rest = checked(grams, short.select(item_key, F.xxhash64(F.substring("_q", F.lit(1), F.lit(least))).alias("_k")))
    return found.union(rest).distinct()
