"""Line deduplication: a suffix array over line identities, by distributed prefix doubling.

A document is the sequence of its lines that hold a word.  A line that stands once in the
corpus ends whatever is repeated, so the suffixes that begin at the other lines are sorted.
The rank of a line is its place among the distinct lines; the rank of a suffix to a depth of
2, 4, 8, ... lines is the place of the pair of its first half's rank and its second half's
among the distinct pairs (prefix doubling; the end of a sequence comes first).  Each step
sorts distinct pairs only, over ranges, so a line that stands in a third of all documents is
one row of it.  Lines are ordered by their 64-bit hash.

Two suffixes share their first ``n`` lines if and only if, at the largest depth 2^k within n,
they have the same rank at their first line and at the n - 2^k-th after it.  So the suffixes
whose ranks agree on a run are an interval of the suffix array, whose longest common prefix
is that run or more.  Asked are the least runs of ``min_words`` words from each line on and
back to each line; that needs ranks to a depth of ``min_words`` lines only, however long the
documents are.  An interval's first place (by document id, then line) stays; the others
join to maximal repeated runs, which are deleted.  A maximal run is the union of the least
runs from its own starts and ends, so it is deleted whole, however long it is.

All of it is DataFrame functions.  Only hashes, ranks and places are shuffled until the rows
that lose lines are rewritten, and groups are aggregated before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import names, once, spaced_words
from recordloom.storage import drop, save

MIN_WORDS = 20


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, th, j, idx, h, w)``: of each line with a word its number among those and among all lines, its
    hash, and how many words it has (no more than matter); ``th`` is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = F.filter(
        F.transform(
            F.split(text, "\n"),
            lambda x, i: F.struct(i.alias("idx"), F.xxhash64(x).alias("h"), F.least(F.lit(min_words), F.size(spaced_words(x))).alias("w")),
        ),
        lambda s: s["w"] > 0,
    )
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), once(told).alias("s"))
    return df.select("id", "th", F.posexplode("s").alias("j", "s")).select("id", "th", "j", "s.idx", "s.h", "s.w")


def _ranks(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of ``keys`` with ``rank``, a number that is greater for later rows."""
    # The sort deals rows by ranges; rows are numbered range by range, and the written numbers stay.
    return save(keys.orderBy(*keys.columns).select("*", F.monotonically_increasing_id().alias("rank")), name)


def suffix_ranks(every: DataFrame, depth: int) -> list[DataFrame]:
    """Tables ``(id, th, j, end, rank)`` of the suffixes that begin at repeated lines, one for each depth of 1,
    2, 4, ... lines up to ``depth`` or more; a suffix ends with the last line, ``end``, before one that is not
    repeated.  The first table has ``idx`` and ``w`` too."""
    repeated = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("key"))
    known = _ranks(repeated, "lineranks")
    found = every.join(known, F.col("h") == F.col("key")).select("id", "th", "j", "idx", "w", "rank")
    stretch = F.col("j") - F.dense_rank().over(Window.partitionBy("id", "th").orderBy("j"))
    found = found.withColumn("stretch", stretch).withColumn("end", F.max("j").over(Window.partitionBy("id", "th", "stretch")))
    levels = [save(found.drop("stretch"), "suffixes")]
    reach = 1
    while reach < depth:
        ahead = F.first("rank").over(Window.partitionBy("id", "th").orderBy("j").rangeBetween(reach, reach))
        pairs = levels[-1].select("id", "th", "j", "end", "rank", F.when(F.col("j") + reach <= F.col("end"), ahead).otherwise(-1).alias("after"))
        pairs = save(pairs, "pairs")
        known = _ranks(pairs.select(F.col("rank").alias("a"), F.col("after").alias("b")).distinct(), "pairranks")
        found = pairs.withColumnRenamed("rank", "before").join(known, (F.col("before") == F.col("a")) & (F.col("after") == F.col("b")))
        levels.append(save(found.select("id", "th", "j", "end", "rank"), "suffixes"))
        drop(pairs)
        drop(known)
        reach *= 2
    return levels


def least_runs(levels: list[DataFrame], min_words: int) -> DataFrame:
    """``(id, th, first, last, n, a, b)``: every least run of repeated lines, its lines counted among all of the
    text's, how many they are, and the ranks at its first line and at the last of the depth below ``n``."""
    nothing = F.lit(None).cast("int")
    rows = [
        df.select("id", "th", F.struct(F.lit(k).alias("k"), "j", (F.col("idx") if not k else nothing).alias("idx"), (F.col("w") if not k else nothing).alias("w"), "rank").alias("s"))
        for k, df in enumerate(levels)
    ]
    # A row for each document; equal rows of the table are one.
    docs = reduce(DataFrame.unionByName, rows).groupBy("id", "th").agg(F.array_sort(F.collect_set("s")).alias("s"))

    def of_level(k: int) -> Column:
        return F.filter("s", lambda x: x["k"] == k)

    of = [of_level(k) for k in range(len(levels))]
    docs = docs.select("id", "th", once(of[0]).alias("z"), once(F.array(*[F.transform(o, lambda x: x["rank"]) for o in of])).alias("ranks"))
    docs = docs.select("id", "th", "ranks", F.col("z.j").alias("j"), F.col("z.idx").alias("idx"), F.col("z.w").alias("w"))

    def least(i: Column, sign: int) -> Column:
        """How many lines from ``i`` on, or back to it, have the words; null if the sequence ends before."""

        def step(s: Column, d: Column) -> Column:
            at = i + sign * d
            follows = F.get("j", at) == F.get("j", i) + sign * d
            more = F.when((s["w"] < min_words) & follows, F.get("w", at))
            return F.when(more.isNotNull(), F.struct((s["n"] + 1).alias("n"), (s["w"] + more).alias("w"))).otherwise(s)

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(min_words - 1)), start, step, lambda s: F.when(s["w"] >= min_words, s["n"]))

    def run(i: Column, n: Column) -> Column:
        def ranked(k: Column) -> Column:
            own = F.get("ranks", k)
            return F.struct(F.get("idx", i).alias("first"), F.get("idx", i + n - 1).alias("last"), n.alias("n"), F.get(own, i).alias("a"), F.get(own, (i + n - F.pow(F.lit(2), k)).cast("int")).alias("b"))

        return F.transform(F.array(F.floor(F.log2(n)).cast("int")), ranked)[0]

    def found(sign: int) -> Column:
        """A run is asked from its first line on, or back from its last one if that gives another."""

        def of_line(_: Column, i: Column) -> Column:
            return F.transform(F.array(least(i, sign)), lambda n: F.when(n.isNotNull(), run(i if sign > 0 else i - n + 1, n)))[0]

        return F.transform("j", of_line)

    both = docs.select("id", "th", F.explode(F.array_compact(F.array_distinct(F.concat(found(1), found(-1))))).alias("r"))
    return both.select("id", "th", "r.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, th, runs)``: of the documents that lose lines, the maximal repeated runs whose first copy stands
    elsewhere, as first and last lines, in order."""
    every = save(lines(docs, id_col, text_col, min_words), "lines")
    levels = suffix_ranks(every, min_words)
    asked = save(least_runs(levels, min_words).withColumn("place", F.struct("id", "th", "first")), "leastruns")
    for table in (every, *levels):
        drop(table)
    intervals = asked.groupBy("n", "a", "b").agg(F.min("place").alias("head"), F.max("place").alias("tail")).where("head < tail")
    intervals = save(intervals.select(F.col("n").alias("n_"), F.col("a").alias("a_"), F.col("b").alias("b_"), "head"), "intervals")
    later = asked.join(intervals, (F.col("n") == F.col("n_")) & (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & (F.col("place") > F.col("head")))
    spans = later.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))

    def joined(acc: Column, s: Column) -> Column:
        """Spans that overlap or touch are one."""
        end = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))))
        return F.when(s["first"] <= end["last"] + 1, grown).otherwise(F.concat(acc, F.array(s)))

    return spans.select("id", "th", F.aggregate(F.slice("spans", 2, F.size("spans")), F.slice("spans", 1, 1), joined).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and ``_n_gone``, how many lines.

    A run is some consecutive lines with a word, ``min_words`` words in all or more; lines
    without a word are passed over, and deleted if they stand inside a least run of that many
    words (between two lines that are each as long they stay).  Lines are equal if they are equal as they stand.  The order of places is that of ids, of any
    type (a null id comes first), then of lines; rows that share an id but not a text are told
    apart, and ordered, by a hash of it.  Rows that share id and text are one document: they
    are all rewritten alike.  Null texts stay null, empty ones empty; an empty table gives no
    rows; other columns stay, but for one that is called ``_n_gone``.  ``count_col``, if given,
    is set to the new length where lines were deleted.
    """
    kept = [c for c in docs.columns if c.lower() != "_n_gone"]
    own_id, own_th, th, gone = names(docs, "id", "th", "h", "gone")
    numbers = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    lost = repeated_runs(docs, id_col, text_col, min_words).select(F.col("id").alias(own_id), F.col("th").alias(own_th), numbers.alias(gone))
    hashed = docs.select(*kept, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(th))
    joined = hashed.join(lost, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th)), "left")
    split = F.split(text_col, "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.transform(F.array(split), lambda all_: F.array_join(F.transform(rest, lambda k: F.get(all_, k)), "\n"))[0]
    n_gone = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    written = F.when(F.col(gone).isNotNull(), text).otherwise(F.col(text_col))
    done = joined.select(*[(written.alias(c) if c == text_col else F.col(c)) for c in kept], n_gone.alias("_n_gone"))
    if count_col:
        kind = docs.schema[count_col].dataType
        done = done.withColumn(count_col, F.when(F.col("_n_gone") > 0, F.length(text_col).cast(kind)).otherwise(F.col(count_col)))
    return done.select(*kept, "_n_gone")
