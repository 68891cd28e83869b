"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed character n-gram of a word with its edges marked; its value in a
document is the number of the document's distinct words that hold it.  Values are scaled by
the log ratio of the n-gram's document rates under both labels, and a logistic regression
is fitted on the scaled values.  Being linear, a document's logit is the sum of its distinct
words' logits, so scoring looks each word up once and never builds a feature vector.

Fitting uses a bounded sample of the labelled rows, ``SAMPLE`` of each label and
``SAMPLE_BYTES`` of text in all, taken in the order of a hash of the id; an id that several
documents have gives one of them.  Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recordloom.llm.common import in_small_batches, names, parts, remainder, tidy

#: Labelled rows of each label that fitting uses at most.
SAMPLE = 2000
#: Bytes of text that fitting uses at most, half of them of each label; texts are whole, and one over a sixteenth of it teaches nothing.
SAMPLE_BYTES = 64_000_000
#: Features, a power of two.
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
THRESHOLD = 0.7
#: Words whose logits a worker remembers before it forgets those that it hasn't met since it last forgot some.
REMEMBERED = 150_000
#: Odd constants that an n-gram's code points are hashed with.
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SUPPORT, _LEAST_RATIO, _STEPS, _DECAY, _ROWS_AT_ONCE = 4, 0.4, 150, 2e-4, 400


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # of each bucket, the ratio times what was fitted


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and buckets of their n-grams, each bucket once for a word, in order."""
    edged = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, edged), np.int64, len(edged))
    number, end = np.repeat(np.arange(len(edged)), size), np.repeat(np.cumsum(size), size)
    found = []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _FACTOR + code[k : len(code) - n + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        inside = np.arange(len(h)) + n <= end[: len(h)]
        found.append(number[: len(h)][inside] * BUCKETS + (h[inside] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    return every // BUCKETS, every % BUCKETS


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def fit(rows: list[tuple[str | None, int]], rates: tuple[float, float] | None = None) -> Model:
    """Model from ``(text, label)``; ``rates`` are the labels' shares where they differ from the sample's."""
    labels = np.array([int(y) for _, y in rows], np.float64)
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    if not ones or not zeros:  # one label only: its share, smoothed, whatever the text
        share = (ones + 1) / (len(labels) + 2)
        return Model(math.log(share / (1 - share)), np.zeros(BUCKETS, np.float32))
    bags, seen, with_one = [], np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for (text, _), label in zip(rows, labels):
        at, n = np.unique(features(list(words_of(text)))[1].astype(np.int32), return_counts=True)
        bags.append((at, n.astype(np.float32)))
        seen[at] += 1
        with_one[at] += int(label)
    ratio = np.log((with_one + 1) / (ones + 2)) - np.log((seen - with_one + 1) / (zeros + 2))
    ratio[(seen < _SUPPORT) | (np.abs(ratio) < _LEAST_RATIO)] = 0
    bags = [(at[keep], n[keep]) for at, n in bags for keep in (ratio[at] != 0,)]
    there = np.zeros(BUCKETS, bool)
    for at, _ in bags:
        there[at] = True
    names = np.flatnonzero(there)
    place = np.zeros(BUCKETS, np.int32)
    place[names] = np.arange(len(names))
    blocks = []  # of some rows: the first, and of each of their features the row, the place and the scaled value
    for lo in range(0, len(bags), _ROWS_AT_ONCE):
        some = bags[lo : lo + _ROWS_AT_ONCE]
        at, n = np.concatenate([a for a, _ in some]), np.concatenate([v for _, v in some])
        blocks.append((lo, len(some), np.repeat(np.arange(len(some), dtype=np.int32), [len(a) for a, _ in some]), place[at], n * ratio[at].astype(np.float32)))
    del bags
    share = (ones / len(labels), zeros / len(labels)) if rates is None else rates
    weight = np.where(labels == 1, share[0] / ones, share[1] / zeros)
    w, bias = np.full(len(names), 0.02), math.log(share[0] / share[1])
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, _STEPS + 1):
        slope = np.append(_DECAY * w, 0.0)
        for lo, many, row, index, scaled in blocks:
            logit = bias + np.bincount(row, scaled * w[index], many)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[lo : lo + many]) * weight[lo : lo + many]
            slope[:-1] += np.bincount(index, scaled * error[row], len(names))
            slope[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = w * ratio[names]
    return Model(float(bias), weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list, tuple[float, float] | None]:
    """At most ``sample`` texts of each label, ``SAMPLE_BYTES`` in all, and both labels' shares among all allowed ones."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & allowed).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")
    )
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    order = F.xxhash64("_id")
    chosen = [marks.where(F.col("_y") == y).distinct().orderBy(order, "_id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows of two numbers at most
    rows = docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_t")).join(picked, F.col("_k") == F.col("_id"))
    # An id that several rows have teaches with one of its texts.
    size = F.coalesce(F.octet_length("_t"), F.lit(0))
    one = rows.groupBy("_k", "_y").agg(F.min("_t").alias("_t")).where(size <= SAMPLE_BYTES // 16)
    upto = F.sum(size).over(Window.partitionBy("_y").orderBy(F.xxhash64("_k"), "_k"))  # ``sample`` rows at most
    got = one.withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_BYTES // 2).select("_k", "_t", "_y").orderBy("_k", "_y").collect()
    return [(r["_t"], r["_y"]) for r in got], (counts.get(1, 0) / total, counts.get(0, 0) / total) if total else None


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> Model:
    """Fit on labelled rows whose label is 0 or 1 and for which ``allowed`` (of the labels' columns) holds.

    Rows with a null id or label, and labels of no document, teach nothing.  Without any
    usable row every text scores one half.
    """
    rows, rates = labelled_sample(docs, labels, F.lit(True) if allowed is None else allowed, id_col, text_col, label_col, sample)
    return fit(rows, rates) if rows else Model(0.0, np.zeros(BUCKETS, np.float32))


class Scorer:
    """Scores of texts; remembers the logits of words."""

    def __init__(self, model: Model) -> None:
        self.bias, self.weights, self.known, self.older = model.bias, model.weights.astype(np.float64), {}, {}

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            number, bucket = features(some)
            self.known.update(zip(some, np.bincount(number, self.weights[bucket], len(some)).tolist()))

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        known, lines, missing = self.known, list(map(words_of, texts)), []
        for w in set().union(*lines).difference(known):
            if (value := self.older.get(w)) is None:
                missing.append(w)
            else:
                known[w] = value
        self._learn(missing)
        # fsum: the same sum in whatever order a set yields its words
        logits = [self.bias + math.fsum(map(known.__getitem__, line)) for line in lines]
        return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in logits]


def scores(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", least: float | None = None, score_col: str = "_score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score_col``; of rows that score below ``least`` only, if given."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, text_col]))
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            score = score or Scorer(told.value)
            for part in parts(batch, at):
                found = pa.array(score(part.column(at).to_pylist()), pa.float64())
                out = pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], [*keep, score_col])
                yield out if least is None else out.filter(pc.less(found, least))

    schema = StructType([*(docs.schema[k] for k in keep), StructField(score_col, DoubleType())])
    return in_small_batches(docs).select(*columns).mapInArrow(tidy(run), schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels are learned from rows whose crc32 of the id modulo ``folds`` is not ``held``.  A null
    or empty text gets the score of a text without words.  Repeated rows score alike; a null
    id counts as an empty text in the fold.  Empty tables give no rows, and without labels
    all scores are one half.  Other columns are not read.
    """
    model = train(docs, labels, remainder(F.col(id_col), folds) != held, id_col, text_col, label_col, sample)
    return scores(docs, model, [id_col], text_col).select(
        F.col(id_col).alias("doc_id"),
        (remainder(F.col(id_col), folds) == held).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more, whatever other columns they have."""
    model = train(docs, labels, remainder(F.col("doc_id"), folds) != held, text_col=text_col)
    return scores(docs, model, docs.columns, text_col, threshold, *names(docs, "score")).select(*docs.columns)
