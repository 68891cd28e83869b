"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is some megabytes of documents, cut out of a task's rows.  Its suffix array is
built by prefix doubling, to the depth of the longest window, over word numbers; suffixes
that cannot begin a benchmark window (their next words don't follow one another anywhere
in the benchmark) are left out first.  Every test suffix is then binary-searched in it, all
at once, to the depth of a window.  The rows between a suffix's lower and upper bound are the
places where its window occurs; windows of one item that continue one another in both
texts are joined to its longest verbatim match, which is reported with its places.

Shards live and die inside a task, so nothing is shuffled and a lost executor costs only
its own tasks.  The benchmark's own index, some numbers for each word, goes to all tasks; a
benchmark over ``BENCHMARK_BYTES`` is searched in several passes of that size each, whose
indexes are made one after another.  An item is in one pass only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from recordloom.llm.common import WORD_BYTES, in_small_batches, names, parts, text_bytes, tidy
from recordloom.storage import save

WINDOW = 13
#: Text of a shard, in bytes.
SHARD_BYTES = 4_000_000
#: Benchmark text that one pass holds, in bytes, about.
BENCHMARK_BYTES = 8_000_000
#: Test suffixes that are searched at once.
AT_ONCE = 100_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of ASCII letters and digits and of anything that isn't ASCII."""
    return text.translate(WORD_BYTES).split()


class TestIndex(NamedTuple):
    """Suffixes of the benchmark's texts, cut at a window's length."""

    vocabulary: dict[bytes, int]
    follows: np.ndarray  # sorted codes of two neighbouring words
    words: np.ndarray  # of all texts, each ended by zeros
    starts: np.ndarray  # where windows begin
    lengths: np.ndarray
    texts: np.ndarray  # the number of each window's text
    begins: np.ndarray  # where each text begins
    items: list[str]  # the item of each text
    window: int

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Words of some windows, one row each, padded with zeros."""
        steps = np.arange(self.window)
        return np.where(steps < self.lengths[which, None], self.words[self.starts[which, None] + steps], 0).astype(np.int64)


def test_index(items: list[tuple[object, str | None]], window: int = WINDOW) -> TestIndex:
    """Index of ``(item_id, text)``; items without an id or without words have no window."""
    vocabulary: dict[bytes, int] = {}
    parts, starts, lengths, texts, begins, names, at = [], [], [], [], [], [], 0
    for key, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())] if key is not None else []
        if not ids:
            continue
        n = max(1, len(ids) - window + 1)
        starts.append(np.arange(at, at + n, dtype=np.int64))
        lengths.append(np.full(n, min(window, len(ids)), np.int64))
        texts.append(np.full(n, len(names), np.int64))
        begins.append(at)
        names.append(str(key))
        parts.append(np.array([*ids, *[0] * window], np.int32))
        at += len(parts[-1])
    words, starts, lengths, texts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, starts, lengths, texts))
    left, right = words[:-1].astype(np.int64), words[1:].astype(np.int64)
    follows = np.unique((left * (len(vocabulary) + 1) + right)[(left > 0) & (right > 0)])
    return TestIndex(vocabulary, follows, words, starts, lengths, texts, np.array(begins, np.int64), names, window)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` (zero: a break) in the order of their next ``depth`` words."""
    rank, reach = words.astype(np.int64), 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1].reshape(-1)
        reach *= 2
    return np.argsort(rank, kind="stable")


def _bounds(words: np.ndarray, order: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test row, the range of ``order`` whose suffixes begin with its words."""
    width = tests.shape[1]
    padded = np.concatenate([words, np.zeros(width, words.dtype)])
    real, steps = tests > 0, np.arange(width)
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            here = padded[order[np.minimum(mid, len(order) - 1)][:, None] + steps]
            differ = (here != tests) & real
            first = differ.argmax(1)
            some = differ[np.arange(len(tests)), first]
            less = here[np.arange(len(tests)), first] < tests[np.arange(len(tests)), first]
            right = np.where(some, less, upper)
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        found.append(lo)
    return found[0], found[1]


class Found(NamedTuple):
    """Of one document: its words; hit words as starts and ends of stretches; items; the longest match, where
    it stands here, its item and where it stands there."""

    n_words: int
    stretches: list[int]
    items: list[str]
    longest: int
    place: int | None = None
    item: str | None = None
    item_place: int | None = None


def scan_shard(texts: list[bytes], index: TestIndex) -> list[Found]:
    """What of the benchmark occurs in each document of a shard."""
    get, base = index.vocabulary.get, len(index.vocabulary) + 1
    parts, counts = [], []
    for text in texts:
        w = words_of(text)
        counts.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
    out = [Found(n, [], [], 0) for n in counts]
    if not len(index.starts) or not parts:
        return out
    words = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    # Steps to a next word that follows somewhere in the benchmark; stretches of them hold all windows.
    code = words[:-1] * base + words[1:]
    at = np.searchsorted(index.follows, code)
    linked = np.concatenate([(at < len(index.follows)) & (index.follows[np.minimum(at, len(index.follows) - 1)] == code) if len(index.follows) else np.zeros(len(code), bool), [False]])
    edge = np.diff(np.concatenate([[0], linked.view(np.int8), [0]]))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    least = int(index.lengths.min())
    if least == 1:
        keep = words > 0
    else:
        long = end - begin + 1 >= least
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, begin[long], 1)
        np.add.at(mark, end[long] + 1, -1)
        keep = np.cumsum(mark[:-1]) > 0
    place = np.nonzero(keep)[0]
    if not len(place):
        return out
    # Kept words, with a break wherever something was left out between them.
    gaps = np.nonzero(np.diff(place) > 1)[0] + 1
    kept, place = np.insert(words[place], gaps, 0), np.insert(place, gaps, -1)
    order = suffix_array(kept, index.window)
    rows, which = _places(kept, order, index, base)
    if not len(which):
        return out
    spot = place[rows]
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, spot, 1)
    np.add.at(mark, spot + index.lengths[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]]))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    of = np.searchsorted(starts, begin, "right") - 1
    stretches: dict[int, list[int]] = {}
    for doc, b, e in zip(of.tolist(), begin.tolist(), end.tolist()):
        stretches.setdefault(doc, []).extend((b - int(starts[doc]), e - int(starts[doc])))
    doc_of = np.searchsorted(starts, spot, "right") - 1
    seen = np.unique(doc_of * len(index.items) + index.texts[which])
    owned: dict[int, set[str]] = {}
    for doc, text in zip((seen // len(index.items)).tolist(), (seen % len(index.items)).tolist()):
        owned.setdefault(doc, set()).add(index.items[text])
    longest = _longest(spot, which, index, starts)
    for doc, spans in stretches.items():
        out[doc] = Found(counts[doc], spans, sorted(owned[doc]), *longest[doc])
    return out


def _places(words: np.ndarray, order: np.ndarray, index: TestIndex, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows stand in ``words``, and which; all test suffixes whose first two words stand there are searched."""
    first = index.words[index.starts].astype(np.int64)
    here = np.unique(words[:-1] * base + words[1:]) if len(words) > 1 else np.zeros(0, np.int64)
    second = index.words[index.starts + 1] if len(index.starts) else first
    asked = np.flatnonzero((index.lengths == 1) | np.isin(first * base + second, here))
    rows, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(asked), AT_ONCE):
        some = asked[k : k + AT_ONCE]
        lo, hi = _bounds(words, order, index.rows(some))
        many = hi - lo
        rows.append(order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        which.append(np.repeat(some, many))
    return np.concatenate(rows), np.concatenate(which)


def _longest(spot: np.ndarray, which: np.ndarray, index: TestIndex, starts: np.ndarray) -> dict[int, tuple[int, int, str, int]]:
    """By document, the longest verbatim match: windows of one text that continue one another, joined.

    Of matches as long the first in the document counts, then the item that comes first.
    """
    text = index.texts[which]
    inside = index.starts[which] - index.begins[text]
    by = np.lexsort((spot, spot - inside, text))
    spot, which, text, inside = spot[by], which[by], text[by], inside[by]
    fresh = np.ones(len(spot), bool)
    fresh[1:] = (np.diff(spot) != 1) | (np.diff(inside) != 1) | (np.diff(text) != 0)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(spot)) - 1
    begin = spot[head]
    size = spot[last] + index.lengths[which[last]] - begin
    best: dict[int, tuple] = {}
    for doc, n, b, t, k in zip((np.searchsorted(starts, begin, "right") - 1).tolist(), size.tolist(), begin.tolist(), text[head].tolist(), inside[head].tolist()):
        found = (-n, b - int(starts[doc]), index.items[t], k)
        if doc not in best or found < best[doc]:
            best[doc] = found
    return {doc: (-n, at, item, k) for doc, (n, at, item, k) in best.items()}


def _shards(texts: list[bytes], most: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    start, weight = 0, 0
    for n, t in enumerate(texts):
        weight += len(t)
        if weight >= most:
            yield start, n + 1
            start, weight = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scan(texts: list[bytes], index: TestIndex) -> list[Found]:
    return [f for lo, hi in _shards(texts) for f in scan_shard(texts[lo:hi], index)]


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's distinct texts in parts of ``BENCHMARK_BYTES`` or so."""
    rows = benchmark.select("item_id", "text").where("item_id is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BENCHMARK_BYTES))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


_FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("stretches", ArrayType(LongType())),
        StructField("items", ArrayType(StringType())),
        StructField("longest", LongType()),
        StructField("place", LongType()),
        StructField("item", StringType()),
        StructField("item_place", LongType()),
    ]
)
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("stretches", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("place", pa.int64()), ("item", pa.string()), ("item_place", pa.int64())]
)


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, found: str, window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``found``: words, stretches of hit words, items, the longest match.

    ``benchmark`` has the columns ``item_id`` and ``text``.
    """
    df = in_small_batches(docs).select(*dict.fromkeys([*keep, text_col]))
    passes = _passes(benchmark)
    for turn, part in enumerate(passes):
        index = test_index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], window)  # ``BENCHMARK_BYTES`` of text
        last = turn + 1 == len(passes)
        df = _one_pass(save(df, "decontam") if turn else df, index, keep if last else df.columns[: len({*keep, text_col})], text_col, found, bool(turn))
    return df


def _one_pass(df: DataFrame, index: TestIndex, keep: list[str], text_col: str, found_col: str, again: bool) -> DataFrame:
    told = df.sparkSession.sparkContext.broadcast(index)
    at, had, own = df.columns.index(text_col), df.columns.index(found_col) if again else None, [df.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in parts(batch, at, SHARD_BYTES)):
            found = [f._asdict() for f in _scan(text_bytes(batch.column(at)), told.value)]
            if had is not None:
                for f, old in zip(found, batch.column(had).to_pylist()):
                    f["stretches"] = old["stretches"] + f["stretches"]
                    f["items"] = sorted({*old["items"], *f["items"]})
                    if old["longest"] and (not f["longest"] or (-old["longest"], old["place"], old["item"], old["item_place"]) < (-f["longest"], f["place"], f["item"], f["item_place"])):
                        f.update({k: old[k] for k in ("longest", "place", "item", "item_place")})
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(found, _FOUND_ARROW)], [*keep, found_col])

    schema = StructType([*(df.schema[k] for k in keep), StructField(found_col, _FOUND)])
    return df.mapInArrow(tidy(run), schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at, longest_item, longest_item_at``.

    A window is ``window`` consecutive words of an item, or all words of a shorter item.
    ``n_hit`` counts a document's words inside any occurrence of a window.  A document is
    contaminated if a word is hit and the hits are a twentieth of its words or more.  The
    longest match is the longest run of words, of a window or more, that stands alike here and
    in one item; its places are counted in words from 0, null without a match.
    Null or wordless texts have no words and no hits; items with a null id, null text or no
    words match nothing; an empty benchmark contaminates nothing; repeated rows of either
    table are each judged alike (an item's id counts once).  Other columns aren't read.
    """
    (own,) = names(docs, "found")
    found = find_matches(docs, benchmark, [id_col], text_col, own, window)
    told = [F.col(f"{own}.{a}").alias(b) for a, b in (("longest", "longest_match"), ("place", "longest_at"), ("item", "longest_item"), ("item_place", "longest_item_at"))]
    return found.select(F.col(id_col).alias("doc_id"), F.col(f"{own}.n_words").alias("n_words"), *_verdict(own), *told)


def _verdict(f: str) -> list:
    hit = F.aggregate(
        F.array_sort(F.arrays_zip(F.filter(f"{f}.stretches", lambda x, i: i % 2 == 0), F.filter(f"{f}.stretches", lambda x, i: i % 2 == 1))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["1"] - F.greatest(s["0"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["1"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return [
        hit.alias("n_hit"),
        F.size(f"{f}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{f}.items"), ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col(f"{f}.n_words"))).alias("contaminated"),
    ]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents (see :func:`contamination`), whatever other columns they have."""
    (own,) = names(docs, "found")
    found = find_matches(docs, benchmark, docs.columns, text_col, own, window)
    return found.where(~_verdict(own)[3]).select(*docs.columns)
