"""Language-model scores: prediction by partial matching, and a smoothed unigram beside it.

Both are pretrained on the documents of the training folds.

* The byte model counts every symbol after every context of up to ``ORDER`` bytes.  Whole
  corpus counts are gathered as (context, symbol) rows; a task first adds up its own.
  Escapes follow method C: a context escapes with as many counts as it has distinct symbols.
  After an escape the symbols of the longer context are excluded.  Contexts form a trie, and
  the symbols of a context are among those of its suffix, so what is excluded at a level
  depends on the next longer context alone: a symbol's code length is the sum of constants
  of the contexts it escapes from and of its own edge, and is looked up, not simulated.
  Every edge counts.  A symbol's code length depends on its ``ORDER`` bytes of context alone:
  those of frequent (context, symbol) pairs (``EDGES`` at most) go to the tasks, the others
  meet theirs in a join.  Pairs that the corpus lacks are looked up in tries of parts of the
  contexts: those that share their last two bytes escape to the same shorter ones.
* The unigram model's counts of frequent words (``FREQUENT`` at most) go to the tasks; the
  others meet their counts in a join, so no count is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import LOWER, in_small_batches, parts, remainder, text_bytes, tidy
from recordloom.storage import save

ORDER = 4
#: Pairs of a context and a symbol whose code lengths go to the tasks, at most.
EDGES = 1_200_000
#: Edges of a part of the contexts, about.
PART_EDGES = 5_000
#: Words whose counts go to the tasks, at most.
FREQUENT = 400_000
#: Bytes that occur in no UTF-8 text: before a text's beginning, and its end.
START, END = 0xFE, 0xFF
#: The token after a text's last word; no word holds a space.
END_TOKEN = b" "
#: Text that is scored or counted at once, in bytes.
CHUNK = 500_000
#: Words that a worker remembers, at most.
REMEMBERED = 150_000


def _key(word: bytes) -> int:
    n = xxhash.xxh64_intdigest(word)
    return n - (1 << 64) if n >> 63 else n


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, weight = 0, 0
    for n, t in enumerate(texts):
        weight += len(t) + ORDER + 1
        if weight >= CHUNK:
            yield start, n + 1
            start, weight = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of lowered texts and their ends, its ``ORDER`` bytes of context and itself
    in one integer; and where each text's symbols begin."""
    joined = np.frombuffer(b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts), np.uint8)
    code = np.zeros(len(joined), np.int64)
    for back in range(ORDER, -1, -1):
        code[ORDER:] |= joined[ORDER - back : len(joined) - back].astype(np.int64) << 8 * back
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    real = np.ones(len(joined), bool)
    first = begin + ORDER * np.arange(len(texts))
    for k in range(ORDER):
        real[first + k] = False
    return code[real], begin


# ---------------------------------------------------------------- counting

def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, np.flatnonzero(first))


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, key, n)``: counts of words (kind 0, by hash) and of symbols in context (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = Counter(), [], 0

        def told(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal words, pairs, held
            if words and (final or len(words) > 200_000):
                yield _rows(0, np.fromiter(map(_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
                words = Counter()
            if len(pairs) > 1 and (final or held > 1_500_000):
                pairs = [_merge(pairs)]
                held = len(pairs[0][0])
            if pairs and (final or held > 1_000_000):
                yield _rows(1, *pairs[0])
                pairs, held = [], 0

        for batch in batches:
            for part in parts(batch, 0):
                texts = [t.translate(LOWER) for t in text_bytes(part.column(0))]
                for lo, hi in _chunks(texts):
                    for t in texts[lo:hi]:
                        words.update(t.split())
                    words[END_TOKEN] += hi - lo
                    pairs.append(np.unique(grams(texts[lo:hi])[0], return_counts=True))
                    held += len(pairs[-1][0])
                    yield from told(False)
        yield from told(True)

    found = in_small_batches(docs).select(F.col(text_col)).mapInArrow(tidy(run), "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count (on a scale of eighths of powers of two) that ``most`` rows or fewer have."""
    scale = F.floor(F.log2("n") * 8).cast("int")
    rows = {r["s"]: r["c"] for r in counts.groupBy(scale.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}  # some hundred rows
    total, least = 0, 1
    for s in sorted(rows, reverse=True):
        total += rows[s]
        if total > most:
            least = int(np.floor(2 ** ((s + 1) / 8))) + 1
            break
    return least


# ---------------------------------------------------------------- model

class Lookup(NamedTuple):
    """Hash table of integers, made of arrays: what finds its slot taken goes to the next level."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]  # shift, keys, numbers

    @staticmethod
    def of(keys: np.ndarray) -> Lookup:
        levels, number = [], np.arange(len(keys), dtype=np.int32)
        while len(keys):
            bits = max(4, int(len(keys) * 3).bit_length())
            table, numbers = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            slot = Lookup.slots(keys, 64 - bits, len(levels))
            table[slot], numbers[slot] = keys, number
            levels.append((64 - bits, table, numbers))
            left = table[slot] != keys
            keys, number = keys[left], number[left]
        return Lookup(levels)

    @staticmethod
    def slots(keys: np.ndarray, shift: int, level: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(shift)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left = None
        for level, (shift, table, numbers) in enumerate(self.levels):
            part = keys if left is None else keys[left]
            slot = self.slots(part, shift, level)
            hit = table[slot] == part
            if left is None:
                out = np.where(hit, numbers[slot], np.int32(-1))
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = numbers[slot[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


def _tag(order: int) -> int:
    return (order + 1) << 48


class Trie(NamedTuple):
    """Counts as log10 constants.  An edge is (context of an order, symbol), a node a context."""

    edges: Lookup
    top: np.ndarray  # of an edge: its share where its context is the longest known
    share: np.ndarray  # of an edge: log10 of its count
    nodes: Lookup
    escape: np.ndarray  # of a node: escaping from it where it is the longest known
    room: np.ndarray  # of a node: log10 of what its suffix counts with this node's symbols excluded
    onward: np.ndarray  # of a node: escaping from its suffix, likewise
    last: float  # any symbol that occurs nowhere


def build_trie(keys: list[np.ndarray], counts: list[np.ndarray]) -> Trie:
    """From the (context, symbol) codes of each order from 0 up, and their counts; every
    suffix of a context with a symbol must be there too."""
    if not sum(map(len, keys)):
        none, nothing = Lookup.of(np.zeros(0, np.int64)), np.zeros(0)
        return Trie(none, nothing, nothing, none, nothing, nothing, nothing, -float(np.log10(256)))
    edge_keys, top, share, node_keys, escape, room, onward = ([] for _ in range(7))
    before: tuple[np.ndarray, ...] | None = None
    with np.errstate(divide="ignore"):
        for order, (key, n) in enumerate(zip(keys, counts)):
            by = np.argsort(key)
            key, n = key[by], n[by].astype(np.float64)
            context, first, inverse = np.unique(key >> 8, return_index=True, return_inverse=True)
            total = np.add.reduceat(n, first)
            kinds = np.bincount(inverse, minlength=len(context)).astype(np.float64)
            edge_keys.append(key | _tag(order))
            top.append(np.log10(n / (total + kinds)[inverse]))
            share.append(np.log10(n))
            node_keys.append(context | _tag(order))
            escape.append(np.log10(kinds / (total + kinds)))
            if before is None:
                room.append(np.zeros(len(context)))
                onward.append(np.zeros(len(context)))
            else:
                low_key, low_n, low_context, low_total, low_kinds = before
                mask = (1 << 8 * order) - 1  # drops the context's first byte
                same = low_n[np.searchsorted(low_key, key & mask)]
                parent = np.searchsorted(low_context, context & (mask >> 8))
                left = low_total[parent] - np.add.reduceat(same, first)
                new = low_kinds[parent] - kinds
                room.append(np.log10(np.where(new > 0, left + new, 1)))
                onward.append(np.where(new > 0, np.log10(np.where(new > 0, new, 1) / np.where(new > 0, left + new, 1)), 0.0))
            before = (key, n, context, total, kinds)
    return Trie(
        Lookup.of(np.concatenate(edge_keys)), np.concatenate(top), np.concatenate(share),
        Lookup.of(np.concatenate(node_keys)), np.concatenate(escape), np.concatenate(room), np.concatenate(onward),
        -float(np.log10(max(1, 256 - len(keys[0])))),
    )


def code_lengths(code: np.ndarray, trie: Trie) -> np.ndarray:
    """log10 probability of each symbol in its context (codes as of :func:`grams`)."""
    if not len(trie.top):
        return np.full(len(code), trie.last)
    edge = trie.edges(code | _tag(ORDER))
    value = np.where(edge >= 0, trie.top[edge], 0.0)
    left = np.flatnonzero(edge < 0)
    started = np.zeros(len(left), bool)  # a longest known context was found
    for order in range(ORDER, -1, -1):
        if not len(left):
            break
        part = code[left]
        context = ((part >> 8) & ((1 << 8 * order) - 1)) | _tag(order)
        symbol = (part & ((1 << 8 * (order + 1)) - 1)) | _tag(order)
        edge = trie.edges(symbol)
        if order < ORDER:
            # Escaped from the next longer context: its constants say what this level counts.
            longer = trie.nodes(((part >> 8) & ((1 << 8 * (order + 1)) - 1)) | _tag(order + 1))
            # The longer context is known wherever the search has started.
            value[left] += np.where(started, np.where(edge >= 0, trie.share[edge] - trie.room[longer], trie.onward[longer]), 0.0)
        node = trie.nodes(context)
        fresh = ~started & (node >= 0)
        value[left] += np.where(fresh, np.where(edge >= 0, trie.top[edge], trie.escape[node]), 0.0)
        started |= fresh
        open_ = edge < 0
        left, started = left[open_], started[open_]
    value[left] += trie.last
    return value


def pair_lengths(counts: DataFrame) -> DataFrame:
    """``(key, n, value)``: code lengths of the pairs in rows ``(key, n)``, one for each pair."""
    own = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.collect_list(F.struct("key", "n")).alias("own")  # 256 at most
    )
    return own.select("total", "kinds", F.inline("own")).select("key", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))


def other_lengths(keys: DataFrame, counts: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """``(key, value)``: code lengths of pairs ``key`` that the rows ``(key, n)`` of ``counts`` lack."""
    orders = F.posexplode(F.array(*[F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)) for k in range(ORDER + 1)]))
    every = save(counts.select(orders.alias("ord", "k"), "n").groupBy("ord", "k").agg(F.sum("n").alias("n")), "contexts")
    low = every.where("ord < 2").toArrow()  # at most 256 * 257 rows
    of, key, n = (low.column(c).to_numpy() for c in ("ord", "k", "n"))
    known = keys.sparkSession.sparkContext.broadcast([(key[of == k], n[of == k]) for k in range(2)])
    parts = 1 + every.count() // part_edges

    def part(pair: str) -> Column:
        return F.pmod(F.xxhash64(F.shiftright(pair, 8).bitwiseAND(F.lit(0xFFFF))), F.lit(parts)).alias("part")

    def run(asked: pa.Table, edges: pa.Table) -> pa.Table:
        code = asked.column("key").to_numpy()
        if len(code):
            of, key, n = (edges.column(c).to_numpy() for c in ("ord", "k", "n"))
            found = [*known.value, *((key[of == k], n[of == k]) for k in range(2, ORDER + 1))]
            value = code_lengths(code, build_trie([k for k, _ in found], [c for _, c in found]))
        else:
            value = np.zeros(0)
        return pa.table({"key": pa.array(code, pa.int64()), "value": pa.array(value, pa.float64())})

    asked = keys.select(part("key"), "key").groupBy("part")
    return asked.cogroup(every.where("ord >= 2").select(part("k"), "ord", "k", "n").groupBy("part")).applyInArrow(run, "key long, value double")


# ---------------------------------------------------------------- scoring

class Told(NamedTuple):
    pairs: Lookup  # frequent pairs of a context and a symbol
    values: np.ndarray  # their code lengths
    keys: np.ndarray  # of frequent words, ascending
    logs: np.ndarray  # log10 of their counts and one more


def _score(docs: DataFrame, model: Told, id_col: str, text_col: str) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        known: dict[bytes, float] = {}
        number = TaskContext.get().partitionId() << 36
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 4)
        for part in (part for batch in batches for part in parts(batch, 1)):
            texts = [t.translate(LOWER) for t in text_bytes(part.column(1))]
            rows = []
            for lo, hi in _chunks(texts):
                code, begin = grams(texts[lo:hi])
                pair = own.pairs(code)
                score = np.add.reduceat(np.where(pair >= 0, own.values[pair], 0.0) if len(own.values) else np.zeros(len(code)), begin)
                odd = np.flatnonzero(pair < 0)
                cuts = np.append(np.searchsorted(odd, begin), len(odd)).tolist()
                odd = code[odd]
                del code, pair
                cut = [[*t.split(), END_TOKEN] for t in texts[lo:hi]]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set().union(*cut).difference(known))
                keys = np.fromiter(map(_key, new), np.int64, len(new))
                at = np.searchsorted(own.keys, keys)
                hit = np.zeros(len(new), bool)
                if len(own.keys):
                    at = np.minimum(at, len(own.keys) - 1)
                    hit = own.keys[at] == keys
                known.update(zip(new, np.where(hit, own.logs[at] if len(own.keys) else 0.0, -1.0).tolist()))
                for line, s, a, b in zip(cut, score.tolist(), cuts, cuts[1:]):
                    logs = np.fromiter(map(known.__getitem__, line), np.float64, len(line))
                    rare = np.flatnonzero(logs < 0)
                    many = Counter(_key(line[k]) for k in rare.tolist())
                    codes, n = np.unique(odd[a:b], return_counts=True)
                    rows.append((number, len(line), len(line) - len(rare), float(logs[logs >= 0].sum()), s, list(many), list(many.values()), codes, n))
                    number += 1
            columns = zip(*rows) if rows else ((),) * 9
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["id", "row", "n_tokens", "n_known", "logs", "score", "rare", "times", "odd", "odd_times"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(
        tidy(run),
        f"id {kind}, row long, n_tokens long, n_known long, logs double, score double, rare array<long>, times array<long>, odd array<long>, odd_times array<long>",
    )


def language_model_scores(
    docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", edges: int = EDGES, frequent: int = FREQUENT
) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32 of the id modulo ``folds`` is ``fold`` teach nothing.  ``score`` is the log10 probability of the lowered text and its end
    under the byte model, ``base_score`` that of its tokens under the unigram model with one
    added to each count.  ``edges`` and ``frequent`` bound what goes to the tasks and change
    no score.  Words are counted by 64-bit hash.  A null or empty text is its end
    alone.  Null and repeated ids keep their rows; an empty table gives no rows; with no
    training rows every symbol is equally likely.  Other columns are not read.
    """
    counts = save(corpus_counts(docs.where(remainder(F.col(id_col), folds) != fold), text_col), "counts")
    words = counts.where("kind = 0").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    pairs = counts.where("kind = 1").select("key", "n")
    lengths = save(pair_lengths(pairs), "pairs")
    least_pair = _least_count(lengths, edges)
    common = lengths.where(F.col("n") >= least_pair).toArrow()  # at most ``edges`` rows of two numbers
    least = _least_count(words, frequent)
    got = words.where(F.col("n") >= least).toArrow()  # at most ``frequent`` rows of two numbers
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    by = np.argsort(keys)
    told = Told(Lookup.of(common.column("key").to_numpy()), common.column("value").to_numpy(), keys[by], np.log10(n[by] + 1.0))
    scored = save(_score(docs, told, id_col, text_col), "scored")

    def met_later(kind: int, key: str, times: str) -> DataFrame:
        return scored.select("row", F.inline(F.arrays_zip(F.col(key).alias("key"), F.col(times).alias("times")))).select("row", F.lit(kind).alias("kind"), "key", "times")

    rare = met_later(0, "rare", "times").unionByName(met_later(1, "odd", "odd_times"))
    unseen = rare.where("kind = 1").select("key").distinct().join(lengths.where(F.col("n") < least_pair), "key", "left_anti")
    values = [
        words.where(F.col("n") < least).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value")),
        lengths.where(F.col("n") < least_pair).select(F.lit(1).alias("kind"), "key", "value"),
        other_lengths(unseen, pairs).select(F.lit(1).alias("kind"), "key", "value"),
    ]
    word, value = F.col("kind") == 0, F.col("times") * F.col("value")
    met = rare.join(reduce(DataFrame.unionByName, values), ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(word, value)).alias("more"), F.sum(F.when(word, F.col("times"))).alias("known"), F.sum(F.when(~word, value)).alias("odd_score")
    )
    denominator = float(np.log10(total["n"] + total["v"] + 1))
    return (
        scored.join(met, "row", "left")
        .select(
            F.col("id").alias("doc_id"),
            (remainder(F.col("id"), folds) == fold).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(total["n"]).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
            (F.col("score") + F.coalesce("odd_score", F.lit(0.0))).alias("score"),
        )
    )
