"""Packing token pieces into few sequences of fixed length, by linear grouping.

Documents are tokenized once and cut into pieces.  All that the packing plan needs is the
histogram of piece lengths: at most ``capacity`` rows whatever the corpus, so the plan is
made on the driver from counts and its size follows the number of distinct lengths.

The plan (``plan_sequences``):

1. Large pieces (over ``capacity / 8``) are ordered by length and cut into groups of equal
   cardinality; each is rounded up to its group's largest length.
2. Configurations of these few sizes are optimised: column generation for the linear
   relaxation of the cutting-stock problem, rounded down, the rest by best-fit decreasing.
3. Actual lengths take the places of rounded ones, run by run: the longest piece that a
   rounded size covers, and in a sequence's last place the longest that fits.
4. What room that leaves is filled with the small pieces, longest first, each into the
   fullest sequence that still has room (best fit); new sequences are opened when none has.

The plan is a list of runs: the pieces of one length with ranks from ``lo`` up go, one
each, to the sequences from ``seq`` up, at a common offset.  Ranks within a length are made
without a global sort: pieces are dealt over buckets, ranked in their bucket, and bucket
offsets are added.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import LOWER, in_small_batches, kept, parts
from recordloom.storage import save

CAPACITY = 2048
END_ID = 0
#: Equal-cardinality groups of the large lengths.
GROUPS = 64
#: Words whose ids a worker keeps, at most, and their bytes and those of their ids.
WORDS_KEPT, WORD_BYTES_KEPT = 600_000, 24_000_000


# ---------------------------------------------------------------- tokens

#: Characters after which a stop or comma may be parted: letters and digits of the commonest scripts that stay
#: one letter or digit in lower case (the dotted capital I does not, nor do letters with joining marks).
_SAFE = "0-9A-Za-zªµºÀ-ÖØ-öø-įı-ɏΆΈ-ΊΌΎ-ΡΣ-ϵϷ-ҁҊ-ԯ一-鿿ぁ-ゖァ-ヺ가-힣"
#: A stop or comma that ends a word and stands behind anything else.
_RUN = re.compile(rf"[^ \t\n{_SAFE}][.,][ \n]")
#: Words of Latin letters, and signs at their end (no apostrophe): the letters are a token run, and so are the signs.
_LETTERS = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: First bytes of marks that join with a letter before them; what begins a special token's name.
_JOINS = (b"\xcc", b"\xcd", b"<|")


class _Words(dict):
    """Words' ids; a word that isn't there is taken from the older ones, or else learned."""

    def __init__(self, learn: Callable[[bytes], bytes], older: dict[bytes, bytes]) -> None:
        super().__init__()
        self.learn, self.older, self.weight = learn, older, 0

    def __missing__(self, word: bytes) -> bytes:
        raw = self.older.get(word)
        if raw is None:
            raw = self.learn(word)
        self[word] = raw
        self.weight += len(word) + len(raw)
        return raw


class WordIds:
    """Ids of texts, as little-endian 32-bit words, found once for each word.

    The tokenizer lowers case and drops white space, and a run of letters, a digit and a run of
    other signs are tokens of their own.  So the ids of a text are those of its words one after
    another, ASCII letters may be lowered first, and a stop or comma may be parted from a
    letter or digit before it.  Texts for which that isn't certain (signs in a row, letters of
    other scripts, joining marks, names of special tokens) are only cut at spaces and line feeds.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # How the byte-level step spells the letters that aren't ASCII.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = str.maketrans({chr(c): "".join(p for p, _ in spell(chr(c))) for c in range(0xDF, 0x100)})
        self.words = _Words(self._learn, {})

    def _learn(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _LETTERS.fullmatch(text) if b"<|" not in word else None
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # The steps before the model leave such a word as it is, but for case and spelling.
        letters, signs = plain[1], plain[2]
        parts = self.tokenizer.model.tokenize(letters if letters.isascii() else letters.lower().translate(self.spelled))
        if signs:
            parts += self.tokenizer.model.tokenize(signs)
        return struct.pack(f"<{len(parts)}I", *[p.id for p in parts])

    @staticmethod
    def cut(text: str) -> list[bytes]:
        """Pieces of a text whose ids follow one another."""
        raw = text.encode()
        if any(x in raw for x in _JOINS):
            return raw.replace(b"\n", b" ").split(b" ")
        if not _RUN.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return text.encode().translate(LOWER).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT // 2 or self.words.weight > WORD_BYTES_KEPT // 2:
            self.words.older = {}
            self.words = _Words(self._learn, self.words)
        ids = self.words.__getitem__
        return [b"".join(map(ids, self.cut(t))) for t in texts]


def _encoder(path: str) -> WordIds:
    """The encoder of this worker process: what it learned serves its later tasks of this operator."""
    return kept(f"words {path}", lambda: WordIds(path))


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32)``: a document's ids and the end id, cut where longer
    than ``capacity``; ``row`` is another number for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for part in (part for batch in batches for part in parts(batch, 1)):
            rows = []
            for row, raw in enumerate(_encoder(tokenizer_path)([t or "" for t in part.column(1).to_pylist()])):
                raw += END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    some = raw[4 * start : 4 * (start + capacity)]
                    rows.append((row, number, piece, start, len(some) // 4, zlib.crc32(some)))
                    number += 1
            took, row_number, piece, start, length, crc = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(took, pa.int64())), pa.array(row_number, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "row", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = in_small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, row long, piece int, start long, length long, ids_crc32 long"
    )
    return out.withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- plan

def _groups(counts: dict[int, int], large: list[int], groups: int) -> list[tuple[int, list[int]]]:
    """(rounded size, lengths descending) of groups of about equal cardinality, largest first."""
    total, out, inside, held = sum(counts[x] for x in large), [], [], 0
    for x in sorted(large, reverse=True):
        inside.append(x)
        held += counts[x]
        if held * groups >= total:
            out.append((inside[0], inside))
            inside, held = [], 0
    if inside:
        out.append((inside[0], inside))
    return out


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Best multiset of sizes within the capacity: its value and multiplicities."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    unit = min(sizes)
    for room in range(unit, capacity + 1):
        value, which = best[room - 1], -1
        for k, size in enumerate(sizes):
            if size <= room and best[room - size] + values[k] > value + 1e-12:
                value, which = best[room - size] + values[k], k
        best[room], took[room] = value, which
    many, room = [0] * len(sizes), capacity
    while room >= unit:
        if took[room] < 0:
            room -= 1
            continue
        many[took[room]] += 1
        room -= sizes[took[room]]
    return float(best[capacity]), many


def _configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (multiplicity of each size) and how often each is used, by column
    generation; they meet at most the need."""
    m = len(sizes)
    columns = [[capacity // s if k == j else 0 for j in range(m)] for k, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    want = np.array(need, float)
    grain = max(1, min(sizes) // 64)  # sizes rounded up for the pricing problem only
    coarse, room = [-(-s // grain) for s in sizes], capacity // grain
    for _ in range(12 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        value, column = _knapsack(coarse, price, room)
        if value <= 1 + 1e-6:
            break
        use, step = np.linalg.solve(basis, want), np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        columns[out] = column
    use = np.linalg.solve(basis, want)
    left, made = list(need), []
    for column, n in zip(columns, use):
        n = int(min([int(n + 1e-9), *(left[k] // c for k, c in enumerate(column) if c)]))
        if n > 0:
            made.append((column, n))
            left = [x - n * c for x, c in zip(left, column)]
    return made


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, lo, hi, seq, offset)``: pieces of this length ranked ``lo`` to ``hi - 1`` go to
    sequences ``seq``, ``seq + 1``, and so on, all at ``offset``."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    runs: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of (first sequence, how many)
    levels: list[int] = []  # rooms in use, ascending
    following = 0

    def have(room: int, seq: int, n: int) -> None:
        if room and n:
            if not rooms[room]:
                bisect.insort(levels, room)
            rooms[room].append((seq, n))

    def take(room: int) -> tuple[int, int]:
        run = rooms[room].pop()
        if not rooms[room]:
            levels.remove(room)
        return run

    def best_fit(length: int, n: int) -> None:
        nonlocal following
        while n:
            at = bisect.bisect_left(levels, length)
            if at == len(levels):
                each = capacity // length
                opened = max(1, n // each)
                seq, many, room = following, opened, capacity
                following += opened
            else:
                room = levels[at]
                seq, many = take(room)
            used = min(many, n)
            have(room, seq + used, many - used)
            runs.append((length, ranks[length], ranks[length] + used, seq, capacity - room))
            ranks[length] += used
            n -= used
            have(room - length, seq, used)

    whole = counts.pop(capacity, 0)
    if whole:
        runs.append((capacity, 0, whole, 0, 0))
        following = whole
    large = [x for x in counts if 8 * x > capacity]
    if large:
        grouped = _groups(counts, large, groups)
        sizes, need = [s for s, _ in grouped], [sum(counts[x] for x in xs) for _, xs in grouped]
        stock, on_hand = {x: counts[x] for x in large}, sorted(large)

        def longest(most: int, used: dict[int, int]) -> int:
            """The longest length on hand up to ``most``, or 0."""
            at = bisect.bisect_right(on_hand, most)
            while at and stock[on_hand[at - 1]] <= used.get(on_hand[at - 1], 0):
                at -= 1
            return on_hand[at - 1] if at else 0

        for column, n in sorted(_configurations(sizes, need, capacity), key=lambda x: x[0], reverse=True):
            slots = [sizes[k] for k, c in enumerate(column) for _ in range(c)]
            while n:
                # A run in which every place has one actual length throughout.  A rounded size is
                # replaced by the longest piece it covers, the last one by what fits best.
                used: dict[int, int] = {}
                room, chosen = capacity, []
                for k, slot in enumerate(slots):
                    x = longest(room if k + 1 == len(slots) else min(slot, room), used)
                    if x:
                        used[x] = used.get(x, 0) + 1
                        room -= x
                        chosen.append(x)
                if not chosen:
                    break
                width = min([n, *(stock[x] // times for x, times in used.items())])
                offset = 0
                for x in chosen:
                    runs.append((x, ranks[x], ranks[x] + width, following, offset))
                    ranks[x] += width
                    stock[x] -= width
                    offset += x
                for x in used:
                    if not stock[x]:
                        on_hand.remove(x)
                have(capacity - offset, following, width)
                following += width
                n -= width
        for x in reversed(on_hand):
            best_fit(x, stock[x])
    for x in sorted((x for x in counts if 8 * x <= capacity), reverse=True):
        best_fit(x, counts[x])
    return runs


# ---------------------------------------------------------------- placing

def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``row`` and ``length``) and the ``sequence_id`` and ``offset`` of each.

    The pieces of a length are dealt over buckets by a hash of ``row``, of about as many pieces
    as there are buckets, so neither a common length nor a repeated row fills one task.  An
    empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity) if counts else []
    spread = spark.createDataFrame([(k, math.isqrt(n)) for k, n in counts.items()], "length long, _buckets long")
    # One row for each length there is: at most ``capacity`` rows.
    dealt = pieces.join(F.broadcast(spread), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64("row"), F.col("_buckets"))
    )
    held = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy("row")
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_start"))
    )
    schema = "_length long, _lo long, _hi long, _seq long, _offset long"
    # At most some runs for each pair of a distinct length and a room: bounded by the capacity, not by the rows.
    runs = F.broadcast(spark.createDataFrame(plan, schema))
    placed = ranked.join(
        runs, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    )
    return placed.select(
        *[c for c in pieces.columns if c != "row"], (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.  A null or
    empty text is the end id alone.  Null and repeated ids keep their rows.  Documents longer
    than ``capacity`` are cut, others never.  An empty table gives no rows; other columns are
    not read.
    """
    return pack(save(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity)
