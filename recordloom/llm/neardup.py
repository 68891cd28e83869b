"""Near-duplicate classes from SimHash fingerprints, without all-pairs comparison.

The 64 bits are cut into 32 segments of two bits.  A fingerprint's embedding is the
vector of the segments' bit counts; the Manhattan distance of two embeddings is a lower
bound of the Hamming distance of their fingerprints.

The embedding's coordinates are cut into ``distance + 3`` slabs.  A cell of the grid fixes
the coordinates of three slabs.  Two fingerprints at Manhattan distance ``distance`` or
less differ in at most that many slabs, so three slabs are equal and they share a cell:
the range join over neighbouring grid points is an equality join on cells.  Of the
cells that a pair shares, only the first may report it, and it does so once the Manhattan
bound and then the exact Hamming distance hold.

That finds fingerprints at a few bits.  Texts whose sets of word shingles have a Jaccard
similarity of 0.8 differ in ten bits on average, which no grid parts from the rest; so a
search by similarity (:func:`similar_classes`) takes the grid's links as candidates, and as
further ones texts that share a hash of their prefixes: in an order of all hashes, the first
fifth of a text's, of which two such texts have one in common.  Hashes that many texts
share come last in that order.  Candidates are verified exactly, on the whole texts: each
text's nearest first, then whatever would still join two classes.  Large groups of texts
are compared in blocks, by all of their shingles' 64-bit hashes.  No pair is left to chance.

Fingerprints are made distinct before that, so groups of equal copies cost one row.
Cells that hold more than ``CELL_ROWS`` fingerprints are dealt into blocks; each pair of
blocks is one bounded task, which returns a spanning forest of its links rather than the
links.  No cell, link or partner is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import LOWER, in_small_batches, names, parts, text_bytes, tidy
from recordloom.operators.components import connected_components
from recordloom.storage import drop, save

#: Cells with more fingerprints than this are joined in blocks.
CELL_ROWS = 128
#: Rows of a block.
BLOCK_ROWS = 1024
#: Texts that share a hash, from which on it comes last in the order, and how many such hashes are told at most.
CROWD, CROWDED = 32, 65_536
#: Texts and hashes of a block of a large group.
CROWD_ROWS, CROWD_HASHES = 512, 1_000_000
#: 64-bit words of a text's marks.
MARKS = 8
#: By how much rounding may shift a bound; bounds are drawn wider by it.
SLACK = 1e-6
#: A text's nearest candidates, which are verified first.
NEAREST = 4
_SLABS_EQUAL = 3
_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)
_EVEN = 0x5555555555555555


def simhash(text: bytes, words: int = 3) -> int:
    """Fingerprint of one text, as an unsigned integer.

    A-Z are lowered; shingles are ``words`` words joined by spaces, repeats included; a
    text of fewer words has one shingle, and a text without words has fingerprint 0.
    """
    w = text.translate(LOWER).split()
    if not w:
        return 0
    joined = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[k:] for k in range(words)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in joined], np.uint64).view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(hashes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(votes * 2 > len(joined), bitorder="little").view(np.uint64)[0])


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, th, fp)``, th a hash of the text, fp a signed 64-bit integer; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, 1)):
            fps = np.array([simhash(t, words) for t in text_bytes(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps.view(np.int64))], ["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_small_batches(docs).select(F.col(id_col), F.col(text_col), _text_hash(text_col)).mapInArrow(tidy(run), f"id {kind}, th long, fp long")
    return found.select(F.col("id").alias(id_col), "th", "fp")


def _embedding(fp: Column) -> Column:
    """The segments' counts in one integer: two bits each, 0, 1, 2 written as 00, 01, 11."""
    even = fp.bitwiseAND(F.lit(_EVEN))
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _manhattan(p: Column, q: Column) -> Column:
    """Manhattan distance of two embeddings: the counts' codes differ in as many bits."""
    return F.bit_count(p.bitwiseXOR(q))


def _slab_masks(slabs: int) -> list[int]:
    """Masks of the packed embedding's coordinates (two bits each), one for each slab."""
    cuts = [round(k * 32 / slabs) for k in range(slabs + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _first_shared(p: Column, q: Column, masks: list[int], combos: list[tuple[int, ...]]) -> Column:
    """Number of the first cell that two embeddings share."""
    diff = p.bitwiseXOR(q)
    same = [diff.bitwiseAND(F.lit(m)) == 0 for m in masks]
    out = F.lit(len(combos))
    for n, combo in reversed(list(enumerate(combos))):
        out = F.when(same[combo[0]] & same[combo[1]] & same[combo[2]], n).otherwise(out)
    return out


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links between a and b (of links at ``distance`` or less) connect."""
    every = np.unique(np.concatenate([a, b]))
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= distance
    left, right = np.searchsorted(every, a), np.searchsorted(every, b)
    label = np.arange(len(every))
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    keep = i != j
    i, j = i[keep], j[keep]
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(every)))[0]
    return [(int(every[k]), int(every[label[k]])) for k in moved]


def fingerprint_links(fps: DataFrame, distance: int = 3, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``: links of distinct fingerprints ``fp`` (one row each) that connect exactly
    what all pairs at Hamming distance 1 to ``distance`` connect."""
    slabs = distance + _SLABS_EQUAL
    masks = _slab_masks(slabs)
    combos = list(combinations(range(slabs), _SLABS_EQUAL))
    cell_masks = [masks[a] | masks[b] | masks[c] for a, b, c in combos]
    pop = _embedding(F.col("fp"))
    cells = fps.select("fp", pop.alias("pop")).select(
        "fp", "pop", F.posexplode(F.array(*[F.col("pop").bitwiseAND(F.lit(m)) for m in cell_masks])).alias("cell", "key")
    )
    sizes = save(cells.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    shared = save(cells.join(sizes, ["cell", "key"]), "incell")
    few = shared.where(F.col("n") <= cell_rows)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (_manhattan(F.col("x.pop"), F.col("y.pop")) <= distance)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        & (_first_shared(F.col("x.pop"), F.col("y.pop"), masks, combos) == F.col("x.cell")),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    # A pair whose first shared cell is a full one is reported from there.

    many = shared.where(F.col("n") > cell_rows).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = many.select("cell", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "cell", "key", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def block(rows: pa.Table) -> pa.Table:
        own, fp = rows.column("own").to_numpy(), rows.column("fp").to_numpy()
        a, b = (fp[own == rows.column(k)[0].as_py()] for k in ("i", "j"))
        found = _forest(a, b, distance)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    blocks = dealt.groupBy("cell", "key", "i", "j").applyInArrow(block, "a long, b long")
    return pairs.unionByName(blocks)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """``(id_col, th, fp)`` of each row, ``th`` a hash of its text; and ``(f, component_id, head)`` of each fingerprint:
    its class's least id and the place of the document that stands for it."""
    own = save(fingerprints(docs, id_col, text_col, words), "simhash")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("th").alias("th"))
    nodes = save(own.groupBy("fp").agg(F.min(id_col).alias("least"), F.min(place).alias("head")), "fingerprints")
    roots = save(connected_components(fingerprint_links(nodes.select("fp"), distance)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "head", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    return own, save(placed.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("f"), "component_id", "head"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits.  ``component_id`` is the least id that is
    reachable over links of fingerprints at ``distance`` or fewer differing bits.  A null or
    wordless text has fingerprint zero and is linked like any other.  Null ids get a row and
    their group's least id; a group whose ids are all null has a null component.  Repeated
    ids and repeated rows keep one row each.  An empty table gives no rows; other columns
    are not read.
    """
    own, classes = _classes(docs, id_col, text_col, words, distance)
    return own.join(classes, F.col("fp") == F.col("f")).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _shingles(text: bytes, words: int) -> list[bytes]:
    w = text.translate(LOWER).split()
    return [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[k:] for k in range(words)))))


def _prefix_rows(n: int, similarity: float) -> int:
    """So many of a set's ``n`` elements, the first in an order that all sets share: two similar sets have one of them in common."""
    return n - math.ceil(similarity * n - SLACK) + 1


def prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``(id, th, prefix)`` of each row: its place and the least hashes of its shingles, as many as :func:`_prefix_rows` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, 1)):
            least = []
            for text in text_bytes(part.column(1)):
                known = _hashes(_shingles(text, words))[1]
                least.append(known[: _prefix_rows(len(known), similarity)].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(least, pa.list_(pa.int64()))], ["id", "th", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col), F.col(text_col), _text_hash(text_col)).mapInArrow(tidy(run), f"id {kind}, th long, prefix array<long>")


def crowded_hashes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, crowd: int = CROWD, most: int = CROWDED) -> np.ndarray:
    """Hashes that stand in the prefixes of more than ``crowd`` different texts, sorted; if there are very many, the ``most`` frequent.

    They only settle an order, in which these come last; similar texts meet in any order.
    """
    own = prefixes(docs, id_col, text_col, words, similarity).groupBy("th").agg(F.min("prefix").alias("prefix"))
    met = own.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd)
    met = save(met, "crowded", clear=True)
    told = np.sort(np.array([r["h"] for r in met.orderBy(F.desc("m"), "h").limit(most).collect()], np.int64).view(np.uint64))
    drop(met)
    return told


def _hashes(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingle hashes, and the different ones of them, sorted."""
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in joined], np.uint64)
    known = np.sort(hashes)
    return hashes, known[np.concatenate([[True], known[1:] != known[:-1]])]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, last: np.ndarray) -> DataFrame:
    """``(id, th, fp, n, marks, prefix)`` of each row: its place, fingerprint, how many different shingles, the parity of
    the hashes at each of ``MARKS`` x 64 places, and the prefix of the hashes, those of ``last`` (sorted) after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, 1)):
            fps, counts, marks, least = [], [], [], []
            for text in text_bytes(part.column(1)):
                joined = _shingles(text, words)
                hashes, known = _hashes(joined)
                votes = np.concatenate([np.bincount(hashes.view(np.uint8).reshape(-1, 8)[:, j], minlength=256) @ _BITS for j in range(8)])
                bits = np.packbits(votes * 2 > len(joined), bitorder="little").view(np.uint64)[0]
                fps.append(bits if joined != [b""] else 0)
                counts.append(len(known))
                odd = np.bincount((known % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
                marks.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, known), len(last) - 1)] == known
                    known = np.concatenate([known[~late], known[late]])
                least.append(known[: _prefix_rows(len(known), similarity)].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (marks, least)]
            columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(counts, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["id", "th", "fp", "n", "marks", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = f"id {kind}, th long, fp long, n long, marks array<long>, prefix array<long>"
    return in_small_batches(docs).select(F.col(id_col), F.col(text_col), _text_hash(text_col)).mapInArrow(tidy(run), wanted)


def prefix_groups(nodes: DataFrame) -> DataFrame:
    """``(th, n, at, h, m)``: the prefix hashes of the texts that more than one text has, their places and how many texts have them."""
    cells = nodes.select("th", "n", F.posexplode("prefix").alias("at", "h"))
    return save(cells.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("m > 1"), "inprefix", clear=True)


def candidate_pairs(nodes: DataFrame, groups: DataFrame, similarity: float, distance: int = 3, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(a, b, bits)``, pairs of texts ``th`` of the table ``(th, fp, n, marks)`` that may be similar, and by how many
    bits their fingerprints differ.

    Of texts that share a prefix hash (:func:`prefix_groups`), all pairs if they are ``cell_rows`` or fewer, but for those
    whose sizes, places of the hash or marks leave too little in common.  Of larger groups each text is paired with
    one of them here, and the groups are returned as ``(h, th)``: :func:`crowd_links` finds what else they have.  And what the
    grid on fingerprints links.
    """

    def bits(x: str, y: str) -> Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))).alias("bits")

    def alike_in_size(n: str, m: str) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - SLACK

    few = groups.where(F.col("m") <= cell_rows)
    x, y = few.alias("x"), few.alias("y")
    # In the first hash that similar texts share, this and what comes after it is all that they can share.
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = left >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - SLACK
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("y.th") < F.col("x.th")) & alike_in_size("x.n", "y.n") & enough)
    few_pairs = met.select(F.col("x.th").alias("a"), F.col("y.th").alias("b")).distinct()
    many = groups.where(F.col("m") > cell_rows)
    centers = many.groupBy(F.col("h").alias("of")).agg(F.min_by("th", F.xxhash64("th")).alias("center"))
    through = many.join(centers, F.col("h") == F.col("of")).where("th <> center").select(F.greatest("th", "center").alias("a"), F.least("th", "center").alias("b")).distinct()
    one, two = (nodes.select(F.col("th").alias(t), F.struct("fp", "n", "marks").alias(f"of_{t}")) for t in ("a", "b"))
    both = few_pairs.union(through).join(one, "a").join(two, "b")
    # Each place where the marks differ is a shingle at least that only one of them has.
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col("of_a.marks")[k].bitwiseXOR(F.col("of_b.marks")[k])) for k in range(MARKS)])
    n, m = F.col("of_a.n"), F.col("of_b.n")
    near = both.where(alike_in_size("of_a.n", "of_b.n") & (apart <= (1 - similarity) / (1 + similarity) * (n + m) + SLACK))
    pairs = near.select("a", "b", bits("of_a.fp", "of_b.fp"))
    first = save(nodes.groupBy("fp").agg(F.min("th").alias("least")), "fingerprints")
    links = fingerprint_links(first.select("fp"), distance)
    named = links.withColumn("bits", bits("a", "b")).join(first.select(F.col("fp").alias("a"), F.col("least").alias("p")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("q")), "b")
    alike = nodes.join(first, "fp").where("th <> least").select(F.col("th").alias("a"), F.col("least").alias("b"), F.lit(0).alias("bits"))
    every = pairs.unionByName(alike).unionByName(named.select(F.col("p").alias("a"), F.col("q").alias("b"), "bits"))
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "bits").distinct(), many.select("h", "th")


def _similar_forest(th: list[int], root: list[int], sets: list[np.ndarray], own: np.ndarray, other: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the texts at the places ``own`` and ``other`` that connect, with what ``root`` connects already, all that are similar."""
    label = np.unique(np.array(root), return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    known, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    # Where the other texts stand, by token.
    held = np.concatenate([np.arange(ends[k] - n[k], ends[k]) for k in other])
    by_token = np.argsort(token[held], kind="stable")
    who = np.repeat(np.arange(len(other)), n[other])[by_token]
    starts = np.searchsorted(token[held][by_token], np.arange(len(known) + 1))
    found = []
    for k in own:
        asked = (label[other] != label[k]) & (np.minimum(n[other], n[k]) >= similarity * np.maximum(n[other], n[k]) - SLACK)
        if not asked.any():
            continue
        mine = token[ends[k] - n[k] : ends[k]]
        lists = [who[starts[t] : starts[t + 1]] for t in mine]
        common = np.bincount(np.concatenate(lists), minlength=len(other))
        for j in np.nonzero(asked & (common >= similarity * (n[other] + n[k] - common)))[0]:
            if label[other[j]] != label[k]:
                found.append((th[k], th[other[j]]))
                label[label == label[other[j]]] = label[k]
    return found


def crowd_links(members: DataFrame, texts: DataFrame, words: int, similarity: float, block_rows: int = CROWD_ROWS, block_hashes: int = CROWD_HASHES) -> DataFrame:
    """``(a, b)``: links of the texts of each crowd that connect, with what their roots connect already, exactly what
    all similar pairs of it connect.  ``members`` is ``(th, root, crowd)``, ``texts`` has the texts ``(th, text)``.

    A crowd is dealt into blocks; each pair of blocks is one bounded task, which compares the texts that are
    not connected yet by all of their shingle hashes and returns no more links than it has texts.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, 1)):
            sets = [_hashes(_shingles(t, words))[1].view(np.int64) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["th", "hashes"])

    asked = members.select("th").distinct()
    sets = save(texts.join(asked, "th", "left_semi").select("th", "text").mapInArrow(tidy(whole), "th long, hashes array<long>"), "crowd", clear=True)
    held = members.join(sets, "th")
    sizes = held.groupBy("crowd").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("hashes")).alias("n"))
    blocks = F.greatest(F.ceil(F.col("k") / block_rows), F.ceil(F.col("n") / block_hashes)).cast("int")
    dealt = held.join(sizes.select("crowd", blocks.alias("blocks")), "crowd").withColumn("own", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    dealt = dealt.select("crowd", "th", "root", "hashes", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("crowd", "th", "root", "hashes", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def block(rows: pa.Table) -> pa.Table:
        own, found = rows.column("own").to_numpy(), []
        x, y = (np.nonzero(own == rows.column(k)[0].as_py())[0] for k in ("i", "j"))
        if len(x) and len(y):
            lists = rows.column("hashes").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[a:b] for a, b in zip(ends, ends[1:])]
            found = _similar_forest(rows.column("th").to_pylist(), rows.column("root").to_pylist(), sets, x, y, similarity)
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return dealt.groupBy("crowd", "i", "j").applyInArrow(block, "a long, b long")


def verified_links(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs ``(a, b)``, those whose texts ``(th, text)`` have a Jaccard similarity of shingles that is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, 2)):
            one, two = (map(lambda t: set(_shingles(t, words)), text_bytes(part.column(k))) for k in (2, 3))
            ok = [len(p & q) >= similarity * len(p | q) for p, q in zip(one, two)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(texts.select(F.col("th").alias("a"), F.col("text").alias("p")), "a").join(texts.select(F.col("th").alias("b"), F.col("text").alias("q")), "b")
    return met.select("a", "b", "p", "q").mapInArrow(tidy(run), "a long, b long")


def similar_classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, distance: int = 3) -> DataFrame:
    """``(th, head)`` of each different text: the place of the document that stands for its class, over links of texts
    whose sets of ``words``-word shingles (lower-cased, as :func:`simhash` cuts them) are similar.  All such links count."""
    last = crowded_hashes(docs, id_col, text_col, words, similarity)
    own = sketches(docs, id_col, text_col, words, similarity, last)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = own.groupBy("th").agg(F.min(place).alias("head"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("marks").alias("marks"), F.min("prefix").alias("prefix"))
    prefixed = save(nodes, "texts", clear=True)
    groups = prefix_groups(prefixed)
    # The prefixes, most of the table, are not read again.
    nodes = save(prefixed.drop("prefix"), "texts")
    drop(prefixed)
    pairs, many = candidate_pairs(nodes.select("th", "fp", "n", "marks"), groups, similarity, distance)
    pairs = save(pairs.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))), "candidates", clear=True)
    asked = pairs.select(F.col("a").alias("th")).union(pairs.select(F.col("b").alias("th"))).union(many.select("th")).distinct().join(nodes.select("th", "head.id"), "th")
    own_id, own_th, th = names(docs, "id", "th", "h")
    hashed = docs.select(F.col(id_col).alias(own_id), _text_hash(text_col).alias(th), F.col(text_col).alias("text"))
    # One document stands for a text's copies, so its place is one row.
    at = asked.select(F.col("id").alias("asked_id"), F.col("th").alias("asked_th"))
    texts = hashed.join(at, F.col(own_id).eqNullSafe(F.col("asked_id")) & (F.col(th) == F.col("asked_th")), "left_semi")
    texts = save(texts.select(F.col(th).alias("th"), "text").dropDuplicates(["th"]), "asked", clear=True)
    links = save(verified_links(pairs.where(F.col("nth") <= NEAREST), texts, words, similarity), "links", clear=True)
    roots = save(connected_components(links), "roots")
    # Of the other candidates those that are not of one class yet.
    rest = pairs.where(F.col("nth") > NEAREST)
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        rest = rest.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    rest = save(rest.where("root_a <> root_b").select("a", "b"), "rest", clear=True)
    drop(pairs)
    if not rest.isEmpty():
        links = save(links.unionByName(verified_links(rest, texts, words, similarity)), "links", clear=True)
        roots = save(connected_components(links), "roots")
    # Of the large groups those that are not of one class yet, joined where they have texts in common.
    placed = many.join(roots, F.col("th") == F.col("node"), "left").select("h", "th", F.coalesce("root", "th").alias("root"))
    placed = save(placed, "placed", clear=True)
    drop(groups)
    parted = placed.groupBy(F.col("h").alias("of")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("th").alias("hub")).where("lo <> hi")
    members = save(placed.join(parted, F.col("h") == F.col("of")).select("th", "root", "hub"), "parted")
    if not members.isEmpty():
        crowds = save(connected_components(members, "th", "hub").select(F.col("node").alias("th"), F.col("root").alias("crowd")), "crowds")
        found = crowd_links(members.select("th", "root").distinct().join(crowds, "th"), texts, words, similarity)
        roots = save(connected_components(links.unionByName(found)), "roots")
    placed = nodes.join(roots, F.col("th") == F.col("node"), "left").select("th", "head", F.coalesce("root", "th").alias("root"))
    classes = save(placed.join(placed.groupBy("root").agg(F.min("head").alias("first")), "root").select("th", F.col("first").alias("head")), "heads", clear=True)
    for old in (nodes, texts):
        drop(old)
    return classes


def keep_one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3, similarity: float | None = None
) -> DataFrame:
    """``docs`` without all but one document of each class; the one with the least id stays.

    Classes are those of fingerprints, or with ``similarity`` those of texts that are that similar.

    Rows are told apart by id and text (by a hash of it; null and empty texts are alike), so
    a text of its own stays whatever other rows share its id.  Of rows that share both one
    stays.  Null ids come after all others.  An empty table gives no rows; other columns stay.
    """
    own_id, th, told, row = names(docs, "id", "th", "told", "row")
    classes = similar_classes(docs, id_col, text_col, words, similarity, distance) if similarity else _classes(docs, id_col, text_col, words, distance)[1]
    rows = docs.select(F.col(id_col).alias(own_id), _text_hash(text_col).alias(th), F.lit(False).alias(told), F.struct(*docs.columns).alias(row))
    heads = classes.select("head").distinct().select(F.col("head.id").alias(own_id), F.col("head.th").alias(th), F.lit(True).alias(told), F.lit(None).cast(rows.schema[row].dataType).alias(row))
    # One exchange of the documents, which meet their heads and their equals in it.
    met = rows.unionByName(heads).groupBy(own_id, th).agg(F.max(told).alias(told), F.first(row, ignorenulls=True).alias(row))
    return met.where(F.col(told) & F.col(row).isNotNull()).select(f"{row}.*")
