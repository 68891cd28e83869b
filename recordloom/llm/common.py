"""Helpers of the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.tables import spread

#: Bytes that are upper-case ASCII letters, lowered; all others as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every byte that belongs to no word (of letters, digits and non-ASCII) is a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts are dealt over all cores if their files give fewer tasks."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def once(value: Column) -> Column:
    """The value, worked out where it is named: neither a filter nor a later projection that
    uses it several times (or for each element of an array) repeats it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def without(text: Column, characters: str, instead: str = "") -> Column:
    """``text`` with each of the characters replaced, without a regular expression."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(instead)), characters, text)


def spaced_words(text: Column) -> Column:
    """Runs of anything but ASCII white space, as an array."""
    return F.array_remove(F.split(without(text, "\t\n\x0b\x0c\r", " "), " "), "")


def names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names for an operator's own use that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(f"{mark}{w}".lower() in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


#: Text that goes to a worker, or back, in one Arrow batch, in bytes; Spark's own bound is 64 MB, and both sides hold some batches.
BATCH_BYTES = 8_000_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends no larger Arrow batches than ``BATCH_BYTES`` from now on."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


#: Text that a worker turns into Python objects at once, in bytes.
PART_BYTES = 1_000_000


def parts(batch: pa.RecordBatch, at: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of its column ``at``, of one row at least."""
    if not len(batch):
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, most + (size[lo - 1] if lo else 0), "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_KEPT: dict[str, object] = {}


def trim() -> None:
    """Gives freed memory back: Spark keeps a worker for its next task, which may be long in coming."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if back is not None:
        back(0)


def let_go(but: str | None = None) -> None:
    """Frees what other operators' tasks left in this worker process."""
    others = _KEPT.keys() - {but}
    for name in others:
        del _KEPT[name]
    if others:
        trim()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that holds nothing of other operators, and nothing when it has ended."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        trim()

    return tidied


def kept(name: str, make: Callable[[], object]) -> object:
    """What an operator's tasks keep in a worker from one to the next; a worker keeps one operator's only."""
    let_go(name)
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]
