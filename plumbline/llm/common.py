"""Helpers shared by the operators: written intermediate tables, text buffers, word hashes and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.operators.materialise import ensure_checkpoint_dir, leaves_with_session

#: Bytes of text that one vectorised pass handles at a time; a longer text is one pass of its own.
SEGMENT = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there; the files go when the session ends."""
    spark = df.sparkSession
    path = leaves_with_session(spark, f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: T.StructType, more: str) -> T.StructType:
    """``schema`` with the columns of the DDL string ``more`` behind its own."""
    return T.StructType(schema.fields + T.StructType.fromDDL(more).fields)


def releasing(fn, encodes: bool = False):
    """``fn`` over the batches of a task; afterwards the worker, which waits for other tasks, gives free memory back.

    What the worker remembers of tokens goes before a task that does not encode.
    """

    def run(batches):
        if not encodes:
            forget_encoders()
        yield from fn(batches)
        trim()

    return run


def forget_encoders() -> None:
    import sys

    if sys.__dict__.pop("_unit_encoders", None):
        trim()


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and the n + 1 offsets into it; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    return (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)), offsets


def segments(offsets: np.ndarray, limit: int = SEGMENT):
    """Consecutive ranges (first, last + 1) of texts of at most ``limit`` bytes together, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class WordHasher:
    """64-bit hashes of words in a byte buffer, all at once.

    ``keep`` marks the bytes that belong to words and ``fold`` replaces bytes before hashing. A word's hash is a random
    polynomial over its bytes, taken from one running sum, so that no word is ever copied or looked at on its own.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, keep: np.ndarray, fold: np.ndarray):
        self.keep = keep
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[fold]
        self.power = self.inverse = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            n = max(n + 1, SEGMENT + 1)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word; words end with their text."""
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.keep[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        cut = offsets[1:-1]
        starts_here, ends_here = inside & ~before, before & ~inside
        joined = cut[(cut > 0) & (cut < len(data))]
        joined = np.unique(joined[inside[joined] & before[joined]])
        starts_here[joined] = ends_here[joined] = True
        starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def lower_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, label) per node, label the smallest node reachable.

    Every round sends each node to the first of itself and its neighbours and keeps only the links between different
    images. First is the smallest number in one round, so that the leaves of a least centre go at once, and the smallest
    random number in the next, which shortens chains by a constant share. So links shrink geometrically, whatever their
    shape. Rounds are written; only whether links are left comes to the driver.
    """
    left = stored(edges.select("a", "b").distinct())
    rounds = []
    while not rounds or left.limit(1).count():
        n = len(rounds)
        place = lambda c: F.struct((F.xxhash64(F.lit(n), c) if n % 2 else F.col(c)).alias("rank"), F.col(c).alias("v"))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", place("a"))["v"].alias("label"))
        rounds.append(stored(first))
        one, two = (rounds[-1].select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b"))
        left = stored(left.join(one, "a").join(two, "b").filter("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    labels = rounds.pop()
    while rounds:  # an image of an earlier round has moved on in the later ones, if it still had links
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        labels = stored(rounds.pop().join(later, "label", "left").select("node", F.coalesce("end", "label").alias("label")))
    return named_by_least(labels)


def named_by_least(labels: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by the least of its nodes."""
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return stored(labels.join(least, "label").select("node", F.col("least").alias("label")))
