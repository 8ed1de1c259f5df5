"""Helpers the operators share: Arrow batch bounds, byte spans and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
SALTS = 8
MOST = (1 << 32) - 1


def bounded_arrow(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that go to Python by rows and bytes, as one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def groups_of(sizes: list[int], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``most``; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class SpanHash:
    """64-bit polynomial hashes of byte spans, from one running sum over the buffer."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) > n:
            return
        size = max(n + 1, PIECE_BYTES + 1)
        for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def table_rows(counts: np.ndarray, slots: int) -> pa.RecordBatch:
    """A task's counter table as ``slots`` rows (slot, salt, counts)."""
    pieces = np.minimum(counts, MOST).astype("<u4").reshape(slots, -1)
    salt = TaskContext.get().partitionId() % SALTS
    return pa.RecordBatch.from_arrays([
        pa.array(range(slots), pa.int32()), pa.array([salt] * slots, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())],
        names=["slot", "salt", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, counts in zip(b.column("slot").to_pylist(), b.column("counts").to_pylist()):
            sums[slot] = sums.get(slot, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
    yield pa.RecordBatch.from_arrays([
        pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, MOST).astype("<u4").tobytes() for v in sums.values()], pa.binary())],
        names=["slot", "counts"])


def summed_table(rows: DataFrame, size: int, slots: int) -> np.ndarray:
    """The counter tables of all tasks added up, salted first; the result has a fixed size."""
    part = rows.select("slot", "salt", "counts").repartition("slot", "salt").select("slot", "counts").mapInArrow(_added, "slot int, counts binary")
    out = np.zeros((slots, size // slots), dtype=np.int64)
    for r in part.repartition("slot").mapInArrow(_added, "slot int, counts binary").collect():
        out[r.slot] = np.frombuffer(r.counts, "<u4")
    return out.reshape(-1)
