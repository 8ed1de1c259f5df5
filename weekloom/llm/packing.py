"""Packing by concatenate and cut.

Pass one tokenises every document inside its partition and stores the ids with
their place in the partition. The totals of the partitions, one number each, are
prefix-summed to partition offsets; pass two adds them, so each document knows
its global place and windows of ``size`` ids cut it. A document that crosses a
window border gives one record per window it touches.

Defined results
  * null and empty texts are the closing id alone.
  * documents follow each other in the order of the stored partitions; repeated
    rows and repeated or null ids are packed one by one.
  * all sequences are full but the last, which is padded to ``size`` unless its
    length is a power of two.
  * an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow, groups_of
from weekloom.llm.tokens import CachedTokenizer
from weekloom.runtime import stored

SEQUENCE = 1024
CLOSING = 0
OUT_BYTES = 8 << 20


def _token_rows(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = CachedTokenizer.shared(tokenizer_path)
        part, place = TaskContext.get().partitionId(), 0
        closing = np.array([CLOSING], dtype="<u4").tobytes()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in groups_of([len(t) for t in texts]):
                ids = [x + closing for x in tok.encode(texts[lo:hi])]
                counts = [len(x) // 4 for x in ids]
                places = list(accumulate(counts, initial=place))
                place = places.pop()
                yield pa.RecordBatch.from_arrays([
                    b.column("id")[lo:hi], pa.array([part] * (hi - lo), pa.int32()), pa.array(places, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                ], names=["id", "part", "place", "n", "ids"])

    return run


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (id, part, place, n, ids): little-endian unsigned 32-bit ids and the ids before them in the partition."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(_token_rows(tokenizer_path), "id bigint, part int, place bigint, n bigint, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer_path, id_col, text_col)
    # One row per partition of pass one, whatever the partitions hold.
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    before = accumulate((t for _, t in totals), initial=0)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, before bigint")
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("place"))
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)

    def piece(w):
        lo = F.greatest(w * size, F.col("at"))
        hi = F.least((w + 1) * size, F.col("at") + F.col("n"))
        return F.struct(
            (lo - F.col("at")).alias("start"), (hi - lo).alias("length"),
            F.substring(F.col("ids"), ((lo - F.col("at")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
            w.alias("sequence_id"), (lo - w * size).alias("offset"))

    return placed.select("id", "n", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select(
        F.col("id").alias(id_col), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


def padded_length(length: int, size: int = SEQUENCE) -> int:
    """Length after padding: only the last sequence can be short."""
    return length if length & (length - 1) == 0 else size
