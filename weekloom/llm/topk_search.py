"""Exact top-k inner products by no-random-access aggregation.

Vectors and queries are cut into blocks; every query block meets every vector
block once. Within a block each dimension is a list sorted by value. A query
reads the lists of its positive components from the top and those of its
negative ones from the bottom, all to one depth at a time. At depth r a read
entry counts exactly, an unread one lies between the last value read and the
list's far end: that gives every vector a lower and an upper score bound. When
few vectors can still reach the k-th lower bound, reading stops and only their
scores are finished. Blocks already seen by a task lend their k-th score.

Defined results
  * vectors that are null, hold a null or non-finite component or have no id
    take no part; shorter vectors count as ending in zeros.
  * a repeated id is several candidates and several queries, none of which is a
    candidate for a query of the same id.
  * ties go to the smaller id; with fewer than k candidates all are returned.
  * scores beyond a long are saturated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.runtime import stored

DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4)
VECTOR_ROWS, QUERY_ROWS = 2048, 512
LENT = 64  # query blocks whose k-th scores a task remembers
LONG_MAX = (1 << 63) - 1


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): components as floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _block(ids: list[int], vectors: list[list[int]], key: int) -> tuple:
    width = max(map(len, vectors))
    m = np.zeros((len(ids), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return key, np.array(ids, dtype="<i8").tobytes(), m.astype("<i8").tobytes(), width


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[list[int]] = []

        def closed():
            row = _block(ids, vectors, (part << 32) + number)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32()))],
                                              names=["block", "ids", "data", "width"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == most:
                    yield closed()
                    ids, vectors, number = [], [], number + 1
        if ids:
            yield closed()

    return run


def _matrix(ids: bytes, data: bytes, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    m = np.frombuffer(data, dtype="<i8").reshape(len(i), width)
    return i, np.pad(m, ((0, 0), (0, to - width))) if to > width else m


def kth_largest(a: np.ndarray, k: int) -> np.ndarray:
    return np.partition(a, a.shape[1] - k, axis=1)[:, a.shape[1] - k]


def block_topk(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, id, score) of each query's k best of one block, those at least ``floor``."""
    n = len(ids)
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    own = qid[:, None] == ids[None, :]
    if kind is object:  # beyond what doubles hold: whole lists, Python integers
        scores = q.astype(object) @ x.astype(object).T
        rows, cols = np.nonzero(~own)
        found = scores[rows, cols]
    else:
        q, x = q.astype(kind), x.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        lists = np.sort(x, axis=0)
        kth = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
        few = max(4 * k, n // 16) * len(q)
        alive = None
        for share in DEPTHS:
            r = max(1, int(n * share))
            top, bottom = lists[n - r], lists[r - 1]
            upper = up @ np.maximum(x, top).T + down @ np.minimum(x, bottom).T
            upper[own] = -np.inf
            lower = up @ np.where(x >= top, x, lists[0]).T + down @ np.where(x <= bottom, x, lists[-1]).T
            lower[own] = -np.inf
            if n >= k:
                kth = np.maximum(kth, kth_largest(lower, k))
            alive = (upper >= kth[:, None]) & ~own
            if np.count_nonzero(alive) <= few:
                break
        else:  # the lists are read to their ends
            scores = up @ x.T + down @ x.T
            scores[own] = -np.inf
            if n >= k:
                kth = np.maximum(kth, kth_largest(scores, k))
            alive = (scores >= kth[:, None]) & ~own
        rows, cols = np.nonzero(alive)
        found = np.empty(len(rows), dtype=kind)
        for lo in range(0, len(rows), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            found[part] = np.einsum("ij,ij->i", q[rows[part]], x[cols[part]])
    order = np.lexsort((ids[cols], -found if kind is not object else np.array([-s for s in found], dtype=float), rows))
    if kind is object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -found[i], ids[cols[i]])), dtype=int)
    rows, cols, found = rows[order], cols[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = place < k
    return rows[best], ids[cols[best]], found[best]


def _meet(k: int):
    names = ["q_block", "q_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lent: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                to = max(row["q_width"], row["width"])
                qid, q = _matrix(row["q_ids"], row["q_data"], row["q_width"], to)
                ids, x = _matrix(row["ids"], row["data"], row["width"], to)
                floor = lent.get(row["q_block"])
                rows, found, scores = block_topk(qid, q, ids, x, k, floor)
                kth = np.full(len(qid), -np.inf) if floor is None else floor
                count = np.bincount(rows, minlength=len(qid))
                last = np.cumsum(count) - 1
                full = count == k
                kth = kth.copy()
                kth[full] = np.maximum(kth[full], scores[last[full]].astype(float))
                while len(lent) >= LENT:
                    lent.pop(next(iter(lent)))
                lent[row["q_block"]] = kth
                whole = [max(-LONG_MAX - 1, min(LONG_MAX, int(s))) for s in scores]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), row["q_block"])), pa.array(rows.astype(np.int32)), pa.array(qid[rows]),
                    pa.array(found), pa.array(whole, pa.int64())], names=names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (id, v) from ``whole_vectors``."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # blocks are rows of up to a megabyte
    schema = "block bigint, ids binary, data binary, width int"
    v = stored(vectors.mapInArrow(_blocks(VECTOR_ROWS), schema), "vectors")
    q = stored(queries.mapInArrow(_blocks(QUERY_ROWS), schema), "queries").select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"))
    pairs = q.select("q_block").crossJoin(v.select("block"))  # block numbers only
    met = pairs.join(q, "q_block").join(v, "block")
    found = met.mapInArrow(_meet(k), "q_block bigint, q_row int, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("q_block", "q_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
