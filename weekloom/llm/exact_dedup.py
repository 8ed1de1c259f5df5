"""Exact dedup by content sort.

Rows are range-partitioned on bounded splitter keys (the first characters of the
normalised text, its SHA-256, the id) whose splitters Spark samples, and sorted
externally inside a partition on (start, digest, whole normalised text, id), so
equal texts are neighbours. One pass compares each whole text with the one
before it. The id belongs to the splitters, so a group of copies of any size is
spread over many partitions: a group that crosses partition borders is put
together from the first and last run of each partition, again by comparing the
whole texts. Only flags and numbers of those two runs per partition reach the
driver.

Defined results
  * null text counts as empty; empty texts equal each other.
  * rows with a null id take part and never stay while their group has an id;
    among rows without ids (or of one repeated id) the first in the sort stays.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow
from weekloom.runtime import stored

SPACES = r"[\x20\x09-\x0D]+"
START_CHARS = 32

RUNS = "id bigint, keep_id bigint, size bigint, kept boolean, sha string, part int, edge int, text string, alone boolean"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their run of equal texts; border runs carry the text once.

    ``edge``: 0 inside, 1 the partition's first run, 2 its last, 3 both.
    """
    part = TaskContext.get().partitionId()
    head = None  # (sha, text) of the open run
    ids: list[int | None] = []  # of the open run: within one partition, so bounded by its rows
    done: list[tuple] = []  # (ids, keep id, sha, edge, text of a border run)
    waiting = 0
    first = True

    def close(last: bool) -> None:
        edge = first + 2 * last
        done.append((ids, ids[0], head[0], edge, head[1] if edge else None))

    def emitted() -> pa.RecordBatch:
        sizes = np.array([len(d[0]) for d in done])
        starts = np.zeros(int(sizes.sum()), dtype=bool)
        at = np.cumsum(sizes) - sizes
        starts[at] = True
        edges = np.repeat(np.array([d[3] for d in done], dtype=np.int32), sizes)
        run = pa.array(np.repeat(np.arange(len(done)), sizes))
        of_first = pa.array(np.where(starts, np.repeat(np.arange(len(done)), sizes), 0), mask=~starts)
        return pa.RecordBatch.from_arrays([
            pa.array([i for d in done for i in d[0]], pa.int64()),
            pa.array([d[1] for d in done], pa.int64()).take(run), pa.array(np.repeat(sizes, sizes)), pa.array(starts),
            pa.array([d[2] for d in done], pa.string()).take(run), pa.array(np.full(len(starts), part, np.int32)), pa.array(edges),
            pa.array([d[4] for d in done], pa.string()).take(of_first), pa.array(starts & (edges > 0)),
        ], names=["id", "keep_id", "size", "kept", "sha", "part", "edge", "text", "alone"])

    for b in batches:
        if not b.num_rows:
            continue
        sha, text, own = b.column("sha").to_pylist(), b.column("norm"), b.column("id").to_pylist()
        new = np.empty(b.num_rows, dtype=bool)
        new[0] = head is None or head[1] != text[0].as_py()
        new[1:] = np.asarray(pc.not_equal(text[1:], text[:-1]))
        bounds = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            if k:
                if head is not None:
                    close(False)
                    first = False
                    waiting += len(ids)
                head, ids = (sha[lo], text[lo].as_py()), []
            ids.extend(own[lo:hi])
        if waiting >= 4096:
            yield emitted()
            done, waiting = [], 0
    if head is not None:
        close(True)
        yield emitted()


def _joined_runs(edges: DataFrame) -> list[tuple]:
    """(part, edge kind, keep id, size, owner) of groups that cross partition borders."""
    borders = edges.select("part", "edge", "keep_id", "size", "sha", "text")
    order = sorted(r.part for r in borders.select("part").distinct().collect())
    if len(order) < 2:
        return []
    following = edges.sparkSession.createDataFrame(list(zip(order[:-1], order[1:])), "part int, next_part int")
    last = borders.filter("edge IN (2, 3)").select("part", F.col("text").alias("last_text"))
    opening = borders.filter("edge IN (1, 3)").select(F.col("part").alias("next_part"), F.col("text").alias("first_text"))
    same = {r.next_part for r in last.join(following, "part").join(opening, "next_part").filter("last_text = first_text").select("next_part").collect()}
    runs = {(r.part, e): r for r in borders.drop("text", "sha").collect() for e in ((1, 2) if r.edge == 3 else (r.edge,))}
    out, chain = [], []

    def finish() -> None:
        if len(chain) > 1:
            size = sum(r.size for r in chain)
            keep = next((r.keep_id for r in chain if r.keep_id is not None), None)
            owner = next((r.part for r in chain if r.keep_id is not None), chain[0].part)
            out.extend((r.part, r.edge, keep, size, r.part == owner) for r in chain)

    for part in order:
        opening_run = runs[part, 1]
        if part not in same:
            finish()
            chain = []
        chain.append(opening_run)
        if opening_run.edge != 3:
            finish()
            chain = [runs[part, 2]]
    finish()
    return out


def dedup_by_content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).select(
        "id", "norm", F.substring("norm", 1, START_CHARS).alias("start"), F.sha2("norm", 256).alias("sha"))
    keys = [F.col("start"), F.col("sha"), F.col("id").asc_nulls_last()]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions("start", "sha", "norm", F.col("id").asc_nulls_last())
    runs = stored(ordered.select("id", "sha", "norm").mapInArrow(_runs, RUNS), "runs")
    crossing = _joined_runs(runs.filter("alone"))
    plain = runs.select("id", "keep_id", "size", "kept", "sha", "part", "edge")
    if crossing:  # at most two rows for each partition
        fixes = spark.createDataFrame(crossing, "part int, edge int, group_keep bigint, group_size bigint, owner boolean")
        plain = plain.join(F.broadcast(fixes), ["part", "edge"], "left").select(
            "id", F.when(F.col("group_size").isNull(), F.col("keep_id")).otherwise(F.col("group_keep")).alias("keep_id"),
            F.coalesce("group_size", "size").alias("size"), (F.col("kept") & F.coalesce("owner", F.lit(True))).alias("kept"), "sha")
    return plain.select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
