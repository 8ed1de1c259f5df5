"""N-gram Jaccard join by T-occurrence search: linked documents and their components.

A document is its set of distinct word shingles; equal sets are one class. Two
sets link at similarity 0.8, so a set of n needs T = ceil(0.8 n) shingles of any
partner. Every set offers its n - T + k rarest shingles (its short lists,
k = ceil(n / 20)); partners share k of them at least, so the rest (the long
lists) is not moved. "Rare" means the order of a fixed-size counter table over
all documents, which only decides the order, not the result.

 1. one pass gives each row its class key and adds up the counters;
 2. the short lists are built by a shuffle on the shingle; classes that share too
    few shingles are done;
 3. each remaining class belongs to the cell of its longest short list, and asks
    every cell that it shares k short lists with. Cells are cut into blocks and
    their askers into chunks, so a cell of any size is spread;
 4. a block builds its inverted lists, and each asker runs DivideSkip over them:
    short lists are heap-merged, long ones probed by binary search. Links that
    join something new are kept, all others are implied;
 5. distributed union-find over the links.

No pairs of copies are made, and no list is ever expanded into its pairs.

Defined results
  * null, empty and blank texts: 0 shingles, linked with nothing.
  * rows with a null id link like others but do not name a component; a
    component without any id has a null component_id.
  * repeated rows and ids: each row gets the component of its own text.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow, groups_of, summed_table, table_rows
from weekloom.llm.components import connected
from weekloom.llm.overlap_index import OverlapIndex, least_overlap
from weekloom.llm.shingles import set_key, shingle_sets
from weekloom.runtime import stored

COUNTERS = 1 << 18
SLOTS = 8  # pieces of the counter table
BLOCK, CHUNK = 256, 1024  # sets of an index block, askers that meet it in one task
SEEN = 1 << 20  # class keys a task remembers, so that copies offer their lists once
FLUSH = 1 << 16
LIGHT_ROWS = 1_000_000


def shared_least(n: int) -> int:
    """Short lists that a set of n offers beyond the least, and shares with a partner."""
    return max(1, -(-n // 20))


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    texts = [t or "" for t in b.column("text").to_pylist()]
    for lo, hi in groups_of([len(t) for t in texts]):
        yield lo, hi, shingle_sets(texts[lo:hi])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "key", "again", "n", "slot", "salt", "counts"]
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for b in batches:
        for lo, hi, sets in _sets(b):
            keys = [set_key(s) for s in sets]
            places = np.concatenate(sets) & np.uint64(COUNTERS - 1)
            counts += np.bincount(places.astype(np.int64), minlength=COUNTERS)
            k = hi - lo
            yield pa.RecordBatch.from_arrays([
                b.column("id")[lo:hi], pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
            ], names=names)
    table = table_rows(counts, SLOTS)
    yield pa.RecordBatch.from_arrays([*[pa.nulls(SLOTS, pa.int64())] * 4, *table.columns], names=names)


def _postings(counters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counters.value
        seen: set[int] = set()
        lists, keys, sizes, waiting = [], [], [], 0

        def emitted():
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in lists])),
                pa.array(np.repeat(np.array(sizes, np.int32), [len(x) for x in lists]))], names=["shingle", "key", "n"])

        for b in batches:
            for _, _, sets in _sets(b):
                for s in sets:
                    key = set_key(s)[0]
                    if not len(s) or key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    n = len(s)
                    keep = n - least_overlap(n) + shared_least(n)
                    order = np.lexsort((s, table[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    lists.append(s[order[:keep]])
                    keys.append(key)
                    sizes.append(n)
                    waiting += keep
                if waiting >= FLUSH:
                    yield emitted()
                    lists, keys, sizes, waiting = [], [], [], 0
        if lists:
            yield emitted()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct postings of lists with two members or more, from rows sorted by (shingle, key); a list may span batches."""
    tail: list[np.ndarray] | None = None
    names = ["shingle", "key", "n", "held"]

    def lists(cols: list[np.ndarray]):
        s, k, n = cols
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        s, k, n = s[new], k[new], n[new]
        _, inverse, held = np.unique(s, return_inverse=True, return_counts=True)
        held = held[inverse]
        many = held > 1
        return pa.RecordBatch.from_arrays([pa.array(s[many]), pa.array(k[many]), pa.array(n[many]), pa.array(held[many])], names=names)

    for b in batches:
        cols = [np.asarray(b.column(c)) for c in ("shingle", "key", "n")]
        if tail is not None:
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
        if cut:
            yield lists([c[:cut] for c in cols])
        tail = [c[cut:] for c in cols]
    if tail is not None:
        yield lists(tail)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cell) for every member of a list and every distinct cell on it, from rows sorted by shingle."""
    names = ["key", "cell"]
    shingle, keys, cells = None, [], []

    def pairs():
        k = np.array(keys, np.int64)
        c = np.unique(np.array(cells, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(k, len(c))), pa.array(np.tile(c, len(k)))], names=names)

    done, waiting = [], 0
    for b in batches:
        for s, k, c in zip(*(b.column(x).to_pylist() for x in ("shingle", "key", "cell"))):
            if s != shingle:
                if len(keys) > 1:
                    done.append(pairs())
                    waiting += done[-1].num_rows
                shingle, keys, cells = s, [], []
                if waiting >= FLUSH:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done, waiting = [], 0
            keys.append(k)
            cells.append(c)
    if len(keys) > 1:
        done.append(pairs())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def _kept_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, sets in _sets(b):
            yield pa.RecordBatch.from_arrays([
                pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                names=["key", "shingles"])


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (cell, block, chunk), whose index rows come before its askers."""
    place, members, sets, index, forest = None, [], [], None, _Forest()
    for b in batches:
        links = []
        for cell, block, chunk, asks, key, shingles in zip(*(b.column(x).to_pylist() for x in ("cell", "block", "chunk", "asks", "key", "shingles"))):
            if (cell, block, chunk) != place:
                place, members, sets, index, forest = (cell, block, chunk), [], [], None, _Forest()
            s = np.frombuffer(shingles, "<u8")
            if not asks:
                members.append(key)
                sets.append(s)
                continue
            if index is None:
                index = OverlapIndex(sets)
                sets = []
            for m in index.search(s)[0].tolist():
                if members[m] != key and forest.joins(key, members[m]):
                    links.append((key, members[m]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _links(docs: DataFrame, rows: DataFrame, counters) -> DataFrame:
    postings = docs.select("text").mapInArrow(_postings(counters), "shingle bigint, key bigint, n int")
    shared = stored(
        postings.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(_shared, "shingle bigint, key bigint, n int, held bigint"), "shared")
    # least lists shared with a partner, which has at least four fifths of the shingles
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * 4 / 5) / 20))
    # the cell is the longest list; its length and a mixed shingle share one number
    rank = F.col("held") * (1 << 40) + F.pmod(F.col("shingle"), F.lit(1 << 40))
    classes = stored(shared.groupBy("key", "n").agg(F.count("*").alias("lists"), F.max(rank).alias("cell")).filter(F.col("lists") >= least).select(
        "key", "cell", least.alias("least")), "classes")
    asked = shared.select("shingle", "key").join(classes.select("key", "cell"), "key").repartition("shingle").sortWithinPartitions("shingle").mapInArrow(
        _asked, "key bigint, cell bigint").groupBy("key", "cell").agg(F.count("*").alias("lists"))
    asks = stored(asked.join(classes.select("key", "least"), "key").filter("lists >= least").select("key", "cell"), "asks")
    sizes = stored(classes.groupBy("cell").agg(F.count("*").alias("members")).join(asks.groupBy("cell").agg(F.count("*").alias("askers")), "cell").select(
        "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("askers") / CHUNK).cast("int").alias("chunks")), "sizes")
    own, all_of = F.xxhash64("key"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = classes.select("key", "cell").join(sizes, "cell").select(
        "cell", F.pmod(own, F.col("blocks")).cast("int").alias("block"), all_of("chunks").alias("chunk"), F.lit(False).alias("asks"), "key")
    asking = asks.join(sizes, "cell").select(
        "cell", all_of("blocks").alias("block"), F.pmod(own, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"), "key")
    wanted = stored(rows.join(classes.select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("wanted")).select("wanted").distinct(), "wanted")
    if wanted.limit(LIGHT_ROWS + 1).count() <= LIGHT_ROWS:  # 8 MB at most; beyond it the join is shuffled
        wanted = F.broadcast(wanted)
    sets = stored(docs.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(
        _kept_sets, "key bigint, shingles binary").groupBy("key").agg(F.min("shingles").alias("shingles")), "sets")
    met = indexed.union(asking).join(sets, "key").repartition("cell", "block", "chunk").sortWithinPartitions("cell", "block", "chunk", "asks")
    return met.select("cell", "block", "chunk", "asks", "key", "shingles").mapInArrow(_searched, "a bigint, b bigint")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    passed = stored(texts.mapInArrow(_first_pass, "id bigint, key bigint, again bigint, n bigint, slot int, salt int, counts binary"), "sets-seen")
    rows = passed.filter("slot IS NULL").select("id", "key", "again", "n")
    mixed_up = rows.groupBy("key").agg(F.min("again").alias("x"), F.max("again").alias("y")).filter("x <> y").limit(1).count()
    if mixed_up:
        raise RuntimeError("two different shingle sets share a 64-bit key; change the seed in shingles.set_key")
    counters = spark.sparkContext.broadcast(summed_table(passed.filter("slot IS NOT NULL"), COUNTERS, SLOTS))
    links = stored(_links(texts, rows, counters), "links")
    roots = connected(links, "a", "b")
    # named by class, so that a class of many rows is one row here
    named = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("first"))
    at_root = named.join(roots.withColumnRenamed("id", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    names = at_root.groupBy("root").agg(F.min("first").alias("component"))
    of_class = at_root.filter("root IS NOT NULL").join(names, "root").select(F.col("key").alias("class"), "component")
    out = rows.join(of_class, F.col("key") == F.col("class"), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))
