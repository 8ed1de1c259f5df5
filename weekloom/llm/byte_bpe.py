"""Byte-level BPE: ranked merges over the bytes of a task's distinct words, all words of a batch at once.

A pattern cuts every text into words on the JVM. A task numbers its distinct
words; each is encoded once there: every round merges in each word the
adjacent pair of the lowest rank, leftmost first, until no pair has a rank. The
ranks are a perfect hash of all pairs of pieces that make a piece,
so a lookup reads one slot. Pieces that no merges lead to are taken from a list of
their own. The documents' word numbers are then replaced by ids. Nothing is shuffled and no state outlives a task; a
task forgets its words when they pass ``MOST_WORDS`` or ``MOST_BYTES`` and goes on.

A round moves all pieces of the words that are left, which is quadratic in the length
of one word. Words over ``LONG`` bytes are therefore merged by the same rule with
a heap inside the task, which gives the same ids. ``encoded_word`` states the merges
once more as a column expression, for words that a table holds as arrays of bytes.

Decoding joins the pieces of the ids, held as hexadecimal digits, and turns the
whole into bytes, in time linear in the text.

Defined results
  * null and empty texts have no ids, and decode to no bytes; null ids decode to null.
  * repeated rows and repeated or null document ids are encoded one by one.
  * an id outside the vocabulary adds nothing to decoded bytes.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow

SLOTS = 1 << 17
GROUPS = 32_749
SPREAD = 1_640_531_527
NO_RANK = 1 << 16
LONG = 512
MOST_WORDS = 300_000
MOST_BYTES = 16 << 20

# The code points of the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The split pattern with white space spelled out, as ``\\s`` and ``\\S`` are ASCII on the JVM."""
    inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
    return inside.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


def byte_ids(ranks: dict[bytes, int]) -> list[int]:
    return [ranks[bytes([b])] for b in range(256)]


def _home(key):
    """Slot of a pair before its displacement; on numbers and on columns."""
    product = key * SPREAD
    return F.shiftright(product, 20) % SLOTS if isinstance(key, Column) else (product >> 20) % SLOTS


def pair_slots(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """A perfect hash of the pairs of pieces that make a piece: slots of ``pair * 2^16 + rank`` (-1: free), displacements.

    A pair is ``left * 2^16 + right`` in ids. Groups of pairs take the first displacement that
    puts all of them on free slots, large groups first.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(GROUPS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                pair = left << 16 | right
                groups[pair % GROUPS].append((_home(pair), pair << 16 | rank))
    slots, moves = [-1] * SLOTS, [0] * GROUPS
    for g in sorted(range(GROUPS), key=lambda g: -len(groups[g])):
        homes = [h for h, _ in groups[g]]
        if len(set(homes)) < len(homes):
            raise ValueError("two pairs of a group share a home slot")
        moves[g] = next(m for m in range(SLOTS) if all(slots[(h + m) % SLOTS] < 0 for h in homes))
        for h, entry in groups[g]:
            slots[(h + moves[g]) % SLOTS] = entry
    return slots, moves


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one foldable struct: ids of the bytes, slots and displacements of the pairs."""
    slots, moves = pair_slots(ranks)
    text = json.dumps({"bytes": byte_ids(ranks), "slots": slots, "moves": moves}, separators=(",", ":"))
    return F.from_json(F.lit(text), "struct<bytes:array<bigint>,slots:array<bigint>,moves:array<bigint>>")


class PairTable:
    """The ranks as arrays: ids of the bytes, slots and displacements of the pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        slots, moves = pair_slots(ranks)
        self.bytes, self.slots, self.moves = (np.array(x, np.int64) for x in (byte_ids(ranks), slots, moves))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NO_RANK`` or more where they make no piece."""
        pair = left << 16 | right
        return (self.slots[(_home(pair) + self.moves[pair % GROUPS]) % SLOTS] - (pair << 16)) & ((1 << 63) - 1)


def merge_words(table: PairTable, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, ids) of words given as their bytes one after another: word w has ``ids[begin[w]: begin[w] + size[w]]``.

    A round makes one merge in every word that has one; words without leave the arrays.
    """
    begin, size = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    word = np.flatnonzero(sizes)
    n = sizes[word]
    ids = table.bytes[data]
    ranks = np.full(len(ids), NO_RANK, np.int64)  # of the pair that a piece opens
    ranks[:-1] = np.minimum(table.rank(ids[:-1], ids[1:]), NO_RANK)
    ranks[np.cumsum(n) - 1] = NO_RANK
    out, used = [np.zeros(0, np.int64)], 0
    while len(word):
        stop = np.cumsum(n)
        start = stop - n
        low = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), start)
        more = low < NO_RANK << 32
        kept = np.repeat(more, n)
        out.append(ids[~kept])
        size[word[~more]] = n[~more]
        begin[word[~more]] = used + np.cumsum(n[~more]) - n[~more]
        used += len(out[-1])
        low, start, stop = low[more], start[more], stop[more]
        at = low & ((1 << 32) - 1)
        ids[at] = low >> 32
        ranks[at] = NO_RANK
        left = np.concatenate([at[at + 2 < stop], at[at > start] - 1])  # its pieces after and before have a new neighbour
        right = np.concatenate([at[at + 2 < stop] + 2, at[at > start]])
        ranks[left] = np.minimum(table.rank(ids[left], ids[right]), NO_RANK)
        kept[at + 1] = False
        ids, ranks, word, n = ids[kept], ranks[kept], word[more], n[more] - 1
    return begin, size, np.concatenate(out)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(table: Column, left: Column, right: Column) -> Column:
    """Rank of a pair of ids; ``NO_RANK`` or more if it makes no piece, null without a right side.

    The slot of another pair, or a free one, differs from the pair by too much or becomes
    large without its sign.
    """
    pair = left * 65536 + right
    slot = (_home(pair) + F.get(table.moves, (pair % GROUPS).cast("int"))) % SLOTS
    return (F.get(table.slots, slot.cast("int")) - pair * 65536).bitwiseAND((1 << 63) - 1)


def _merge(table: Column, state: Column) -> Column:
    """One merge: the leftmost pair of the lowest rank becomes one piece, its two neighbouring pairs are ranked anew."""
    ids, ranks = state.ids, state["ranks"]

    def at(low: Column, k: Column) -> Column:  # k counts from 1: the pair's right piece has index k
        joined = F.transform(ids, lambda x, i: F.when(i == k - 1, low).otherwise(x))
        ranked = F.transform(ranks, lambda r, i: F.when(i == k - 1, _rank(table, low, F.get(ids, k + 1))).when(
            i == k - 2, _rank(table, F.get(ids, i), low)).otherwise(r))
        return F.struct(F.filter(joined, lambda _, i: i != k).alias("ids"), F.filter(ranked, lambda _, i: i != k).alias("ranks"))

    return _let(F.array_min(ranks), lambda low: F.when(low < NO_RANK, _let(
        F.array_position(ranks, low).cast("int"), lambda k: at(low, k))).otherwise(state))


def encoded_word(table: Column, word: Column) -> Column:
    """Ids of one word given as an array of bytes.

    The fold's state is the ids of the pieces and, for each, the rank of the pair that it opens.
    """
    def folded(ids: Column) -> Column:
        start = F.struct(ids.alias("ids"), F.transform(ids, lambda x, i: _rank(table, x, F.get(ids, i + 1))).alias("ranks"))
        return F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, lambda state, _: _merge(table, state), lambda state: state.ids)

    return F.when(F.size(word) > 0, _let(F.transform(word, lambda b: F.get(table.bytes, b)), folded)).otherwise(F.array().cast("array<bigint>"))


def merge_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges with a heap of (rank, place): for one word of any length."""
    end = list(range(1, len(word) + 1))  # of the piece that starts here
    start = list(range(-1, len(word)))  # of the piece before the one that starts here
    alive = [True] * len(word)

    def pair(i: int) -> tuple | None:
        j = end[i]
        rank = ranks.get(word[i:end[j]]) if j < len(word) else None
        return None if rank is None else (rank, i, j, end[j])

    heap = [p for p in map(pair, range(len(word))) if p]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < len(word) and alive[j] and end[j] == stop):
            continue
        alive[j], end[i] = False, stop
        if stop < len(word):
            start[stop] = i
        for k in (start[i], i):
            found = pair(k) if k >= 0 else None
            if found:
                heapq.heappush(heap, found)
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def unreached(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Pieces that the merges of their own bytes do not end in; a word equal to one is that one id."""
    return {piece: rank for piece, rank in ranks.items() if merge_long(ranks, piece) != [rank]}


def _numbered(apart: dict[bytes, int]):
    """One row per batch: ids and word counts of its documents, word numbers, and the words that are new to this task.

    Words over ``LONG`` bytes and those of ``apart`` are left empty in ``new`` and listed with their places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        held = 0
        for b in batches:
            restart = len(numbers) > MOST_WORDS or held > MOST_BYTES
            if restart:
                numbers, held = {}, 0
            words = b.column("words")
            coded = words.flatten().dictionary_encode()
            known = len(numbers)
            listed = coded.dictionary.to_pylist()
            own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in listed), np.int32, len(listed))
            new = [w.encode() for w in islice(numbers, known, None)]
            held += sum(map(len, new))
            odd = [k for k, w in enumerate(new) if len(w) > LONG or w in apart]
            aside = [new[k] for k in odd]
            for k in odd:
                new[k] = b""
            sizes = np.cumsum([0, *map(len, new)])
            arrays = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.frombuffer(b"".join(new), np.uint8).astype(np.int16)))
            codes = own[np.asarray(coded.indices)] if listed else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.diff(np.asarray(words.offsets)).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([codes.astype("<i4").tobytes()], pa.binary()), pa.array([restart]),
                pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), arrays),
                pa.array([odd], pa.list_(pa.int32())), pa.array([aside], pa.list_(pa.binary())),
            ], names=["ids", "counts", "codes", "restart", "new", "odd", "aside"])

    return run


def _gathered(table, rank_file: str, apart: dict[bytes, int]):
    """Ids of every document, from the rows of ``_numbered``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        begin = size = flat = np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.slice(r, 1)
                if b.column("restart")[0].as_py():
                    begin = size = flat = np.zeros(0, np.int64)
                new = b.column("new").flatten()
                starts, sizes, found = merge_words(table.value, np.asarray(new.flatten()), np.diff(np.asarray(new.offsets)).astype(np.int64))
                starts += len(flat)
                for k, w in zip(b.column("odd")[0].as_py(), b.column("aside")[0].as_py()):
                    ranks = ranks or read_ranks(rank_file)
                    own = [apart[w]] if w in apart else merge_long(ranks, w)
                    starts[k], sizes[k] = len(flat) + len(found), len(own)
                    found = np.concatenate([found, own])
                begin, size, flat = np.concatenate([begin, starts]), np.concatenate([size, sizes]), np.concatenate([flat, found])
                codes = np.frombuffer(b.column("codes")[0].as_py(), "<i4")
                ends = np.cumsum(np.asarray(b.column("counts").flatten()).astype(np.int64))
                for lo, hi in _pieces(ends):
                    first = int(ends[lo - 1]) if lo else 0
                    own = codes[first: int(ends[hi - 1])]
                    n = size[own]
                    to = np.cumsum(n)
                    ids = flat[np.arange(to[-1] if len(to) else 0) + np.repeat(begin[own] - to + n, n)].astype(np.int32)
                    places = np.concatenate([[0], to])[np.concatenate([[0], ends[lo:hi] - first])]
                    lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([b.column("ids").flatten()[lo:hi], lists], names=["id", "ids"])

    return run


def _pieces(ends: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` words; a longer document stands alone."""
    lo = 0
    while lo < len(ends):
        first = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, first + most, side="right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens."""
    bounded_arrow(docs.sparkSession)
    words = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("words"))
    ranks = read_ranks(rank_file)
    apart = unreached(ranks)
    table = docs.sparkSession.sparkContext.broadcast(PairTable(ranks))
    number, gather = _numbered(apart), _gathered(table, rank_file, apart)
    return words.mapInArrow(lambda batches: gather(number(batches)), "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that the ids stand for."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def digests(encoded: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): SHA-256 of the ids as decimal text and of the decoded bytes."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), read_ranks(rank_file)), 256).alias("decoded_sha256"))
