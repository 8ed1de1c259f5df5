"""Spelling variant grouping by k-d trees over letter-count vectors.

Two words are near when one inserted, deleted or replaced code point turns one
into the other. Such an edit moves the letter counts by a distance of at most
two: within one length one count falls and one rises, from a length to the next
one count rises. So each pair of lengths (L, L) and (L, L + 1) is a range search
in the tree of the longer length, whose box allows just these steps, and the few
words that pass are compared letter by letter.

The upper levels of the tree of a length are fitted on a bounded sample of its
words (``SAMPLE`` words in all, by hash) and cut the words into cells of about
``CELL``; every word lies in one cell and is sent as a guest to every other cell
that its box reaches, so the result does not depend on the sample. A task builds
the rest of the tree over the words of its cell and searches all guests in it, in
batches. Neighbour counts and the most frequent neighbour of a word are formed in
the task and merged by word.

Defined results
  * null and empty texts have no words; a null document id counts as empty text
    in the hash that decides on a deletion.
  * repeated rows count as often as they occur.
  * among near words of the same count the first in code-point order is the form.
  * words without a form are their own root.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow
from weekloom.runtime import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64  # a to z, U+00C0 to U+00FF
SHORTEST = 7
LEAST = 2
EVERY = 31
TIMES = 10
CELL = 16_384
SAMPLE = 131_072
LEAF = 64
ROWS = 8_192
PAIR_CELLS = 1 << 22


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): distinct words of at least ``shortest`` letters after the seeded deletions, and their occurrences."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    seeded = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return seeded.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# ---- letters and trees ---------------------------------------------------------------------------

def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words behind each other, and the length of each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.where(points < 128, points - 97, points - 0xC0 + 26), lengths


def vectors_of(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word."""
    letters, lengths = letters_of(words)
    rows = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(rows * LETTERS + letters, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(np.float64)


def grown(vectors: np.ndarray, most: float) -> list[tuple]:
    """Nodes of a k-d tree: (letter, cut, left, right), or (-1, leaf number, rows, None). At most ``cut`` goes left."""
    nodes: list = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(None)
        if len(rows) > most:
            own = vectors[rows]
            for letter in np.argsort(-own.var(axis=0))[:8].tolist():
                x = own[:, letter]
                cut = float(np.median(x))
                cut = min((c for c in (np.floor(cut), np.floor(cut) - 1)), key=lambda c: abs(int((x <= c).sum()) * 2 - len(x)))
                low = x <= cut
                if 0 < low.sum() < len(x):
                    left = grow(rows[low])
                    nodes[me] = (letter, cut, left, grow(rows[~low]))
                    return me
        nodes[me] = (-1, leaves, rows, None)
        leaves += 1
        return me

    grow(np.arange(len(vectors)))
    return nodes


def reached(nodes: list[tuple], vectors: np.ndarray, up: bool, down: bool) -> Iterator[tuple]:
    """(leaf number, rows of the leaf, queries) where a query's box meets the leaf.

    ``up`` allows one count to rise by one, ``down`` one to fall by one. A step
    taken on the way fixes that letter and is used up.
    """
    n = len(vectors)
    state = np.full((2, n), -1 if up else LETTERS, np.int64)  # the letter that rose, the letter that fell; -1: still free
    state[1] = -1 if down else LETTERS
    stack = [(0, np.arange(n), state)]
    while stack:
        node, own, (rose, fell) = stack.pop()
        letter, cut, left, right = nodes[node]
        if letter < 0:
            yield cut, left, own
            continue
        x = vectors[own, letter] + (rose == letter) - (fell == letter)
        low, free = x <= cut, (rose != letter) & (fell != letter)
        fall = ~low & (x == cut + 1) & free & (fell < 0)
        rise = low & (x == cut) & free & (rose < 0)
        for to, plain, step, k in ((left, low, fall, 1), (right, ~low, rise, 0)):
            takes = plain | step
            if takes.any():
                s = np.stack([rose, fell])
                s[k, step] = letter
                stack.append((to, own[takes], s[:, takes]))


# ---- cells -----------------------------------------------------------------------------------------

def _trees(words: DataFrame) -> dict[int, list[tuple]]:
    """Upper trees of the lengths that have more than a cell of words."""
    counts = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).filter(F.col("n") > CELL).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    keep = F.pmod(F.xxhash64("word"), F.lit(total)) < SAMPLE
    sample: dict[int, list[str]] = {k: [] for k in counts}
    for r in words.filter(F.length("word").isin(list(counts)) & keep).select("word").collect():
        sample[len(r.word)].append(r.word)
    return {k: [(*n[:2], None, None) if n[0] < 0 else n for n in grown(vectors_of(sample[k]), max(len(sample[k]) * CELL / counts[k], 8))] for k in counts}


def _sent(trees: dict[int, list[tuple]]):
    """Rows (length, leaf, role, word, n): a word in its cell (0), as a guest of its own length (1), of the next length (2)."""
    one = [(-1, 0, None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            parts = []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = vectors_of([words[i] for i in rows.tolist()])
                home = np.zeros(len(rows), np.int64)
                for leaf, _, own in reached(trees.get(length, one), vectors, False, False):
                    home[own] = leaf
                parts.append((rows, np.full(len(rows), length), home, 0))
                for leaf, _, own in reached(trees.get(length, one), vectors, True, True):
                    own = own[home[own] != leaf]
                    parts.append((rows[own], np.full(len(own), length), np.full(len(own), leaf), 1))
                for leaf, _, own in reached(trees.get(length + 1, one), vectors, True, False):
                    parts.append((rows[own], np.full(len(own), length + 1), np.full(len(own), leaf), 2))
            for rows, size, leaf, role in _gathered(parts):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(size, pa.int32()), pa.array(leaf, pa.int32()), pa.array(role, pa.int32()), b.column("word").take(at), b.column("n").take(at),
                ], names=["length", "leaf", "role", "word", "n"])

    return run


def _gathered(parts: list[tuple]) -> Iterator[tuple]:
    if parts:
        rows, size, leaf = (np.concatenate([p[k] for p in parts]) for k in range(3))
        role = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
        for lo in range(0, len(rows), 8 * ROWS):
            yield tuple(x[lo: lo + 8 * ROWS] for x in (rows, size, leaf, role))


# ---- search within a cell --------------------------------------------------------------------------

class Cell:
    """The words of one cell with the lower part of the tree."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.n = words, counts
        self.vectors = vectors_of(words)
        self.square = (self.vectors ** 2).sum(axis=1)
        letters, lengths = letters_of(words)
        self.letters = letters.reshape(len(words), int(lengths[0])).astype(np.uint8)
        self.nodes = grown(self.vectors, LEAF)

    def pairs(self, vectors: np.ndarray, letters: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) that one edit separates; queries have the cell's length, or one letter less."""
        square = (vectors ** 2).sum(axis=1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for _, members, own in reached(self.nodes, vectors, True, same):
            for lo in range(0, len(own), max(1, PAIR_CELLS // max(LETTERS, len(members)))):
                q = own[lo: lo + max(1, PAIR_CELLS // max(LETTERS, len(members)))]
                # Steps of one are the only integer steps whose squares add up to 2 or to 1.
                apart = square[q][:, None] + self.square[members][None, :] - 2 * (vectors[q] @ self.vectors[members].T)
                i, j = np.nonzero(apart == (2 if same else 1))
                out.append(self._verified(q[i], members[j], letters, same))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _verified(self, q: np.ndarray, m: np.ndarray, letters: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        good = np.zeros(len(q), bool)
        step = max(1, PAIR_CELLS // self.letters.shape[1])
        for lo in range(0, len(q), step):
            a, b = letters[q[lo: lo + step]], self.letters[m[lo: lo + step]]
            if same:
                good[lo: lo + step] = (a != b).sum(axis=1) == 1
            else:  # the letters before and after the inserted one
                head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                good[lo: lo + step] = head + tail >= a.shape[1]
        return q[good], m[good]


def _best(target: np.ndarray, words: list[str], other: np.ndarray, others: list[str], n: np.ndarray) -> tuple | None:
    """(words, neighbours, count of the best neighbour, best neighbour) of the words that have one."""
    if not len(target):
        return None
    place = np.empty(len(others), np.int64)
    place[sorted(range(len(others)), key=lambda k: (-n[k], others[k]))] = np.arange(len(others))
    order = np.lexsort((place[other], target))
    target, other = target[order], other[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    sizes = np.diff(np.append(first, len(target)))
    best = other[first]
    return [words[i] for i in target[first].tolist()], sizes, n[best], [others[i] for i in best.tolist()]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and role: members first, then guests batch by batch."""
    cell, key, waiting = None, None, []

    def search(words: list[str], counts: np.ndarray, role: int) -> Iterator[pa.RecordBatch]:
        if cell is None:
            return
        letters, lengths = letters_of(words)
        q, m = cell.pairs(vectors_of(words), letters.reshape(len(words), int(lengths[0])).astype(np.uint8), role != 2)
        found = [_best(q, words, m, cell.words, cell.n)]
        if role == 2:
            found.append(_best(m, cell.words, q, words, counts))
        for f in found:
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(f[0], pa.string()), pa.array(f[1], pa.int64()), pa.array(f[2], pa.int64()), pa.array(f[3], pa.string())], names=["word", "near", "best_n", "best"])

    def opened() -> Iterator[pa.RecordBatch]:
        nonlocal cell, waiting
        if waiting:
            cell = Cell([w for words, _ in waiting for w in words], np.concatenate([n for _, n in waiting]))
            waiting = []
            for lo in range(0, len(cell.words), ROWS):
                yield from search(cell.words[lo: lo + ROWS], cell.n[lo: lo + ROWS], 1)

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(c)) for c in ("length", "leaf", "role")])
        bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            length, leaf, role = keys[:, lo].tolist()
            if (length, leaf) != key:
                yield from opened()
                cell, key = None, (length, leaf)
            words, counts = b.column("word")[lo:hi].to_pylist(), np.asarray(b.column("n")[lo:hi])
            if role == 0:
                waiting.append((words, counts))
            else:
                yield from opened()
                yield from search(words, counts, role)
    yield from opened()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words that have a near one: how many, and the most frequent."""
    bounded_arrow(words.sparkSession, ROWS)
    trees = _trees(words)
    cells = 64 + 2 * sum(sum(n[0] < 0 for n in t) for t in trees.values())
    sent = words.select("word", "n").mapInArrow(_sent(trees), "length int, leaf int, role int, word string, n bigint")
    dealt = sent.repartition(min(cells, 4096), "length", "leaf").sortWithinPartitions("length", "leaf", "role")
    found = dealt.mapInArrow(_searched, "word string, near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("first")).select(
        "word", "n_near", (-F.col("first.minus")).alias("near_n"), F.col("first.best").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every (word, form): forms followed to the last, in doubling steps. Counts grow along a chain, so it ends."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        at = stored(at.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(word_counts(docs, id_col, text_col), "words")
    known = F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False))
    joined = stored(words.join(near_words(words), "word", "left").select(
        "word", F.when(known, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("near_n")).alias("form_n")), "near")
    return joined.join(roots(joined.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
