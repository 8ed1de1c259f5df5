"""Phrase collocations by stripes.

A stripe is the counter of the words that follow a prefix; a prefix has none to
three words. A task cuts the texts of a chunk of documents into words, forms its
stripes over word numbers of its own, and sends them under (language, prefix,
share): the stripe of a hot prefix is spread over shares by the hashes of its next
words, any other has one share. Stripes of one key are merged element by element.
The merged stripes hold the counts of all extended phrases; the total of a prefix is
its own entry one level up, and the largest extension decides whether it is part
of a longer phrase.

Lengths are taken one after another. A phrase can only reach the least count if
the phrases without its first and without its last word do, so a position is
extended only if both pass a filter of the frequent phrases one shorter. The filter
is a bit table of a fixed size (``FILTER_BITS``) with false positives and no false
negatives: it saves work, and the counts are exact whatever it lets through.

Subsumption needs one word more only: a phrase inside a longer candidate is inside
one that is longer by one word and at least as frequent.

Defined results
  * null and empty texts have no words; a null language is ``und``.
  * repeated rows count as often as they occur, document ids are not read.
  * ties in score and count are ordered by the phrase's bytes.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow, groups_of, mixed
from weekloom.runtime import stored

# Characters that end a piece, and those between words.
_ENDS, _GAPS = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?\n\x0b\x0c\r", b" \t"))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A"): ord("Z") + 1] += 32
LONGEST = 4
LEAST = 30
TOP = 2000
UNKNOWN = "und"
SCALE = 2_000_000
SHARES = 1024  # of the empty prefix, which all words follow, and of hot phrases
HOT = 1024  # a phrase is hot from one position in so many on
CHUNK_BYTES = 4 << 20
ROWS = 8_192
BYTES = 4 << 20
FILTER_BITS = 1 << 26
SLOT_BITS = 1 << 16
STRIPES = "lang string, prefix string, share int, next string, counts binary"  # next words joined by spaces, 32-bit counts
MERGED = "lang string, prefix string, next string, a bigint"


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _phrase_hashes(langs: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    h = langs
    for p in parts:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, number of the piece, number of the text) of some texts; all separators are ASCII, so bytes are cut."""
    raw = [t.encode() for t in texts]
    data = _LOWERED[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    end, inside = _ENDS[data], ~(_ENDS | _GAPS)[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    after = np.cumsum([len(r) + 1 for r in raw])
    return words, np.cumsum(end)[starts], np.searchsorted(after, starts, side="right")


class Chunk:
    """The words of some documents behind each other, with their language and the piece they belong to."""

    def __init__(self, langs: list[str], texts: list[str]):
        words, self.piece, text = _cut(texts)
        coded = words.dictionary_encode()
        self.dictionary, self.words = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        self.langs = sorted(set(langs))
        number = {v: k for k, v in enumerate(self.langs)}
        self.lang = np.fromiter((number[v] for v in langs), np.int64, len(langs))[text]
        self.hashes = _word_hashes(self.dictionary.to_pylist())
        self.lang_hashes = _word_hashes(self.langs)

    def whole(self, length: int) -> np.ndarray:
        """Positions at which ``length`` words of one piece start."""
        n = len(self.words) - length + 1
        return np.flatnonzero(self.piece[:max(n, 0)] == self.piece[length - 1:]) if n > 0 else np.zeros(0, np.int64)

    def phrases(self, at: np.ndarray, length: int) -> np.ndarray:
        return _phrase_hashes(self.lang_hashes[self.lang[at]], [self.hashes[self.words[at + k]] for k in range(length)])

    def frequent(self, length: int, bits: np.ndarray) -> np.ndarray:
        """For every position: may the phrase of ``length`` words here be frequent?"""
        at = self.whole(length)
        h = self.phrases(at, length) & np.uint64(FILTER_BITS - 1)
        out = np.zeros(len(self.words) + 1, bool)
        out[at] = (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def stripes(self, length: int, bits: np.ndarray | None, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stripes of the prefixes of ``length - 1`` words; those of ``hot`` phrases in shares."""
        at = np.arange(len(self.words))
        if length > 1:
            passes = self.frequent(length - 1, bits)
            at = self.whole(length)
            at = at[passes[at] & passes[at + 1]]
        if not len(at):
            return
        v = len(self.dictionary)
        prefix = self.lang[at]
        for k in range(length - 1):
            prefix = np.unique(prefix * v + self.words[at + k], return_inverse=True)[1]
        entry, first, counts = np.unique(prefix * v + self.words[at + length - 1], return_index=True, return_counts=True)
        prefix, following, at = entry // v, entry % v, at[first]
        spread = np.isin(self.phrases(at, length - 1), hot) if length > 1 else True
        share = np.where(spread, (self.hashes % np.uint64(SHARES)).astype(np.int64)[following], 0)
        order = np.lexsort((share, prefix))
        prefix, following, at, counts, share = (x[order] for x in (prefix, following, at, counts.astype("<i4"), share))
        starts = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (share[1:] != share[:-1])))
        names = [self.dictionary.take(pa.array(self.words[at[starts] + k])) for k in range(length - 1)]
        text = pc.binary_join_element_wise(*names, " ") if names else pa.array([""] * len(starts), pa.string())
        langs = pa.array(self.langs).take(pa.array(self.lang[at[starts]]))
        nexts = self.dictionary.take(pa.array(following))
        offsets = np.append(starts, len(following))
        for lo in range(0, len(starts), ROWS):
            hi = min(lo + ROWS, len(starts))
            inner, own = (offsets[lo: hi + 1] - offsets[lo]).astype(np.int32), slice(offsets[lo], offsets[hi])
            yield pa.RecordBatch.from_arrays([
                langs[lo:hi], text[lo:hi], pa.array(share[starts[lo:hi]].astype(np.int32)), pc.binary_join(pa.ListArray.from_arrays(pa.array(inner), nexts[own]), " "),
                pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(inner * np.int32(4)), pa.py_buffer(counts[own].tobytes())]),
            ], names=["lang", "prefix", "share", "next", "counts"])


def _formed(length: int, bits: np.ndarray | None, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lo, hi in groups_of([len(t) for t in texts], CHUNK_BYTES):
                yield from Chunk(langs[lo:hi], texts[lo:hi]).stripes(length, bits, hot)
                pa.default_memory_pool().release_unused()

    return run


def _merged(least: int):
    """Stripes of one key are neighbours: their counters are added up, and each key is closed with its frequent entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, None

        def closed(t: pa.Table, langs: pa.Array, prefixes: pa.Array) -> Iterator[pa.RecordBatch]:
            """Rows of (key number, next, a) with the names of the keys; the empty prefix gives its total, too."""
            many = t.filter(pc.greater_equal(t["a"], least))
            for c in many.to_batches(max_chunksize=ROWS):
                yield pa.RecordBatch.from_arrays([langs.take(c["key"]), prefixes.take(c["key"]), c["next"], c["a"]], names=["lang", "prefix", "next", "a"])
            empty = pc.equal(prefixes, "")
            if pc.any(empty).as_py():
                total = t.filter(empty.take(t["key"].combine_chunks())).group_by("key").aggregate([("a", "sum")])
                for c in total.to_batches():
                    yield pa.RecordBatch.from_arrays([langs.take(c["key"]), prefixes.take(c["key"]), pa.nulls(len(c), pa.string()), c["a_sum"]], names=["lang", "prefix", "next", "a"])

        def last() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield from closed(held, pa.array([held_key[0]]), pa.array([held_key[1]]))

        for b in batches:
            if not b.num_rows:
                continue
            lang, prefix, h = b.column("lang"), b.column("prefix"), b.column("h")
            change = np.ones(b.num_rows, bool)
            change[1:] = ~np.logical_and.reduce([np.asarray(pc.equal(x[1:], x[:-1])) for x in (lang, prefix, h)])
            key = (np.cumsum(change) - 1).astype(np.int32)
            names = [x.take(pa.array(np.flatnonzero(change))) for x in (lang, prefix)]
            lists = pc.split_pattern(b.column("next"), " ")
            counts = np.frombuffer(b"".join(b.column("counts").to_pylist()), "<i4").astype(np.int64)
            t = pa.table([pa.array(np.repeat(key, pc.list_value_length(lists))), lists.flatten(), pa.array(counts)], names=["key", "next", "a"])
            first = (lang[0].as_py(), prefix[0].as_py(), h[0].as_py())
            if held is not None and first == held_key:
                t = pa.concat_tables([held, t])
            else:
                yield from last()
            t = t.group_by(["key", "next"], use_threads=False).aggregate([("a", "sum")]).select(["key", "next", "a_sum"]).rename_columns(["key", "next", "a"])
            is_open = pc.equal(t["key"], int(key[-1]))
            yield from closed(t.filter(pc.invert(is_open)), *names)
            rest = t.filter(is_open)
            held_key = (lang[-1].as_py(), prefix[-1].as_py(), h[-1].as_py())
            held = pa.table([pa.array(np.zeros(len(rest), np.int32)), rest["next"], rest["a"]], names=["key", "next", "a"])
            del t, lists, rest
            pa.default_memory_pool().release_unused()
        yield from last()

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of frequent phrases as (slot, places within it)."""
    for b in batches:
        texts = b.column("phrase").to_pylist()
        parts = [t.split(" ") for t in texts]
        h = _phrase_hashes(_word_hashes(b.column("lang").to_pylist()), [_word_hashes([p[k] for p in parts]) for k in range(len(parts[0]) if parts else 0)])
        h = np.unique(h & np.uint64(FILTER_BITS - 1))
        slots, starts = np.unique(h // np.uint64(SLOT_BITS), return_index=True)
        places = np.split((h % np.uint64(SLOT_BITS)).astype("<u2"), starts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array([p.tobytes() for p in places], pa.binary())], names=["slot", "places"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, places in zip(b.column("slot").to_pylist(), b.column("places").to_pylist()):
            tables.setdefault(slot, np.zeros(SLOT_BITS, bool))[np.frombuffer(places, "<u2")] = True
    yield pa.RecordBatch.from_arrays([
        pa.array(list(tables), pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes() for t in tables.values()], pa.binary())], names=["slot", "bits"])


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """Bit table of the (lang, phrase) rows, all of one length; ``FILTER_BITS`` bits whatever their number."""
    rows = phrases.select("lang", "phrase").mapInArrow(_placed, "slot int, places binary").repartition("slot").mapInArrow(_slots, "slot int, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:  # at most FILTER_BITS / SLOT_BITS rows of a fixed size
        out[r.slot * SLOT_BITS // 8: (r.slot + 1) * SLOT_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def lang_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, text) without nulls."""
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def hot_phrases(phrases: DataFrame, words: int) -> np.ndarray:
    """Hashes of the phrases that open at least one position in ``HOT``: at most so many, whatever the corpus."""
    rows = phrases.filter(F.col("a") * HOT >= words).select("lang", "phrase").collect()
    parts = [r.phrase.split(" ") for r in rows]
    return _phrase_hashes(_word_hashes([r.lang for r in rows]), [_word_hashes([p[k] for p in parts]) for k in range(len(parts[0]) if parts else 0)])


def merged_stripes(texts: DataFrame, length: int, bits: np.ndarray | None, hot: np.ndarray, least: int = LEAST) -> DataFrame:
    """Merged stripes of one prefix length: (lang, prefix, next, a) of the frequent extensions; without ``next`` shares of the empty prefix's total."""
    keyed = texts.mapInArrow(_formed(length, bits, hot), STRIPES).select(F.xxhash64("lang", "prefix", "share").alias("h"), "lang", "prefix", "next", "counts")
    return keyed.repartition("h").sortWithinPartitions("h", "lang", "prefix").mapInArrow(_merged(least), MERGED)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language."""
    bounded_arrow(docs.sparkSession, ROWS, BYTES)
    texts = lang_texts(docs, lang_col, text_col)
    phrases, bits, hot = [], None, np.zeros(0, np.uint64)
    for length in range(1, longest + 1):
        stripes = stored(merged_stripes(texts, length, bits, hot, least), f"stripes{length}")
        if length == 1:
            totals = stored(stripes.filter("next IS NULL").groupBy("lang").agg(F.sum("a").alias("n")), "totals")
            words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        own = stripes.filter("next IS NOT NULL").select("lang", "prefix", F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "next").alias("phrase"), "a", F.lit(length).alias("m"))
        phrases.append(own)
        if length < longest:
            bits, hot = phrase_filter(own), hot_phrases(own, words)

    def all_of(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    counts = all_of(phrases).select("lang", "phrase", "a")
    longer = all_of(phrases[1:])
    parts = longer.select("lang", "phrase", "a", "m", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    halves = parts.join(rest, ["lang", "rest"]).join(head, ["lang", "head"])
    scored = halves.select("lang", "phrase", "a", F.struct(F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20, 0)) + r)").alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"))
    # a stripe's largest extension contains the prefix, and each extension what follows its first word
    above = all_of(phrases[2:]).select("lang", F.explode(F.array(F.col("prefix"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))).alias("phrase"), F.col("a").alias("inside"))
    inside = above.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    left = lowest.join(inside, ["lang", "phrase"], "left").filter(
        "inside IS NULL OR CAST(inside AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80").select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
