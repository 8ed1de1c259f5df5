import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.rows import awkward, empty
from weekloom.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(FILE)
TOOL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "B", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "漢", "😀", "1", "23", ".", "!?", " ", " ", "\x1c", "x" * 20, "\x85", "<|endoftext|>", "\x00"]


def encoded(docs):
    return byte_bpe.encode(docs, FILE, public_tokenizers.PATTERN)


def checked(docs):
    got = encoded(docs).select("doc_id", "ids", byte_bpe.decoded(F.col("ids"), RANKS).alias("data")).collect()
    want = sorted((str(r.doc_id), TOOL.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.data)) for r in got) == want


def test_table_equals_the_library(spark):
    checked(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_awkward_rows(spark):
    checked(awkward(spark))
    assert encoded(empty(spark)).count() == 0


def test_odd_texts_and_long_words(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["abc" * 20_000, "a" * 60_000, "".join(rnd.choice("etaoinshrdlu") for _ in range(20_000)), " " * 5000 + "x", "漢" * 171, "b" * 512, "b" * 513]
    texts += [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(0, 0x3100)]
    checked(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5))


def test_words_are_forgotten_when_many(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    batches = docs.select(F.col("doc_id").alias("id"), F.split("text", " ").alias("words")).toArrow().to_batches(max_chunksize=20)
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 50)
    rows = [b.to_pylist()[0] for b in byte_bpe._numbered({})(iter(batches))]
    assert any(r["restart"] for r in rows) and not rows[0]["restart"]
    words, at = [], []
    for r in rows:
        words = ([] if r["restart"] else words) + r["new"]
        at += [bytes(words[c]).decode() for c in memoryview(r["codes"]).cast("i")]
    assert at == [w for b in batches for ws in b.column("words").to_pylist() for w in ws]


def test_heap_equals_the_fold(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("theinaro") for _ in range(rnd.randint(2, 40))).encode() for _ in range(400)]
    table = byte_bpe.rank_literal(RANKS)
    rows = [(w, list(w)) for w in [*words, *list(RANKS)[:3000:7], b""]]
    got = spark.createDataFrame(rows, "w binary, b array<smallint>").select("w", byte_bpe.encoded_word(table, F.col("b")).alias("ids")).collect()
    assert [list(r.ids) for r in got] == [byte_bpe.merge_long(RANKS, bytes(r.w)) for r in got]


def test_words_merged_together_equal_the_heap():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("theinaro é漢") for _ in range(rnd.randint(0, 60))).encode() for _ in range(3000)]
    words += [b"", b"a" * 512, bytes(range(256)), *list(RANKS)[:4000:3], b""]
    table = byte_bpe.PairTable(RANKS)
    for some in (words, words[:1], [b""], []):
        sizes = np.array([len(w) for w in some], np.int64)
        begin, size, ids = byte_bpe.merge_words(table, np.frombuffer(b"".join(some), np.uint8).astype(np.int16), sizes)
        assert [ids[b:b + n].tolist() for b, n in zip(begin, size)] == [byte_bpe.merge_long(RANKS, w) for w in some]


def test_pieces_that_no_merge_reaches(spark, tmp_path):
    """A rank file whose piece ``abc`` has neither ``ab`` nor ``bc``: the word is that piece, inside others it is not made."""
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b"abc", b"xy", b"xyz"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(k).encode() for k, p in enumerate(pieces)))
    tool = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={})
    texts = ["abc", "abcabc xyz", "abc xyzabc", " abc"]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), str(tmp_path / "ranks"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {k: tool.encode_ordinary(t) for k, t in enumerate(texts)}


def test_digests(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in byte_bpe.digests(encoded(docs), FILE).collect()}
    ids = TOOL.encode_ordinary("hello world")
    assert tuple(got[1]) == (1, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(b"hello world").hexdigest())
    assert tuple(got[2]) == (2, 0, sha256(b"").hexdigest(), sha256(b"").hexdigest())
