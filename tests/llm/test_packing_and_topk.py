import cProfile
import math
import pstats
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.rows import awkward, empty
from weekloom.llm import packing, topk_search
from weekloom.llm.queries import tokenizer_file
from weekloom.llm.tokens import CachedTokenizer

AWKWARD_TEXTS = ["a\n\n b", "  lead", "x" * 3000, "don't  stop", "é\u00a0ü 漢字\r\n", "tail ", "1234,5.6!?", "\t\tif x:\n    y()", "a\u2003b", "Q.E.D.\n",
                 "a <|endoftext|> b", "a  <|endoftext|>\n\n<|endoftext|>x", "<|endoftext|>", "word<|endoftext|>.\t <|endoftext|><|endof", "text|> <|endof", "text|>"]


def checked(docs, pieces, size=packing.SEQUENCE):
    """Every document's ids come back whole; sequences are gapless and full but the last."""
    tok = Tokenizer.from_file(tokenizer_file())
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in docs)
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        parts[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    for number, s in sequences.items():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or number == max(sequences) and at < size
    assert sorted(sequences) == list(range(len(sequences)))
    got = []
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    open_doc = None
    for p in order:
        if p.start == 0:
            open_doc = (str(p.doc_id), [])
            got.append(open_doc)
        assert p.start == len(open_doc[1])
        open_doc[1].extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted(got) == want


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    checked([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, tokenizer_file()).collect())


def test_new_pieces_are_remembered_together():
    """Pieces the cache has not seen cost few Python calls each; the ids are those of whole texts, past all its first sizes."""
    r = random.Random(2)
    texts = ["", *[" ".join("".join(r.choice("aeinrstéß") for _ in range(r.randint(3, 12))) for _ in range(500)) for _ in range(20)], "", "last"]
    tok, calls = CachedTokenizer(tokenizer_file()), cProfile.Profile()
    got = calls.runcall(tok.encode, texts)
    want = [x.ids for x in Tokenizer.from_file(tokenizer_file()).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want == [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)]
    assert len(tok.at) > 5000 and pstats.Stats(calls).total_calls < 4 * len(tok.at)


def test_packing_awkward_rows(spark):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(AWKWARD_TEXTS)], "doc_id bigint, text string")
    docs = awkward(spark).unionByName(extra, allowMissingColumns=True)
    for size in (16, 1024):
        checked([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, tokenizer_file(), size).collect(), size)
    assert packing.pack(empty(spark), tokenizer_file()).count() == 0
    assert [packing.padded_length(n) for n in (1, 3, 512, 1000, 1024)] == [1, 1024, 512, 1024, 1024]


def brute_top(rows, k):
    out = []
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * x) for x in v]))
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(0)).withColumn("block", F.lit(1))
    vectors = topk_search.whole_vectors(df, 64, "vec_id", "embedding")
    return sorted(map(tuple, topk_search.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), k).collect()))


def test_top_k_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.choice((0.25, -0.5, r.gauss(0, 1))))) for _ in range(12)]) for i in range(600)]
    rows += [(900 + i, [1.0] * 12) for i in range(50)]  # ties
    assert found(spark, rows, 20) == brute_top(rows, 20)


def test_top_k_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [-1.0, -1.0]), (40, None)]
    assert found(spark, rows, 3) == brute_top(rows, 3)
    assert found(spark, rows[2:3], 3) == []
    assert found(spark, rows, 50) == brute_top(rows, 50)
