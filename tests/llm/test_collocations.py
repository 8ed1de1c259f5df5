import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.rows import awkward, empty
from weekloom.llm import collocations

NONE = np.zeros(0, np.uint64)
LOWERED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=30, top=2000):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for m in range(1, 5):
                f.update((lang or "und", *w[i:i + m]) for i in range(len(w) - m + 1))
    n = Counter()
    for p, a in f.items():
        if len(p) == 2:
            n[p[0]] += a
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = set()
    for q, b in candidates.items():
        for m in range(2, len(q) - 1):
            for i in range(1, len(q) - m + 1):
                if 100 * b >= 80 * candidates[q[0], *q[i:i + m]]:
                    inside.add((q[0], *q[i:i + m]))
    out = []
    for p, a in candidates.items():
        if p not in inside:
            cuts = [(2_000_000 * a // (f[p[:k + 1]] + f[p[0], *p[k + 1:]]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[p[0], *p[k + 1:]], n[p[0]]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, l, r, total, -score))
    return ranked


def checked(docs, **limits):
    got = sorted(map(tuple, collocations.collocations(docs, **limits).collect()))
    want = sorted(brute([tuple(r) for r in docs.select("lang", "text").collect()], **limits))
    assert got == want
    return want


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "an", "big", "red", "new york", "city", "state", "ÉTÉ", "été", "é", "x" * 300, "-", "1"]
    weights = [8, 2, 6, 5, 4, 3, 3, 3, 3, 3, 2, 2, 1, 1, 1, 1]
    fixed = ["new york city hall", "big red big red big red", "a a a a a a", "state of the art"]
    out = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.15 else rnd.choices(words, weights)[0] for _ in range(rnd.randint(0, 60))]
        out.append("".join(p + rnd.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".\n", " ! ", "\x0b", "\r\n"]) for p in parts))
    return out


def test_made_up_texts(spark):
    rows = [(random.Random(i).choice(["en", "de", None, "und"]), t) for i, t in enumerate(texts(4, 900))]
    want = checked(spark.createDataFrame(rows, "lang string, text string").repartition(7))
    assert {r[0] for r in want} == {"en", "de", "und"}


def test_limits_and_hot_prefix(spark):
    rows = [("en", f"hot w{i % 700} hot w{i % 11}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    checked(docs, least=5, top=40)
    texts = collocations.lang_texts(docs)
    hot = collocations._phrase_hashes(collocations._word_hashes(["en"]), [collocations._word_hashes(["hot"])])
    every = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
    for length, keys in ((1, NONE), (2, hot)):
        formed = texts.mapInArrow(collocations._formed(length, every if length > 1 else None, keys), collocations.STRIPES)
        assert formed.filter(F.col("prefix") == ("" if length == 1 else "hot")).select("share").distinct().count() > 300


def test_awkward_rows(spark):
    checked(awkward(spark), least=2)
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two"), ("en", None)], "lang string, text string")).count() == 0


def test_chunks_of_a_task_add_up(monkeypatch):
    rows = [("en", t) for t in texts(8, 60)]
    table = pa.table({"lang": [lang for lang, _ in rows], "text": [t for _, t in rows]})

    def total(chunk):
        monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
        out = Counter()
        batches = list(collocations._formed(1, None, NONE)(iter(table.to_batches(max_chunksize=5))))
        assert (len(batches) > 20) == (chunk == 50)
        for b in batches:
            for r in b.to_pylist():
                for w, n in zip(r["next"].split(" "), memoryview(r["counts"]).cast("i")):
                    out[w] += n
        return out

    assert total(50) == total(1 << 20) != Counter()
