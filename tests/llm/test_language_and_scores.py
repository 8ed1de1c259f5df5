import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import TEXTS, awkward, empty
from weekloom.llm import language_id, lm_scoring


def test_gradients_by_differences():
    net = language_id.ByteLanguages(["a", "b", "c"], hidden=4)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, (6, 5)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 1, 0]), np.ones((6, 5), np.float32)

    def loss():
        p = net.positions(data)[0].astype(np.float64)
        return -np.log(p[:, label, np.arange(5)]).mean()

    p = net.positions(data)[0]
    assert p.shape == (6, 3, 5) and np.allclose(p.sum(1), 1, atol=1e-5)
    value, parts = net.gradients(data, label, weight)
    assert math.isclose(value, loss(), rel_tol=1e-4)
    assert [id(p) for p, _ in parts] == [id(net.out), id(net.ahead.p), id(net.behind.p)]
    # 64-bit parameters, so that a difference of losses is exact enough
    for params, _ in parts:
        for name in params:
            params[name] = params[name].astype(np.float64)
    checked = 0
    for params, found in parts:
        assert set(found) == set(params)
        for name, p in params.items():
            columns = range(97, 105) if name == "x" else range(p.shape[1])  # bytes that occur
            for i in range(p.shape[0]):
                for j in columns:
                    was = p[i, j]
                    p[i, j] = was + 1e-2
                    high = loss()
                    p[i, j] = was - 1e-2
                    low = loss()
                    p[i, j] = was
                    assert found[name][i, j] == pytest.approx((high - low) / 2e-2, abs=2e-4), (name, i, j)
                    checked += 1
    assert checked > 300


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(docs, language_id.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    tested = [r for r in out if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.85 * len(tested)


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = language_id.train(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r.doc_id in (4, 5, 6, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id is None:
            assert r.held_out
    unlearned = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(docs, unlearned).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def words(t):
    return (t or "").encode().split()


def test_scores_prefer_the_target(spark):
    r = random.Random(4)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.filter("doc_id % 4 = 1").select("doc_id", F.lit(True).alias("good"))
    got = {x.doc_id: x for x in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    assert max(got[i].score for i in range(1, 200, 2)) < min(got[i].score for i in range(0, 200, 2))
    # with fewer words than frequent classes every word is a class: the counts are those of plain bigrams
    counts = {}
    for i, t in rows:
        for a, b in zip([None, *words(t)], words(t)):
            counts[a, b] = counts.get((a, b), 0) + 1
    history, word = {}, {}
    for (a, b), n in counts.items():
        history[a], word[b] = history.get(a, 0) + n, word.get(b, 0) + n
    total = sum(word.values())
    for i, t in rows[:20]:
        w = words(t)
        loss = 0.0
        for a, b in zip([None, *w], w):
            base = (word[b] + 1) / (total + lm_scoring.CLASSES)
            loss -= math.log((counts[a, b] + lm_scoring.PRIOR * base) / (history.get(a, 0) + lm_scoring.PRIOR))
        assert got[i].n_tokens == len(w)
        assert math.isclose(got[i].loss_background, loss / len(w), rel_tol=1e-3)


def test_scores_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None), (99, True)], "doc_id bigint, good boolean")
    got = lm_scoring.cross_entropy_difference(docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(words(t))) for i, t, *_ in TEXTS)
    for r in got:
        assert (r.score is None) == (r.n_tokens == 0)
        assert r.score is None or math.isfinite(r.score)
    assert all(r.score is None or math.isfinite(r.score) for r in lm_scoring.cross_entropy_difference(docs, labels.limit(0)).collect())
    assert lm_scoring.cross_entropy_difference(empty(spark), labels).count() == 0
