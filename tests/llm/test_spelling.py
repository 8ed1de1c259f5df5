import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from tests.conftest import SMALL
from tests.llm.rows import awkward, empty
from weekloom.llm import spelling

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words):
    """Every word with the words that share it, or one of its letters-left-out forms, compared by the definition."""
    shared = {}
    for w in words:
        for k in range(len(w)):
            shared.setdefault((w[:k] + w[k + 1:]), []).append(w)
        shared.setdefault(w, []).append(w)
    near = {w: set() for w in words}
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(near[w]), words[form] if form else None)
    rows = []
    for w, (form, n, k, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, form_n))
    return sorted(rows, key=str)


def checked(docs):
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=str)
    want = brute(brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert got == want
    return want


def variants(seed, bases=60, copies=4000):
    """Texts of made-up words with edits, so that chains, ties and dense neighbourhoods occur."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß÷ÿ") for _ in range(rnd.randint(7, 12))) for _ in range(bases)]
    out = []
    for _ in range(copies):
        w = words[min(int(rnd.expovariate(0.08)), bases - 1)]
        for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("abcÀ") + w[k:], w[:k] + rnd.choice("abcÿ") + w[k + 1:]])
        out.append(w.upper() if rnd.random() < 0.1 and w.isascii() else w)
    chain = ["chainaaa"] * 3000 + ["chainaab"] * 250 + ["chainabb"] * 20 + ["chainbbb"] * 2
    out += rnd.sample(chain, len(chain))
    return [(i, " | ".join(out[i::200])) for i in range(200)]


def test_made_up_variants(spark):
    want = checked(spark.createDataFrame(variants(1), "doc_id bigint, text string"))
    assert sum(r[1] is not None for r in want) > 20
    assert any(r[1] not in (None, r[2]) for r in want)


def test_many_cells_equal_one(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 40)
    monkeypatch.setattr(spelling, "LEAF", 8)
    checked(spark.createDataFrame(variants(2, 200, 8000), "doc_id bigint, text string"))


def test_table(spark):
    checked(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_awkward_rows(spark):
    checked(awkward(spark))
    assert spelling.spelling_variants(empty(spark)).count() == 0
    rows = [(None, "x" * 9000 + " " + "x" * 9000 + " " + "x" * 8999), (None, "x" * 8999 + " " + "x" * 9000), (1, "abcdefg " * 40), (1, "abcdefg " * 40), (2, "abcdefh abcdefh"), (3, "gfedcba gfedcba")]
    checked(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_every_near_vector_is_reached():
    rnd = np.random.default_rng(3)
    vectors = rnd.integers(0, 3, (600, spelling.LETTERS)).astype(float)
    nodes = spelling.grown(vectors, 10)
    for up, down in ((True, True), (True, False), (False, False)):
        moved = vectors.copy()
        for k, v in enumerate(moved):
            i, j = rnd.choice(spelling.LETTERS, 2, replace=False)
            v[i] -= up
            v[j] += down
        found = np.zeros(600, bool)
        for _, rows, own in spelling.reached(nodes, moved, up, down):
            found[np.intersect1d(rows, own)] = True
        assert found.all()
