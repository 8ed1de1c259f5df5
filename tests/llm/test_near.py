import random
import re
from collections import Counter, defaultdict

from tests.llm.rows import TEXTS, awkward, empty
from weekloom.llm.jaccard_join import near_components
from weekloom.llm.line_dedup import SHINGLE, dedup_lines


def parents(items, linked):
    up = {x: x for x in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return top


def word_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = {i: word_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = parents(ids, links)
    return {i: (len(sets[i]), top(i)) for i in ids}


def varied(seed, n):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w))
            w[at:at + r.randint(0, 2)] = [r.choice(vocabulary)]
        rows.append((i, " ".join(w)))
    return rows


def test_near_components_against_brute_force(spark):
    rows = varied(5, 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_near(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_near_awkward_rows(spark):
    got = near_components(awkward(spark)).collect()
    want = brute_near([r[:2] for r in TEXTS if r[0] is not None])
    assert len(got) == len(TEXTS)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(want[1][0], 1)]
    assert near_components(empty(spark)).count() == 0


def brute_lines(rows):
    """Texts by (id, text): components over exact similarity, the first line stays."""
    place = re.compile(rf"(?s)(?<![a-z])(?=(.{{{SHINGLE}}}))")
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, sets = [], {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            p = line.strip(" ").lower()
            if len(p) >= SHINGLE:
                sets.setdefault(p, frozenset(place.findall(p) + [p[-SHINGLE:]]))
                seen.append((i, t, k, p))
    inverted, links = defaultdict(list), []
    for p, s in sets.items():
        common = Counter(q for x in s for q in inverted[x])
        links += [(p, q) for q, n in common.items() if n >= 0.8 * (len(s) + len(sets[q]) - n)]
        for x in s:
            inverted[x].append(p)
    top, met, gone = parents(sets, links), set(), defaultdict(set)
    for i, t, k, p in seen:
        if top(p) in met:
            gone[i, t].add(k)
        met.add(top(p))
    return {(i, t): None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in docs}


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    lines = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(30)) for _ in range(25)]
    rows = []
    for i in range(120):
        mine = [r.choice(lines) for _ in range(r.randint(0, 5))]
        rows.append((i, "\n".join(x.upper() if r.random() < 0.2 else x + " end" if r.random() < 0.2 else x for x in mine)))
    got = {(x.row.doc_id, x.row.text): x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_follows_chains(spark):
    """Chains of lines in which each is near its neighbours only: every link counts."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    rows = []
    for c in range(40):
        line = [r.choice(words) for _ in range(36)]
        for k in range(8):
            rows.append((10 * c + k, " ".join(line)))
            line[r.randrange(36)] = r.choice(words)
            if c % 2:
                line[r.randrange(36)] = r.choice(words)
    got = {(x.row.doc_id, x.row.text): x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_a_common_frame(spark):
    """One frame in many lines: different in a few words only, some near and some not."""
    r = random.Random(5)
    frame = [f"word{k:02d}" for k in range(30)]
    rows = []
    for i in range(150):
        line = list(frame)
        for k in r.sample(range(30), r.randint(1, 3)):
            line[k] = f"x{r.randrange(10**6):06d}"
        rows.append((i, " ".join(line)))
    got = {(x.row.doc_id, x.row.text): x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_that_share_a_rare_phrase_only_are_never_listed_as_pairs(spark):
    """The pairs written for buckets of many groups follow the links, not the square of the bucket."""
    from weekloom.llm import line_dedup

    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5000)]
    rows = [(i, "a phrase that all of them have " + " ".join(r.choice(words) for _ in range(60))) for i in range(60)]
    rows += [(60 + i, t[:-1] + "!") for i, (_, t) in enumerate(rows[:5])]
    texts = [(line, t) for line, (_, t) in enumerate(rows)]
    sizes = {line: len(set(re.findall(rf"(?s)(?<![a-z])(?=(.{{{SHINGLE}}}))", t)) | {t[-SHINGLE:]}) for line, t in texts}
    shared = spark.createDataFrame([(1, line, n, 0, True) for line, n in sizes.items()], "shingle bigint, line bigint, n bigint, at bigint, wide boolean")
    none = spark.createDataFrame([], "id bigint, root bigint")
    got = {(x.a, x.b) for x in line_dedup._across(shared, none, spark.createDataFrame(texts, "line bigint, plain string")).collect()}
    assert got == {(i, 60 + i) for i in range(5)}


def test_line_dedup_awkward_rows(spark):
    got = dedup_lines(awkward(spark)).collect()
    assert len(got) == len(TEXTS)
    assert {(x.row.doc_id, x.row.text): x.text for x in got} == brute_lines([t[:2] for t in TEXTS])
    assert all(x.row.line == "extra" for x in got)
    assert dedup_lines(empty(spark)).count() == 0
