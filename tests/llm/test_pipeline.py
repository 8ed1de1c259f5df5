import random
from collections import Counter

import duckdb

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.rows import awkward, empty
from tests.llm.test_near import brute_lines, brute_near
from tests.llm.test_packing_and_topk import checked
from weekloom.llm import language_id, mixing
from weekloom.llm.packing import pack
from weekloom.llm.queries import tokenizer_file
from weekloom.runtime import stored


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stored(stages["language_id"](spark, docs, SMALL), "t-lang")
    predicted = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert {(r.doc_id, r.lang) for r in kept.collect()} == {
        (i, r.lang_pred) for i, r in predicted.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}

    lines = stored(stages["line_dedup"](spark, kept, SMALL), "t-lines")
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for (i, was), t in want.items() if t or t == was}
    assert all(r.n_chars == len(r.text) for r in got.values())

    near = stored(stages["ngram_jaccard"](spark, lines, SMALL), "t-near")
    groups = brute_near([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    mixed = stored(stages["source_mixing"](spark, near, SMALL), "t-mixed")
    con = duckdb.connect()
    con.register("documents", near.toPandas())
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in con.execute(mixing.mixing_sql()).fetchall() if r[6])

    for stage in (kept, lines, near, mixed):
        assert stage.columns == columns
    pieces = stages["packing"](spark, mixed, SMALL)
    checked([(r.doc_id, r.text) for r in mixed.collect()], pack(mixed, tokenizer_file()).collect())
    total = Counter()
    for r in pieces.collect():
        total[r.doc_id, r.doc_tokens] += r.length
    assert all(n == tokens for (_, tokens), n in total.items()) and len(total) == mixed.count()


def test_stages_on_awkward_and_empty_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            assert out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()


def test_line_stage_follows_chains(spark):
    """Documents of one line, each near its neighbours only: the first of each chain stays."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    rows = []
    for c in range(40):
        line = [r.choice(words) for _ in range(36)]
        for k in range(8):
            rows.append((10 * c + k, " ".join(line)))
            line[r.randrange(36)] = r.choice(words)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) + 0L AS n_chars")
    got = dict(corpus_pipeline.line_stage(spark, docs, SMALL).select("doc_id", "text").collect())
    assert got == {i: t for (i, _), t in brute_lines(rows).items() if t}


def test_near_stage_keeps_one_row_of_each_group(spark):
    from tests.llm.rows import PASSAGE, SCHEMA

    other = "an entirely different text about rivers and bridges that nobody has copied from anywhere at all"
    rows = [(3, PASSAGE), (5, PASSAGE), (5, other), (None, PASSAGE), (None, "one more text which stands alone and has no id whatsoever in this table"), (7, ""), (7, ""), (8, None), (2, PASSAGE + " now")]
    docs = stored(spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3), "t-rows")
    near = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    got = sorted(((r.doc_id, r.text) for r in near(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(2, PASSAGE + " now"), (5, other), (None, rows[4][1]), (7, ""), (7, ""), (8, None)], key=str)
