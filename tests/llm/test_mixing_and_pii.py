import datetime
import re

import duckdb
from pyspark.sql import functions as F

from tests.llm.rows import TEXTS, awkward, empty
from weekloom.llm import mixing, pseudonyms


def test_margins_are_met(spark):
    cells = spark.createDataFrame(
        [("hot", "en", "x", 900), ("hot", "de", "y", 300), ("cold", "en", "y", 50), ("cold", "de", "x", 40), (None, "en", "x", 10), (None, "de", "y", 0)],
        "source string, lang string, topic string, tokens bigint")
    targets = {
        "source": spark.createDataFrame([("hot", 2.0), ("cold", 1.0), (None, 0.5)], "value string, target double"),
        "lang": spark.createDataFrame([("en", 1.0), ("de", 1.0)], "value string, target double"),
    }
    rows = mixing.rake(cells, targets, rounds=60).collect()
    total = sum(r.tokens * r.probability for r in rows)
    for d, want in (("source", {"hot": 4 / 7, "cold": 2 / 7, None: 1 / 7}), ("lang", {"en": 0.5, "de": 0.5})):
        for v, share in want.items():
            assert abs(sum(r.tokens * r.probability for r in rows if r[d] == v) / total - share) < 1e-3
    assert max(r.probability for r in rows if r.tokens) == 1.0


def test_mixing_awkward_rows(spark):
    got = mixing.mixed(awkward(spark)).collect()
    con = duckdb.connect()
    documents = awkward(spark).drop(*[c for c in awkward(spark).columns if c in ("row",)]).toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents[["doc_id", "text", "lang", "source"]])
    want = con.execute(mixing.mixing_sql()).fetchall()
    key = lambda r: (str(r[0]), str(r[1]))
    mine = [(x.row.doc_id, x.row.source, round(x.probability, 6), x.kept) for x in got]
    assert sorted(mine, key=key) == sorted([(r[0], r[1], r[5], r[6]) for r in want], key=key)
    assert len({x.kept for x in got if x.row.doc_id == 9}) == 1
    assert mixing.mixed(empty(spark)).count() == 0


VALUES = [
    "mail ann.bee@example.org now", "see 192.168.10.250 and 999.1.1.1", "born 1984-02-29, not 1983-02-29", "due 31/12/2020 or 12.31.2020",
    "call +44 20 7946 0958", "call (555) 123-4567", "card 4111 1111 1111 1111", "card 4111111111111111", "ssn 123-45-6789",
    "key deadbeefdeadbeefdeadbeefdeadbeef", "nothing here", "", None, "ann.bee@example.org" * 2, "1.2.3.4 " * 20_000,
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def form(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", text)))


def test_pseudonyms_keep_the_format_and_links(spark):
    docs = spark.createDataFrame(list(enumerate(VALUES)), "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("hits", F.lit("x"))
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert len(out) == len(VALUES)
    again = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "k").collect()}
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "another").collect()}
    for i, text in enumerate(VALUES):
        assert out[i].text == again[i]
        if text in ("nothing here", "", None):
            assert (out[i].text, out[i].n_found) == (text, 0)
        else:
            assert out[i].n_found > 0 and out[i].text != text and other[i] != out[i].text
            if i not in (1, 9, 14):
                assert form(out[i].text) == form(text)
    assert "999.1.1.1" in out[1].text and "not 1983-02-29" in out[2].text
    assert datetime.date.fromisoformat(re.search(r"born (\S+),", out[2].text)[1])
    spaced, plain = re.sub(r"\D", "", out[6].text), re.sub(r"\D", "", out[7].text)
    assert spaced == plain and luhn(plain)
    assert len(set(out[14].text.split())) == 1


def test_pseudonyms_are_a_permutation(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("n 55555"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"))
    assert pseudonyms.pseudonymise(docs, "k").select("text").distinct().count() == 10_000
    days = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("on "), F.date_add(F.lit("1960-01-01").cast("date"), F.col("id").cast("int")).cast("string")).alias("text"))
    assert pseudonyms.pseudonymise(days, "k").select("text").distinct().count() == 20_000


def test_pseudonyms_awkward_rows(spark):
    got = pseudonyms.pseudonymise(awkward(spark), "k").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, *_ in TEXTS)
    assert pseudonyms.pseudonymise(empty(spark), "k").count() == 0
