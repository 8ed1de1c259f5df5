"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import byte_bpe, collocations, exact_dedup, jaccard_join, language_id, line_dedup, lm_scoring, mixing, packing, pseudonyms, spelling, topk_search, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_file() -> str:
    """Place of the public byte-level BPE vocabulary; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# (host, path, verdict) of the contract
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

URL_SQL = """
WITH rules(rh, rp, v) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'),
                                 ('com','/fr/','allow'), ('com','/de/','block')),
u AS (SELECT page_id, row_number() OVER () AS rn,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rn, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, rn, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT rn, rh || rp AS rule, v, row_number() OVER (PARTITION BY rn ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) AS b ON p.rn = b.rn
"""


@query("op8_url_filters", URL_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query("op1_exact_dedup", EXACT_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_by_content_sort(table(spark, folder, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


TOPK_SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM f AS q, f AS c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op10_topk_search", TOPK_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, folder, "embeddings"), 64, "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), 20)


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.train(docs))


@query("op3_source_mixing", mixing.mixing_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("row.text")
    return mixing.mixed(table(spark, folder, "documents")).select(
        "row.doc_id", "row.source", "row.lang", mixing.form_topic(text).alias("topic"), mixing.tokens_of(text).alias("tokens"),
        F.round("probability", 6).alias("probability"), "kept")


@query("op4_pii_pseudonyms")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, folder, "documents"), "an example key, a secret in production")


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, folder, "documents"))


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("row.doc_id", "text", "n_lines", "n_removed")


@query("op6_lm_scoring")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return lm_scoring.cross_entropy_difference(table(spark, folder, "documents"), labels)


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN), ranks)


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


COLLOCATION_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS p FROM t)),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30 OR m = 1),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
x AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, k, l.a AS l, r.a AS r, (2000000 * x.a::HUGEINT) // (l.a + r.a) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.head
      JOIN f AS r ON r.lang = x.lang AND r.phrase = x.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS d ON c.lang = d.lang AND d.m > c.m
        AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.a::HUGEINT >= 80 * c.a),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
