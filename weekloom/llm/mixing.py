"""Mixing sources to target weights by iterative proportional fitting.

Documents are reduced to cells (source, language, topic) with their token
counts. Raking multiplies each cell's factor until the weighted tokens match the
target shares of every margin in turn; ``rounds`` full turns are made. Factors
over the largest factor are the sampling probabilities, so none is clipped and
the margins hold in expectation. A document is drawn when a hash of its id, read
as a number in [0, 1), is below its probability: the draw is repeatable.

Defined results
  * a null source, language or topic is a value of its own.
  * null and empty texts have no tokens; they share their cell's probability.
  * a value without a target gets probability 0; a margin value whose documents
    hold no tokens keeps its factor.
  * rows with a null id draw by their text; equal ids draw alike, so repeated
    rows stay or go together. An empty table gives no rows.
  * extra columns are carried by ``drawn`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.runtime import durable

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 20
ROUNDS_A_JOB = 4
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """Topic by form, for tables without a topic column."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!!")), "shout")
        .when(F.contains(text, F.lit("\n")), "prose").otherwise("line")
    )


def cells_of(keyed: DataFrame) -> DataFrame:
    """Token totals of each (source, lang, topic), added up before the shuffle."""
    return durable(keyed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets (value, target) in proportion to token totals to a power: below 1 flattens a hot source."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells with their ``probability``; ``targets`` maps a dimension to (value, target) in any unit."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    w = cells
    for d, t in targets.items():
        whole = t.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] or 1.0
        shares = t.select(F.col("value").alias(f"value_{d}"), (F.col("target") * (total / whole)).alias(f"target_{d}"))
        w = w.join(shares, F.col(d).eqNullSafe(F.col(f"value_{d}")), "left").drop(f"value_{d}").fillna(0.0, [f"target_{d}"])
    w = w.withColumn("factor", F.lit(1.0))
    for done in range(1, rounds + 1):
        for d in targets:
            mass = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d))
            w = w.withColumn("factor", F.when(mass > 0, F.col("factor") * F.col(f"target_{d}") / mass).otherwise(F.col("factor")))
        if done % ROUNDS_A_JOB == 0 or done == rounds:
            w = durable(w)
    most = w.filter("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    return w.select(*DIMENSIONS, "tokens", F.least(F.lit(1.0), F.col("factor") / F.lit(most)).alias("probability"))


def draw(name: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a keyed digest."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def drawn(docs: DataFrame, raked: DataFrame, source: Column, lang: Column, topic: Column, name: Column, seed: str = "mix") -> DataFrame:
    """(row, probability, kept): ``row`` is the whole input row as a struct."""
    keyed = docs.select(F.struct("*").alias("row"), source.alias("s"), lang.alias("l"), topic.alias("t"), draw(name, seed).alias("u"))
    r = raked.select(*DIMENSIONS, "probability")
    return keyed.join(r, F.col("s").eqNullSafe(F.col("source")) & F.col("l").eqNullSafe(F.col("lang")) & F.col("t").eqNullSafe(F.col("topic")), "left").select(
        "row", "probability", (F.col("u") < F.col("probability")).alias("kept"))


# Powers for the margins of the registered query and the pipeline.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}


def calibrate(docs: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """Raked cells of ``documents`` rows (source, lang, text) with tempered targets and the topic by form."""
    text = F.col("text")
    cells = cells_of(docs.select("source", "lang", form_topic(text).alias("topic"), tokens_of(text).alias("tokens")))
    return rake(cells, {d: tempered(cells, d, p) for d, p in powers.items()})


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(row, probability, kept) of ``documents`` rows."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return drawn(docs, calibrate(docs), F.col("source"), F.col("lang"), form_topic(F.col("text")), name, seed)


def mixing_sql() -> str:
    """The same in SQL: every round is written out."""
    key = {"source": "source", "lang": "lang", "topic": "topic"}
    steps = []
    last = "c0"
    for r in range(1, ROUNDS + 1):
        for d in key:
            name = f"r{r}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, "
                f"CASE WHEN sum(tokens * f) OVER w > 0 THEN f * t_{d} / sum(tokens * f) OVER w ELSE f END AS f FROM {last} WINDOW w AS (PARTITION BY {d}))")
            last = name
    shares = ", ".join(
        f"m_{d} AS (SELECT {d} AS v, pow(sum(tokens)::DOUBLE, {POWERS[d]}) AS p FROM cells GROUP BY {d}), "
        f"s_{d} AS (SELECT v, p * (SELECT sum(tokens) FROM cells) / (SELECT sum(p) FROM m_{d}) AS t FROM m_{d})" for d in key)
    joins = " ".join(f"LEFT JOIN s_{d} ON cells.{d} IS NOT DISTINCT FROM s_{d}.v" for d in key)
    return f"""
WITH k AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens, text,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, chr(10)) THEN 'prose' ELSE 'line' END AS topic
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM k GROUP BY 1, 2, 3), {shares},
c0 AS (SELECT cells.*, coalesce(s_source.t, 0) AS t_source, coalesce(s_lang.t, 0) AS t_lang, coalesce(s_topic.t, 0) AS t_topic, 1.0::DOUBLE AS f FROM cells {joins}),
{', '.join(steps)},
p AS (SELECT source, lang, topic, least(1.0, f / (SELECT max(f) FROM {last} WHERE tokens > 0)) AS probability FROM {last})
SELECT k.doc_id, k.source, k.lang, k.topic, k.tokens, round(p.probability, 6) AS probability,
  ('0x' || substr(md5('mix:' || coalesce(k.doc_id::VARCHAR, k.text, '')), 1, 13))::BIGINT / 4503599627370496.0 < p.probability AS kept
FROM k LEFT JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.lang IS NOT DISTINCT FROM p.lang AND k.topic = p.topic
"""
