"""URL filters: host-suffix and path-prefix expressions matched against hashed rules.

Each URL is expanded into the expressions a rule could have (its last k host
labels, its first n path characters, for the k and n that rules have). The
expressions meet the rules by an equi-join on the first four digest bytes, full
SHA-256 digests confirm, and the longest rule wins.

Defined results
  * null URL or one without ``://``: empty host and path, judged like any other
    (no rule has an empty host), so it gets the default verdict.
  * two rules of equal length fit: the one with the longer host wins. The same
    rule given twice with both verdicts blocks.
  * rules with a null host or verdict are ignored, a null path is the empty prefix.
  * repeated rows stay repeated, null ids stay null, empty tables give empty results.
  * extra columns are not carried; only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the digest that the join uses
HOST_BITS = 1 << 20  # rule length, host length and verdict share one sortable number


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row per rule (host, path): digest, its short prefix and whether it blocks."""
    return (
        rules.filter("host IS NOT NULL AND verdict IS NOT NULL")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").cast("int").alias("blocks"))
        .groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
        .select("host", "path", "blocks", _digest(F.col("host"), F.col("path")).alias("r_digest"))
        .withColumn("r_short", F.substring("r_digest", 1, SHORT))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict (allow or block)."""
    known = hashed_rules(rules)
    # Shapes of rules, not rules: at most one row per label count and path length.
    shapes = known.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct().collect()
    counts, lengths = sorted({s.k for s in shapes}), sorted({s.n for s in shapes})
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    options = [
        F.when((F.size(labels) >= k) & (F.length("path") >= n), F.struct(
            F.array_join(F.slice(labels, F.size(labels) - k + 1, F.lit(k)), ".").alias("h"), F.substring("path", 1, n).alias("p")))
        for k in counts for n in lengths
    ]
    none = F.lit(None).cast("struct<h:string,p:string>")
    expressions = urls.select("id", "host", "path", F.posexplode_outer(F.array_compact(F.array(*options, none))).alias("at", "e"))
    hashed = expressions.select(
        "id", "host", "path", F.coalesce("at", F.lit(0)).alias("at"), F.length("e.h").alias("hn"), F.length("e.p").alias("pn"),
        _digest(F.col("e.h"), F.col("e.p")).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, SHORT))
    met = hashed.join(
        known.select("r_short", "r_digest", "blocks"),
        (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left",
    )
    weight = ((F.col("hn") + F.col("pn")).cast("long") * HOST_BITS + F.col("hn")) * 2 + F.col("blocks")
    best = met.groupBy("id", "host", "path").agg(
        F.max(F.when(F.col("blocks").isNotNull(), weight)).alias("w"), F.sum((F.col("at") == 0).cast("long")).alias("copies"))
    w = F.col("w")
    hn = F.shiftright(w, 1) % HOST_BITS
    pn = F.shiftright(w, 21) - hn
    rule = F.concat(F.right("host", hn), F.substring(F.col("path"), F.lit(1), pn.cast("int")))
    verdict = F.when(w.isNull(), F.lit(default)).when(w % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    return (
        best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    )
