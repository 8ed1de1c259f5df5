import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from tests.llm.rows import TEXTS, awkward, empty
from weekloom.llm.exact_dedup import dedup_by_content_sort
from weekloom.llm.url_rules import judge_urls


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        free = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = free and i == keep
            free = free and not kept
            out.append((i, keep, len(ids), kept, sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_awkward_rows(spark):
    assert sorted(map(tuple, dedup_by_content_sort(awkward(spark)).collect()), key=str) == brute([r[:2] for r in TEXTS])


def test_dedup_group_over_many_partitions(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot  text")).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, dedup_by_content_sort(docs).collect()), key=str) == brute(rows)


def test_dedup_empty(spark):
    assert dedup_by_content_sort(empty(spark)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/", "allow"), ("example.org", None, "block"), (None, "/", "block"), ("net", "", "block"), ("net", "", "allow")]
URLS = [
    (1, "http://Example.ORG/es/x?q=/"), (2, "https://example.org"), (3, "https://b.a.example.org/es/"), (4, None), (5, "no scheme"), (6, ""),
    (7, "ftp://notexample.org/es/"), (7, "ftp://notexample.org/es/"), (None, "http://x.net#/a"), (8, "http://"), (9, "http://a.b/" + "p/" * 50_000), (10, "x://.org/"),
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in RULES
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_against_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string").withColumn("host", F.lit("extra")).withColumn("id", F.lit(0)).withColumn("digest", F.lit(""))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(i, *judged(u)) for i, u in URLS], key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}
