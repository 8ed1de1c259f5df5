"""Small awkward tables for the operator tests."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997} of{i % 31}" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower"

TEXTS = [
    (1, PASSAGE, "en", "web"),
    (2, PASSAGE + " today", "en", "web"),
    (3, PASSAGE.replace(" ", "\t\n "), None, None),
    (4, None, "en", "news"),
    (5, "", "de", None),
    (6, "", None, "web"),
    (7, LONG, "en", "web"),
    (None, PASSAGE, "fr", "web"),
    (8, "two words", "fr", "web"),
    (9, "12 34 !!", "de", "web"),
    (9, "12 34 !!", "de", "web"),
    (10, "Größe und Maß: ein Satz | mit Zeichen ✓", "de", "books"),
    (11, "first line of this little text\nsecond line that is quite different\nFirst line of this little text", "en", "books"),
    (12, "first line of this little text", "en", "books"),
]
CLASHING = ["row", "id", "h", "key", "part", "line", "text_hash", "removed", "norm", "n", "topic", "probability", "root", "a", "b"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in TEXTS], SCHEMA)
    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASHING])


def empty(spark):
    return awkward(spark).limit(0)
