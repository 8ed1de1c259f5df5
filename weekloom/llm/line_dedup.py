"""Fuzzy line dedup by an exact similarity join of shingle sets.

A line's shingles are the 16 characters from every place that no ASCII letter
precedes (word starts, every place of unspaced scripts) and its last 16. Two lines
link when the Jaccard similarity of their sets is 0.8 or more. A set of n shares
ceil(0.8 n) of them with any partner, so it offers the others and one more, the
rarest first: partners share an offered shingle. "Rare" means the order of a
fixed-size counter table over a sixteenth of the lines, which decides the order of
the search only, not its result.

 1. every bucket (the lines that offer a shingle) has a centre, another line in each
    bucket; every line is compared with the smallest one of its centres, links make groups;
 2. the other centres of a line are compared if they are of another group by then, so
    a line of a large group of near copies is compared about once;
 3. in buckets with lines of several groups, all lines of different groups are
    compared, so a bucket of near copies is not expanded into its pairs. A line brings
    the parities of its shingles in 512 cells: sets that differ in d shingles differ
    in d cells at most, so pairs that cannot link are never written;
 4. exact similarity confirms, distributed union-find joins the links, and of each
    component the first line by (id, place) stays in the corpus.

Lines are compared without case and outer blanks. Lines under 16 characters are
left alone. Copies are counted before anything is shuffled, and a line of many
copies offers its shingles once, so a line that holds a third of all rows is one row
in the search. All steps are column expressions, windows and joins.

Defined results
  * null text stays null, empty stays empty; a text whose lines all went is empty.
  * documents without an id come last in the order that picks the line that stays.
  * rows that repeat both id and text are one document and get the same result.
  * lines are numbered by a 64-bit hash.
  * an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.components import connected
from weekloom.runtime import stored

SHINGLE = 16
COUNTERS = 1 << 17
PAGE = 1 << 10  # counters in one row of the table as it is collected
COUNTED = 16  # one line in so many is counted
LEVELS = 63  # of rarity: three times the logarithm of a counter
MANY = 64  # lines of so many copies offer their shingles once
WORDS = 8  # of 64 cells, in the parities of a line
LIGHT_ROWS = 1_000_000

# A match starts at a place, keeps the shingle and runs on to the next place, so nothing is searched between matches.
PLACES = rf"(?s)(?=(.{{{SHINGLE}}}))[a-z]*+.?"


def _plain(line: Column) -> Column:
    return F.lower(F.trim(line))


def _shingles(plain: Column) -> Column:
    return F.array_append(F.regexp_extract_all(plain, F.lit(PLACES), F.lit(1)), F.right(plain, F.lit(SHINGLE)))


def _hashes(plain: Column) -> Column:
    return F.transform(_shingles(plain), lambda s: F.xxhash64(s))


def shingle_numbers(plain: Column) -> Column:
    """Distinct hashes of the shingles of a line of 16 characters or more."""
    return F.array_distinct(_hashes(plain))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, place, line, plain) of every line that takes part."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    return lines.select("id", "text_hash", "place", _plain(F.col("raw")).alias("plain")).filter(F.length("plain") >= SHINGLE).withColumn(
        "line", F.xxhash64("plain"))


def _here() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "place")


def _slot(shingle: Column) -> Column:
    return shingle.bitwiseAND(F.lit(COUNTERS - 1).cast("long"))


def _rarity(occurrences: DataFrame) -> str:
    """One level from 1 on for each counter, separated by commas: how often shingles of this slot occur in the counted lines."""
    spark = occurrences.sparkSession
    some = occurrences.filter(F.pmod("line", F.lit(COUNTED)) == 0).select(F.explode(_hashes(F.col("plain"))).alias("s"))
    counts = some.groupBy(_slot(F.col("s")).alias("id")).count()
    level = F.least(F.round(3 * F.log1p(F.coalesce("count", F.lit(0)))), F.lit(LEVELS - 1.0)).cast("int")
    levels = spark.range(COUNTERS).join(counts, "id", "left").select("id", (level + 1).cast("string").alias("c"))
    pages = levels.groupBy(F.floor(F.col("id") / PAGE).alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "c"))), lambda x: x.c), ",").alias("levels"))
    return ",".join(r.levels for r in sorted(pages.collect()))


def _keys(plain: Column, rarity: str) -> Column:
    """The shingles of a line in the order of the search, the rarest first: level and 57 bits of the hash in one number."""
    table = F.split(F.lit(rarity), ",").cast("array<tinyint>")  # a constant

    def key(s: Column) -> Column:
        return F.shiftleft(F.get(table, _slot(s).cast("int")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(s, 7))

    return F.sort_array(F.transform(shingle_numbers(plain), key))


def _once(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, plain) of every line; only the first row of lines of many copies."""
    many = lines.filter(F.col("n") >= MANY).select("line", "first")
    met = occurrences.join(_light(many, many.count()), "line", "left")
    return met.filter(F.col("first").isNull() | _here().eqNullSafe(F.col("first"))).select("line", "plain")


def _fits(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether two sets whose first shared shingle has these places can be similar: 0.8 is 9 |A and B| >= 4 (|A| + |B|)."""
    return 9 * F.least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)


def _buckets(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """(shingle, line, n, at, wide, centre, fits) of the offered shingles that two lines or more offer.

    A set of n offers floor(n / 5) + 1, as n - ceil(0.8 n) is floor(n / 5). ``at`` is the shingle's place in the
    order, ``wide`` tells whether the bucket has a third line. ``centre`` has the bucket's smallest
    number after the shingle is mixed in, so that a line of many buckets meets a different one in each;
    ``fits`` tells whether the two can be similar.
    """
    keys = _once(occurrences, lines).select("line", _keys(F.col("plain"), _rarity(occurrences)).alias("keys"))
    sized = keys.select("line", F.size("keys").cast("long").alias("n"), F.slice("keys", 1, F.floor(F.size("keys") / 5).cast("int") + 1).alias("keys"))
    # Every line has keys. The outer form keeps Spark from filtering by the keys first, which would compute them twice.
    offered = sized.select("line", "n", F.posexplode_outer("keys").alias("at", "shingle")).select(
        "shingle", "line", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
    bucket = Window.partitionBy("shingle")
    shared = offered.select("*", F.min("line").over(bucket).alias("low"), F.max("line").over(bucket).alias("high")).filter("low <> high")
    before = F.lag("line").over(bucket.orderBy("line"))
    shared = shared.withColumn("before", before).filter("before IS NULL OR before <> line")
    turned = F.shiftleft("shingle", 7)  # without the level
    met = shared.select(
        "shingle", "line", "place", F.max((F.col("line") != F.col("low")) & (F.col("line") != F.col("high"))).over(bucket).alias("wide"),
        F.min(F.struct(F.col("line").bitwiseXOR(turned).alias("mixed"), "place")).over(bucket).alias("c"))
    n, at = (lambda p: F.shiftright(p, 32)), (lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)))
    own, other = F.col("place"), F.col("c.place")
    centre = F.col("c.mixed").bitwiseXOR(turned)
    return met.select(
        "shingle", "line", n(own).alias("n"), at(own).alias("at"), "wide", centre.alias("centre"),
        ((F.col("line") != centre) & _fits(n(own), at(own), n(other), at(other))).alias("fits"))


def _texts(wanted: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(line, plain) of the wanted lines, one row each."""
    return occurrences.select("line", "plain").join(_light(wanted, wanted.count()), "line", "left_semi").groupBy("line").agg(F.min("plain").alias("plain"))


def _parities(texts: DataFrame) -> DataFrame:
    """(line, p0, p1, ...): a bit is set if an odd number of the line's shingles falls into its cell."""
    cells = texts.select("line", F.explode(shingle_numbers(F.col("plain"))).alias("s"))
    word, bit = F.shiftright("s", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(s & 63 AS int))")
    return cells.groupBy("line").agg(*[F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0))).alias(f"p{k}") for k in range(WORDS)])


def _close() -> Column:
    """Whether the parities of a and b allow the similarity: sets of 0.8 differ in a ninth of |A| + |B| shingles at most."""
    apart = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(WORDS)), F.lit(0))
    return 9 * apart <= F.col("n_a") + F.col("n_b")


def _across(shared: DataFrame, roots: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Distinct (a, b) of lines of one bucket and different groups whose sizes, places and parities allow the similarity."""
    of = roots.withColumnRenamed("id", "line")
    grouped = stored(shared.filter("wide").select("shingle", "line", "n", "at").join(of, "line", "left").withColumn(
        "root", F.coalesce("root", "line")), "line-groups")
    several = grouped.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("shingle")
    rows = stored(grouped.join(several, "shingle", "left_semi"), "line-rest")
    parities = _parities(_texts(stored(rows.select("line").distinct(), "rest-ids"), occurrences))
    marked = rows.join(parities, "line")
    a, b = (marked.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in marked.columns if c != "shingle"]) for side in "ab")
    met = a.join(b, "shingle").filter(
        (F.col("root_a") < F.col("root_b")) & _fits(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")) & _close())
    return met.select(F.col("line_a").alias("a"), F.col("line_b").alias("b")).distinct()


def _light(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast within a checked size, shuffled beyond it."""
    return F.broadcast(df) if rows <= LIGHT_ROWS else df


def _confirmed(pairs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a similarity of 0.8 or more; the texts are moved, as they are shorter than the sets."""
    wanted = stored(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct(), "line-ids")
    texts = _texts(wanted, occurrences)  # both joins read one exchange
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("plain").alias("ta")), "a").join(texts.select(F.col("line").alias("b"), F.col("plain").alias("tb")), "b")
    sets = F.array(F.struct(shingle_numbers(F.col("ta")).alias("a"), shingle_numbers(F.col("tb")).alias("b")))  # evaluated once
    return both.filter(F.exists(sets, lambda s: 9 * F.size(F.array_intersect(s.a, s.b)) >= 4 * (F.size(s.a) + F.size(s.b)))).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are of different groups."""
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def line_links(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b) of links with the components of all pairs of lines whose shingle sets have a similarity of 0.8 or more."""
    shared = stored(_buckets(occurrences, lines), "shared")
    near = stored(shared.filter("fits").select(F.col("centre").alias("a"), F.col("line").alias("b")).distinct(), "line-pairs")
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_confirmed(first, occurrences), "first-links")
    others = stored(_apart(near.join(first, ["a", "b"], "left_anti"), connected(links, "a", "b")), "other-pairs")
    links = stored(links.union(_confirmed(others, occurrences)), "centre-links")
    across = stored(_across(shared, connected(links, "a", "b"), occurrences), "pairs-across")
    return links if across.isEmpty() else links.union(_confirmed(across, occurrences))


def removed_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, removed): sorted places of the lines that go, for documents that lose any."""
    occurrences = stored(_occurrences(docs, id_col, text_col), "occurrences")
    lines = stored(occurrences.groupBy("line").agg(F.count("*").alias("n"), F.min(_here()).alias("first")), "line-counts")
    roots = connected(stored(line_links(occurrences, lines), "line-links"), "a", "b")
    rooted = lines.join(roots.withColumnRenamed("id", "line"), "line", "left").select("line", "n", "first", F.coalesce("root", "line").alias("root"))
    stay = rooted.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("stays")).filter("n > 1").select("root", "stays")
    many = stored(rooted.select("line", "root").join(stay, "root").select(F.col("line").alias("again"), "stays"), "lines-again")
    gone = occurrences.join(_light(many, many.count()), F.col("line") == F.col("again")).filter(~_here().eqNullSafe(F.col("stays")))
    return gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines at sorted places: the runs between them, joined again."""
    lines = F.split(text, "\n")

    def run(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(removed, k - 1) + 1)
        stop = F.when(k == F.size(removed), F.size(lines)).otherwise(F.get(removed, k))
        return F.slice(lines, start + 1, stop - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), run)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): ``row`` is the whole input row as a struct, ``text`` what is left of its text."""
    gone = stored(removed_places(docs, id_col, text_col), "places").select(
        F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    entries = gone.agg(F.coalesce(F.sum(F.size("removed") + 1), F.lit(0))).first()[0]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    met = rows.join(_light(gone, entries), (F.col("text_hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    return met.select(
        "row", F.when(F.col("removed").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("removed"))).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))
