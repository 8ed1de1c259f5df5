"""CSV sources: typed scans, header repair, report files and tolerant reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.constants import CLIMATE_VARIABLES
from weekloom.runtime import durable

DAILY_CLIMATE = T.StructType(
    [T.StructField("district", T.StringType()), T.StructField("d", T.DateType())]
    + [T.StructField(v, T.DoubleType()) for v in CLIMATE_VARIABLES]
)

# File name of a weekly report, start and end day.
REPORT_NAME = r"(\d{4}-\d{2}-\d{2})_to_(\d{4}-\d{2}-\d{2})"


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Declared schema: no inference pass over the files."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_named(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names as they stand in the header (blanks included)."""
    return (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, bytes) of every file below a folder that has bytes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def _report_end(path: Column) -> Column:
    """The report's end day from its file name; NULL if the name has no such day."""
    return F.try_to_date(F.regexp_extract(path, REPORT_NAME, 2), "yyyy-MM-dd")


def scan_report_files(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Many weekly reports in one scan.

    The report's end day comes from the path; the counted week ended 7 days
    earlier and started 6 days before that. Files whose name holds no valid day are
    left out; ``stray_reports`` lists them.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("report_end", _report_end(F.col("_metadata.file_path")))
        .filter("report_end IS NOT NULL")
    )
    end = F.date_sub("report_end", 7)
    return rows.withColumns({"start_date": F.date_sub(end, 6), "end_date": end}).drop("report_end")


def stray_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, bytes) of the files that ``scan_report_files`` leaves out for their name."""
    return list_files(spark, path).filter(_report_end(F.col("path")).isNull())


def tolerant_scan(spark: SparkSession, path: str, schema: str, keep: str = "_corrupt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, quarantined lines, quarantined files): neither malformed lines nor unreadable files stop the scan.

    The parsed rows are kept once with the file they came from, so all outputs come from a
    single parse. A quarantined file has bytes but gave no row at all. Lines before a damage
    inside a file are kept; files without bytes hold nothing and are not listed.
    """
    rows = durable(
        spark.read.schema(f"{schema}, {keep} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", keep)
        .option("ignoreCorruptFiles", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    good = rows.filter(F.col(keep).isNull()).drop(keep, "_file")
    bad = rows.filter(F.col(keep).isNotNull()).select(F.col(keep).alias("line"), F.col("_file").alias("path"))
    # both sides of the comparison as plain paths: a scheme may be written with one or three slashes
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
    read = rows.select(plain(F.col("_file")).alias("_plain")).distinct()
    files = list_files(spark, path).withColumn("_plain", plain(F.col("path"))).join(read, "_plain", "left_anti")
    return good, bad, files.select("path", "bytes")


def keep_known(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """The known columns that are present, in the known order."""
    return df.select(*[c for c in known if c in df.columns])
