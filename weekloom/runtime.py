"""Session settings, reliable checkpoints, shared folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def build_session(app: str = "weekloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings stay with spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="weekloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and survive a lost executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a lookup whose row count was counted and is within the bound.

    The lookup is evaluated once into a checkpoint, so counting it costs nothing
    extra. Above the bound it is returned without a hint: Spark then shuffles the
    join and adaptive execution splits skewed keys.
    """
    kept = durable(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: for inputs that several passes need."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
