"""Keyed store of fitted Spark ML models in the shared folder, with a manifest."""

from __future__ import annotations

import json

from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KINDS = {k.__name__: k for k in (DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel)}
MANIFEST = "key string, part string, kind string, features array<string>, facts map<string,double>"


class ModelStore:
    """Models by (key, part). The manifest row is written after the model, so a listed model is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def place(self, key: str, part: str) -> str:
        return f"{self.path}/models/{key}/{part}"

    def save(self, key: str, part: str, model, features: list[str], **facts: float) -> None:
        model.write().overwrite().save(self.place(key, part))
        row = {"key": key, "part": part, "kind": type(model).__name__, "features": list(features), "facts": {k: float(v) for k, v in facts.items()}}
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{key}-{part}")

    def manifest(self) -> DataFrame:
        """One row per stored model; none if nothing was stored."""
        try:
            lines = self.spark.read.text(f"{self.path}/manifest/*")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)
        return lines.select(F.from_json("value", MANIFEST).alias("r")).select("r.*")

    def listed(self) -> dict[tuple[str, str], dict]:
        """The manifest by (key, part): one entry per model."""
        return {(r.key, r.part): r.asDict() for r in self.manifest().collect()}

    def load(self, key: str, part: str):
        return KINDS[self.listed()[key, part]["kind"]].load(self.place(key, part))

    def leaves(self, key: str, part: str) -> DataFrame:
        """(tree, leaf, value, weight) of a stored tree ensemble; leaves are numbered as ``leafCol`` numbers them."""
        nodes = self.spark.read.parquet(f"{self.place(key, part)}/data")
        weights = self.spark.read.parquet(f"{self.place(key, part)}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
        leaf = nodes.filter("nodeData.leftChild < 0").groupBy("treeID").agg(
            F.sort_array(F.collect_list(F.struct("nodeData.id", "nodeData.prediction"))).alias("l"))  # one tree's leaves
        return leaf.select("treeID", F.posexplode("l").alias("leaf", "n")).join(weights, "treeID").select(
            F.col("treeID").alias("tree"), "leaf", F.col("n.prediction").alias("value"), F.col("weights").alias("weight"))
