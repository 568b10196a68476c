"""Saved results by kind and key: the newest of each key, and of each kind the newest fifty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.sources.tables import settle

KEEP = 50
DDL = "kind string, key string, at long, value string"


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """kind, key, at, value of what is saved, of one kind where it is named (only its partition is read); nothing if nothing was saved."""
    try:
        out = spark.read.schema("key string, at long, value string, kind string").parquet(path).select("kind", "key", "at", "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        out = spark.createDataFrame([], DDL)
    return out if kind is None else out.where(F.col("kind") == kind)


def _newest(rows: DataFrame, keep: int) -> DataFrame:
    one = rows.groupBy("kind", "key").agg(F.max_by(F.struct("at", "value"), F.struct("at", "value")).alias("x")).select("kind", "key", "x.*")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at"), "key"))).where(F.col("_r") <= keep).drop("_r")


def save(results: DataFrame, path: str, keep: int = KEEP) -> None:
    """Save results (kind, key, at, value), so that of each key the newest stays (of equally new ones the greatest value) and of each kind the `keep` newest keys.

    What is new is cut down to `keep` rows a kind before it meets what is saved, so a kind's rows are few whatever comes in. Only the
    partitions of kinds that come in are written anew; saving the same results again changes nothing. Rows without a kind or key are left out. One writer at a time.
    """
    spark = results.sparkSession
    fresh = settle(_newest(results.select("kind", "key", F.col("at").cast("long").alias("at"), "value").where("kind IS NOT NULL AND key IS NOT NULL"), keep), "fresh")
    saved = load(spark, path).join(fresh.select("kind").distinct(), "kind", "left_semi")
    merged = settle(_newest(fresh.unionByName(saved), keep), "merged")
    if not merged.isEmpty():
        merged.repartition("kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)
