"""Reports as JSON files: a line for each change with its entries (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(entries: DataFrame, path: str, change: str = "change_id") -> None:
    """Writes {change, entries: [...]} lines; entries are in the order of their columns, nulls are left out. One change's entries come into one row."""
    fields = [c for c in entries.columns if c != change]
    entries.groupBy(change).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entries")).write.json(path)


def read_report(spark: SparkSession, path: str, like: DataFrame, change: str = "change_id") -> DataFrame:
    """The entries of a report, with the columns and types of `like`."""
    fields = [c for c in like.columns if c != change]
    ddl = f"{change} {like.schema[change].dataType.simpleString()}, entries array<struct<{','.join(f'`{c}`:{like.schema[c].dataType.simpleString()}' for c in fields)}>>"
    return spark.read.schema(ddl).json(path).select(change, F.explode("entries").alias("e")).select(change, "e.*")
