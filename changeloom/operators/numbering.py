"""A running number over all rows of a table, in an order, without bringing them into one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.sources.tables import settle


def number_rows(df: DataFrame, order: list[Column], name: str = "id", first: int = 1) -> DataFrame:
    """df with `name`: its place in the order, from `first`.

    Rows are dealt by ranges of the order and numbered within each; a range's first number is the count of all before it. Those
    counts, one a partition, are all that the driver sees. Nulls come first in ascending columns; which of equal rows comes first
    is open, so an order that tells all rows apart gives the same numbers each time. An empty table stays empty.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = dict(part.groupBy("_part").count().collect())
    upto = dict(zip(sorted(sizes), np.cumsum([first, *(sizes[k] for k in sorted(sizes))])[:-1].tolist(), strict=True))
    base = F.create_map(*[F.lit(x) for kv in upto.items() for x in kv]) if upto else F.create_map().cast("map<int,bigint>")
    return part.withColumn(name, F.element_at(base, F.col("_part")).cast("long") + F.col("_at")).drop("_part", "_at")
