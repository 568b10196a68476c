"""Which C files compile others in, directly or through headers (F10): as many joins as the depth allows.

Spark's recursive CTE has no set semantics and stops at a million rows, so each level is joined and made distinct by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 2


def include_table(lines: DataFrame) -> DataFrame:
    """path, target: the file that each `#include "x"` line of lines (path, line) names, from the folder of the file it stands in; <x> and includes that leave the tree are left out."""
    named = lines.select("path", F.regexp_extract("line", r'^\s*#\s*include\s*"([^"]+)"', 1).alias("to")).where("to <> ''")
    parts = F.concat(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.split("to", "/"))
    start = F.array().cast("array<string>")
    up = F.aggregate(parts, start, lambda s, p: F.when(p.isin(".", ""), s).when((p == "..") & (F.size(s) > 0) & (F.get(s, F.size(s) - 1) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return named.select("path", F.array_join(up, "/").alias("target")).where(~F.col("target").startswith("../")).distinct()


def compiled_in(includes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, target, steps: the .c files that a file includes itself (0), or through at most `depth` headers (.h), each at its least number. A file does not compile in itself."""
    edges = includes.select("path", "target").where("path IS NOT NULL AND target IS NOT NULL").distinct()
    level, levels = edges, [edges.withColumn("steps", F.lit(0).cast("long"))]
    for n in range(1, depth + 1):
        via = level.where("endswith(target, '.h')").withColumnRenamed("target", "via")
        level = via.join(edges.withColumnRenamed("path", "via"), "via").select("path", "target").distinct()
        levels.append(level.withColumn("steps", F.lit(n).cast("long")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.where("endswith(target, '.c') AND target <> path").groupBy("path", "target").agg(F.min("steps").alias("steps"))
