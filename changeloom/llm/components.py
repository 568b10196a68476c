"""Connected components of a graph given as an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node it is connected with) for edges (a, b); nodes without edges do not appear. Each round is a table in the shared folder."""
    e = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    lab = cut(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = lab.join(near, "node").select("node", "comp", F.least("comp", "m").alias("c"))
        jump = lab.select(F.col("node").alias("c"), F.col("comp").alias("j"))
        new = step.join(jump, "c").select("node", F.col("comp").alias("was"), F.least("c", "j").alias("comp"))
        new = cut(new, "labels")
        lab = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return lab
