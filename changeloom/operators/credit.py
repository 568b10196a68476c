"""Whose decision it was: the nearest of a person's messages before and after an event, as an as-of join both ways (C17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(points: DataFrame, marks: DataFrame, key: list[str], at: str) -> DataFrame:
    """points (key, at, ...) with before and after: the greatest `at` of a mark (key, at) of its key below its own, and the least one above.

    One sort of both tables together; a key's rows are one window, sorted and spilled to disk. Marks at a point's own place are neither.
    Points without a key or a place have no neighbours.
    """
    both = points.withColumn("_m", F.lit(None).cast(points.schema[at].dataType)).unionByName(marks.select(*key, at, F.col(at).alias("_m")).distinct(), allowMissingColumns=True).withColumn("_point", F.col("_m").isNull())
    w = Window.partitionBy(*key).orderBy(at)
    # places are counted, so that "before" can be one place less whatever the type of `at`
    ranked = both.withColumn("_r", F.dense_rank().over(w))
    v = Window.partitionBy(*key).orderBy("_r")
    out = ranked.withColumns({"before": F.last("_m", ignorenulls=True).over(v.rangeBetween(Window.unboundedPreceding, -1)), "after": F.first("_m", ignorenulls=True).over(v.rangeBetween(1, Window.unboundedFollowing))})
    fits = F.col(at).isNotNull()
    for k in key:
        fits = fits & F.col(k).isNotNull()
    return out.where("_point").withColumns({"before": F.when(fits, F.col("before")), "after": F.when(fits, F.col("after"))}).drop("_m", "_r", "_point")


def repair_credit(decisions: DataFrame, trace: DataFrame, key: list[str], person: Column | str = "user") -> DataFrame:
    """decisions (key, id, who, event, ...) with who and at_event as the trace (key, n, who) bears them out.

    who is you, approved or agent; anything else counts as agent. A choice credited to the person must rest on their own words: where it
    names another's message, one that they asked for ("you") is theirs from the nearest message of theirs before it; else a reply of theirs behind it
    means that they approved; else it was the agent's. Events that are not in the trace are left as they are. A trace has each n once.
    """
    told = F.when(F.col("who").isin("you", "approved"), F.col("who")).otherwise("agent")
    points = decisions.withColumn("who", told).withColumnRenamed("event", "n")
    spoken = trace.where(F.col("who") == person)
    near = nearest(points, spoken.select(*key, "n"), key, "n")
    seen = trace.select(*key, "n", F.col("who").alias("_speaker"))
    rows = near.join(seen, [*key, "n"], "left")
    doubt = (F.col("who") != "agent") & F.col("_speaker").isNotNull() & (F.col("_speaker") != person)
    asked = doubt & (F.col("who") == "you") & F.col("before").isNotNull()
    replied = doubt & ~asked & F.col("after").isNotNull()
    who = F.when(asked, "you").when(replied, "approved").when(doubt, "agent").otherwise(F.col("who"))
    at = F.when(asked, F.col("before")).when(replied, F.col("after")).otherwise(F.col("n"))
    return rows.withColumns({"who": who, "at_event": at}).withColumnRenamed("n", "event").drop("before", "after", "_speaker")
