"""Sessions, quizzes, spans and rankings over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAK_SECONDS = 2 * 3600
HUNK_CONTEXT, SPAN_GAP = 3, 8


def session_cut(events: DataFrame, key: str, ts: str, tie: str, write: Column, prompt: Column, other: Column) -> DataFrame:
    """The events of each session up to its end. Sessions without a write are dropped.

    After the last write a session ends at a prompt that follows its predecessor by more than two hours, or at the first write
    elsewhere, backed up to the prompt before it, whichever comes first.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    whole = Window.partitionBy(key)
    e = events.withColumns({"_n": F.row_number().over(w), "_gap": F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w), "_w": write, "_p": prompt, "_o": other})
    e = e.withColumn("_last", F.max(F.when(F.col("_w"), F.col("_n"))).over(whole)).where("_last is not null")
    after = F.col("_n") > F.col("_last")
    e = e.withColumns({"_pause": F.min(F.when(after & F.col("_p") & (F.floor(F.col("_gap")) > BREAK_SECONDS), F.col("_n"))).over(whole), "_away": F.min(F.when(after & ~F.col("_p") & F.col("_o"), F.col("_n"))).over(whole)})
    e = e.withColumn("_ask", F.max(F.when(after & F.col("_p") & (F.col("_n") < F.col("_away")), F.col("_n"))).over(whole))
    end = F.when(F.col("_pause") < F.coalesce("_away", F.lit(2**31 - 1)), F.col("_pause")).otherwise(F.coalesce("_ask", "_away"))
    return e.withColumn("_cut", end).where(F.col("_cut").isNull() | (F.col("_n") < F.col("_cut"))).drop("_n", "_gap", "_w", "_p", "_o", "_last", "_pause", "_away", "_ask", "_cut")


def number_newest(df: DataFrame, key: str, order: str, keep: int = 20) -> DataFrame:
    """Adds number (from 1, oldest first) to the newest `keep` rows of each key."""
    new = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= keep)
    return new.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")).drop("_r")


def within_budget(df: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """The rows of each key in order until the first that no longer fits, with `used` so far; later ones that would fit are left out too."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).withColumn("_most", F.max("used").over(w)).where(F.col("_most") <= budget).drop("_most")


def context_hunks(lines: DataFrame, key: str, at: str, changed: Column, context: int = HUNK_CONTEXT) -> DataFrame:
    """key, first, last, n_changed of the runs of lines that lie within `context` lines of a changed one."""
    w = Window.partitionBy(key).orderBy(at)
    near = lines.withColumn("_c", changed.cast("int")).withColumn("_k", F.max("_c").over(w.rowsBetween(-context, context))).where("_k = 1")
    runs = near.withColumn("_g", F.col(at) - F.row_number().over(w))
    return runs.groupBy(key, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.sum("_c").cast("long").alias("n_changed")).drop("_g")


def merge_spans(spans: DataFrame, key: str, start: str, end: str, gap: int = SPAN_GAP) -> DataFrame:
    """key, start, end, n: spans that begin at most `gap` after the furthest end before them become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    s = spans.withColumn("_far", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_g", F.sum(F.when(F.col(start) <= F.col("_far") + gap, 0).otherwise(1)).over(w))
    return s.groupBy(key, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_g")


def quiz_score(attempts: DataFrame, key: list[str], question: str, seq: str, right: Column) -> DataFrame:
    """key, answered, first_right, latest_right, most_tries over each one's questions."""
    q = attempts.withColumn("_r", right.cast("int")).groupBy(*key, question).agg(F.min_by("_r", seq).alias("f"), F.max_by("_r", seq).alias("l"), F.count("*").alias("n"))
    return q.groupBy(*key).agg(F.count("*").alias("answered"), F.sum("f").cast("long").alias("first_right"), F.sum("l").cast("long").alias("latest_right"), F.max("n").alias("most_tries"))


def grade_fold(attempts: DataFrame, key: list[str], choice: str, seq: str, right: Column) -> DataFrame:
    """key, first_choice, ever_right: the first answer counts, having been right once stays."""
    return attempts.groupBy(*key).agg(F.min_by(choice, seq).alias("first_choice"), F.max(right).alias("ever_right"))


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_each(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def set_diff(old: DataFrame, new: DataFrame, key: list[str], item: str) -> DataFrame:
    """key, added, removed (sorted arrays): what each key's set of items gained and lost; a side may be missing."""
    o = old.groupBy(*key).agg(F.collect_set(item).alias("o"))
    n = new.groupBy(*key).agg(F.collect_set(item).alias("n"))
    both = o.join(n, key, "full_outer")
    kind = both.schema["o"].dataType
    x, y = F.coalesce("o", F.array().cast(kind)), F.coalesce("n", F.array().cast(kind))
    return both.select(*key, F.sort_array(F.array_except(y, x)).alias("added"), F.sort_array(F.array_except(x, y)).alias("removed"))


def unreferenced(items: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    return items.join(refs.select(key).distinct(), key, "left_anti")
