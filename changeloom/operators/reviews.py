"""Reviews, quizzes and groups of changes.

Rows with a null key are a key of their own unless a docstring says otherwise; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators import blocks
from changeloom.sources.tables import settle


def vanished(old: DataFrame, new: DataFrame, file: list[str], name: str, order: str) -> DataFrame:
    """file, name, first: names of the old side that the new side no longer has, with the first place of each. Null names are left out."""
    gone = old.where(F.col(name).isNotNull()).join(new.select(*file, name).distinct(), [*file, name], "left_anti")
    return gone.groupBy(*file, name).agg(F.min(order).alias("first"))


def broken_references(gone: DataFrame, uses: DataFrame, file: list[str], name: str, order: str, most: int = 5) -> DataFrame:
    """The uses (file, name, order) of vanished names (file, name), the first `most` of each name and file."""
    hits = uses.join(gone.select(*file, name).distinct(), [*file, name], "left_semi")
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*file, name).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def import_changes(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, module, symbol, change (added or removed) of two versions' imports (file, module, symbol), each once."""
    o, n = (d.select(*file, "module", "symbol").distinct().withColumn(c, F.lit(True)) for d, c in ((old, "_o"), (new, "_n")))
    both = o.join(n, [*file, "module", "symbol"], "full_outer").where("_o IS NULL OR _n IS NULL")
    return both.select(*file, "module", "symbol", F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"))


def _lone(side: DataFrame, keys: list[str], value: str) -> DataFrame:
    return side.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def local_renames(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, module, symbol, old_local, new_local: imports (file, module, symbol, local) with one local name on each side that differ, where the other side doesn't use the name for anything else."""
    keys = [*file, "module", "symbol"]
    both = _lone(old, keys, "local").withColumnRenamed("local", "old_local").join(_lone(new, keys, "local").withColumnRenamed("local", "new_local"), keys).where("old_local <> new_local")
    both = both.join(new.select(*file, F.col("local").alias("old_local")).distinct(), [*file, "old_local"], "left_anti")
    return both.join(old.select(*file, F.col("local").alias("new_local")).distinct(), [*file, "new_local"], "left_anti").select(*keys, "old_local", "new_local")


def swapped_imports(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, local, old_module, old_symbol, new_module, new_symbol: local names that stand for one import on each side, another one each."""
    side = lambda d, name: d.groupBy(*file, "local").agg(F.count_distinct("module", "symbol").alias("_n"), F.min(F.struct("module", "symbol")).alias("_m")).where("_n = 1").select(*file, "local", F.col("_m.module").alias(f"{name}_module"), F.col("_m.symbol").alias(f"{name}_symbol"))
    return side(old, "old").join(side(new, "new"), [*file, "local"]).where("old_module <> new_module OR old_symbol <> new_symbol")


def extractions(lines: DataFrame, pairs: DataFrame, key: str, least: int = 3, share: int = 2, percent: int = 70) -> DataFrame:
    """key, n_lines, n_covered, receivers (sorted): texts whose lines (key, norm) went to others.

    pairs (a, b), each once, are those that may have received a's lines, `share` different ones at least each; there must be two or more,
    and together they must hold `percent` percent of a's lines, of which there are `least` or more. Lines meet by their MD5.
    """
    own = lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.base64(F.unhex(F.md5("norm")))).alias("s"))
    units = own.select(key, F.concat(F.array(F.hex(F.col(key).cast("string"))), "s").alias("units"))  # with their keys no two texts are equal

    def work(texts: list[list[str]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        sets = [frozenset(t[1:]) for t in texts]
        for left, part in blocks.by_left(x, y):
            at, covered = [], set()
            for k, right in zip(part.tolist(), y[part].tolist(), strict=True):
                both = sets[left] & sets[right]
                if len(both) >= share:
                    at.append(k)
                    covered |= both
            if at:  # what the text's pairs of this group cover stands with the first
                yield np.array(at), [pa.array([len(sets[left])] * len(at)), pa.array([list(covered), *[None] * (len(at) - 1)], pa.list_(pa.string()))]

    given = blocks.over_pairs(units, pairs, key, work, "n_lines long, covered array<string>")
    got = given.groupBy(F.col("a").alias(key)).agg(F.max("n_lines").alias("n_lines"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_covered"), F.sort_array(F.collect_set("b")).alias("receivers"))
    return got.where((F.col("n_lines") >= least) & (F.size("receivers") >= 2) & (100 * F.col("n_covered") >= percent * F.col("n_lines"))).select(key, "n_lines", "n_covered", "receivers")


def stale_calls(calls: DataFrame, symbol: list[str], updated: Column) -> DataFrame:
    """symbol, n_calls, n_stale: call sites of changed signatures and how many were not updated."""
    return calls.groupBy(*symbol).agg(F.count("*").alias("n_calls"), F.count_if(~F.coalesce(updated, F.lit(False))).alias("n_stale"))


def agreed(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value: the one value that all facts of a key agree on, null if they disagree. Null values are no facts."""
    return facts.groupBy(*key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def drop_adjacent(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows without those whose value equals the one right before; later repeats stay."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_b", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where(f"_n = 1 OR NOT (`{value}` <=> _b)").drop("_b", "_n")


def answer_log(answers: DataFrame, key: list[str], order: str, choice: str) -> DataFrame:
    """Answers that are kept, with `attempt` from 1: a repeat of the latest answer to a question is none, another one is a retake."""
    return drop_adjacent(answers, key, order, choice).withColumn("attempt", F.row_number().over(Window.partitionBy(*key).orderBy(order)).cast("long"))


def ungraded(answers: DataFrame, marks: DataFrame, key: list[str], user: str, at: str) -> DataFrame:
    """Answers (key, user, at) without a mark of their own key, and without an older-style mark (null key) of their user from then or later."""
    own = answers.join(marks.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*key).distinct(), key, "left_anti")
    old = marks.where(" AND ".join(f"{k} IS NULL" for k in key)).groupBy(user).agg(F.max(at).alias("_until"))
    return own.join(old, user, "left").where(F.col("_until").isNull() | (F.col(at) > F.col("_until"))).select(*answers.columns)


def latest_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last."""
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"))
    return got.select("_r.*")


def gate(score: DataFrame, total: Column, author_rule: Column, reviewer_rule: Column, passed_by: Column) -> DataFrame:
    """Adds author_waits, reviewer_waits, status and lead (text) to scores with latest_right and answered: an author has passed when all questions are answered and the latest answers right."""
    author = author_rule & ~((F.col("answered") == total) & (F.col("latest_right") == total))
    reviewer = reviewer_rule & (passed_by == "")
    by = F.when(passed_by != "", F.concat(F.lit("Quiz passed by "), passed_by)).otherwise("")
    lead = F.when(author & reviewer, "Waiting on the author's quiz and a reviewer's").when(author, F.concat(F.lit("Waiting on the author's quiz"), F.when(by != "", F.concat(F.lit(" · "), by)).otherwise(""))).when(reviewer, "Waiting on a reviewer's quiz").otherwise(by)
    return score.withColumns({"author_waits": author, "reviewer_waits": reviewer, "status": F.when(author | reviewer, "in_progress").otherwise("completed"), "lead": lead})


def vote(votes: DataFrame, hunk: str, group: str) -> DataFrame:
    """hunk, group: the group that most entries of a hunk belong to, of equally many the lowest."""
    n = votes.where(F.col(group).isNotNull()).groupBy(hunk, group).agg(F.count("*").alias("_c"))
    return n.groupBy(hunk).agg(F.max_by(group, F.struct("_c", -F.col(group))).alias(group))


def first_and_rest(rows: DataFrame, key: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """key, shown (the first n values in order, joined by commas), more (how many others)."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", F.col(value).cast("string").alias("v"))))), lambda x: x["v"]), ",")
    return r.groupBy(*key).agg(shown.alias("shown"), F.count_if(F.col("_r") > n).alias("more"))


def fit_budget(rows: DataFrame, key: str, order: str, size: Column, kind: Column, drop_first: list[str], budget: int, keep: str = "user") -> DataFrame:
    """The rows of each key that a budget keeps, with `number` from 1.

    While a key's rows are too many, whole kinds go in the order of drop_first; then the oldest rows not of kind `keep`, then
    the oldest of all, until the rest fits.
    """
    r = rows.withColumns({"_s": F.coalesce(size, F.lit(0)).cast("long"), "_k": F.coalesce(kind, F.lit(""))})
    for k in drop_first:
        w = Window.partitionBy(key)
        r = r.withColumn("_t", F.sum("_s").over(w)).where((F.col("_t") <= budget) | (F.col("_k") != k)).drop("_t")
    first = Window.partitionBy(key).orderBy((F.col("_k") == keep).cast("int").desc(), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_u", F.sum("_s").over(first)).where(F.col("_u") <= budget).drop("_u", "_s", "_k")
    return r.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def units(edges: DataFrame) -> DataFrame:
    """node, unit: the least node that edges (a, b) connect each node with. Nodes without edges do not appear.

    Labels fall to the least of the neighbours' and are then followed once; each round is a table, so long chains take
    about the logarithm of their length.
    """
    e = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    lab = settle(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("unit")), "labels")
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "unit"), "b").groupBy(F.col("a").alias("node")).agg(F.min("unit").alias("m"))
        step = lab.join(near, "node").select("node", F.col("unit").alias("was"), F.least("unit", "m").alias("c"))
        new = step.join(lab.select(F.col("node").alias("c"), F.col("unit").alias("j")), "c").select("node", "was", F.least("c", "j").alias("unit"))
        new = settle(new, "labels")
        lab = new.select("node", "unit")
        if new.where("was <> unit").isEmpty():
            return lab


def number_in_order(rows: DataFrame, order: list[Column], key: list[str] | None = None) -> DataFrame:
    """Adds `place` from 1 in order, within key or over all rows; over all rows the places of a whole table are sorted in one task, so give a key where there is one."""
    w = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def concepts_for(changed: Column) -> Column:
    """How many concepts a lesson has by the number of changed lines."""
    return F.when(changed < 80, 1).when(changed < 400, 2).otherwise(3)
