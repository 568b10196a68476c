"""Names that a change took away and the rest of the repository still uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import paths, references
from changeloom.operators import renames

MOST_EACH = 10
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """repo, path, line, text, name, qualifier: lines (repo, path, line, code, text) of blanked code that hold one of a repository's names (repo, name), the first place of each.

    The identifiers of a line meet the names by an equi-join; a name that is very common makes as many rows as lines hold it.
    """
    words = lines.select("repo", "path", "line", "text", "code", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(rf"(?<![A-Za-z0-9_$]){NAME}"), 0))).alias("name"))
    hits = words.join(names.select("repo", "name").distinct(), ["repo", "name"])
    before = F.call_function("regexp_extract", F.col("code"), F.concat(F.lit(r"^(.*?)(?<![A-Za-z0-9_$])\Q"), F.col("name"), F.lit(r"\E(?![A-Za-z0-9_$])")), F.lit(1))
    return hits.withColumn("qualifier", F.regexp_extract(before, r"([A-Za-z0-9_$]*)(?:\?\.|\.|->|::)$", 1)).select("repo", "path", "line", "text", "code", "name", "qualifier")


def repo_references(vanished: DataFrame, changed: DataFrame, lines: DataFrame, most: int = MOST_EACH) -> DataFrame:
    """change_id, name, origin, path, line, text: uses of vanished names outside of the change, the first `most` of each by path and line.

    vanished (change_id, repo, name, origin, exported), names as `owner.name` or bare; changed (change_id, path): the change's own files, which are
    looked at elsewhere; lines (repo, path, line, code: blanked, text) of the repository as it is afterwards. Left out are files of unknown languages, documentation,
    vendored and generated ones, mentions whose qualifier can't mean the name, and what can't see a private one. A name that other
    code defines too is nobody's. Names that vanish twice in a change are one, by their least origin.
    """
    gone = vanished.groupBy("change_id", "repo", "name").agg(F.min_by(F.struct("origin", "exported"), "origin").alias("x")).select("change_id", "repo", "name", "x.*").withColumn("bare", C.bare_name(F.col("name")))
    found = mentions(lines, gone.select("repo", F.col("bare").alias("name")))
    role = paths.role(F.col("path"))
    found = found.where((paths.language(F.col("path")) != "unknown") & ~role.isin("docs", "vendored", "generated"))
    both = found.withColumnRenamed("name", "bare").join(gone, ["repo", "bare"])
    away = both.join(changed.select("change_id", "path").distinct(), ["change_id", "path"], "left_anti").withColumn("defines", references.defines(F.col("code"), F.col("bare")))
    twice = away.where("defines").select("change_id", "name").distinct()
    fits = references.reference_ok(F.col("qualifier"), F.col("name"), F.col("origin"), renames.distinctive(F.col("bare")))
    used = away.join(twice, ["change_id", "name"], "left_anti").where(fits & (F.col("exported") | references.private_reaches(F.col("origin"), F.col("path"))))
    w = Window.partitionBy("change_id", "name").orderBy("path", "line")
    return used.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("change_id", "name", "origin", "path", "line", "text")
