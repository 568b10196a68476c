"""Whole changes from what git prints: status lists, patches and contents as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import paths
from changeloom.functions import text as T

MOST_PARSED = 1_500_000  # bytes of a side beyond which a file has no language
STATUS = pa.schema([("change_id", pa.string()), ("seq", pa.int64()), ("status", pa.string()), ("old_path", pa.string()), ("new_path", pa.string())])
# fixed values: names of roles in attribute files
ROLE_WORDS = {"source": ["source", "src", "code"], "test": ["test", "tests"], "docs": ["docs", "doc", "documentation"], "generated": ["generated"], "vendored": ["vendored", "vendor"]}


def parse_name_status(outputs: DataFrame) -> DataFrame:
    """change_id, seq, status, old_path, new_path of NUL-separated status lists (change_id, out). Renames and copies take two paths, others one; an entry whose paths are missing ends its list. Null lists have none."""

    def entries(out: str) -> Iterator[tuple[str, str, str]]:
        fields = iter([f for f in out.split("\0") if f])
        for status in fields:
            old = next(fields, None)
            new = next(fields, None) if status[0] in "RC" else old
            if old is None or new is None:
                return
            yield status[0], old, new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(change, i, *e) for change, out in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, e in enumerate(entries(out or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, STATUS, strict=True)], schema=STATUS)

    return outputs.selectExpr("cast(change_id as string)", "out").mapInArrow(run, "change_id string, seq long, status string, old_path string, new_path string")


def split_patches(patches: DataFrame) -> DataFrame:
    """change_id, header, section of patches (change_id, raw) of many files; sections with the same header are put together in order. What stands before the first header is left out."""
    parts = patches.select("change_id", F.posexplode(F.split("raw", r"(?m)^(?=diff --(?:git|cc|combined) )")).alias("at", "part")).where(F.col("part").rlike("^diff --(git|cc|combined) "))
    parts = parts.withColumn("header", F.substring_index("part", "\n", 1))
    return parts.groupBy("change_id", "header").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("section"))


def patches_of(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """The entries with their patch (raw_diff, '' without one): by quoted header, by plain header, and for unmerged files by combined ones."""
    a, b, new = F.concat(F.lit("a/"), "old_path"), F.concat(F.lit("b/"), "new_path"), C.c_quote(F.col("new_path"))
    header = lambda x, y: F.concat(F.lit("diff --git "), x, F.lit(" "), y)
    keys = F.concat(F.array(header(C.c_quote(a), C.c_quote(b)), header(a, b)), F.when(F.col("status") == "U", F.array(F.concat(F.lit("diff --cc "), new), F.concat(F.lit("diff --combined "), new))).otherwise(F.array().cast("array<string>")))
    found = entries.select("change_id", "seq", F.posexplode(keys).alias("rank", "header")).join(sections, ["change_id", "header"]).groupBy("change_id", "seq").agg(F.min_by("section", "rank").alias("raw_diff"))
    return entries.join(found, ["change_id", "seq"], "left").withColumn("raw_diff", F.coalesce("raw_diff", F.lit("")))


def addition_patch(path: Column, content: Column) -> Column:
    """A patch that adds content as a new file; '' for an empty one."""
    lines = T.lines(content)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x, F.lit("\n"))), "")))


def file_changes(entries: DataFrame, sections: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for each entry of a status list: paths, status, both sources, binary, language, role, raw_diff.

    contents (change_id, side, path, data) are the files' bytes; what is missing there is empty. Added and copied files have
    no old side, deleted ones no new one. Binary files (a NUL byte) have empty sources and no patch; they and files of more
    than MOST_PARSED bytes have the language unknown.
    """
    side = lambda s, p: contents.where(F.col("side") == s).select("change_id", F.col("path").alias(p), F.col("data").alias(f"{s}_data"))
    both = patches_of(entries, sections).join(side("old", "old_path"), ["change_id", "old_path"], "left").join(side("new", "new_path"), ["change_id", "new_path"], "left")
    both = both.withColumns({"old_data": F.when(~F.col("status").isin("A", "C"), F.col("old_data")), "new_data": F.when(F.col("status") != "D", F.col("new_data"))})
    nul = lambda c: F.coalesce(F.position(F.lit(b"\x00"), c) > 0, F.lit(False))
    binary = nul("old_data") | nul("new_data")
    large = F.greatest(F.coalesce(F.octet_length("old_data"), F.lit(0)), F.coalesce(F.octet_length("new_data"), F.lit(0))) > MOST_PARSED
    text = lambda c: F.when(binary, "").otherwise(F.coalesce(F.decode(c, "UTF-8"), F.lit("")))
    path = F.col("new_path")
    return both.select("change_id", "seq", "status", "old_path", "new_path", text("old_data").alias("old_source"), text("new_data").alias("new_source"), binary.alias("binary"), F.when(binary | large, "unknown").otherwise(paths.language(path)).alias("language"), paths.role(path).alias("role"), F.when(binary, "").otherwise(F.col("raw_diff")).alias("raw_diff"))


def override_role(detected: Column, role: Column, linguist: dict[str, Column]) -> Column:
    """The role an attribute file gives: a role by name; else a linguist attribute that is set or true gives its role, and one that is unset takes the detected role away."""
    named = F.lit(None).cast("string")
    for r, words in ROLE_WORDS.items():
        named = F.when(F.lower(F.trim(role)).isin(words), r).otherwise(named)
    out = detected
    for r, c in linguist.items():
        out = F.when(c.isin("set", "true"), r).when(c.isNotNull() & ~c.isin("unspecified", "set", "true") & (detected == r), "source").otherwise(out)
    return F.coalesce(named, out)
