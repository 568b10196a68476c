"""Sources of changes: unified diffs, file pairs, agent transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
LINES = pa.schema([("change_id", pa.string()), ("path", pa.string()), ("hunk", pa.int64()), ("kind", pa.string()), ("old_no", pa.int64()), ("new_no", pa.int64()), ("line", pa.string())])


def _hunk_lines(raw: str) -> Iterator[tuple]:
    """(hunk, kind, old_no, new_no, line) of a patch; a new file header ends a hunk, markers of a missing line end are skipped."""
    hunk, old, new, inside = 0, 0, 0, False
    for line in raw.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("diff --"):
            inside = False
        elif m := HUNK.match(line):
            hunk, old, new, inside = hunk + 1, int(m[1]), int(m[2]), True
        elif inside and line[:1] in ("+", "-", " ", ""):
            if line[:1] == "+":
                yield hunk, "added", None, new, line[1:]
                new += 1
            elif line[:1] == "-":
                yield hunk, "removed", old, None, line[1:]
                old += 1
            else:
                yield hunk, "context", old, new, line[1:]
                old, new = old + 1, new + 1


def parse_unified_diffs(patches: DataFrame) -> DataFrame:
    """Lines of patches (change_id, path, raw): hunk from 1, kind, old_no, new_no, line. Null patches have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for change, path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [dict(zip(LINES.names, (change, path, *r), strict=True)) for r in _hunk_lines(raw or "")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=LINES)

    return patches.select("change_id", "path", "raw").mapInArrow(run, "change_id string, path string, hunk long, kind string, old_no long, new_no long, line string")


def read_file_pairs(spark: SparkSession, old_dir: str, new_dir: str) -> DataFrame:
    """path, old_source, new_source, binary of the files under two folders; a file on one side only has null on the other; a NUL byte makes a file binary."""
    side = lambda d, name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select(F.regexp_extract("path", f"{re.escape(d.rstrip('/').removeprefix('file:').replace('//', '/'))}/(.*)$", 1).alias("path"), F.col("content").alias(name))
    both = side(old_dir, "o").join(side(new_dir, "n"), "path", "full_outer")
    binary = F.coalesce(F.position(F.lit(b"\x00"), "o") > 0, F.lit(False)) | F.coalesce(F.position(F.lit(b"\x00"), "n") > 0, F.lit(False))
    return both.select("path", F.when(~binary, F.decode("o", "UTF-8")).alias("old_source"), F.when(~binary, F.decode("n", "UTF-8")).alias("new_source"), binary.alias("binary"))


def parse_transcripts(raw: DataFrame) -> DataFrame:
    """session, seq, ts, role, kind, text, tool of transcript lines (session, seq, value): a row for each content block, batch or stream; side chains and meta lines are left out, lines that are not JSON too."""
    v = raw.select("session", "seq", F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    keep = v.where(~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)) & ~F.coalesce(get("$.isMeta", "boolean"), F.lit(False)))
    plain = get("$.message.content")
    blocks = F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), "array<struct<type:string,text:string,name:string>>")
    one = F.array(F.struct(F.lit("text").alias("type"), plain.alias("text"), F.lit(None).cast("string").alias("name")))
    rows = keep.select("session", "seq", get("$.timestamp").alias("ts"), get("$.type").alias("role"), F.explode(F.when(F.typeof(plain).isNotNull() & plain.isNotNull() & ~plain.startswith("["), one).otherwise(blocks)).alias("b"))
    return rows.select("session", "seq", "ts", "role", F.col("b.type").alias("kind"), F.col("b.text").alias("text"), F.col("b.name").alias("tool"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """parse_transcripts of JSONL files; seq orders the lines of a file."""
    return parse_transcripts(spark.read.text(path).select("value", F.input_file_name().alias("session"), F.monotonically_increasing_id().alias("seq")))
