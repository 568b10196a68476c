"""A table of file changes taken apart in one call: one relation of entries, labelled lines, review statistics and call impacts.

The parts are those of the other operators; this module says in which order they give way to each other and numbers what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import lexer, paths
from changeloom.functions import signatures as S
from changeloom.functions import text as T
from changeloom.operators import definitions, impacts, items, noise, pairs, renames
from changeloom.sources.tables import settle

FILE = ["change_id", "path"]
MOVED_ALIKE = 0.6
CATEGORIES = ["renamed", "signature", "logic", "formatting", "dependency", "added", "removed", "moved"]
LINES = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("old_line", pa.int64()), ("new_line", pa.int64()), ("text", pa.string())])


@dataclass
class Analysis:
    entries: DataFrame  # change_id, id, category, kind, name, detail, path, side, start, end
    lines: DataFrame  # change_id, path, hunk, seq, kind, side, line, text, noise
    stats: DataFrame  # change_id, path, added, removed, mechanical, test, needs_review
    impacts: DataFrame  # change_id, def_path, name, path, at, line, updated


def diff_lines(files: DataFrame) -> DataFrame:
    """change_id, path, hunk, seq, kind, old_line, new_line, text of the aligned lines of each file's two sources (change_id, path, old_source, new_source); null ones are empty. A file's lines are one hunk with its unchanged ones."""
    kind = {f.name: f.dataType.simpleString() for f in files.schema.fields}["change_id"]
    both = files.select("change_id", "path", T.lines(F.col("old_source")).alias("o"), T.lines(F.col("new_source")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for k, (path, old, new) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                rows = [(path, i, kind, o or None, n or None, old[o - 1] if o else new[n - 1]) for i, (kind, o, n) in enumerate(pairs.align(old, new))]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LINES.types, strict=True)]
                    yield pa.record_batch([ids.take(pa.array([k] * len(rows))), *cols], names=["change_id", *LINES.names])

    out = both.mapInArrow(run, f"change_id {kind}, path string, seq long, kind string, old_line long, new_line long, text string")
    return out.select("change_id", "path", F.lit(0).cast("long").alias("hunk"), "seq", "kind", "old_line", "new_line", "text")


def moved_between(gone: DataFrame, come: DataFrame) -> DataFrame:
    """change_id, old_path, old_idx, new_path, new_idx, how: items that left one file of a change and came to another.

    First those of equal kind and text but for layout ("exact"), then those equal but for their names ("renamed"), each the k-th with the k-th by
    path and place; then, of equal kind and name, those whose tokens are alike by MOVED_ALIKE or more ("edited"), the most alike first. Items are those of
    items.items without a partner in their own file; imports and unnamed ones do not move.
    """
    named = "name IS NOT NULL AND kind <> 'import'"
    old, new = gone.where(named), come.where(named)
    found = None
    for how, by in (("exact", ["norm"]), ("renamed", ["shape"])):
        k = F.row_number().over(Window.partitionBy("change_id", "kind", *by).orderBy("path", "idx"))
        side = lambda d, s, k=k, by=by: d.withColumn("k", k).select("change_id", "kind", *by, "k", F.col("path").alias(f"{s}_path"), F.col("idx").alias(f"{s}_idx"))
        hit = side(old, "old").join(side(new, "new"), ["change_id", "kind", *by, "k"]).where("old_path <> new_path")
        hit = settle(hit.select("change_id", "old_path", "old_idx", "new_path", "new_idx", F.lit(how).alias("how")), "moved")
        left = lambda d, s, hit=hit: d.join(hit.select("change_id", F.col(f"{s}_path").alias("path"), F.col(f"{s}_idx").alias("idx")), ["change_id", "path", "idx"], "left_anti")
        old, new = left(old, "old"), left(new, "new")
        found = hit if found is None else found.unionByName(hit)
    side = lambda d, s: d.select("change_id", "kind", C.bare_name(F.col("name")).alias("bare"), F.col("path").alias(f"{s}_path"), F.col("idx").alias(f"{s}_idx"), F.col("tokens").alias(f"{s}_tokens"))
    alike = side(old, "old").join(side(new, "new"), ["change_id", "kind", "bare"]).where("old_path <> new_path").withColumn("alike", items.dice(F.col("old_tokens"), F.col("new_tokens"))).where(F.col("alike") >= MOVED_ALIKE)
    # one to one: an item's best partner, if the item is that partner's best too; what a round leaves may find another in the next one
    rest = settle(alike.select("change_id", "old_path", "old_idx", "new_path", "new_idx", "alike"), "alike")
    while not rest.isEmpty():
        order = [F.desc("alike"), "old_path", "old_idx", "new_path", "new_idx"]
        first = lambda s: F.row_number().over(Window.partitionBy("change_id", f"{s}_path", f"{s}_idx").orderBy(*order))
        best = settle(rest.withColumns({"a": first("old"), "b": first("new")}).where("a = 1 AND b = 1").drop("a", "b"), "best")
        found = found.unionByName(best.drop("alike").withColumn("how", F.lit("edited")))
        for s in ("old", "new"):
            rest = rest.join(best.select("change_id", f"{s}_path", f"{s}_idx"), ["change_id", f"{s}_path", f"{s}_idx"], "left_anti")
        rest = settle(rest, "alike")
    return found


def member_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """change_id, path, category, kind, name, detail, side, start, end of what changed in classes: methods and fields' types, by `Class.member`."""
    of = lambda d, s: d.select(*FILE, *[F.col(c).alias(f"{s}_{c}") for c in ("d", "name", "start", "end", "params", "shape")])
    m = definitions.match_members(old, new, FILE).join(of(old, "old"), [*FILE, "old_d"], "left").join(of(new, "new"), [*FILE, "new_d"], "left")
    qualified = lambda s: F.concat_ws(".", "owner", f"{s}_name")
    row = lambda d, category, side, detail: d.select(*FILE, F.lit(category).alias("category"), F.lit("method").alias("kind"), qualified(side).alias("name"), detail.cast("string").alias("detail"), F.lit(side).alias("side"), F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"))
    said = S.describe(F.col("old_params"), F.col("new_params"))
    broken = F.when(S.breaks_callers(F.col("old_params"), F.col("new_params"), F.col("path")), " (callers break)").otherwise("")
    body = lambda c: F.regexp_replace(c, r"^[^\n]*\n?", "")
    out = row(m.where("match = 'renamed'"), "renamed", "new", qualified("old"))
    out = out.unionByName(row(m.where(said.isNotNull() & (F.col("match") == "modified")), "signature", "new", F.concat(said, broken)))
    out = out.unionByName(row(m.where("match = 'modified'").where((body(F.col("old_shape")) != body(F.col("new_shape"))) | said.isNull()), "logic", "new", F.lit("body modified")))
    return out.unionByName(row(m.where("match = 'added'"), "added", "new", F.lit(None))).unionByName(row(m.where("match = 'removed'"), "removed", "old", F.lit(None)))


def analyze(files: DataFrame) -> Analysis:
    """What changed in files (change_id, path, old_source, new_source; an empty or null source: the file was added or deleted). path is unique in its change.

    Entries: items that were renamed, whose parameters, body or layout changed, that came, went or moved, imports that came or went; methods and
    fields of classes on both sides, in whose place their class has no entry of its own. An item that moved to another file was neither
    added nor removed. They are numbered in each change by pass (items, members, moves), path, side and line.
    lines and stats cover every file, unknown languages too; generated and vendored files are noise, tests are counted as such. impacts are the calls of
    functions and methods whose new parameters break callers. An empty table gives empty results.
    """
    f = settle(files.select("change_id", "path", F.coalesce("old_source", F.lit("")).alias("old_source"), F.coalesce("new_source", F.lit("")).alias("new_source"), paths.language(F.col("path")).alias("language")).withColumn("role", paths.role(F.col("path"), F.col("new_source"))), "files")
    side = lambda s: f.select(*FILE, "language", F.col(f"{s}_source").alias("source"))
    old, new = (settle(items.items(side(s)), "items") for s in ("old", "new"))
    matched = settle(items.match_items(old, new, FILE), "matched")
    found = items.classify(old, new, matched, FILE)
    defs = {s: settle(definitions.definitions(side(s), FILE), "definitions") for s in ("old", "new")}
    members = member_entries(defs["old"], defs["new"])
    typed = definitions.retyped_fields(*(definitions.fields(side(s), FILE) for s in ("old", "new")), FILE)
    at = definitions.fields(side("new"), FILE).groupBy(*FILE, "owner", "name").agg(F.min("line").alias("line"))
    told = lambda c: F.coalesce(c, F.lit("untyped"))
    retyped = typed.join(at, [*FILE, "owner", "name"]).select(*FILE, F.lit("logic").alias("category"), F.lit("field").alias("kind"), F.concat_ws(".", "owner", "name").alias("name"), F.concat(told(F.col("old_type")), F.lit(" → "), told(F.col("new_type"))).alias("detail"), F.lit("new").alias("side"), F.col("line").alias("start"), F.col("line").alias("end"))
    members = settle(members.unionByName(retyped), "members")

    own = lambda d, s: d.select(*FILE, F.col("idx").alias(f"{s}_idx"), F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"))
    placed = found.join(own(old, "old"), [*FILE, "old_idx"], "left").join(own(new, "new"), [*FILE, "new_idx"], "left")
    which = F.when(F.col("new_idx").isNotNull(), "new").otherwise("old")
    placed = placed.select(*FILE, "category", "kind", "name", "detail", which.alias("side"), F.coalesce("new_start", "old_start").alias("start"), F.coalesce("new_end", "old_end").alias("end"), "old_idx", "new_idx")
    inside = members.select(*FILE, F.substring_index("name", ".", 1).alias("name"), F.lit("class").alias("kind"), F.lit("logic").alias("category")).distinct()
    placed = settle(placed.join(inside, [*FILE, "name", "kind", "category"], "left_anti"), "placed")

    lone = lambda d, s, category: d.join(placed.where(F.col("category") == category).select(*FILE, F.col(f"{s}_idx").alias("idx")), [*FILE, "idx"], "left_semi")
    away = settle(moved_between(lone(old, "old", "removed"), lone(new, "new", "added")), "between")
    for s, category in (("old", "removed"), ("new", "added")):
        moved = away.select("change_id", F.col(f"{s}_path").alias("path"), F.col(f"{s}_idx"), F.lit(category).alias("category"))
        placed = placed.join(moved, [*FILE, f"{s}_idx", "category"], "left_anti")
    there = new.select(F.col("change_id"), F.col("path").alias("new_path"), F.col("idx").alias("new_idx"), "kind", "name", "start", "end")
    here = old.select("change_id", F.col("path").alias("old_path"), F.col("idx").alias("old_idx"), F.col("name").alias("old_name"), F.col("start").alias("old_start"), F.col("end").alias("old_end"))
    across = settle(away.join(there, ["change_id", "new_path", "new_idx"]).join(here, ["change_id", "old_path", "old_idx"]), "across")
    whence = F.concat(F.lit("from "), F.col("old_path"), F.when(F.col("how") == "renamed", F.concat(F.lit(" as "), F.col("old_name"))).when(F.col("how") == "edited", " with edits").otherwise(""))
    moves = across.select("change_id", F.col("new_path").alias("path"), F.lit("moved").alias("category"), "kind", "name", whence.alias("detail"), F.lit("new").alias("side"), "start", "end")
    within = settle(items.moved_items(old, new, matched, FILE), "within")
    moves = moves.unionByName(within.join(new.select(*FILE, F.col("idx").alias("new_idx"), "kind", "name", "start", "end"), [*FILE, "new_idx"]).select(*FILE, F.lit("moved").alias("category"), "kind", "name", F.lit("within the file").alias("detail"), F.lit("new").alias("side"), "start", "end"))
    columns = [*FILE, "category", "kind", "name", "detail", "side", "start", "end"]
    passes = [(1, placed.select(*columns)), (2, members), (3, moves)]
    every = None
    for k, d in passes:
        d = d.select(*columns, F.lit(k).alias("pass"))
        every = d if every is None else every.unionByName(d)
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    number = F.row_number().over(Window.partitionBy("change_id").orderBy("pass", "path", F.desc("side"), "start", rank, "name", "detail"))
    entries = settle(every.withColumn("id", number.cast("long")).select("change_id", "id", "category", "kind", "name", "detail", "path", "side", "start", "end"), "entries")

    facts = lexer.line_facts(f.select(*FILE, "language", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_source").alias("source")), F.struct(F.lit("new").alias("side"), F.col("new_source").alias("source")))).alias("x")).select(*FILE, "language", "x.*"), [*FILE, "side"])
    facts = facts.select(*FILE, "side", F.col("line_no").alias("line"), F.col("line").alias("text"), "comment", "in_string", "define", "directive", (F.col("language") != "unknown").alias("parsed"))
    renamed = entries.where("category = 'renamed'").select("change_id", F.array("path").alias("paths"), F.col("id").alias("seq"), "kind", F.col("detail").alias("old"), F.col("name").alias("new"))
    spans = lambda d, path, s, e, side: d.select("change_id", F.col(path).alias("path"), F.lit(side).alias("side"), F.col(s).alias("start"), F.col(e).alias("end"))
    whole = across.where("how = 'exact'")
    stay = within.join(own(old, "old"), [*FILE, "old_idx"]).join(own(new, "new"), [*FILE, "new_idx"])
    gone = spans(whole, "new_path", "start", "end", "new").unionByName(spans(whole, "old_path", "old_start", "old_end", "old")).unionByName(spans(stay, "path", "old_start", "old_end", "old")).unionByName(spans(stay, "path", "new_start", "new_end", "new"))
    lines = settle(noise.label_changes(settle(diff_lines(f), "diff"), settle(facts, "facts"), settle(definitions.bodies(defs["old"], defs["new"], FILE), "bodies"), settle(gone, "gone"), renames.scoped(renamed), f.where("role IN ('generated', 'vendored')")), "lines")
    tests = f.where("role = 'test'").select(*FILE, F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), F.lit(1).cast("long").alias("start"), F.size(F.split(F.concat("old_source", F.lit("\n"), "new_source"), "\n")).cast("long").alias("end"))

    k = F.row_number().over(Window.partitionBy(*FILE, "owner", "name").orderBy("d"))
    signed = lambda s: defs[s].where("kind IN ('function', 'method')").withColumn("k", k).select(*FILE, F.coalesce("owner", F.lit("")).alias("owner"), "name", "k", F.col("params").alias(s), F.col("exported").alias(f"{s}_exported"))
    both = signed("old").join(signed("new"), [*FILE, "owner", "name", "k"]).where(S.breaks_callers(F.col("old"), F.col("new"), F.col("path")))
    full = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    changed = both.select("change_id", "path", full.alias("name"), "old", "new", F.col("new_exported").alias("exported"))
    named = defs["new"].where("kind IN ('function', 'method')").select("change_id", "path", F.concat_ws(".", "owner", "name").alias("name"))
    added = lines.where("kind = 'added'").select("change_id", "path", "line")
    calls = settle(impacts.call_table(side("new").where("language <> 'unknown'"), FILE), "calls")
    return Analysis(entries, lines, noise.review_stats(lines, tests), impacts.call_impacts(settle(changed, "changed-signatures"), calls, named, added))
