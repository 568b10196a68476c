"""Queries of the code, hunk, review, graph and source operators over tables that Spark derives from the driver's, with the SQL they must agree with.

Two versions of a source file for each customer: a function for each line of the first and of the last order (VERSIONS). Links of
pages are imports, the page after a page of one site its next version. Events are answers, calls and commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import paths
from changeloom.functions import signatures as S
from changeloom.functions import text as T
from changeloom.operators import events as E
from changeloom.operators import calls, graph, hunks, items, mentions, pairs, reviews
from changeloom.sinks import reports
from changeloom.sources import changes, patches
from changeloom.sources.tables import read, scratch, settle

PARAMS = {"R": "qty: int, price", "A": "qty: int", "N": "price, qty: int = 1"}
FILE = ["change_id", "path"]


def _choose(c: Column, by: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in by.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def sources(spark: SparkSession, d: str) -> DataFrame:
    """change_id, side, path, language, source: the versions of each customer's file."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("old"), F.max("o_orderkey").alias("new")).where("old < new")
    side = o.select("o_custkey", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("k")), F.struct(F.lit("new").alias("side"), F.col("new").alias("k")))).alias("v")).select("o_custkey", "v.*")
    gap = F.when(F.col("l_linestatus") == "O", " ").otherwise("")
    body = F.concat(F.lit("def f"), (F.col("l_partkey") % 7).cast("string"), F.lit("("), _choose(F.col("l_returnflag"), PARAMS), F.lit("):\n    total = qty"), gap, F.lit("*"), gap, (F.col("l_partkey") % 3).cast("string"), F.lit("\n    return total\n"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", body.alias("body"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "body"))), lambda x: x["body"]), "\n")
    return side.join(lines, "k").groupBy("o_custkey", "side").agg(text.alias("source")).select(F.col("o_custkey").alias("change_id"), "side", F.lit("app/main.py").alias("path"), F.lit("python").alias("language"), "source")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = settle(sources(spark, d), "sources")
    return tuple(settle(items.items(s.where(F.col("side") == x).drop("side")), "items") for x in ("old", "new"))


def source_items(spark, d):
    both = settle(sources(spark, d), "sources")
    out = items.items(both.withColumn("path", F.concat_ws("/", "side", "path")).drop("side"))
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["name"], p["type"], F.when(p["optional"], "?"))), ",")
    return out.select("change_id", F.substring_index("path", "/", 1).alias("side"), "idx", "kind", "name", "start", "end", params.alias("params"), F.size("tokens").cast("long").alias("n_tokens"), "exported")


def item_match(spark, d):
    return items.match_items(*_sides(spark, d), FILE).where("match <> 'rename_modified'").select("change_id", "old_idx", "new_idx", "match")


def fuzzy_renames(spark, d):
    return items.match_items(*_sides(spark, d), FILE).where("match = 'rename_modified'").select("change_id", "old_idx", "new_idx")


def change_entries(spark, d):
    old, new = _sides(spark, d)
    sure = items.match_items(old, new, FILE).where("match <> 'rename_modified'")
    return items.classify(old, new, settle(sure, "sure"), FILE).select("change_id", "category", "kind", "name", "detail", "old_idx", "new_idx")


def moved_items(spark, d):
    old, new = _sides(spark, d)
    return items.moved_items(old, new, settle(items.match_items(old, new, FILE), "matches"), FILE).select("change_id", "old_idx", "new_idx")


def vanished_names(spark, d):
    return reviews.vanished(*_sides(spark, d), ["change_id"], "name", "idx")


def signature_pairs(spark, d):
    old, new = _sides(spark, d)
    side = lambda x, c: x.where("idx = 1").select("change_id", F.col("params").alias(c))
    both = side(old, "o").join(side(new, "n"), "change_id")
    o, n = F.col("o"), F.col("n")
    return both.select("change_id", S.differs(o, n).alias("differs"), S.breaks_callers(o, n).alias("breaks"), S.describe(o, n).alias("said"))


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", "source")


def _lines(spark, d):
    return pairs.explode_lines(_docs(spark, d), "doc_id", "text")


def code_keys(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", C.code_key(F.col("line")).alias("code_key"), C.code_key(F.col("line"), True).alias("with_indent"))


def snippets(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", C.snippet(F.col("line"), F.col("line_no")).alias("snippet"), C.one_line(F.col("line"), 48).alias("one_line"))


def renamed_lines(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", C.apply_renames(F.col("line"), [("the", "THE"), ("THE", "le$1"), ("of", "von")]).alias("line"))


def single_fixes(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(C.apply_fix(F.coalesce("text", F.lit("")), F.lit("License"), F.lit("Licence")).cast("binary")).alias("fixed"))


def comment_payloads(spark, d):
    body = F.concat(F.lit("-- > "), C.comment_payload(F.col("text"), "data"), F.lit(" --> tail"))
    return _docs(spark, d).where("text IS NOT NULL AND text NOT LIKE '%u002d%' AND text <> ''").select("doc_id", F.md5(C.read_payload(body, "data").cast("binary")).alias("back"), F.length(C.comment_payload(F.col("text"), "data")).cast("long").alias("size"))


def context_sizes(spark, d):
    return _docs(spark, d).select("doc_id", C.context_size(F.length(F.coalesce("text", F.lit(""))) * 4).alias("context"), reviews.concepts_for(F.size(T.lines(F.col("text")))).cast("long").alias("concepts"))


def _url_parts(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    return p.withColumns({"host": F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), "path": F.regexp_extract("url", r"^[^:]*://[^/]*/([^?#]*)", 1)})


def url_names(spark, d):
    p, host = _url_parts(spark, d), F.col("host")
    return p.select("page_id", C.bare_name(host).alias("bare"), C.owner_of(host).alias("owner"), C.module_name(F.concat("path", F.element_at(F.array(*map(F.lit, ["/index.ts", ".py", "/lib.rs", "/a.tar.gz"])), (F.col("page_id") % 4 + 1).cast("int")))).alias("module"))


def remotes(spark, d):
    r = C.remote(F.regexp_replace("url", r"[?#].*$", ""))
    return _url_parts(spark, d).select("page_id", r["repo"].alias("repo"), r["link"].alias("link"), C.link_allowed(F.col("url"), ["example.org", "example.net"]).alias("allowed"))


ROLE_FILES = {"FooTest.java": "test", "Cargo.lock": "generated", "README": "docs", "a.min.js": "generated", "x_test.go": "test", "test_y.py": "test", "z.py": "source", "w.test.tsx": "test", "FooSpec.scala": "test", "notes.rst": "docs", "Form1.Designer.cs": "generated", "ATest.php": "test", "invoice_spec.rb": "test", "node_modules/r/i.js": "vendored", "tests/h.rs": "test", "dist/app.js": "generated", "docs/conf.py": "source", "docs/i.png": "docs", "testing.rs": "source", "Foo.Tests/P.cs": "test", "src/commonTest/kotlin/H.kt": "test", "db/schema.rb": "generated", "vendor/x/y.go": "vendored", "tests.rs": "source"}
ROLE_LANGUAGES = ["java", "unknown", "unknown", "typescript", "go", "python", "python", "tsx", "scala", "unknown", "csharp", "php", "ruby", "typescript", "rust", "typescript", "python", "unknown", "rust", "csharp", "kotlin", "ruby", "go", "rust"]


def file_roles(spark, d):
    """A file of every kind under each page's path; file_order is that of a report."""
    name = F.element_at(F.array(*map(F.lit, ROLE_FILES)), (F.col("page_id") % len(ROLE_FILES) + 1).cast("int"))
    p = _url_parts(spark, d).select("page_id", "host", F.concat(F.lit("pkg/"), F.col("page_id").cast("string"), F.lit("/"), name).alias("path"))
    p = p.withColumns({"role": paths.role(F.col("path")), "language": paths.language(F.col("path"))})
    rank = F.when(F.col("role") == "source", 0).when(F.col("role") == "test", 1).when(F.col("role") == "docs", 2).otherwise(3)
    return reviews.number_in_order(p, [rank, F.col("page_id")], ["host"]).select("page_id", "path", "role", "language", F.col("place").alias("file_order"))


def parsed_times(spark, d):
    return read(spark, d, "events").select("event_id", T.epoch_seconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+05:00"))).alias("seconds"))


def name_lines(spark, d):
    return _lines(spark, d).where(T.mentions(F.col("line"), "License") | T.mentions(F.col("line"), "password")).select("doc_id", "line_no")


def change_runs(spark, d):
    r = hunks.change_runs(_lines(spark, d), ["doc_id"], "line_no", F.col("line").rlike("[0-9]"))
    return r.groupBy("doc_id", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def split_runs(spark, d):
    return hunks.split_runs(_lines(spark, d), ["doc_id"], "line_no", F.col("line").rlike("[0-9]"), F.length("line") % 2 == 0).select("doc_id", "line_no", "part")


def hunk_labels(spark, d):
    r = hunks.change_runs(_lines(spark, d), ["doc_id"], "line_no", F.length("line") % 3 > 0)
    size = F.length("line") % 5
    return hunks.hunk_labels(r, ["doc_id", "run"], F.when(size < 2, "comment").when(size < 4, "formatting"), F.when(size < 2, 1).otherwise(0), F.length("line") % 2 == 0)


def _spans(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("long")).alias("end"))
    return s


def smallest_spans(spark, d):
    at = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") * 7 % 250).alias("at"))
    return hunks.smallest_span(at, _spans(spark, d), ["k"], "at")


def linked_changes(spark, d):
    side = F.when(F.col("l_suppkey") % 2 == 0, "old").otherwise("new")
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("at"), side.alias("side"), (F.col("l_suppkey") * 7 % 250).alias("line"), (F.col("l_suppkey") * 3 % 250).alias("next_new"))
    e = _spans(spark, d).withColumn("side", F.when(F.col("id") % 2 == 0, "old").otherwise("new"))
    return hunks.link_changes(c, e, ["k"])


def merged_hunks(spark, d):
    start, end, two = F.col("l_partkey") % 200, F.col("l_partkey") % 200 + F.col("l_quantity").cast("long"), F.col("l_suppkey") % 3 > 0
    zero = F.lit(0).cast("long")
    h = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (start + 1).alias("old_start"), (end + 1).alias("old_end"), F.when(two, start + 3).otherwise(zero).alias("new_start"), F.when(two, end + 3).otherwise(zero).alias("new_end"))
    return hunks.merge_hunks(h, ["k"])


def preferred(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 4).alias("m"))
    return hunks.prefer(e, ["user_id"], [F.col("event_type") == "purchase", F.col("m") == 0, F.col("event_id") < 0]).select("user_id", "event_id")


def _links(spark, d):
    """change_id (the later page), side, module, symbol, local of the links of pages and of the pages after them on their site."""
    p = _url_parts(spark, d).select("page_id", F.substring_index("host", ".", -2).alias("site")).join(read(spark, d, "pages").select("page_id", "html"), "page_id")
    found = F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), 0), lambda x: F.struct(F.regexp_extract(x, '"([^"]*)"', 1).alias("symbol"), F.regexp_extract(x, ">([^<]*)<", 1).alias("local")))
    own = settle(p.select("page_id", "site", F.explode(found).alias("l")).select("page_id", "site", F.substring("l.symbol", 1, 2).alias("module"), F.lower("l.symbol").alias("symbol"), F.substring("l.local", 1, 4).alias("local")).where("local <> ''"), "links")
    nxt = p.select("page_id", "site", F.lead("page_id").over(Window.partitionBy("site").orderBy("page_id")).alias("change_id")).where("change_id IS NOT NULL")
    old = nxt.select("page_id", "change_id").join(own, "page_id").select("change_id", "module", "symbol", "local")
    new = nxt.select("change_id").join(own.withColumnRenamed("page_id", "change_id"), "change_id").select("change_id", "module", "symbol", "local")
    return old, new


def link_changes(spark, d):
    return reviews.import_changes(*_links(spark, d), ["change_id"])


def link_renames(spark, d):
    return reviews.local_renames(*_links(spark, d), ["change_id"])


def swapped_links(spark, d):
    return reviews.swapped_imports(*_links(spark, d), ["change_id"])


def broken_links(spark, d):
    old, new = _links(spark, d)
    gone = reviews.vanished(old, new, ["change_id"], "symbol", "local")
    return reviews.broken_references(gone, old.select("change_id", "symbol", "local").distinct(), ["change_id"], "symbol", "local", 2)


def extractions(spark, d):
    docs = _docs(spark, d)
    p = settle(pairs.version_pairs(docs, "doc_id", "text", 2), "pairs")
    both = p.select("a", "b").union(p.select("b", "a"))
    e = reviews.extractions(pairs.nontrivial_lines(docs, "doc_id", "text").select("doc_id", "norm"), both, "doc_id")
    return e.select("doc_id", "n_lines", "n_covered", F.array_join(F.transform("receivers", lambda x: x.cast("string")), ",").alias("receivers"))


def document_units(spark, d):
    return reviews.units(pairs.version_pairs(_docs(spark, d), "doc_id", "text").select("a", "b"))


def stale_calls(spark, d):
    return reviews.stale_calls(read(spark, d, "lineitem"), ["l_partkey"], F.col("l_returnflag") == "R")


def agreed_types(spark, d):
    return reviews.agreed(read(spark, d, "lineitem").where("l_quantity > 10"), ["l_orderkey"], "l_linestatus")


def _answers(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("question"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("choice"))


def answer_log(spark, d):
    return reviews.answer_log(_answers(spark, d), ["user_id", "question"], "event_id", "choice")


def ungraded(spark, d):
    a = _answers(spark, d)
    marks = a.where("choice = 1").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("event_id"), "user_id", F.col("event_id").alias("at"))
    return reviews.ungraded(a.select("event_id", "user_id", F.col("event_id").alias("at")), marks, ["event_id"], "user_id", "at").select("event_id", "user_id")


def latest_answers(spark, d):
    return reviews.latest_of_each(_answers(spark, d), ["user_id"], "event_id")


def merge_gate(spark, d):
    s = E.quiz_score(_answers(spark, d), ["user_id"], "question", "event_id", F.col("choice") < 3)
    by = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("")
    return reviews.gate(s, F.lit(5), F.col("user_id") % 2 == 0, F.col("user_id") % 5 > 0, by).select("user_id", "author_waits", "reviewer_waits", "status", "lead")


def group_votes(spark, d):
    return reviews.vote(_answers(spark, d), "user_id", "choice")


def group_files(spark, d):
    return reviews.first_and_rest(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey", 3)


def fitted_traces(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return reviews.fit_budget(c, "conv_id", "turn", F.col("size"), F.col("role"), ["tool", "system"], 1200).select("conv_id", "turn", "role", "number")


def quiz_replies(spark, d):
    a = _answers(spark, d)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "choice"))), lambda x: F.concat((x["event_id"] % 9 + 1).cast("string"), F.element_at(F.array(*map(F.lit, ["", ".", ":", " "])), (x["event_id"] % 4 + 1).cast("int")), F.chr(x["choice"] + 97)))
    body = a.groupBy("user_id").agg(F.concat(F.lit("/quiz "), F.array_join(parts, ", ")).alias("body"))
    return body.select("user_id", F.posexplode(C.parse_answers(F.col("body"))).alias("at", "x")).select("user_id", F.col("at").cast("long").alias("at"), "x.question", "x.choice")


def recovered_json(spark, d):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}"))).otherwise(F.concat(F.lit("Here it is "), "props", F.lit(" ok")))
    return read(spark, d, "events").select("event_id", F.get_json_object(C.first_json(reply), "$.k").cast("long").alias("k"))


COMMANDS = {"cat src/a.txt": False, "rm -f x": True, "perform rm": False, "echo hi > out/log.txt": True, "make 2>&1": False, "ls > /dev/null": False, "a && sed -i s/x/y/ f": True, "if (a > 3.5) b": False, "python -c 'f.write_text(1)'": True, "sort x | tee y": True, "x => y.z": False, "cp a b": True}


def command_effects(spark, d):
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    there = F.concat(F.element_at(F.array(*map(F.lit, ["cd /repo/sub && ", "cd /else; ", "", "cd sub && "])), (F.col("user_id") % 4 + 1).cast("int")), command)
    return read(spark, d, "events").select("event_id", C.writes_files(command).alias("writes"), C.leaves_folder(there, "/repo").alias("leaves"))


def path_mentions(spark, d):
    """Commands that name a page's path, whole or by its last two segments."""
    p = _url_parts(spark, d).where("path <> ''").select("page_id", "path")
    commands = p.select(F.col("page_id").alias("command_id"), F.concat(F.lit("cat /repo/"), "path", F.lit(" | head -"), F.col("page_id").cast("string")).alias("command"))
    tails = commands.select("command_id", F.explode(C.path_tokens(F.col("command"))).alias("tail"))
    return tails.join(p.where(F.col("path").contains("/")), F.col("tail") == F.col("path")).groupBy("command_id").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def _calls(spark, d):
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("k").alias("dst"))
    return e.join(nxt, "event_id").where("abs(k - dst) <= 12").select(F.col("k").alias("src"), "dst")


def _nodes(spark, d, where):
    return read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("node")).where(where).distinct()


def changed_callees(spark, d):
    return graph.changed_callees(_calls(spark, d), _nodes(spark, d, "node % 9 = 0"), _nodes(spark, d, "node % 7 = 3"))


def test_reach(spark, d):
    t = graph.test_reach(_calls(spark, d), _nodes(spark, d, "node % 25 = 4"))
    return t.select("node", "depth", F.array_join(F.transform("origins", lambda x: x.cast("string")), ",").alias("origins"))


def descendants(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    return graph.descends(c)


def reading_order(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), (F.col("l_partkey") % 9).alias("src"), (F.col("l_suppkey") % 9).alias("dst"))
    nodes = e.select("change_id", F.col("src").alias("node")).union(e.select("change_id", "dst")).distinct()
    return graph.reading_order(nodes, e, "change_id")


def patch_lines(spark, d):
    """The lines of documents, written as patches of many files and read back."""
    docs = _docs(spark, d)
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("é.txt"))
    added = docs.select(F.col("doc_id") % 50, path.alias("path"), changes.addition_patch(C.c_quote(path), F.col("text")).alias("raw")).toDF("change_id", "path", "raw").where("raw <> ''")
    one = added.groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    split = changes.split_patches(one).select(F.col("change_id").cast("string"), F.regexp_extract("header", "d/([0-9]+)", 1).alias("path"), F.col("section").alias("raw"))
    return patches.parse_unified_diffs(split).select(F.col("path").cast("long").alias("doc_id"), F.col("new_no").alias("line_no"), "line")


def status_lists(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["M", "A", "R090", "D", "C100"])), (F.col("event_id") % 5 + 1).cast("int"))
    one = F.concat(kind, F.lit("\0"), F.lit("a/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 2, F.concat(F.lit("\0M"), F.col("event_id").cast("string"))).when(F.col("event_id") % 5 == 4, "\0R").otherwise(""))
    out = read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", one.alias("s")))), lambda x: x["s"]), "\0").alias("out"))
    return changes.parse_name_status(out.select(F.col("user_id").alias("change_id"), "out")).select(F.col("change_id").cast("long"), "seq", "status", "old_path", "new_path")


def file_changes(spark, d):
    """Each document as the new side of a change of its source, whose old side is the text of the document before it."""
    docs = _docs(spark, d)
    e = docs.select(F.col("source").alias("change_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "M").otherwise("D").alias("status"), F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("old_path")).withColumn("new_path", F.col("old_path"))
    data = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\0"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    blobs = docs.select(F.col("source").alias("change_id"), F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), data.cast("binary").alias("data"))
    section = docs.select(F.col("source").alias("change_id"), F.concat(F.lit("diff --git a/p/"), F.col("doc_id").cast("string"), F.lit(".py b/p/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("header"), F.lit("patch").alias("section")).where("doc_id % 2 = 0")
    f = changes.file_changes(e, section, blobs)
    return f.select("seq", "status", F.length("old_source").cast("long").alias("old_chars"), F.length("new_source").cast("long").alias("new_chars"), "binary", "language", "role", "raw_diff")


def quoted_paths(spark, d):
    return _docs(spark, d).select("doc_id", C.c_quote(F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("quoted"))


def transcript_lines(spark, d):
    """Conversations written as JSONL transcripts and read back."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("timestamp"), F.col("role").alias("type"), (F.col("turn") % 5 == 4).alias("isMeta"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message")))
    at = scratch(spark, "transcripts")
    c.select(line.alias("value")).write.text(at)
    t = patches.read_transcripts(spark, at)
    return t.select(F.substring_index("ts", ":", 1).cast("long").alias("conv_id"), F.substring_index("ts", ":", -1).cast("long").alias("turn"), "role", "kind", "text")


def file_source(spark, d):
    """At most 200 lines of a file, and the definition of a name: the first item of that name."""
    return E.cap_each(_lines(spark, d), ["doc_id"], [F.asc("line_no")], 200).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def definitions(spark, d):
    _, new = _sides(spark, d)
    return new.where("name IN ('f1', 'f5')").groupBy("change_id", "name").agg(F.min_by("start", "idx").alias("start"), F.min_by("end", "idx").alias("end"))


def _callers(spark, d):
    """Items of a file for each order: a function for each of its lines, by name and place, that calls another one with one argument."""
    body = F.concat(F.lit("def f"), (F.col("l_partkey") % 7).cast("string"), F.lit("("), _choose(F.col("l_returnflag"), PARAMS), F.lit("):\n    return f"), (F.col("l_suppkey") % 7).cast("string"), F.lit("(qty)\n"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "body"))), lambda x: x["body"]), "\n")
    f = lines.groupBy("l_orderkey").agg(text.alias("source")).select(F.col("l_orderkey").alias("change_id"), F.lit("m.py").alias("path"), F.lit("python").alias("language"), "source")
    return settle(items.items(f), "callers")


def call_edges(spark, d):
    return calls.call_edges(_callers(spark, d)).select("change_id", "src_idx", "dst_idx")


def dead_items(spark, d):
    return calls.dead_items(_callers(spark, d)).select("change_id", "idx", "name")


def signature_impacts(spark, d):
    new = _callers(spark, d)
    return calls.signature_impacts(new.where("kind = 'function'").select("change_id", "name", "params"), new)


def moved_runs(spark, d):
    docs = _docs(spark, d)
    p = settle(pairs.version_pairs(docs, "doc_id", "text"), "pairs")
    norms = F.filter(F.transform(T.lines(F.col("text")), T.norm_line), T.is_nontrivial)
    return calls.moved_runs_of_pairs(docs.select("doc_id", norms.alias("units")), p, "doc_id")


def resolved_paths(spark, d):
    p = _url_parts(spark, d).where("path LIKE '%/%'").select("page_id", "path")
    asked = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, F.substring_index("path", "/", -1)).otherwise(F.concat(F.lit("x/"), "path")).alias("path"))
    return calls.resolve_paths(asked, p, "page_id")


def word_search(spark, d):
    names = spark.createDataFrame([("License",), ("password",), ("the",)], "name string")
    return calls.first_hits(mentions.identifier_mentions(_lines(spark, d), names, "doc_id"), [F.col("name"), F.col("doc_id"), F.col("line_no")], 3000)


def report_entries(spark, d):
    """Entries written as a JSON report and read back, counted by category."""
    e = settle(change_entries(spark, d), "entries")
    at = scratch(spark, "report")
    reports.write_report(e, at)
    return reports.read_report(spark, at, e).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("change_id").alias("n_changes"), F.count("detail").alias("n_details"), F.sum(F.coalesce("new_idx", F.lit(0))).alias("places"))


QUERIES = {f.__name__: f for f in (
    source_items, item_match, fuzzy_renames, change_entries, moved_items, vanished_names, signature_pairs, code_keys, snippets, renamed_lines, single_fixes, comment_payloads, context_sizes, url_names, remotes, file_roles, parsed_times, name_lines,
    change_runs, split_runs, hunk_labels, smallest_spans, linked_changes, merged_hunks, preferred, link_changes, link_renames, swapped_links, broken_links, extractions, document_units, stale_calls, agreed_types, answer_log, ungraded, latest_answers, merge_gate, group_votes,
    group_files, fitted_traces, quiz_replies, recovered_json, command_effects, path_mentions, changed_callees, test_reach, descendants, reading_order, patch_lines, status_lists, file_changes, quoted_paths, transcript_lines, file_source, definitions, call_edges, dead_items, signature_impacts, moved_runs, resolved_paths, word_search, report_entries,
)}
