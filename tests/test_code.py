import os
import random

import pytest
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import signatures as S
from changeloom.operators import calls, graph, hunks, items, reviews
from changeloom.sinks import reports
from changeloom.sources import changes
from changeloom.streaming import transcripts

FILE = ["change_id", "path"]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def one(spark, f, values, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(f(F.col("x"))).collect()]


def test_code_functions(spark):
    assert one(spark, C.code_key, ["  if ( a  ==b ) {", "x = 'a  b' + c", "return  x", 's = "q \\" r"  + 1', "don't  stop", None]) == ["if(a==b){", "x='a  b'+c", "return x", 's="q \\" r"+1', "don't  stop", None]
    assert one(spark, lambda x: C.code_key(x, C.is_indented(F.lit("a/b.py"))), ["    f ( 1 )"]) == ["    f(1)"]
    assert one(spark, lambda x: C.apply_renames(x, [("a", "b$"), ("b$", "c")]), ["a.a aa $a b"]) == ["c.c aa $a b"]
    assert one(spark, C.call_name, ["A.__init__", "m.A.constructor", "f", "__init__", "A::b.c"]) == ["A", "A", "f", "__init__", "c"]
    assert one(spark, C.module_name, ["a/b/index.ts", "x.py", "src/lib.rs", ".env", "main.go"]) == ["b", "x", "src", ".env", "main"]
    assert [r and tuple(r) for r in one(spark, C.remote, ["git@h.x:a/b/c.git", "https://u@h:88/o/r.git/", "x", "https://h/only"])] == [("b/c", "https://h.x/a/b/c"), ("o/r", "https://h/o/r"), None, None]
    assert one(spark, lambda x: C.leaves_folder(x, "/r"), ["cd /r/x && ls", "cd /else", "abcd /else", "cd sub", "cd /r"]) == [False, True, False, False, False]
    assert one(spark, C.first_json, ['x ```json\n{"a":1}\n``` y', 'so {"a":{"b":2}} ok', "none"]) == ['{"a":1}', '{"a":{"b":2}}', None]
    assert one(spark, C.strip_refs, ["fix (#12) it", "see issue (#3)", "a (#1, #2 and 4) b", "PR  (#9)"]) == ["fix it", "see issue (#3)", "a b", "PR  (#9)"]
    got = one(spark, C.parse_answers, ["/quiz 1a 2c", "/quiz 2 b, 3:d 10)e", "/quizzes 1a", "/quiz", "  /quiz 0a 1f 2a", "/quiz 1ab 2 3c"])
    assert [g and [tuple(x) for x in g] for g in got] == [[(0, 0), (1, 2)], [(1, 1), (2, 3), (9, 4)], None, None, [(1, 0)], [(2, 2)]]
    assert one(spark, lambda x: C.apply_fix(x, F.lit("b"), F.lit("_")), ["abc", "bb", ""]) == ["a_c", "bb", ""]
    assert one(spark, C.context_size, [1, 8193, 70000], "x long") == [8192, 16384, None]


def test_signatures(spark):
    p = lambda *ps: [(n, t, o) for n, t, o in ps]
    cases = [
        (p(("a", "int", False)), p(("a", "int", False)), None, False), (p(("a", None, False)), p(("a", "int", False)), "`a`: untyped → int", False), (p(), p(("b", "str", True)), "added optional param `b: str`", False), (p(), p(("b", None, False)), "added param `b`", True),
        (p(("a", None, False), ("b", None, False)), p(("b", None, False), ("a", None, False)), "params reordered", True), (p(("a", None, True)), p(("a", None, False)), None, True), (p(("a", None, False)), p(), "removed param `a`", True),
    ]
    t = "array<struct<name:string,type:string,optional:boolean>>"
    df = spark.createDataFrame([(i, o, n) for i, (o, n, _, _) in enumerate(cases)], f"i long, o {t}, n {t}").select("i", S.describe(F.col("o"), F.col("n")), S.breaks_callers(F.col("o"), F.col("n")))
    assert rows(df) == [(i, said, breaks) for i, (_, _, said, breaks) in enumerate(cases)]


OLD_TS = """import { a } from './x'

// adds
export function add(a: number, b: number) {
  return a + b
}

const twice = (n: number) => n * 2

class Box {
  size = 1
}

function gone(alpha: number, beta: number, gamma: number) {
  const total = alpha + beta + gamma
  return total * 2
}

run()
"""
NEW_TS = """import { a, c } from './y'

export function add( a: number,  b: number ) {
  return a + b
}

const double = (n: number) => n * 2

class Box {
  size = 2
}

function here(alpha: number, beta: number, gamma: number) {
  const total = alpha + beta - gamma
  return total * 2
}

run()
"""


def test_items_and_classification(spark):
    py = 'import os\n\n@deco\ndef f(self, a: int, b=1, *rest):\n    # note\n    return a\n\n\nclass K:\n    def m(self): pass\n\n_x = f"{1}"\nif a:\n    b()\nelse:\n    c()\n'
    files = [(1, "a.py", "python", py), (2, "a.md", "unknown", "x"), (3, "b.py", "python", None), (4, "c.rs", "rust", "pub fn go(x: i32) -> i32 {\n    x\n}\nstruct P;\n"), (5, "d.go", "go", "func (t *T) Run(a int) {\n}\nfunc hide() {}\n")]
    df = spark.createDataFrame(files, "change_id long, path string, language string, source string")
    got = items.items(df)
    assert rows(got.select("change_id", "idx", "kind", "name", "start", "end", "exported")) == [(1, 1, "import", "os", 1, 1, True), (1, 2, "function", "f", 3, 6, True), (1, 3, "class", "K", 9, 10, True), (1, 4, "variable", "_x", 12, 12, False), (1, 5, "other", None, 13, 16, True), (4, 1, "function", "go", 1, 3, True), (4, 2, "class", "P", 4, 4, False), (5, 1, "function", "Run", 1, 2, True), (5, 2, "function", "hide", 3, 3, False)]
    assert [tuple(p) for p in got.where("name = 'f'").first().params] == [("a", "int", False), ("b", None, True), ("*rest", None, False)]
    assert "note" not in got.where("name = 'f'").first().norm

    side = lambda text: items.items(spark.createDataFrame([(1, "m.ts", "typescript", text)], "change_id long, path string, language string, source string"))
    old, new = side(OLD_TS), side(NEW_TS)
    m = items.match_items(old, new, FILE)
    names = {r.idx: r.name for r in old.collect()}
    assert {names[r.old_idx]: r.match for r in m.collect()} == {"add": "formatting", "twice": "rename", "Box": "modified", "gone": "rename_modified", None: "exact"}
    entries = rows(items.classify(old, new, m, FILE), "category", "name", "detail")
    assert entries == sorted([("dependency", "./x", "removed"), ("dependency", "./y", "added"), ("formatting", "add", None), ("logic", "Box", "body modified"), ("logic", "here", "body modified"), ("renamed", "double", "twice"), ("renamed", "here", "gone")], key=str)


def test_choices_brute_force(spark):
    r = random.Random(7)
    cands = [(c, o, n, r.choice([0.5, 0.6, 0.8, 0.9])) for c in range(12) for o in range(7) for n in range(7) if r.random() < 0.6]
    df = spark.createDataFrame(cands, "change_id long, old_idx long, new_idx long, alike double")
    best = [("alike", False), ("old_idx", True), ("new_idx", True)]
    want = []
    for c in range(12):
        a, b = set(), set()
        for _, o, n, s in sorted((x for x in cands if x[0] == c), key=lambda x: (-x[3], x[1], x[2])):
            if o not in a and n not in b:
                a.add(o), b.add(n), want.append((c, o, n))
    assert rows(items.choose(df, ["change_id"], best), "change_id", "old_idx", "new_idx") == sorted(want, key=str)
    want = []
    for c in range(12):
        used = set()
        for o in range(7):
            free = [x for x in cands if x[0] == c and x[1] == o and x[2] not in used]
            if free:
                n = max(free, key=lambda x: (x[3], x[2]))[2]
                used.add(n), want.append((c, o, n))
    assert rows(items.choose(df, ["change_id"], [("old_idx", True), ("alike", False), ("new_idx", False)]), "change_id", "old_idx", "new_idx") == sorted(want, key=str)
    assert items.choose(df.limit(0), ["change_id"], best).count() == 0
    x = [(i, [r.choice("abcd") for _ in range(r.randrange(6))], [r.choice("abcd") for _ in range(r.randrange(6))]) for i in range(60)]
    got = dict(rows(spark.createDataFrame(x, "i long, a array<string>, b array<string>").select("i", items.dice(F.col("a"), F.col("b")))))
    for i, a, b in x:
        both = sum(min(a.count(t), b.count(t)) for t in set(a))
        assert abs(got[i] - (2 * both / (len(a) + len(b)) if a or b else 0)) < 1e-12


def test_moves():
    r = random.Random(3)
    for _ in range(200):
        p = r.sample(range(20), r.randrange(0, 9))
        kept = [x for x, k in zip(p, items.longest_run(p), strict=True) if k]
        best = [1] * len(p)
        for i in range(len(p)):
            best[i] = 1 + max((best[j] for j in range(i) if p[j] < p[i]), default=0)
        assert kept == sorted(kept) and len(kept) == max(best, default=0)


def test_moved_items(spark):
    f = lambda n: f"def {n}():\n    x = 1\n    return '{n}'\n"
    side = lambda order: items.items(spark.createDataFrame([(1, "m.py", "python", "\n".join(map(f, order)))], "change_id long, path string, language string, source string"))
    old, new = side("abcd"), side("bcda")
    assert rows(items.moved_items(old, new, items.match_items(old, new, FILE), FILE), "old_idx", "new_idx") == [(1, 4)]


def test_calls(spark, tmp_path):
    text = "def a(x, y=1):\n    return b(x) + a(x, y)\n\ndef b(x):\n    return log(c(), 1)\n\ndef c(*rest):\n    return 1\n\ndef lost(q):\n    return q\n"
    files = [(1, "m.py", "python", text), (1, "n.py", "python", "def c():\n    return b()\n"), (2, "m.py", "python", None)]
    got = items.items(spark.createDataFrame(files, "change_id long, path string, language string, source string"))
    assert rows(calls.call_sites(got), "path", "idx", "name", "n_args") == [("m.py", 1, "a", 2), ("m.py", 1, "b", 1), ("m.py", 2, "c", 0), ("m.py", 2, "log", None), ("n.py", 1, "b", 0)]
    assert rows(calls.call_edges(got)) == [(1, "m.py", 1, "m.py", 2), (1, "m.py", 2, "m.py", 3), (1, "n.py", 1, "m.py", 2)]
    assert rows(calls.dead_items(got), "path", "name") == [("m.py", "a"), ("m.py", "lost")]
    changed = got.where("name IN ('b', 'c')").select("change_id", "name", "params")
    assert rows(calls.signature_impacts(changed, got), "name", "n_calls", "n_stale") == [("b", 2, 1)]
    lines = lambda t: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(t)], "k long, at long, norm string")
    assert rows(calls.moved_runs(lines("abcdxab"), lines("zzabcd"), ["k"])) == [(1, 1, 3, 4)]
    paths = lambda *x: spark.createDataFrame(list(enumerate(x)), "i long, path string")
    assert rows(calls.resolve_paths(paths("a/b.c", "b.c", "x/q/d", "no", "c"), paths("a/b.c", "z/b.c", "q/d"), "i")) == [(0, "a/b.c"), (1, "a/b.c"), (2, "q/d")]
    e = spark.createDataFrame([(1, "x", None, 2), (1, "a", "t", 1), (2, "b", None, None)], "change_id long, category string, detail string, n long")
    reports.write_report(e, f"file://{tmp_path}/report")
    assert rows(reports.read_report(spark, f"file://{tmp_path}/report", e)) == rows(e)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 9), (9, 4), (1, 7), (7, 4), (4, 4)], "src long, dst long")
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "node long")
    assert rows(graph.changed_callees(e, n(1, 3, 4), n(9))) == [(1, 3, 2), (1, 4, 2), (3, 1, 1)]
    assert [(r.node, r.depth, r.origins) for r in graph.test_reach(e, n(1, 9), 8, 1).orderBy("node").collect()] == [(1, 0, [1]), (2, 1, [1]), (3, 2, [1]), (4, 1, [9]), (7, 1, [1]), (9, 0, [9])]
    assert rows(graph.descends(e.select(F.col("src").alias("child"), F.col("dst").alias("parent")).where("child > 3"))) == [(7, 4), (9, 4)]
    nodes = spark.createDataFrame([(5, x) for x in (1, 2, 3, 4, 6)], "c long, node long")
    order = graph.reading_order(nodes, spark.createDataFrame([(5, 1, 2), (5, 1, 3), (5, 2, 3), (5, 4, 6), (5, 6, 4)], "c long, src long, dst long"), "c")
    assert [tuple(r)[1:] for r in order.orderBy("step").collect()] == [(0, 1, 0, False), (1, 2, 1, False), (2, 3, 2, False), (3, 3, 1, True), (4, 4, 0, False), (5, 6, 1, False), (6, 4, 2, True)]


def test_reading_order_of_many_changes_and_large_numbers(spark):
    """Numbers that no float holds, a change without edges, an edge to no node, null nodes, and batches of changes."""
    big = 2**60
    nodes = spark.createDataFrame([(1, big + 1), (1, big + 3), (1, big + 5), (2, 7), (2, 7), (3, None)], "c long, node long")
    edges = spark.createDataFrame([(1, big + 1, big + 3), (1, big + 3, big + 5), (1, big + 3, big + 1), (2, 7, 8), (2, 7, 7), (2, 7, None), (4, 1, 2)], "c long, src long, dst long")
    got = sorted(tuple(x) for x in graph.reading_order(nodes, edges, "c").collect())
    assert got == [(1, 0, big + 1, 0, False), (1, 1, big + 3, 1, False), (1, 2, big + 1, 2, True), (1, 3, big + 5, 2, False), (2, 0, 7, 0, False)]
    many = spark.range(30000).select(F.col("id").alias("c"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("node"))
    pairs = many.groupBy("c").agg(F.max("node").alias("src"), F.min("node").alias("dst"))
    out = graph.reading_order(many, pairs, "c").groupBy("step", "node", "depth", "repeat").count().collect()
    assert sorted(tuple(x) for x in out) == [(0, 2, 0, False, 30000), (1, 1, 1, False, 30000)]


def test_reviews_and_hunks(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45)], "a long, b long")
    assert dict(rows(reviews.units(e))) == {i: 0 for i in range(21)} | {50: 40, 40: 40, 45: 40}
    budget = spark.createDataFrame([(1, i, k, s) for i, (k, s) in enumerate([("user", 4), ("tool", 50), ("agent", 6), ("user", 3), ("agent", 5)])], "k long, i long, kind string, s long")
    assert rows(reviews.fit_budget(budget, "k", "i", F.col("s"), F.col("kind"), ["tool"], 12), "i", "number") == [(0, 1), (3, 2), (4, 3)]
    spans = spark.createDataFrame([(1, 1, 0, 300), (1, 2, 60, 70), (1, 3, 65, 75)], "k long, id long, start long, end long")
    lines = spark.createDataFrame([(1, 64), (1, 68), (1, 72), (1, 300), (1, 301), (2, 64)], "k long, at long")
    assert rows(hunks.smallest_span(lines, spans, ["k"], "at")) == [(1, 300, 1), (1, 64, 2), (1, 68, 2), (1, 72, 3)]
    n = spark.createDataFrame([(1, None), (2, "a"), (2, None)], "k long, v string")
    assert rows(reviews.agreed(n, ["k"], "v")) == [(1, None), (2, "a")]


def test_changes(spark):
    out = spark.createDataFrame([("1", "M\0a\0R100\0b\0c\0D\0d\0R1\0lost"), ("2", None)], "change_id string, out string")
    assert rows(changes.parse_name_status(out)) == [("1", 0, "M", "a", "a"), ("1", 1, "R", "b", "c"), ("1", 2, "D", "d", "d")]
    raw = 'junk\ndiff --git a/x b/x\n-1\ndiff --git "a/\\303\\251" "b/\\303\\251"\n+2\ndiff --git a/x b/x\n+3\ndiff --cc u\n@@@\n'
    s = changes.split_patches(spark.createDataFrame([("1", raw)], "change_id string, raw string"))
    entries = spark.createDataFrame([("1", 0, "M", "x", "x"), ("1", 1, "A", "é", "é"), ("1", 2, "U", "u", "u"), ("1", 3, "D", "n", "n")], "change_id string, seq long, status string, old_path string, new_path string")
    assert [r.raw_diff[-3:-1] for r in changes.patches_of(entries, s).orderBy("seq").collect()] == ["+3", "+2", "@@", ""]
    r = changes.override_role(F.lit("vendored"), F.col("role"), {"vendored": F.col("v")})
    attr = spark.createDataFrame([("tests", None), (None, "unset"), (None, "set"), (None, None)], "role string, v string")
    assert [x[0] for x in attr.select(r).collect()] == ["test", "source", "vendored", "vendored"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda t, role: f'{{"type":"{role}","timestamp":"{t}","message":{{"content":"hello there"}}}}'
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([line("2024-01-01T00:01:00Z", "user"), line("2024-01-01T00:02:00Z", "user"), line("2024-01-01T00:11:00Z", "assistant"), "not json"]))
    events = transcripts.stream_transcripts(spark, f"file://{tmp_path}/in")

    def run(df, mode):
        got = []
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/{mode}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return got

    assert sorted((r.start.minute, r.role, r.n) for r in run(transcripts.activity(events), "complete")) == [(0, "user", 2), (10, "assistant", 1)]
    assert len(run(transcripts.answers_once(events, ["role"]), "append")) == 2


def _names():
    from changeloom.plans import derived_sql

    return sorted(set(derived_sql.ORACLE) - {"change_entries", "source_items", "definitions"})  # as item_match


@pytest.mark.parametrize("name", _names())
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from changeloom.plans import derived, derived_sql

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in (f.removesuffix(".parquet") for f in os.listdir(sf)):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = c.sql(derived_sql.ORACLE[name]), derived.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    quote = lambda q: [f"{q}{x}{q}" for x in cols]
    assert sorted(str(tuple(r)) for r in got.select(*quote("`")).collect()) == sorted(map(str, want.select(*quote('"')).fetchall()))


def test_extractions_and_moved_runs_in_blocks(spark):
    """A family larger than a block: receivers and what they cover are gathered over all of its groups; runs are those of the joined lines."""
    r = random.Random(5)
    texts = {k: [f"l{r.randrange(14)}" for _ in range(r.randrange(9))] for k in range(300)} | {300: ["l1"] * 70 + ["l2", "l3", "l4"]}
    found = sorted((a, b) for a in texts for b in texts if a < b and r.random() < 0.2)
    lines = spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t, 1)], "k long, at long, norm string")
    p = spark.createDataFrame(found, "a long, b long")
    both = p.union(p.select("b", "a"))
    want = []
    for k, t in texts.items():
        got = {b: set(t) & set(texts[b]) for x in found for a, b in (x, x[::-1]) if a == k}
        got = {b: s for b, s in got.items() if len(s) >= 2}
        covered = set().union(*got.values())
        if len(set(t)) >= 3 and len(got) >= 2 and 100 * len(covered) >= 70 * len(set(t)):
            want.append((k, len(set(t)), len(covered), sorted(got)))
    got = sorted(tuple(x) for x in reviews.extractions(lines, both, "k").collect())
    assert got == sorted(want) and len(want) > 150
    side = lambda x: p.join(lines.withColumnRenamed("k", x), x).select("a", "b", "at", "norm")
    units = lines.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]).alias("units"))
    got = rows(calls.moved_runs_of_pairs(units, p, "k", 2))
    assert got == rows(calls.moved_runs(side("a"), side("b"), ["a", "b"], 2)) and len(got) > 100


def test_paths_with_a_common_end(spark):
    """Asked ends meet the first path of each end, not all of them: one row for each asked path and end."""
    known = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("en/"), (F.col("id") + 1000).cast("string"), F.lit("/")).alias("path"))
    asked = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") < 1990, "").otherwise("x/en/1007/").alias("path"))
    got = calls.resolve_paths(asked, known, "k")
    assert {(x.path, x.n) for x in got.groupBy("path").agg(F.count("*").alias("n")).collect()} == {("en/1000/", 1990), ("en/1007/", 10)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(path" in plan.split("Generate")[0] and plan.count("min(path") == 1
