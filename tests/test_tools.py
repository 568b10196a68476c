import json
import random
import struct

from pyspark.sql import functions as F

from changeloom.functions import code, seeded
from changeloom.operators import credit, enrich, graph, includes, items, numbering
from changeloom.operators import events as E
from changeloom.sinks import store
from changeloom.sources.tables import scratch
from changeloom.streaming import sessions


def test_numbers_are_those_of_a_window(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = numbering.number_rows(df, [F.col("k"), F.col("v").desc(), F.col("i")], "n", first=10).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1], x[2]))
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x.n)] == want and sorted(x.n for x in got) == list(range(10, 510))
    assert numbering.number_rows(df.limit(0), [F.col("i")]).count() == 0
    assert numbering.number_rows(df.where("i = 3"), [F.col("i")]).first().id == 1


def test_credit_brute_force(spark):
    r = random.Random(2)
    trace = [(s, n, r.choice(["user", "agent", "notes"])) for s in ("a", "b") for n in range(1, 40) if r.random() < 0.8]
    decisions = [(r.choice(["a", "b", "c", None]), i, r.choice(["you", "approved", "agent", "unseen", None]), r.choice([None, *range(45)])) for i in range(300)]
    who = {(s, n): w for s, n, w in trace}
    want = {}
    for s, i, w, e in decisions:
        w = w if w in ("you", "approved") else "agent"
        at = e
        if w != "agent" and who.get((s, e), "user") != "user":
            before = max((n for (t, n), x in who.items() if t == s and n < e and x == "user"), default=None)
            after = min((n for (t, n), x in who.items() if t == s and n > e and x == "user"), default=None)
            if w == "you" and before is not None:
                at = before
            elif after is not None:
                w, at = "approved", after
            else:
                w = "agent"
        want[i] = (w, at)
    t = spark.createDataFrame(trace, "s string, n int, who string")
    d = spark.createDataFrame([(*x, 1) for x in decisions], "s string, id int, who string, event int, before int").drop("before")
    got = credit.repair_credit(d, t, ["s"]).collect()
    assert {x.id: (x.who, x.at_event) for x in got} == want and len(got) == 300
    assert credit.repair_credit(d, t.limit(0), ["s"]).count() == 300 and credit.repair_credit(d.limit(0), t, ["s"]).count() == 0


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def order_of(n, text):
    seed, order, m = fnv(text.encode()), list(range(n)), 2**64
    for i in range(n - 1, 0, -1):
        seed ^= seed << 13 & m - 1
        seed ^= seed >> 7
        seed ^= seed << 17 & m - 1
        j = seed % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def test_seeded_functions(spark):
    r = random.Random(3)
    texts = ["", "a", "What is it?", "é日本", "x" * 3000] + ["".join(r.choice("abcé ?") for _ in range(r.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(t, r.randrange(0, 9)) for t in texts] + [(None, 3)], "t string, n int")
    for x in df.select("t", "n", seeded.shuffled(F.col("n"), F.col("t")).alias("o"), seeded.fnv_hex([F.col("t"), F.lit("é")]).alias("h")).collect():
        assert x.o == (order_of(x.n, x.t) if x.t is not None and x.n else None)
        assert x.h == struct.pack(">Q", fnv((x.t or "").encode() + b"\xff" + "é".encode() + b"\xff")).hex()
    ask = spark.createDataFrame([(" q ", ["a ", "b", "c"], "2", " why "), ("q", ["a", "b"], "+1", None), ("q", ["a", " "], "0", ""), ("q", ["a"], "0", ""), (" ", ["a", "b"], "0", ""), ("q", ["a", "b"], "2", ""), ("q", None, "0", ""), ("q", ["a", "b"], "x", ""), (None, ["a", "b"], "0", ""), ("q", ["a", "b"], None, "")], "t string, c array<string>, a string, e string")
    got = [x[0] for x in ask.select(seeded.question(*map(F.col, "tcae"))).collect()]
    assert got[2:] == [None] * 8
    one = order_of(3, "q")
    assert tuple(got[0]) == ("q", [["a", "b", "c"][i] for i in one], one.index(2), "why")
    assert got[1].answer == order_of(2, "q").index(1) and got[1].explanation == ""


def test_store(spark):
    path = scratch(spark, "saved")
    make = lambda rows: spark.createDataFrame(rows, store.DDL)
    assert store.load(spark, path).count() == 0
    store.save(make([]), path)
    store.save(make([("a", str(i), i, f"v{i}") for i in range(100)] + [("b", "x", 1, "old"), (None, "x", 1, ""), ("b", None, 1, "")]), path)
    for _ in range(2):
        store.save(make([("a", "99", 99, "v99"), ("a", "0", 200, "again"), ("a", "70", 3, "late")]), path)
    kept = {(x.kind, x.key): (x.at, x.value) for x in store.load(spark, path).collect()}
    assert kept == {("a", str(i)): (i, f"v{i}") for i in range(51, 100)} | {("a", "0"): (200, "again"), ("b", "x"): (1, "old")}
    assert store.load(spark, path, "b").count() == 1


def test_includes(spark):
    rows = [("s/a.c", '#include "../h/b.h"'), ("h/b.h", '  # include "c.h" // x'), ("h/c.h", '#include "./d.c"'), ("s/a.c", "#include <x.h>"), ("s/a.c", '#include "../../x.c"'), ("s/a.c", '#include "a.c"'), ("h/d.c", '#include "c.h"'), ("s/e.c", '#include "a.c"'), (None, '#include "d.c"'), ("q.c", None)]
    t = includes.include_table(spark.createDataFrame(rows, "path string, line string"))
    assert sorted(map(tuple, t.where("path IS NOT NULL").collect())) == [("h/b.h", "h/c.h"), ("h/c.h", "h/d.c"), ("h/d.c", "h/c.h"), ("s/a.c", "h/b.h"), ("s/a.c", "s/a.c"), ("s/e.c", "s/a.c")]
    # a source that is compiled in hands on nothing
    assert sorted(map(tuple, includes.compiled_in(t).collect())) == [("h/b.h", "h/d.c", 1), ("h/c.h", "h/d.c", 0), ("s/a.c", "h/d.c", 2), ("s/e.c", "s/a.c", 0)]
    assert sorted(x.path for x in includes.compiled_in(t, 1).collect()) == ["h/b.h", "h/c.h", "s/e.c"] and includes.compiled_in(t.limit(0)).count() == 0


def test_paths_brute_force(spark):
    r = random.Random(5)
    for _ in range(3):
        edges = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
        tests = {r.randrange(30) for _ in range(3)}
        best = {t: [t] for t in tests}
        front = dict(best)
        for _ in range(4):
            step = {}
            for a, p in front.items():
                for x, y in edges:
                    if x == a and y not in best and (y not in step or [*p, y] < step[y]):
                        step[y] = [*p, y]
            best |= step
            front = step
        got = graph.test_paths(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(t,) for t in tests], "node long"), 4).collect()
        assert {x.node: x.path for x in got} == best and all(x.depth == len(x.path) - 1 for x in got)


def session_events(r, n):
    out = []
    for s in range(n):
        at = 1_700_000_000 + r.randrange(10_000)
        for i in range(r.randrange(1, 25)):
            at += r.choice([5, 60, 600, 7200, 7201, 9000])
            kind = r.random()
            out.append({"session": f"s{s}", "at": at, "tie": i, "wrote": kind < 0.2, "prompt": 0.2 <= kind < 0.5, "other": 0.5 <= kind < 0.6 or kind < 0.05})
    return out


def test_stream_of_sessions_equals_batch(spark, tmp_path):
    r = random.Random(7)
    events = session_events(r, 40)
    ddl = "session string, at long, tie long, wrote boolean, prompt boolean, other boolean"
    df = spark.createDataFrame([tuple(e.values()) for e in events], ddl).withColumn("at", F.timestamp_seconds("at"))
    batch = E.session_cut(df, "session", "at", "tie", F.col("wrote"), F.col("prompt"), F.col("other") & ~F.col("wrote"))
    want = sorted((x.session, x.tie) for x in batch.collect())
    assert 0 < len(want) < len(events)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    try:
        for turn in range(2):
            r.shuffle(events)
            src, out, ck = (str(tmp_path / f"{x}{turn}") for x in ("in", "out", "ck"))
            (tmp_path / f"in{turn}").mkdir()
            for k in range(0, len(events), 120):
                (tmp_path / f"in{turn}" / f"{k:05}.json").write_text("\n".join(json.dumps(e) for e in events[k : k + 120]))
            end = {"session": "last", "at": 1_800_000_000, "tie": 0, "wrote": False, "prompt": False, "other": None}
            (tmp_path / f"in{turn}" / "99999.json").write_text("\n".join(json.dumps(e) for e in (end, end | {"session": None})))
            stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(src).withColumn("at", F.timestamp_seconds("at"))
            q = sessions.cut_sessions(stream, late="30 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(240)
            got = sorted((x.session, x.tie) for x in spark.read.parquet(out).collect())
            assert got == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_rule_alone():
    h = 3600 * 1_000_000
    e = lambda at, what: (at, 0, what == "w", what == "p", what == "o")
    assert sessions.kept([e(0, "p")]) == 0 and sessions.kept([]) == 0
    assert sessions.kept([e(0, "w"), e(1, "p"), e(2, "x"), e(3, "o")]) == 1
    assert sessions.kept([e(0, "w"), e(2 * h + 1_000_000, "p"), e(2 * h + 2_000_000, "w")]) == 3
    assert sessions.kept([e(0, "w"), e(2 * h, "p")]) == 2 and sessions.kept([e(0, "w"), e(2 * h + 1_000_000, "p")]) == 1


def test_whole_json(spark):
    cases = {'{"x": 1} and then {y}': '{"x": 1}', 'a {"s": "}\\"{", "t": {"u": {}}} b }': '{"s": "}\\"{", "t": {"u": {}}}', "{": None, "": None, "no": None, '{"a': None, "{}{": "{}", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {x.t: x.j for x in df.select("t", code.whole_json(F.col("t")).alias("j")).collect()} == cases


def test_items_of_languages(spark):
    src = {"c": "int add(int a, char *b)\n{\n  return a;\n}\n", "go": "func (s *S) Get(n int) {\n}\nfunc init() {\n}\n", "rust": "#[test]\nfn seen() {\n}\nfn hidden() {\n}\n", "python": "def f(a):\n    '''x\ny = 1\n'''\n    return a\nz = 2\n"}
    got = {k: [(x.kind, x.name, x.start, x.end, [p.name for p in x.params], x.exported) for x in items.items(spark.createDataFrame([(1, f"f.{k}", k, s)], "change_id long, path string, language string, source string")).orderBy("idx").collect()] for k, s in src.items()}
    assert got["c"] == [("function", "add", 1, 4, ["a", "b"], True)]
    assert got["go"] == [("function", "Get", 1, 2, ["n"], True), ("function", "init", 3, 4, [], True)]
    assert got["rust"] == [("function", "seen", 1, 3, [], True), ("function", "hidden", 4, 5, [], False)]
    assert got["python"] == [("function", "f", 1, 5, ["a"], True), ("variable", "z", 6, 6, [], True)]


def test_repo_references(spark):
    lines = [("a.py", 1, "f(1) + g(2)"), ("a.py", 2, "x.f(1)"), ("b.go", 1, "mod.f(1)"), ("c.md", 1, "f()"), ("vendor/d.js", 1, "f()"), ("e.py", 1, "def g():"), ("own.py", 1, "f(3)"), ("k/p.py", 1, "h()"), ("lib/p.py", 1, "h()"), ("m.py", 1, "w.getOut() + v.run() + self.run()"), ("n.py", 1, "xf(1) f2(1) $f"), ("q.py", 1, None)] + [(f"z{i:02}.py", 1, "  many()") for i in range(20)]
    repo = spark.createDataFrame([("r", p, n, c, c) for p, n, c in lines] + [("other", "a.py", 1, "f()", "f()")], "repo string, path string, line int, code string, text string")
    gone = spark.createDataFrame([(1, "r", n, "lib/mod.py", e) for n, e in [("f", True), ("g", True), ("h", False), ("T.getOut", True), ("T.run", True), ("many", True), ("f", True)]], "change_id int, repo string, name string, origin string, exported boolean")
    changed = spark.createDataFrame([(1, "own.py"), (2, "a.py")], "change_id int, path string")
    got = sorted((x.name, x.path, x.line) for x in enrich.repo_references(gone, changed, repo).collect())
    assert got == [("T.getOut", "m.py", 1), ("f", "a.py", 1), ("f", "b.go", 1), ("h", "lib/p.py", 1)] + [("many", f"z{i:02}.py", 1) for i in range(10)]
    assert enrich.repo_references(gone.limit(0), changed, repo).count() == 0
