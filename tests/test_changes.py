import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.functions import paths
from changeloom.functions import text as T
from changeloom.operators import events as E
from changeloom.operators import blocks, graph, mentions, pairs
from changeloom.sources import patches


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_roles_and_languages(spark):
    cases = {
        "src/a.py": ("source", "python"), "tests/a.py": ("test", "python"), "pkg/test_x.py": ("test", "python"), "a/b_test.go": ("test", "go"), "docs/x.png": ("docs", "unknown"), "README": ("docs", "unknown"), "docs/conf.py": ("source", "python"),
        "node_modules/x/README.md": ("vendored", "unknown"), "Cargo.lock": ("generated", "unknown"), "a/dist/x.js": ("generated", "typescript"), "x.min.js": ("generated", "typescript"), "Foo.Tests/A.cs": ("test", "csharp"), "src/commonTest/kotlin/A.kt": ("test", "kotlin"),
        "src/main/FooTest.java": ("test", "java"), "Gemfile": ("source", "ruby"), "v/x.blade.php": ("source", "unknown"), "A.TSX": ("source", "tsx"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.role(F.col("p")).alias("r"), paths.language(F.col("p")).alias("l"))
    assert {r.p: (r.r, r.l) for r in df.collect()} == cases
    marked = spark.createDataFrame([("a.go", "// Code generated by x. DO NOT EDIT.\n"), ("b.go", "\n" * 9 + "@generated")], "p string, c string")
    assert rows(marked.select(paths.role(F.col("p"), F.col("c")))) == [("generated",), ("source",)]


def test_lines_and_norms(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\n\ny")], "k long, t string")
    assert rows(pairs.explode_lines(df, "k", "t")) == [(1, 1, "a"), (1, 2, "b"), (4, 1, "x"), (4, 2, ""), (4, 3, "y")]
    n = spark.createDataFrame([("a b",), ("é é",), ("});",), ("= = = =",), ("abcd",)], "l string").select(T.norm_line(F.col("l")).alias("n")).select("n", T.is_nontrivial(F.col("n")))
    assert dict(rows(n)) == {"ab": False, "éé": True, "});": False, "====": False, "abcd": True}


def test_align_gives_new_from_old():
    assert [k for k, *_ in pairs.align(["a", "x", "b"], ["a", "y", "b"])] == ["context", "removed", "added", "context"]
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(8))] for _ in range(2))
        d = pairs.align(a, b)
        assert [a[o - 1] for _, o, _ in d if o] == a and [b[n - 1] for _, _, n in d if n] == b
        assert all(a[o - 1] == b[n - 1] for k, o, n in d if k == "context")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(k == "context" for k, _, _ in d) == best[-1][-1]
    assert [k for k, _, _ in pairs.align(["a", "b"], ["c", "d"])] == ["removed", "removed", "added", "added"]


def test_review_stats(spark):
    df = spark.createDataFrame([(1, "f(a)\nkeep\nold line"), (2, "f( a )\nkeep\n\nnew line")], "k long, t string")
    p = spark.createDataFrame([(1, 2)], "a long, b long")
    assert rows(pairs.review_stats(pairs.line_diff(df, p, "k", "t"))) == [(1, 2, 5, 3, 2)]
    assert rows(pairs.line_multiset_diff(df, p, "k", "t")) == [(1, 2, 3, 2, 1)]
    assert rows(pairs.review_stats(pairs.line_diff(df, spark.createDataFrame([(1, 1)], "a long, b long"), "k", "t"))) == []


def test_pairs_in_blocks_brute_force(spark):
    """A family of more texts than a block holds, equal and empty texts, repeated keys, keys without a text, and columns in several chunks."""
    r = random.Random(9)
    white = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000] if c not in (10, 13))
    line = lambda: r.choice(["", " ", "x", f"w{r.randrange(9)} {r.choice(white)}y{r.randrange(3)}", "same\x1c line", "same line"])
    texts = {k: "\n".join(line() for _ in range(r.randrange(6))) for k in range(200)} | {200: None, 201: "", 202: "\n", 203: "\n\nb"}
    data = [*texts.items(), (5, "again\nx"), (None, "x")]
    found = {(a, b) for a in range(206) for b in range(a, 206) if r.random() < 0.4 or b > 199} | {(900, 900)}
    lines, words = {}, {}
    for k, t in data:
        parts = re.split("\r?\n", t or "")
        lines.setdefault(k, []).extend(parts[:-1] if parts[-1] == "" else parts)
        words.setdefault(k, []).extend(w for w in re.split(f"[{white}\n\r]+", t or "") if w)

    def common(per, a, b):
        x, y = Counter(per.get(a, [])), Counter(per.get(b, []))
        return sum((x & y).values()), sum(x.values()), sum(y.values())

    df = spark.createDataFrame(data, "k long, t string").repartition(3)
    p = spark.createDataFrame(sorted(found), "a long, b long").repartition(3)
    want = [(a, b, y - n, x - n, n) for a, b in sorted(found) for n, x, y in [common(lines, a, b)] if x + y]
    assert rows(pairs.line_multiset_diff(df, p, "k", "t")) == want
    want = [(a, b, 2 * n, x + y) for a, b in sorted(found) for n, x, y in [common(words, a, b)] if x + y]
    assert rows(pairs.token_dice(df, p, "k", "t")) == want
    once = df.where("t <> 'again\nx' or t is null")
    diff = pairs.line_diff(once, p, "k", "t")
    assert rows(pairs.pair_stats(once, p, "k", "t")) == rows(pairs.review_stats(diff))
    got = {}
    for x in diff.orderBy("a", "b", "seq").collect():
        got.setdefault((x.a, x.b), []).append((x.kind, x.old_no or 0, x.new_no or 0, x.line))
    lines[5] = lines[5][:-2]
    for a, b in found:
        o, n = lines.get(a, []), lines.get(b, [])
        assert got.pop((a, b), []) == [(k, i, j, o[i - 1] if i else n[j - 1]) for k, i, j in pairs.align(o, n)]
    assert not got
    blocks_of = [[str(i % 7), str(i), str(i)] for i in range(50)]
    x, y = np.array([1, 1, 3, 8]), np.array([8, 1, 10, 1])
    cells, blocks.CELLS = blocks.CELLS, 100
    both, n = blocks.shared_counts(blocks_of, x, y)
    blocks.CELLS = cells
    assert both.tolist() == [1, 3, 1, 1] and set(n) == {3}


def test_a_block_holds_a_few_texts(spark):
    """A family's pairs are dealt to many groups, and a group's texts are no more than those of two blocks."""
    one = spark.range(600).select(F.col("id").alias("k"), F.array(F.lit("x")).alias("units"))
    p = one.select(F.col("k").alias("a")).join(one.select(F.col("k").alias("b"))).where("a < b")

    def work(texts, x, y):
        yield np.array([0]), [pa.array([len(x)])]

    sizes = [x.n for x in blocks.over_pairs(one, p, "k", work, "n long").collect()]
    assert sum(sizes) == 600 * 599 // 2 and len(sizes) >= 15 and max(sizes) < 4 * blocks.BLOCK**2 // 2


def test_version_pairs_of_common_lines(spark):
    r = random.Random(4)
    text = {i: [f"line {r.randrange(12)}" for _ in range(r.randrange(2, 9))] for i in range(40)}
    text |= {100 + i: ["same one", "same two", "same three", "line 1"] for i in range(70)}
    text |= {200 + i: ["same one", "same two", "same three", f"own {i}", "license"] for i in range(25)}
    text |= {300 + i: ["license", f"else {i}"] for i in range(30)}
    want = [(a, b, n) for a in text for b in text if a < b and (n := len(set(text[a]) & set(text[b]))) >= 3]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in text.items()], "k long, t string").repartition(3)
    assert len(want) > 4000 and rows(pairs.version_pairs(df, "k", "t"), "a", "b", "shared") == sorted(want)


def test_requirement_and_quotes(spark):
    t = ["yes do it", "please fix the bug", "<system-reminder>x</system-reminder> make it run fast", "<cmd> a b c d", "w " * 1000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(T.requirement(F.col("t"))).collect()]
    assert got[:4] == [None, "please fix the bug", "make it run fast", None] and len(got[4]) == 1201
    q = spark.createDataFrame([("“Fix", "x"), ('"Fix  the', "please fix the bug"), ("ab", "ab")], "q string, t string")
    assert [r[0] for r in q.select(T.quote_in(F.col("q"), F.col("t"))).collect()] == [False, True, False]


def test_mentions(spark):
    lines = spark.createDataFrame([(1, 1, "foo(bar) $foo"), (1, 2, "foobar"), (2, 1, "x.foo foo")], "k long, line_no long, line string")
    assert rows(mentions.identifier_mentions(lines, spark.createDataFrame([("foo",)], "name string"), "k")) == [(1, 1, "foo"), (2, 1, "foo")]
    quotes = spark.createDataFrame([(1, "the quick brown fox jumps over the dog"), (2, "lazy cat")], "q long, text string")
    texts = spark.createDataFrame([(7, "so The quick\nbrown fox jumps over the dogs"), (8, "a lazy  cat"), (9, None)], "d long, text string")
    assert rows(mentions.quote_check(quotes, texts, "q", "d")) == [(1, 7), (2, 8)]
    r = random.Random(5)
    marks = lambda t: r.choice(["", '" ', "'", "… "]) + t + r.choice(["", '"', " '", "…"])
    body = {i: " ".join(r.choice(["fix", "the", "bug", "now", "please", "ok", "yes", "sir"]) for _ in range(30)) for i in range(20)} | {50: None, 51: ""}
    said = {100: '" fix the bug now please ok yes sir', 101: "ab", 102: None, 103: '"…"'}
    for i in range(60):
        t = body[r.randrange(20)]
        x = r.randrange(len(t) - 40)
        said[i] = marks(t[x : x + r.randrange(3, 40)])
    body[60] = "prefix the bug now please ok yes sir"
    flat = lambda t: " ".join(t.lower().split())
    want = [(i, d) for i, a in said.items() for d, t in body.items() if a and t and len(flat(a.strip("\"'… "))) >= 3 and flat(a.strip("\"'… ")) in flat(t)]
    df = lambda x, k: spark.createDataFrame(list(x.items()), f"{k} long, text string")
    assert rows(mentions.quote_check(df(said, "q"), df(body, "d"), "q", "d")) == sorted(want) and (100, 60) in want


def test_session_cut(spark):
    e = [(1, 0, "p"), (1, 10, "w"), (1, 20, "p"), (1, 30, "o"), (2, 0, "w"), (2, 9000, "p"), (3, 0, "p"), (4, 0, "w"), (4, 5, "o"), (4, 6, "p")]
    df = spark.createDataFrame([(s, i, t, k) for i, (s, t, k) in enumerate(e)], "s long, i long, t long, k string").withColumn("ts", F.timestamp_seconds("t"))
    k = F.col("k")
    assert rows(E.session_cut(df, "s", "ts", "i", k == "w", k == "p", k == "o"), "s", "t") == [(1, 0), (1, 10), (2, 0), (4, 0)]


def test_windows(spark):
    df = spark.createDataFrame([(1, i, i in (1, 9, 10)) for i in range(1, 15)], "k long, n long, c boolean")
    assert rows(E.context_hunks(df, "k", "n", F.col("c"))) == [(1, 1, 4, 1), (1, 6, 13, 2)]
    s = spark.createDataFrame([(1, 0, 30), (1, 5, 6), (1, 38, 40), (1, 49, 50)], "k long, s long, e long")
    assert rows(E.merge_spans(s, "k", "s", "e")) == [(1, 0, 40, 3), (1, 49, 50, 1)]
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 9, 1])], "k long, i long, x long")
    assert rows(E.within_budget(b, "k", "i", F.col("x"), 10)) == [(1, 0, 5, 5)]


def test_quiz(spark):
    a = spark.createDataFrame([(1, "q", 1, 2), (1, "q", 2, 0), (1, "r", 3, 0), (1, "r", 4, 1)], "u long, q string, n long, c long")
    assert rows(E.quiz_score(a, ["u"], "q", "n", F.col("c") == 0)) == [(1, 2, 1, 1, 2)]
    assert rows(E.grade_fold(a, ["u", "q"], "c", "n", F.col("c") == 0)) == [(1, "q", 2, True), (1, "r", 0, True)]


def test_graph_and_sets(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    assert rows(graph.reach(e, spark.createDataFrame([(1,)], "node long"))) == [(1, 0), (2, 1), (3, 2)]
    o, n = (spark.createDataFrame(x, "k long, i long") for x in ([(1, 1), (1, 2), (2, 5)], [(1, 2), (1, 3)]))
    assert rows(E.set_diff(o, n, ["k"], "i")) == [(1, [3], [1]), (2, [], [5])]
    assert rows(pairs.match_kth(o, n, ["k"], "i")) == [(1, 1, 1, 2), (1, 2, 2, 3), (2, 1, 5, None)]
    assert rows(E.unreferenced(o, n, "k")) == [(2, 5)]


def test_sources(spark, tmp_path):
    raw = "diff --git a/x b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline at end of file\ndiff --git a/y b/y\n+++ b/y\n"
    df = spark.createDataFrame([("1", "x", raw), ("1", "z", None)], "change_id string, path string, raw string")
    assert [(r.kind, r.old_no, r.new_no, r.line) for r in patches.parse_unified_diffs(df).collect()] == [("context", 1, 1, "a"), ("removed", 2, None, "b"), ("added", None, 2, "c")]
    odd = spark.createDataFrame([("1", "x", "@@ -0,0 +1,2 @@\n+foo\fbar\x1c\u2028z\r\n+end")], "change_id string, path string, raw string")
    assert [r.line for r in patches.parse_unified_diffs(odd).collect()] == ["foo\fbar\x1c\u2028z", "end"]
    for side, files in {"o": {"a.py": b"1", "s/b.py": b"2"}, "n": {"a.py": b"3", "bin": b"\x00"}}.items():
        for name, data in files.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_bytes(data)
    assert sorted(map(tuple, patches.read_file_pairs(spark, f"{tmp_path}/o", f"{tmp_path}/n").collect()), key=str) == [("a.py", "1", "3", False), ("bin", None, None, True), ("s/b.py", "2", None, False)]
    (tmp_path / "t.jsonl").write_text('{"type":"user","timestamp":"t1","message":{"content":"hello there"}}\nnot json\n{"type":"assistant","isMeta":true,"message":{"content":"x"}}\n{"type":"assistant","timestamp":"t2","message":{"content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Edit"}]}}\n')
    assert rows(patches.read_transcripts(spark, f"{tmp_path}/t.jsonl"), "ts", "role", "kind", F.coalesce("text", F.lit("-")), F.coalesce("tool", F.lit("-"))) == [("t1", "user", "text", "hello there", "-"), ("t2", "assistant", "text", "hi", "-"), ("t2", "assistant", "tool_use", "-", "Edit")]


def _named():
    from changeloom.plans import queries as Q

    return sorted(Q.ORACLE)


@pytest.mark.parametrize("name", _named())
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    from changeloom.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in (f.removesuffix(".parquet") for f in os.listdir(sf)):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = Q.QUERIES[name](spark, sf)
    want = c.sql(Q.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
