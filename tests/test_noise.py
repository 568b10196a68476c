import random

from pyspark.sql import functions as F

from changeloom.functions import lexer
from changeloom.operators import noise, renames

CHANGES = "change_id long, path string, hunk long, seq long, kind string, old_line long, new_line long, text string"


def longest(n, m, fits):
    """Pairs of a longest order-preserving matching, walked from the front: skip on the left first where it costs nothing."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if fits(i, j) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if fits(i, j):
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


def test_align_brute_force(monkeypatch):
    r = random.Random(6)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        z = [r.choice(["e", None, "a", "b"]) for _ in a]
        b = [r.choice([x, x, "e"]) for x in b]
        fits = lambda i, j: a[i] == b[j] or z[i] == b[j]
        assert noise.align(a, b, z) == [(i, j, a[i] == b[j]) for i, j in longest(len(a), len(b), fits)]
        with monkeypatch.context() as m:
            m.setattr(noise, "MOST_CELLS", 0)
            want, nxt = [], 0
            for i in range(len(a)):
                j = next((j for j in range(nxt, len(b)) if fits(i, j)), None)
                if j is not None:
                    want.append((i, j, a[i] == b[j]))
                    nxt = j + 1
            assert noise.align(a, b, z) == want


def squeeze(t):
    return "".join(t.split())


def brute(changes, bodies, moved):
    """Labels of the changed lines of one change, step by step; texts have no strings, so a key is the text without blanks (no line has two words side by side)."""
    label = {}
    lines = {}
    for c in changes:
        for side, at in (("old", c["old"]), ("new", c["new"])):
            if at:
                lines[c["path"], side, at] = c["text"]
    hunks = {}
    for c in changes:
        hunks.setdefault((c["path"], c["hunk"]), []).append(c)
    ident = lambda c: (c["path"], "old", c["old"]) if c["kind"] == "removed" else (c["path"], "new", c["new"])
    comment = lambda t: t.strip().startswith("#")
    paired = {}
    for path, os_, oe, ns, ne in bodies:
        code = lambda side, s, e, path=path: [(path, side, k) for k in range(s, e + 1) if (t := lines.get((path, side, k))) and t.strip() and not comment(t)]
        a, b = code("old", os_, oe), code("new", ns, ne)
        for i, j in longest(len(a), len(b), lambda i, j: squeeze(lines[a[i]]) == squeeze(lines[b[j]])):  # noqa: B023
            for x in (a[i], b[j]):
                paired.setdefault(x, "moved" if lines[a[i]] == lines[b[j]] else "formatting")
    runs = {"old": [], "new": []}
    blocks = []
    for key in sorted(hunks):
        piece, block = {"old": [], "new": []}, []
        for c in [*hunks[key], {"kind": "context"}]:
            if c["kind"] == "context":
                for s in piece:
                    runs[s] += [piece[s]] if piece[s] else []
                blocks += [block] if block else []
                piece, block = {"old": [], "new": []}, []
                continue
            block.append(c)
            if c["text"].strip() and not comment(c["text"]):
                piece[ident(c)[1]].append((ident(c), squeeze(c["text"])))
    for block in blocks:
        for c in block:
            if not c["text"].strip():
                label[ident(c)] = "formatting"
            elif comment(c["text"]):
                if "noqa" not in c["text"]:
                    label[ident(c)] = "comment"
            elif ident(c) in paired:
                label[ident(c)] = paired[ident(c)]
        a, b = ([c for c in block if (c["kind"] == "removed") == o and ident(c) not in label] for o in (True, False))
        again = lambda t: t.replace("foo", "bar")
        for i, j in longest(len(a), len(b), lambda i, j: squeeze(b[j]["text"]) in (squeeze(a[i]["text"]), squeeze(again(a[i]["text"])))):  # noqa: B023
            for c in (a[i], b[j]):
                label[ident(c)] = "formatting" if squeeze(a[i]["text"]) == squeeze(b[j]["text"]) else "rename"
        for c in block:
            path, side, at = ident(c)
            if ident(c) not in label and any(p == path and sd == side and s <= at <= e for p, sd, s, e in moved):
                label[ident(c)] = "moved"
    final = dict(label)
    for block in blocks:
        for side, other in (("old", "new"), ("new", "old")):
            seq = [(ident(c), squeeze(c["text"])) for c in block if ident(c)[1] == side and c["text"].strip() and not comment(c["text"])]
            i = 0
            while i < len(seq):
                best = 0
                if seq[i][0] not in label and len(seq[i][1]) >= 4:
                    for run in runs[other]:
                        for p in range(len(run)):
                            n = 0
                            while i + n < len(seq) and p + n < len(run) and seq[i + n][1] == run[p + n][1]:
                                n += 1
                            if n <= best or sum(len(x[1]) >= 4 for x in seq[i : i + n]) < 3:
                                continue
                            here, there = (seq[i][0][2], seq[i + n - 1][0][2]), (run[p][0][2], run[p + n - 1][0][2])
                            old, new = (here, there) if side == "old" else (there, here)
                            same = run[p][0][0] == seq[i][0][0]
                            if not (same and any(q == run[p][0][0] and s < old[0] and old[1] <= e and s2 < new[0] and new[1] <= e2 for q, s, e, s2, e2 in bodies)):
                                best = n
                for x, _ in seq[i : i + best]:
                    final.setdefault(x, "moved")
                i += best or 1
    return final


def random_change(r):
    """Changes of two files: one hunk each of mixed lines, numbered as they stand."""
    pool = ["foo(1)", "bar(1)", " bar( 1)", "alpha=1", "beta=22", "  beta = 22", "gamma(x)", "delta(y)", "}", "{", "", "# note", "# noqa: q", "eps(foo)", "eps(bar)"]
    chunk = [r.choice(pool[3:10]) for _ in range(r.randrange(3, 7))]
    out = []
    for path in ("a.py", "b.py"):
        o = n = 0
        for hunk in range(2):
            for _ in range(r.randrange(1, 6)):
                kind = r.choice(["removed", "added", "context"])
                some = [(kind, t) for t in r.choice([chunk, [r.choice(pool) for _ in range(r.randrange(1, 6))], ["  " + x for x in chunk]])]
                if r.random() < 0.4:
                    some = [("removed", "foo(7)"), ("removed", r.choice(pool)), ("added", r.choice(pool)), ("added", r.choice(["bar(7)", " foo( 7)"]))]
                for kind, t in some:
                    o, n = o + (kind != "added"), n + (kind != "removed")
                    out.append({"path": path, "hunk": hunk, "kind": kind, "old": o if kind != "added" else None, "new": n if kind != "removed" else None, "text": t})
    return out


def test_labels_brute_force(spark):
    r = random.Random(12)
    changes, facts, bodies, moved, want = [], {}, [], [], {}
    for cid in range(60):
        rows = random_change(r)
        last = lambda p, s: max([c[s] or 0 for c in rows if c["path"] == p], default=0)  # noqa: B023, E731
        own = [(p, 1, last(p, "old"), 1, last(p, "new")) for p in ("a.py", "b.py") if r.random() < 0.5 and last(p, "old") and last(p, "new")]
        gone = [("a.py", "old", 2, 4)] if r.random() < 0.3 else []
        want |= {(cid, *k): v for k, v in brute(rows, own, gone).items()}
        for k, c in enumerate(rows):
            changes.append((cid, c["path"], c["hunk"], k, c["kind"], c["old"], c["new"], c["text"]))
            for side in ("old", "new"):
                if c[side]:
                    t = c["text"]
                    facts[cid, c["path"], side, c[side]] = (cid, c["path"], side, c[side], t, t.strip().startswith("#"), False, False, "noqa" in t, True)
        bodies += [(cid, *b) for b in own]
        moved += [(cid, *m) for m in gone]
    df = spark.createDataFrame(changes, CHANGES).repartition(4)
    f = spark.createDataFrame(list(facts.values()), "change_id long, path string, side string, line long, text string, comment boolean, in_string boolean, define boolean, directive boolean, parsed boolean")
    renamed = spark.createDataFrame([(i, None, 0, "foo", "bar") for i in range(60)], "change_id long, path string, seq long, old string, new string")
    path = lambda d: d.withColumn("path", F.replace("path", F.lit(".py"), F.lit(".js")))
    b = spark.createDataFrame(bodies, "change_id long, path string, old_start long, old_end long, new_start long, new_end long")
    m = spark.createDataFrame(moved, "change_id long, path string, side string, start long, end long")
    got = noise.label_changes(path(df), path(f), path(b), path(m), renamed).collect()
    assert len(got) == sum(c[4] != "context" for c in changes)
    bad = [(x.change_id, x.path, x.side, x.line, x.text, x.noise, want.get((x.change_id, x.path.replace(".js", ".py"), x.side, x.line))) for x in got if x.noise != want.get((x.change_id, x.path.replace(".js", ".py"), x.side, x.line))]
    assert not bad, bad[:10]
    assert {x.noise for x in got} == {None, "formatting", "comment", "rename", "moved"}


def test_label_edges(spark):
    rows = [(1, "x.lock", 0, 0, "added", None, 1, "a"), (1, "m.txt", 0, 0, "removed", 1, None, "a  b "), (1, "m.txt", 0, 1, "added", None, 1, "a b"), (2, "t.py", 0, 0, "removed", 1, None, "  x"), (2, "t.py", 0, 1, "added", None, 1, "x"), (2, "t.py", 0, 2, "context", 2, 2, "y")]
    df = spark.createDataFrame(rows, CHANGES)
    src = spark.createDataFrame([(2, "t.py", "old", "'''\n  x\n'''"), (2, "t.py", "new", "'''\nx\n'''")], "change_id long, path string, side string, source string").withColumn("language", F.lit("python"))
    facts = lexer.line_facts(src, ["change_id", "path", "side"]).select("change_id", "path", "side", (F.col("line_no") - 1).alias("line"), F.col("line").alias("text"), "comment", "in_string", "define", "directive", F.lit(True).alias("parsed"))
    got = {(x.path, x.side, x.line): x.noise for x in noise.label_changes(df, facts, generated=df.where("path = 'x.lock'")).collect()}
    # a file that is not parsed keeps blanks at the end, a line within a text all of its blanks
    assert got == {("x.lock", "new", 1): "generated", ("m.txt", "old", 1): None, ("m.txt", "new", 1): None, ("t.py", "old", 1): None, ("t.py", "new", 1): None}
    stats = {tuple(x)[1:] for x in noise.review_stats(noise.label_changes(df, facts), spark.createDataFrame([(2, "t.py", "new", 1, 9)], "change_id long, path string, side string, start long, end long")).collect()}
    assert stats == {("x.lock", 1, 0, 0, 0, 1), ("m.txt", 1, 1, 0, 0, 2), ("t.py", 1, 1, 0, 1, 1)}
    assert noise.label_changes(df.limit(0), facts).count() == 0


def test_renames_as_a_table(spark):
    found = spark.createDataFrame([(1, ["a.py"], 1, "function", "old", "new"), (1, ["a.py"], 2, "function", "new", "newer"), (1, ["a.py"], 3, "method", "Svc.get", "Svc.fetch"), (1, ["a.py", "b.py"], 4, "method", "Svc.getOut", "Svc.putOut"), (1, ["b.py"], 5, "import", "np", "num"), (1, ["b.py"], 6, "function", "{a}", "b")], "change_id long, paths array<string>, seq long, kind string, old string, new string")
    t = renames.scoped(found)
    assert sorted((r.path or "", r.old, r.new) for r in t.collect()) == [("", "getOut", "putOut"), ("", "new", "newer"), ("", "old", "new"), ("a.py", "get", "fetch"), ("b.py", "np", "num")]
    lines = spark.createDataFrame([(1, "a.py", "x.get(old, newish, np) # old$ é-old"), (1, "b.py", "np.get(new, getOut)"), (2, "a.py", "old"), (1, "c.py", None)], "change_id long, path string, line string")
    assert [r.renamed for r in renames.rename_lines(lines, t).orderBy("change_id", "path").collect()] == ["x.fetch(newer, newish, np) # old$ é-newer", "num.get(newer, putOut)", None, "old"]
    names = spark.createDataFrame([(x,) for x in ["getOut", "outer_sep", "toString", "abcdef", "_ab_", "Aabcde", "abcdE", "__x__long_"]], "n string")
    assert [r[0] for r in names.where(renames.distinctive(F.col("n"))).collect()] == ["getOut", "outer_sep", "__x__long_"]
