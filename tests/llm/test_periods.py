import hashlib
import random
import re

import numpy as np

from changeloom.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All (start, length, period) by trying each period at each place."""
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        s = 0
        while s < n - p:
            if w[s] != w[s + p]:
                s += 1
                continue
            e = s
            while e + p < n and w[e] == w[e + p]:
                e += 1
            if e - s + p >= max(6, 4 * p):
                out.setdefault((s, e + p - s), p)
            s = e
    return sorted((s, n, p) for (s, n), p in out.items())


def shapes():
    r = random.Random(4)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, ["a", "a", "b"] * 4 + ["a"] * 9, ["a"] * 2000, ["x", "y", "z"] * 700 + ["x"]]
    for _ in range(150):
        say = lambda k, m: [f"w{r.randrange(m)}" for _ in range(k)]
        t = say(r.randrange(30), r.choice([2, 3, 50]))
        for _ in range(r.randrange(4)):
            unit = say(r.randrange(1, 25), r.choice([1, 2, 5, 90]))
            if r.random() < 0.3:
                unit = unit * r.randrange(1, 5) + say(1, 3)
            t += (unit * r.randrange(2, 9))[: r.randrange(1, 160)] + say(r.randrange(8), 40)
        out.append(t)
    long = say(700, 400)
    return [*out, long * 5 + ["end"] + long[:90] * 7, [x for k in range(9) for x in ["q"] * 30 + [str(k)]], say(3000, 2)]


def test_runs_brute_force():
    for w in shapes():
        h = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in w], np.uint64)
        assert periods.runs(h, periods.back(h, np.array([0, len(w)]))) == brute(w), w[:60]


def test_squares_are_squares():
    w = [0, 1, 0, 1, 0, 0, 0, 1, 0, 1, 0, 0]
    got = set(periods.squares(w, 0, 6))
    assert got and all(w[i - p + 1 : i + 1] == w[i - 2 * p + 1 : i - p + 1] for i, p in got)
    assert {(3, 2), (5, 1), (11, 6)} <= got


def test_texts(spark):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "  ", "\n", "\t "]).join(w)) for i, w in enumerate(shapes())]
    rows += [(900, None), (901, ""), (902, " \n "), (None, "no no no no no no name"), (903, "é é é é é é"), (903, "é é é é é é"), (904, "a\x0bb " * 40 + "\x0c"), (905, "long " + "word after word " * 30000)]
    docs = spark.createDataFrame([(d, t, "runs", 1) for d, t in rows], "doc_id long, text string, collapsed string, n_runs int").repartition(3)
    for edit in (None, queries.planted):
        want, texts = {}, {}
        for d, t in rows:
            if d == 905:
                continue
            w = WORD.findall(t or "")
            if edit and w and (at := edit(d, len(w))):
                a, p = at
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            of = brute(w)
            gone = {i for s, n, p in of for i in range(s + p, s + n)}
            text = " ".join(x for i, x in enumerate(w) if i not in gone)
            best = min(of, key=lambda x: (-x[1], x[0], x[2])) if of else (None, None, None)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            one = (len(w), len(of), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in of)), sha(text))
            want.setdefault(d, []).append(one)
            texts[d] = text
        got, long = {}, None
        for x in periods.periodic_runs(docs, edit, with_text=True).collect():
            if x.doc_id == 905:
                long = x
                continue
            got.setdefault(x.doc_id, []).append(tuple(x)[1:9])
            assert x.collapsed == texts[x.doc_id] and len(x.runs) == x.n_runs
        assert got == want
        assert long.n_runs == 1 and long.length >= 29990 if edit is None else long.n_runs >= 1
    none = periods.periodic_runs(docs.limit(0))
    assert none.count() == 0 and none.columns[:3] == ["doc_id", "n_words", "n_runs"]


def test_plants_are_found():
    """A text of different words that repeats itself from a on has that one run, if it is long enough."""
    for a, n, p in ((0, 100, 25), (3, 99, 24), (3, 99, 25), (10, 5000, 1000), (50, 20000, 4987), (7, 20000, 4999)):
        h = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h[a:] = h[a + np.arange(n - a) % p]
        assert periods.runs(h, periods.back(h, np.array([0, n]))) == ([(a, n - a, p)] if n - a >= 4 * p else [])
