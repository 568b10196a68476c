import base64
import collections
import hashlib
import os
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from changeloom.llm import bpe, chat, components, fingerprint, jaccard, packing, quality, substrings, toxicity, urls, warc

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=5):
    """Texts with copies, near copies, shared passages, repeats, empty and null ones, and one long one."""
    r = random.Random(seed)
    words = ["ab", "Cd", "ef.", "é", "日本", "g1", "hi,", "jk"] + [f"w{i}" for i in range(60)]
    say = lambda k: [r.choice(words) for _ in range(k)]
    passage, base, out = say(40), say(90), [None, "", "one", "two words here", " \n\t ", "x " * 60]
    for i in range(n):
        t = say(r.randrange(5, 120))
        if i % 5 == 0:
            t = t[:30] + passage + t[30:]
        if i % 4 == 1:
            t = list(base)
            t[r.randrange(90)] = "new"
        if i % 7 == 2:
            t = base
        out.append(r.choice([" ", "\n", "  "]).join(t))
    return [(i, t) for i, t in enumerate([*out, " ".join(say(3000))])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "spans", "k") for i, t in corpus()], "doc_id long, text string, key string, rep string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_jaccard_brute_force(spark, docs, none):
    for k, pc in ((4, 85), (5, 80), (2, 60)):
        sets = {}
        for d, t in corpus():
            w = WORD.findall((t or "").lower())
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        to = {d: d for d in sets}
        find = lambda x: x if to[x] == x else find(to[x])
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pc * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    to[max(x, y)] = min(x, y)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs, k, pc).collect()}
        assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert jaccard.link_documents(none).count() == 0


@pytest.mark.parametrize("k, pc", [(5, 80), (4, 85)])  # as the pipeline has it, as op2 has it
def test_jaccard_family_of_near_copies(spark, monkeypatch, k, pc):
    """Near copies of one text, most of which do not qualify: right components, and pairs that are opened do not grow with the square of their number."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(140)]

    def copy(i, edits):
        w = list(base)
        for j in range(edits):
            w[r.randrange(140)] = f"e{i}x{j}"
        return w

    texts = [copy(i, 1 + i % 5) for i in range(400)]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in texts]
    to = list(range(len(sets)))
    find = lambda x: x if to[x] == x else find(to[x])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= pc * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                to[max(x, y)] = min(x, y)
    met, cut = [0], jaccard.cut

    def counted(df, name):
        out = cut(df, name)
        met[0] += out.count() if name in ("opened", "pairs", "inner") else 0
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    got = jaccard.link_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), k, pc).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: find(i) for i in range(len(texts))}
    assert met[0] <= 5 * len(texts)  # some 31 for each text without families


@pytest.mark.parametrize("k, pc, kind", [(5, 80, "odd head"), (4, 85, "odd head"), (5, 80, "nested")])
def test_jaccard_family_apart_from_its_head(spark, monkeypatch, k, pc, kind):
    """Near copies that all lack what their head has changed, or copies of changed copies: right components, and neither a family's pairs nor links grow with the square of its size."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(160)]

    def copy(of, tag, edits):
        w = list(of)
        for j in r.sample(range(160), edits):
            w[j] = f"{tag}x{j}"
        return w

    second, n = copy(base, "p", 5), 300
    third = copy(second, "q", 3)
    if kind == "nested":
        texts = [copy((base, second, third)[i % 3], f"e{i}", 1 + i // 3 % 3) for i in range(n)]
    else:  # the first of them has most changes
        texts = [copy(base, f"e{i}", 1 + i % 3 if i else 7) for i in range(n)]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in texts]
    to, links = list(range(n)), 0
    find = lambda x: x if to[x] == x else find(to[x])
    for a in range(n):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= pc * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                to[max(x, y)] = min(x, y)
                links += 1
    assert links > 10 * n
    met, cut = {}, jaccard.cut

    def counted(df, name):
        out = cut(df, name)
        if name in ("inner", "links"):
            met[name] = met.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    got = jaccard.link_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), k, pc).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: find(i) for i in range(n)}
    assert sum(met.values()) <= 5 * n, met


def test_components(spark):
    e = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45)]
    got = dict(map(tuple, components.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 40, 40: 40, 45: 40}


def test_substrings_brute_force(spark, docs, none):
    for span in (35, 14):
        w = {d: WORD.findall(t or "") for d, t in corpus()}
        seen = collections.Counter(tuple(x[i : i + span]) for x in w.values() for i in range(len(x) - span + 1))
        want = {}
        for d, x in w.items():
            gone = {i + j for i in range(len(x) - span + 1) if seen[tuple(x[i : i + span])] > 1 for j in range(span)}
            kept = [v for i, v in enumerate(x) if i not in gone]
            want[d] = (len(x), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
        got = {r.doc_id: r for r in substrings.remove_repeats(docs, span, with_text=True, keep=["key"]).collect()}
        assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == {d: v[:3] for d, v in want.items()}
        assert all(WORD.findall(r.kept_text) == want[d][3] and r.key == "spans" for d, r in got.items())
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", 2)
    r = random.Random(1)
    line = [f"l{i}" for i in range(20)]
    texts = [" ".join([f"a{r.random()}" for _ in range(30)] + line + [f"b{r.random()}" for _ in range(30)]) for _ in range(9)]
    texts += [texts[0][:400] + " tail " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in substrings.remove_repeats(df, 25).collect()}
    seen = collections.Counter(tuple(t.split()[i : i + 25]) for t in texts for i in range(len(t.split()) - 24))
    for d, t in enumerate(texts):
        w = t.split()
        assert got[d] == len({i + j for i in range(len(w) - 24) if seen[tuple(w[i : i + 25])] > 1 for j in range(25)})


def test_automaton():
    r = random.Random(2)
    for _ in range(50):
        seqs = [[r.randrange(3) for _ in range(r.randrange(4, 12))] for _ in range(4)]
        a, seen = substrings.Automaton(), {}
        for s in seqs:
            a.add(s)
        for i, s in enumerate(seqs):
            a.count(s, 1, seen, i)
        for s in seqs:
            for i, n in enumerate(a.matches(s)):
                in_two = lambda k: sum(any(t[j : j + k] == s[i + 1 - k : i + 1] for j in range(len(t))) for t in seqs) >= 2  # noqa: B023, E731
                assert n == max([k for k in range(1, i + 2) if in_two(k)], default=0)


def test_bpe_is_the_public_encoding(spark, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs, path, P.PATTERN, with_ids=True).collect():
        t = dict(corpus())[r.doc_id] or ""
        assert r.ids == e.encode_ordinary(t) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0
    b, rnd = bpe.encoder(path), random.Random(4)
    for _ in range(60):
        text = bytes(rnd.choice(b"abcdeth in") for _ in range(rnd.randrange(1, 60)))
        p = bpe.Prefixes(b, text[:9])
        p.append(text[9:])
        s = rnd.randrange(len(text))
        f = rnd.randrange(s, len(text) + 1)
        p.replace(s, f, b"then")
        assert p.ids() == b.merge(text[:s] + b"then" + text[f:])


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = dict(corpus()) | {900: "hi <|endoftext|> yo", 901: "<|startoftext|>", 902: "a<|endoftext|><|endoftext|> b <|ENDOFTEXT|>", 903: "<|endoftext", None: "no id"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for plain in (False, True):
        t.encode_special_tokens = plain
        rows = packing.pack_documents(df, path, plain_special=plain).collect()
        by, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
            seqs[r.sequence_id].append(r)
        for d, text in texts.items():
            ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
            for r in sorted(by[d], key=lambda r: r.start):
                assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
                at += r.length
            assert at == len(ids)
        for s in seqs.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and not at & (at - 1)
    assert packing.pack_documents(none, path).count() == 0


def test_packing_neighbours():
    """All neighbours of a shard by plain BM25; a window takes them in that order."""
    r = random.Random(12)
    texts = [[r.choice([r.randrange(40), r.randrange(2000)]) for _ in range(r.randrange(1, 300))] for _ in range(40)]
    flat, lengths = np.array([x for t in texts for x in t], np.uint16), np.array([len(t) for t in texts])
    index = packing.Index(flat, lengths)
    df = collections.Counter(x for t in texts for x in set(t))

    def score(seed, d):
        f = collections.Counter(texts[d])
        norm = packing.K1 * (1 - packing.B + packing.B * len(texts[d]) / lengths.mean())
        return sum(np.log1p((40 - df[x] + 0.5) / (df[x] + 0.5)) * f[x] * (packing.K1 + 1) / (f[x] + norm) for x in set(texts[seed]) if df[x] > 1)

    for seed in range(40):
        got = index.neighbours(seed).tolist()
        want = {d: score(seed, d) for d in range(40)}
        assert set(got) == {d for d, s in want.items() if s > 0} and all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))
    pieces = packing.pack_shard(flat, lengths)
    first = [p for p in pieces if p[3] == 0]
    order = [d for d in index.neighbours(first[0][0]).tolist() if d != first[0][0]]
    assert [p[0] for p in first[1:]] == order[: len(first) - 1] and sum(p[2] for p in pieces) == len(flat)


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    text = {d: t or "" for d, t in corpus()}
    w, run = fingerprint.WINDOW, fingerprint.RUN

    def entropy(x):
        n = [x.count(c) / w for c in set(x)]
        return int(-sum(p * np.log2(p) for p in n) / np.log2(w) * 1000 + 0.51)

    slots = lambda b: [b[i : i + w] for i in range(len(b) - w + 1)] if len(b) >= w or not b else [b.ljust(w, b"\0")]
    counts = collections.Counter(entropy(x) for t in text.values() for x in slots(t.encode()))
    order = sorted(range(1001), key=lambda e: (e < 100, counts[e], -e))
    rank = {e: i for i, e in enumerate(order)}

    def chain(t):
        own = slots(t.encode())
        key = [(rank[entropy(x)], i) for i, x in enumerate(own)]
        popular = collections.Counter(min(key[max(0, j - run + 1) : j + 1])[1] for j in range(len(own) + run - 1)) if own else {}
        pick = [i for i, x in enumerate(own) if popular[i] >= fingerprint.POPULAR and entropy(x) >= 100] or ([min(key)[1]] if own else [])
        hashes = list(dict.fromkeys(fingerprint.kernel.mix(np.array([sum((c + 1) * pow(int(fingerprint.kernel._BASE), k, 1 << 64) for k, c in enumerate(own[i])) % (1 << 64)], np.uint64)).tolist()[0] for i in pick))
        return [{h >> 11 * j & 2047 for h in hashes[i : i + 160] for j in range(5)} for i in range(0, len(hashes), 160)]

    def like(a, b):
        a, b = sorted((a, b), key=len)
        if a == b:
            return 1.0
        of = lambda x, y: len(x) * len(y) / 2048 + 0.1 * (min(len(x), len(y)) - len(x) * len(y) / 2048)
        return float(np.mean([max(min(1, max(0, (len(x & y) - of(x, y)) / max(min(len(x), len(y)) - of(x, y), 1e-9))) for y in b) for x in a])) if a else 0.0

    ids = sorted(text, reverse=True)
    for i, d in enumerate(ids):
        a, b = text[d], text[ids[(i + 1) % len(ids)]]
        h = len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(a)
        prints = [chain(x) for x in (a, edited, b)]
        for p, shown in zip(prints, (got[d].fingerprint, got[d].edited_fingerprint), strict=False):
            n, _, body = shown.partition(":")
            bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).reshape(int(n), 2048)
            assert [set(np.flatnonzero(x).tolist()) for x in bits] == p
        assert abs(got[d].near_edited - like(prints[0], prints[1])) < 1e-9 and abs(got[d].near_next - like(prints[0], prints[2])) < 1e-9
    # no length at which a text gets features of another kind
    long = text[ids[0]]
    table = fingerprint.rarity_table(docs)
    for n in (31, 32, 255, 256, 600):
        a, b = fingerprint.fingerprints([long[:n], long[: n + 8]], np.array(table))
        assert fingerprint.likeness(a, b) > 0.5
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_warc(spark):
    big = "é<p>" * 30000
    rows = [(1, "http://a", None), (2, None, "x" * 2000), (3, "u", "x" * 2000), (4, "u", "short"), (5, "u", "short"), (6, "u", big), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n\r\n" * 200), (8, "u", "x" * 2000)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max(q for q, _, g in rows if g == h)
        again = len(b) >= 1000 and p < top
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    def archive(rows, to):
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), to)
        return [r for f in spark.read.format("binaryFile").load(to).collect() for r in warc.parse_archive(bytes(f.content))]

    root = tempfile.mkdtemp(prefix="spark-")
    many = [(9, "u", "y" * 3000)] * 1500 + [(9, "v", "y" * 3000)] * 3 + [(8, "w", "y" * 3000), (9, "u", "z")]
    made = archive(many, f"{root}/many")
    names = [r["origin"] for r in made]
    assert len(set(names)) == len(made) == len(many) and all(r["refers_to"] in names for r in made if r["type"] == "revisit") and sum(r["type"] == "revisit" for r in made) == 1
    assert warc.read_archives(spark, f"{root}/many").count() == len(many)
    lone = warc._record([("WARC-Type", "revisit"), ("WARC-Record-ID", warc.ID % (1, "a" * 40, 0)), ("WARC-Refers-To", warc.ID % (2, "a" * 40, 0))], b"") + b"\r\n\r\n"
    os.mkdir(f"{root}/lone")
    with open(f"{root}/lone/a", "wb") as f:
        f.write(lone)
    with pytest.raises(Exception, match="not there"):
        warc.read_archives(spark, f"{root}/lone").collect()
    d, raw = warc.Dechunker(), warc.chunked(b"abc" * 5000, 700)
    assert b"".join(d.feed(raw[i : i + 11]) for i in range(0, len(raw), 11)) == b"abc" * 5000 and d.done


def test_chat(spark):
    hostile = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", None), (2, 0, None, "</turn>"), (2, 1, "tool): </turn>", "\\\\"), (3, 0, "user", "a"), (3, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest() and got[c].n_turns == 2
    assert got[1].loss_chars == len(hostile) and got[1].n_violations == 0 and got[3].n_violations == 2
    t = chat.ChatTemplate()
    r = random.Random(1)
    for _ in range(300):
        s = "".join(r.choice(["\\", "</turn>", "### User: ", "#", "<", "/turn>", "a", "): "]) for _ in range(6))
        assert t.unescaper()(t.escaper()(s)) == s and t.parser()(t.open["user"] + t.escaper()(s) + t.close) == [("user", s, False)]
    with pytest.raises(ValueError):
        chat.ChatTemplate(close="</a", other_close="x<")


def test_urls(spark):
    u = [None, "no scheme", "HTTP://Sub.Example.NET/en/x?q#f", "http://example.net", "https://a.example.com/de/1", "http://b.org/fr/", "http://x.com?y/z", "http://evilnet/"]
    df = spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    from changeloom.llm.queries import URL_RULES

    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.filter_urls(df, URL_RULES).collect()}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("sub.example.net", "/en/x", "example.net/en/"), 3: ("example.net", "", None), 4: ("a.example.com", "/de/1", "example.com/de/"), 5: ("b.org", "/fr/", "org/fr/"), 6: ("x.com", "", None), 7: ("evilnet", "/", None)}
    r = random.Random(3)
    many = [(i, f"http://{r.choice('abcd')}.{'casino' if i % 2 else 'news'}{r.randrange(99)}.{('net' if i % 2 else 'org') if i % 3 else 'com'}/{'fr/' if not i % 2 else ''}{i}") for i in range(400)]
    v = {x.page_id: x.verdict for x in urls.filter_urls(spark.createDataFrame(many, "page_id long, url string"), URL_RULES).collect()}
    assert sum(v[i] == ("block" if i % 2 else "allow") for i, _ in many) > 380


def test_url_models_brute_force(spark, monkeypatch):
    r = random.Random(8)
    say = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    text = {i: f"{say(12)}.{r.choice(['net', 'org', 'com'])}/{r.choice(['fr', 'x'])}/{say(60)}é" for i in range(400)}
    text |= {400: "", 401: text[3], 402: "a" * 300}
    kind = {i: i % 3 for i in text}
    n, c = collections.Counter(), collections.Counter()
    raw = {i: [0] * 5 + [x + 1 for x in t.encode()] for i, t in text.items()}
    for i, t in raw.items():
        for j in range(5, len(t)):
            for o in range(6):
                c[kind[i], tuple(t[j - o : j])] += 1
                n[kind[i], tuple(t[j - o : j + 1])] += 1

    def p(k, t, j):
        q = 1 / 256
        for o in range(6):
            q = (n[k, tuple(t[j - o : j + 1])] + 4 * q) / (c[k, tuple(t[j - o : j])] + 4)
        return q

    want = {i: sum(np.log(p(1, t, j) / p(0, t, j)) for j in range(5, len(t))) / (len(t) - 5) for i, t in raw.items() if len(t) > 5}
    df = spark.createDataFrame([(i, kind[i], t) for i, t in text.items()], "id long, kind int, text string").repartition(3)
    rows = urls.url_grams(df).selectExpr("id", "kind", "explode(grams) gram")
    for most in (urls.MOST_SHARED, 0):  # broadcast and dealt by gram
        monkeypatch.setattr(urls, "MOST_SHARED", most)
        got = {x.id: x.ratio for x in urls.score(rows.select("id", "gram"), urls.weights(rows.select("kind", "gram"))).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_quality(spark, none):
    df = spark.createDataFrame([(1, "a b c a b c\n\nx\nx", "s"), (2, None, None), (3, " ".join(f"w{i}" for i in range(60)) + " #", "s"), (4, "", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r)[1:8] for r in quality.judge(df).collect()}
    assert got[1] == (8, 8, 0, 1, 6, True, False) and got[2] == (0, 0, 0, 0, 0, True, False) and got[3][:5] == (61, 171, 1, 0, 0) and got[3][5:] == (False, True) and got[4][0] == 0
    bad = [(i, "x", "bad") for i in range(40)] + [(100 + i, " ".join(f"v{i}{j}" for j in range(60)), "bad" if i < 2 else "good") for i in range(30)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(bad, "doc_id long, text string, source string")).collect()}
    assert not kept[100] and kept[110] and quality.judge(none).count() == 0


def test_toxicity(spark, none):
    r = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("nd", "rt", "ll", "ming", "sto")]
    rows = []
    for i in range(600):
        w = [r.choice(words) for _ in range(r.randrange(30, 90))]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zyxqut", "vqokkar", "wyzzupt"])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(df, labels).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(400, 600)) >= 190 and 0 <= got[9999].score <= 1
    assert {x.score for x in toxicity.score_documents(df.limit(3), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(none, labels).count() == 0


def test_toxicity_lengths():
    """The features of a text are those of the compression lengths of its windows, computed apart."""
    import zstandard as z

    r = random.Random(9)
    say = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(k))
    samples = [toxicity.windows(say(60) + (" zyxqut vqokkar" * 2 if i % 3 == 0 else "")) for i in range(300)]
    m = toxicity.fit(samples, [i % 3 == 0 for i in range(300)])
    plain, toxic = bytes.fromhex(m["ordinary"]), bytes.fromhex(m["toxic"])
    assert plain and toxic and len(toxic) <= max(toxicity.TOXIC_BYTES)
    d = toxicity.Distance(plain, toxic)

    def length(window, content):
        c = z.ZstdCompressor(level=toxicity.LEVEL, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        return len(c.compress(window))

    text = say(40) + " zyxqut vqokkar " + say(9)
    diff = [length(w, bytes(0xF8 + i % 8 for i in range(len(toxic))) + plain) - length(w, toxic + plain) for w in toxicity.windows(text)]
    got = d.features(toxicity.windows(text))
    assert np.allclose(got[:5], np.log1p([sum(x >= k for x in diff) for k in (1, 2, 3, 4, 5)])) and got[5] == max(diff) and got[6] == np.mean(diff)
    assert d.features([])[:7] == [0.0] * 7 and toxicity.fit(samples[:5], [False] * 5) is None


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op2_ngram_jaccard", "op6_warc", "op8_substring_dedup", "op10_quality_rules"])
def test_oracle(spark, name):
    import duckdb

    from changeloom.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = c.sql(Q.ORACLE[name]), Q.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == sorted(map(str, want.select(*cols).fetchall()))


def test_by_sql_in_part(spark):
    """Host, path and rule of op9 and the edited text of op5, which SQL can say without the methods."""
    import duckdb

    from changeloom.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql("""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, CASE WHEN regexp_matches(host, '(^|\\.)example\\.net$') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN regexp_matches(host, '(^|\\.)example\\.com$') AND starts_with(path, '/de/') THEN 'example.com/de/'
WHEN regexp_matches(host, '(^|\\.)org$') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN regexp_matches(host, '(^|\\.)net$') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h""".replace("\\\\", "\\"))
    assert sorted(want.fetchall()) == sorted(tuple(r)[:4] for r in Q.op9_url_filter(spark, sf).collect())
    want = c.sql("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nx FROM documents)
SELECT doc_id, length(t), sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2)) FROM d""")
    assert sorted(want.fetchall()) == sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in Q.op5_fingerprints(spark, sf).collect())


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "substring dedup", "packing"]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # stage by stage: what each keeps of what the one before kept, and run() as the stages one after the other
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels, 0.7).where("predicted = 1").collect()}
    kept = cp.toxic(spark, docs, sf)
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.select(*cp.COLUMNS).collect() if r.doc_id not in bad)
    good = {r.doc_id for r in quality.judge(kept).where("kept").collect()}
    judged = cp.rules(spark, kept, sf)
    assert {r.doc_id for r in judged.collect()} == good
    single = cp.near_duplicates(spark, judged, sf).collect()
    comp = {r.doc_id: r.component_id for r in jaccard.link_documents(judged, 5, 80).collect()}
    assert sorted(r.doc_id for r in single) == sorted(set(comp.values()))
    once = _frame(spark, [tuple(r) for r in single])
    cleaned = cp.repeats(spark, once, sf).collect()
    pieces = cp.packed(spark, _frame(spark, [tuple(r) for r in cleaned]), sf).collect()
    assert sorted({(p.doc_id, p.start, p.ids_crc32) for p in pieces if p.start == 0}) and {p.doc_id for p in pieces} == {r.doc_id for r in single}
    total = lambda x: sorted(collections.Counter((p.doc_id, p.doc_tokens) for p in x if p.start == 0).items())
    assert total(cp.run(spark, sf).collect()) == total(pieces)


def test_pipeline_repeats_and_empty(spark):
    import corpus_pipeline as cp

    rows = [(d, t, "en", "s", 0) for d, t in corpus()] + [(None, corpus()[9][1], None, None, None)]
    w = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = collections.Counter(tuple(x[i : i + 35]) for x in w for i in range(len(x) - 34))
    want = []
    for (d, *_), x in zip(rows, w, strict=True):
        gone = {i + j for i in range(len(x) - 34) if seen[tuple(x[i : i + 35])] > 1 for j in range(35)}
        want.append((d, [v for i, v in enumerate(x) if i not in gone]))
    got = cp.repeats(spark, _frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, WORD.findall(r.text)) for r in got), key=str) == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in got)
    for stage in (cp.rules, cp.near_duplicates, cp.repeats):
        out = stage(spark, _frame(spark, []), "")
        assert out.columns == cp.COLUMNS and out.count() == 0
    assert cp.packed(spark, _frame(spark, []), "").count() == 0


def test_pipeline_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    r = random.Random(11)
    say = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    a, b, c, d = (say(80) for _ in range(4))
    near = [*c[:79], "other"]
    rows = [(1, a), (1, ["x"]), (None, b), (None, ["y"]), (None, None), (2, c), (2, c), (3, near), (4, d), (4, say(70) + d[:40]), (None, d)]
    rows = [(i, None if t is None else " ".join(t), "en", f"s{k % 2}", 0) for k, (i, t) in enumerate(rows)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    words = lambda t: (t or "").split()

    good = [x for x in rows if len(words(x[1])) >= 50]
    assert got(cp.rules(spark, frame(rows), "")) == sorted((x[:2] for x in good), key=str)

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(x[1]) for x in good)]
    to = list(range(len(good)))
    for i in to[:]:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                to = [to[j] if x == to[i] else x for x in to]
    first = [min((x for x, k in zip(good, to, strict=True) if k == c), key=lambda x: (x[0] is None, x[0] or 0)) for c in set(to)]
    assert got(cp.near_duplicates(spark, frame(good), "")) == sorted((x[:2] for x in first), key=str)
    assert sorted(str(x[0]) for x in first) == ["1", "2", "4", "4", "None"]


def test_host_verdicts(spark):
    """Domains of which most documents fail a rule are rejected, whatever their size, and SQL says the same."""
    import duckdb

    clean = lambda i: " ".join(f"v{i}{j}" for j in range(60))
    rows = []
    for d, (n, bad, kind) in {"a": (40, 2, "short"), "b": (300, 12, "short"), "c": (25, 24, "short"), "d": (7, 7, "short"), "e": (1, 1, "short"), "f": (60, 3, "short"), "g": (30, 28, "lines"), "h": (30, 27, "symbols"), "i": (90, 4, "short")}.items():
        for i in range(n):
            t = clean(i)
            if i < bad:
                t = {"short": "x", "lines": t + "\nsame" * 9, "symbols": t + " " + "#" * 90}[kind]
            rows.append((len(rows), t, d))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df).collect()}
    gone = {s for d, t, s in rows if not got[d][0] and not got[d][1]}
    assert gone == {"c", "g", "h"} and all(not got[d][1] for d, _, s in rows if s in "cdgh")
    documents = df.toPandas()  # noqa: F841
    want = {r[0]: r[6:8] for r in duckdb.sql(quality.ORACLE).fetchall()}
    assert {d: tuple(v) for d, v in got.items()} == want


def test_pipeline_small_domains(spark):
    import corpus_pipeline as cp

    clean = lambda i: " ".join(f"v{i}{j}" for j in range(60))
    rows = [(i, "x" if i < 18 else clean(i), "en", "small" if i < 19 else f"good{i % 3}", 0) for i in range(49)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.rules(spark, df, "").collect()) == list(range(19, 49))


def test_substrings_of_many_equal_rows(spark):
    """Time and memory must not grow with the square of the copies: 20,000 rows of one text, and one that shares a passage with them."""
    words = [f"w{i}" for i in range(60)]
    copies = spark.range(20000).selectExpr("7L AS doc_id", f"'{' '.join(words)}' AS text")
    other = spark.createDataFrame([(8, " ".join(words[:40] + ["new"] * 30))], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(copies.unionByName(other)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert (got[7].n_words, got[7].n_removed, got[7]["count"]) == (60, 60, 20000) and (got[8].n_words, got[8].n_removed, got[8]["count"]) == (70, 40, 1)
