"""Substring dedup: suffix automata of reference passages give matching statistics; repeated spans are cut out.

Each window of `span` words has an anchor, its least hash of `GRAM` words, which equal windows share. The windows of
one anchor at one place, with their words, are a passage; passages of an anchor that occurs once cannot repeat and
never travel. Equal passages are one kind, with their number as weight. The kinds of one anchor are a reference shard: a
suffix automaton of them, with the number of places of each state, is built in the task that owns the shard, and
the kinds are streamed through it for the longest match with a second place at each word. What it finds holds for
every passage of a kind. A shard of more than MANY kinds is dealt out by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernel
from changeloom.llm.shared import cut, partitions

GRAM, MANY = 12, 512
U64 = np.uint64


def passages(word_hash: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """anchor, context hash, first window, number of windows of each passage of one document; every window is in just one."""
    n = len(word_hash) - span + 1
    if n <= 0:
        return (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    g = kernel.grams(word_hash, GRAM)
    width = span - GRAM + 1
    at = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    for i in range(0, n, 4096):  # bounded memory for any length
        at[i : i + 4096] = view[i : i + 4096].argmin(1) + np.arange(i, min(i + 4096, n))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n))
    p = at[first]
    up, down = kernel.powers(len(word_hash) + 1)
    run = np.concatenate([np.zeros(1, U64), np.cumsum(word_hash * up[: len(word_hash)], dtype=U64)])
    end = first + count + span - 1
    ctx = (run[end] - run[first]) * down[first] + (p - first).astype(U64) * kernel._STEP[100] + count.astype(U64) * kernel._STEP[101]
    return g[p], kernel.mix(ctx), first, count


class Automaton:
    """A suffix automaton of several word sequences; `places` of a state is the weight of the sequences its strings occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.places = [-1], [0], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            self.places.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = cur

    def _split(self, p: int, q: int, w: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.places.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def count(self, words: list[int], weight: int, seen: dict[int, int], number: int) -> None:
        """Adds weight to every state that has a string in words."""
        v = 0
        for w in words:
            v = self.next[v][w]
            u = v
            while u > 0 and seen.get(u) != number:
                seen[u] = number
                self.places[u] += weight
                u = self.link[u]

    def matches(self, words: list[int], least: int = 2) -> Iterator[int]:
        """At each word the length of the longest match that ends there and has `least` places."""
        v = 0
        for i, w in enumerate(words):
            v = self.next[v][w]
            u, n = v, i + 1
            while u > 0 and self.places[u] < least:
                u = self.link[u]
                n = self.len[u]
            yield n if u > 0 else 0


def repeated_windows(sequences: list[list[int]], weights: list[int], span: int) -> list[list[int]]:
    """For each sequence the starts of its windows of `span` words that have a second place among all of them."""
    a, seen = Automaton(), {}
    for s in sequences:
        a.add(s)
    for i, (s, w) in enumerate(zip(sequences, weights, strict=True)):
        a.count(s, w, seen, i)
    return [[i - span + 1 for i, n in enumerate(a.matches(s)) if n >= span] if w == 1 else list(range(len(s) - span + 1)) for s, w in zip(sequences, weights, strict=True)]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Sorted starts as (first, last + 1)."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [tuple(x) for x in out]


def repeated_spans(rows: DataFrame, span: int) -> DataFrame:
    """id, th, spans (array of from, to in words) of the texts (id, th, text) that hold windows with a second place anywhere."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [c.to_numpy() for c in b.columns[:2]]
            for i, j, data, off in kernel.slices(b.column(2)):
                w = kernel.Words(data, off)
                got = [passages(w.hash[a:e], span) for a, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                cols = [np.concatenate(c) for c in zip(*got, strict=True)]
                own = [np.repeat(k[i:j], [len(g[0]) for g in got]) for k in keys]
                yield pa.record_batch([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), *map(pa.array, own), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], names=["anchor", "ctx", "id", "th", "a", "n"])

    every = cut(rows.mapInArrow(find, "anchor long, ctx long, id long, th long, a int, n int"), "passages")
    twice = cut(every.groupBy(F.col("anchor").alias("again")).count().where("count > 1").select("again"), "twice")  # a table, so that the join below can split a hot anchor
    found = cut(every.join(twice, F.col("anchor") == F.col("again"), "left_semi"), "found")
    kinds = cut(found.groupBy("anchor", "ctx").agg(F.count("*").alias("w"), F.min(F.struct("id", "th", "a", "n")).alias("at")), "kinds")
    many = cut(kinds.groupBy(F.col("anchor").alias("shard")).count().where(F.col("count") > MANY).select("shard"), "many")
    ask = kinds.join(many, F.col("anchor") == F.col("shard"), "left").select("anchor", "ctx", F.least("w", F.lit(2)).cast("int").alias("w"), "at.*", F.col("shard").isNotNull().alias("hot"))
    ask = cut(ask.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "ctx", "w", "a", "n", "hot")).alias("asked")), "asked")
    texts = rows.join(ask.withColumnsRenamed({"id": "i", "th": "t"}), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).dropDuplicates(["id", "th"]).select("text", *[f"asked.{c}" for c in ("anchor", "ctx", "w", "a", "n", "hot")])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.columns[1:]
            for i, j, data, off in kernel.slices(b.column(0)):
                words = kernel.Words(data, off)
                out, flat = [], []
                for d in range(i, j):
                    own = words.hash[words.first[d - i] : words.first[d - i + 1]]
                    whole = kernel.grams(own, span).view(np.int64)
                    for anchor, ctx, w, a, n, hot in zip(*(c[d].as_py() for c in asked), strict=True):
                        if hot:  # one row a window, which any number of tasks can count
                            out += [(anchor, ctx, w, x, h) for x, h in enumerate(whole[a : a + n].tolist())]
                            flat += [np.zeros(0, np.int64)] * n
                        else:
                            out.append((anchor, ctx, w, 0, 0))
                            flat.append(own[a : a + n + span - 1].view(np.int64))
                if out:
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                    yield pa.record_batch([*cols, kernel.ragged(np.concatenate(flat), np.array([len(x) for x in flat]), pa.int64())], names=["anchor", "ctx", "w", "x", "window", "words"])

    pieces = cut(texts.mapInArrow(cut_out, "anchor long, ctx long, w int, x int, window long, words array<long>"), "pieces")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard by shard; a shard has at most MANY kinds of at most 2 * span words."""
        shard: list[tuple] = []

        def flush() -> list[tuple]:
            got = repeated_windows([s[3] for s in shard], [s[2] for s in shard], span)
            res = [(anchor, ctx, [x for x, _ in runs], [y for _, y in runs]) for (anchor, ctx, _, _), starts in zip(shard, got, strict=True) if (runs := _runs(starts))]
            shard.clear()
            return res

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard and shard[0][0] != row[0]:
                    out += flush()
                shard.append(row)
            yield rows_of(out)
        if shard:
            yield rows_of(flush())

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["anchor", "ctx", "s", "e"])

    cold = pieces.where("size(words) > 0").repartition(partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "ctx").select("anchor", "ctx", "w", "words")
    cold = cold.mapInArrow(stream, "anchor long, ctx long, s array<int>, e array<int>")
    hot = pieces.where("size(words) = 0").drop("words")
    often = hot.groupBy(F.col("window").alias("again")).agg(F.sum("w").alias("t")).where("t > 1").select("again")
    hot = hot.join(often, F.col("window") == F.col("again"), "left_semi").groupBy("anchor", "ctx").agg(F.array_sort(F.collect_list("x")).alias("s"))
    repeats = cut(cold.unionByName(hot.select("anchor", "ctx", "s", F.transform("s", lambda x: x + 1).alias("e"))), "repeats")
    spans = found.join(repeats, ["anchor", "ctx"]).select("id", "th", F.transform(F.arrays_zip("s", "e"), lambda r: F.struct((r["s"] + F.col("a")).alias("s"), (r["e"] + F.col("a") + span - 1).alias("e"))).alias("spans"))
    # rows that are equal have equal spans, which a set keeps once, however many rows there are
    return cut(spans.groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, span: int = 35, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, white space between kept words as it was; and columns in keep).

    Every word in a window of `span` words whose sequence also starts anywhere else, in the same document or another, is
    removed, the first occurrence too. A null text has no words; texts shorter than a window keep all; rows that repeat each
    other repeat all their windows. The digest is of the kept words joined by one space. An empty table gives an empty
    result; other columns are ignored.
    """
    keep = keep or []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    base = base.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("doc_id", "text")})  # equal rows have equal spans
    spans = repeated_spans(base.select("id", "th", "text"), span)
    joined = base.join(spans.withColumnsRenamed({"id": "i", "th": "t"}), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left")
    joined = joined.select("doc_id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"), *[f"keep_{i}" for i in range(len(keep))])
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = b.column(2), b.column(3)
            n, gone, digests, texts = [], [], [], []
            for i, j, data, off in kernel.slices(b.column(1)):
                w = kernel.Words(data, off, hashes=False)
                for d in range(i, j):
                    a, e = int(w.first[d - i]), int(w.first[d - i + 1])
                    raw = data[off[d - i] : off[d - i + 1]]
                    ws, we = w.start[a:e] - off[d - i], w.end[a:e] - off[d - i]
                    mask = np.zeros(e - a + 1, np.int64)
                    if starts[d].is_valid:
                        np.add.at(mask, np.array(starts[d].as_py()), 1)
                        np.add.at(mask, np.array(ends[d].as_py()), -1)
                    kept = np.cumsum(mask)[:-1] == 0
                    n.append(e - a)
                    gone.append(e - a - int(kept.sum()))
                    body = raw.tobytes()
                    digests.append(hashlib.sha256(b" ".join(body.split() if kept.all() else [body[x:y] for x, y in zip(ws[kept].tolist(), we[kept].tolist(), strict=True)])).hexdigest())
                    if with_text:
                        hole = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(hole, ws[~kept], 1)  # a removed word goes with the white space after it
                        np.add.at(hole, np.append(ws, len(raw))[1:][~kept] if len(ws) else ws, -1)
                        texts.append(raw[np.cumsum(hole)[:-1] == 0].tobytes().decode() if gone[-1] else body.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if with_text else []), *(b.column(4 + x) for x in range(len(keep)))]
            yield pa.record_batch(cols, names=names + [f"keep_{x}" for x in range(len(keep))])

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = joined.mapInArrow(run, ddl)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
