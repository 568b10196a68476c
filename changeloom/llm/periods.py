"""Repetitions of words within texts: runs, that is longest stretches that keep a smallest period.

A suffix automaton of a stretch of words has as its link tree the suffixes of each prefix. Appending word i is an access in
the manner of link-cut trees: the path from prefix i to the root becomes one path of colour i (the place where its words end
last). A segment that loses colour j says that the i - j words behind j are found again behind i, if the segment's longest word
sequence has as many: a square, which is then extended both ways to its run. The tree of a whole stretch is known before the
first access, so paths are kept as stacks of segments along heavy paths, and no splay trees are needed.

Only stretches that can hold a long run get an automaton. In a run of period q every triple of words from its (q + 3)-rd word on
has been there within the last q words; for periods between Q/2 and Q that makes some 1.5 Q neighbouring places at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm import kernel

LEAST, TIMES, TRIPLE, CHUNK = 6, 4, 3, 512
_FAR = np.int64(1) << 60


def squares(words: list[int], low: int, high: int) -> Iterator[tuple[int, int]]:
    """(end, period) with low < period <= high of squares in a word sequence, from its suffix automaton and an access for each word. Each run of such a smallest period, of two periods or more, has one at least."""
    # the automaton
    nxt: list[dict[int, int]] = [{}]
    link, longest, prefix, last = [-1], [0], [], 0
    for c in words:
        cur = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
        last = cur
        prefix.append(cur)
    del nxt
    # heavy paths of the link tree: from each state to the child with most states below it
    n = len(link)
    by_length = np.argsort(longest, kind="stable").tolist()
    size, heavy = [1] * n, [0] * n
    for v in reversed(by_length[1:]):
        u = link[v]
        size[u] += size[v]
        if not heavy[u] or size[v] > size[heavy[u]]:
            heavy[u] = v
    head = [0] * n
    for v in by_length[1:]:
        head[v] = head[link[v]] if link[v] and heavy[link[v]] == v else v
    # accesses: on each heavy path the segments nearest its head lie on top, as (longest sequence, colour)
    paths: dict[int, list[tuple[int, int]]] = {}
    for i, v in enumerate(prefix):
        while v:
            top, most = head[v], longest[v]
            stack = paths.get(top)
            if stack is None:
                paths[top] = [(most, i)]
            else:
                while stack:
                    size_of, j = stack[-1]
                    if low < i - j <= high and i - j <= (size_of if size_of < most else most):
                        yield i, i - j
                    if size_of > most:
                        break
                    stack.pop()
                stack.append((most, i))
            v = link[top]


def _stretches(at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last of the runs of consecutive numbers in a sorted array, `least` numbers or more."""
    if len(at) < least:
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]
    long = last - first + 1 >= least
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def _needed(q: int) -> int:
    """How many neighbouring places a run with a period over q / 2, up to q, has that repeat a triple of at most q words before."""
    return max(LEAST, TIMES * (q // 2 + 1)) - (q // 2 + 1) - TRIPLE + 1


def back(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For the triple of words that ends at each place, how many words before its like ended last within its document; _FAR where it is new."""
    n = len(hashes)
    out = np.full(n, _FAR)
    if n < TRIPLE:
        return out
    triple = kernel.grams(hashes, TRIPLE)
    order = np.argsort(triple, kind="stable")
    same = np.flatnonzero(triple[order[1:]] == triple[order[:-1]])
    now, was = order[same + 1], order[same]
    begin = first[np.searchsorted(first, now, "right") - 1]
    inside = was >= begin  # both lie within the document; a triple over its end would begin in the document before
    now, was = now[inside], was[inside]
    fits = now + TRIPLE - 1 < first[np.searchsorted(first, now, "right")]
    out[now[fits] + TRIPLE - 1] = (now - was)[fits]
    return out


def runs(hashes: np.ndarray, distance: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least LEAST words and TIMES periods, by start, then period. distance: of `back`, for this document."""
    n, found = len(hashes), {}
    near = np.flatnonzero(distance < _FAR)
    gap = distance[near]
    code = None
    q = 1
    while TIMES * (q // 2 + 1) <= n:
        keep = gap <= q
        for (s, e), p in found.items():  # deep within a run of a smaller period no other can lie
            if e - s + 1 > 2 * (p + q):
                keep &= (near < s + p + q) | (near > e - p - q)
        for u, v in _stretches(near[keep], _needed(q)):
            if code is None:
                code = np.unique(hashes, return_inverse=True)[1]
            lo, hi = max(0, u - q - TRIPLE), min(n, v + 2)
            width = max(4 * q, CHUNK)
            for at in range(lo, max(lo + 1, hi - 2 * q), width - 2 * q):
                to = min(hi, at + width)
                if any(s <= at and to - 1 <= e for s, e in found):
                    continue  # other runs that have a square here have a later or an earlier one outside
                reach: dict[int, int] = {}
                for i, p in squares(code[at:to].tolist(), q // 2, q):
                    i += at
                    if reach.get(p, -1) >= i:
                        continue
                    s, e = _extend(code, i, p)
                    reach[p] = e
                    if e - s + 1 >= max(LEAST, TIMES * p) and (s, e) not in found:
                        found[s, e] = p
        q *= 2
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def _extend(code: np.ndarray, end: int, p: int) -> tuple[int, int]:
    """First and last word of the longest stretch around a square that keeps period p."""
    n, e, step = len(code), end, 64
    while e + 1 < n:
        to = min(n, e + 1 + step)
        off = np.flatnonzero(code[e + 1 : to] != code[e + 1 - p : to - p])
        if len(off):
            e += int(off[0])
            break
        e, step = to - 1, step * 2
    s, step = end - 2 * p + 1, 64
    while s > 0:
        to = max(0, s - step)
        off = np.flatnonzero(code[to:s] != code[to + p : s + p])
        if len(off):
            s = to + int(off[-1]) + 1
            break
        s, step = to, step * 2
    return s, e


DDL = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
SPANS = ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
Edit = Callable[[int | None, int], tuple[int, int] | None]


def periodic_runs(docs: DataFrame, edit: Edit | None = None, with_text: bool = False) -> DataFrame:
    """For each document (doc_id, text) its runs of at least 6 words and 4 periods, and its text collapsed to one period of each.

    n_words, n_runs; start, length, period and floor(1000 length / period) of the longest run (ties: smallest start, then
    period; null without one); SHA-256 of the lines `start,length,period` of all runs and of the kept words joined by one
    blank; with_text also `runs` and `collapsed` themselves. Words are equal if their 64-bit hashes are. A null or empty text has no words and no runs.
    Rows are judged each by itself, so repeated rows, null doc_ids, empty tables and other columns are of no matter. edit
    (doc_id, n words) may name a place a and a period p: from word a on the text is then its words a .. a+p-1 again and again. Nothing
    is shuffled; a task holds one text with some 40 bytes a word, and some 400 for each word of a stretch that may hold a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in kernel.slices(b.column(1)):
                yield _judge(b.column(0).slice(i, j - i), data, off, edit, with_text)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, DDL + SPANS * with_text)


def _judge(names: pa.Array, data: np.ndarray, off: np.ndarray, edit: Edit | None, with_text: bool) -> pa.RecordBatch:
    w = kernel.Words(data, off)
    hashes, source, changed = w.hash, None, set()
    if edit:
        for d, (name, n) in enumerate(zip(names.to_pylist(), w.counts().tolist(), strict=True)):
            if n and (at := edit(name, n)):
                a, p = at
                if source is None:
                    source = np.arange(len(hashes))
                f = w.first[d]
                source[f + a : f + n] = f + a + np.arange(n - a) % p
                changed.add(d)
        if changed:
            hashes = hashes[source]
    distance = back(hashes, w.first)
    close = np.flatnonzero(distance < _FAR)
    every = np.bincount(w.doc[close], minlength=w.n_docs)
    got: dict[int, list[tuple[int, int, int]]] = {}
    keep = np.ones(len(hashes), bool)
    for d in np.flatnonzero(every >= _needed(1)).tolist():
        f, t = int(w.first[d]), int(w.first[d + 1])
        if of := runs(hashes[f:t], distance[f:t]):
            got[d] = of
            for s, n, p in of:
                keep[f + s + p : f + s + n] = False
    texts = _joined(w, data, keep, source, changed)
    longest = [min(got[d], key=lambda r: (-r[1], r[0], r[2])) if d in got else None for d in range(w.n_docs)]
    pick = lambda k: pa.array([r and r[k] for r in longest], pa.int64())
    lines = ["".join(f"{s},{n},{p}\n" for s, n, p in got.get(d, ())) for d in range(w.n_docs)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    cols = [names, pa.array(w.counts()), pa.array([len(got.get(d, ())) for d in range(w.n_docs)], pa.int64()), pick(0), pick(1), pick(2)]
    cols += [pa.array([r and 1000 * r[1] // r[2] for r in longest], pa.int64()), pa.array([sha(x.encode()) for x in lines]), pa.array(list(map(sha, texts)))]
    if with_text:
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        cols += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in got.get(d, ())] for d in range(w.n_docs)], pa.list_(one)), pa.array([x.decode() for x in texts])]
    return pa.record_batch(cols, names=[c.split()[0] for c in DDL.split(", ")] + ["runs", "collapsed"] * with_text)


def _joined(w: kernel.Words, data: np.ndarray, keep: np.ndarray, source: np.ndarray | None, changed: set[int]) -> list[bytes]:
    """The kept words of each document, joined by one blank."""
    out, raw = [], data.tobytes()
    kept = np.flatnonzero(keep)
    upto = np.searchsorted(kept, w.first)
    # a mask over bytes: the kept words and the byte behind each, but for the last of a document
    size = w.end[kept] - w.start[kept]
    last = np.zeros(len(kept), bool)
    last[upto[1:][np.diff(upto) > 0] - 1] = True
    wide = size + ~last
    at = np.cumsum(wide) - wide
    take = np.repeat(w.start[kept] - at, wide) + np.arange(int(wide.sum()))
    joined = data[take] if len(take) else np.zeros(0, np.uint8)
    joined[(at + size)[~last]] = 32
    flat = joined.tobytes()
    ends = np.concatenate([at, [len(flat)]])
    for d in range(w.n_docs):
        if d in changed:
            mine = source[kept[upto[d] : upto[d + 1]]]
            out.append(b" ".join([raw[s:e] for s, e in zip(w.start[mine].tolist(), w.end[mine].tolist(), strict=True)]))
        else:
            out.append(flat[ends[upto[d]] : ends[upto[d + 1]]])
    return out
