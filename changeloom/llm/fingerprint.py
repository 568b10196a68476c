"""Document fingerprints: an improbable-feature digest.

Every window of WINDOW bytes is a candidate feature, in texts of any length. Its Shannon entropy ranks it: the entropies
of all windows of the corpus are counted, and the rarer an entropy is, the less likely is its window to recur by chance.
A window that ranks best in enough of the runs of RUN consecutive candidates around it is selected, and the selected
windows fill a chain of Bloom filters in text order. Two digests are compared by the filters' bit overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm import kernel
from changeloom.llm.shared import partitions

WINDOW, RUN, POPULAR, WEAK = 16, 32, 8, 0.1
BITS, PER_FILTER, HASHES, ABOVE_CHANCE = 2048, 160, 5, 0.1
STREAMS = 4096
_count = np.arange(WINDOW + 2, dtype=float)
_GAIN = np.round(np.diff(np.concatenate([[0.0], _count[1:] * np.log2(np.maximum(_count[1:], 1))])) * 65536).astype(np.int32)
U64 = np.uint64


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window as a share of the most possible, scaled to 0..1000 (int64). Many streams slide side by side."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    streams = max(1, min(STREAMS, n // 256))
    length = -(-n // streams)
    steps = length + WINDOW - 1
    padded = np.zeros(streams * length + WINDOW, np.uint8)
    padded[: len(data)] = data
    x = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (streams, steps), (length, 1)).T)
    base, counts = np.arange(streams) * 256, np.zeros(streams * 256, np.uint8)
    total, out = np.zeros(streams, np.int32), np.empty((length, streams), np.int32)
    for t in range(steps):
        if t >= WINDOW:
            at = base + x[t - WINDOW]
            c = counts[at] - 1
            counts[at] = c
            total -= _GAIN[c]
        at = base + x[t]
        c = counts[at]
        total += _GAIN[c]
        counts[at] = c + 1
        if t >= WINDOW - 1:
            out[t - WINDOW + 1] = total
    most = np.log2(WINDOW)
    flat = out.T.ravel()[:n].astype(float) / 65536 / WINDOW
    return np.floor((most - flat) / most * 1000 + 0.51).astype(np.int64)  # sums of rounded terms: what lies on a half goes up


def _slide(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` (a power of two) consecutive keys."""
    k = 1
    while k < width:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return key


def _long_enough(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of less than a window are filled up with zero bytes, empty ones left out of that: one window each."""
    size = np.diff(offsets)
    short = (size > 0) & (size < WINDOW)
    if not short.any():
        return data, offsets
    return np.insert(data, np.repeat(offsets[1:][short], WINDOW - size[short]), 0), np.concatenate([[0], np.cumsum(np.where(short, WINDOW, size))])


def entropy_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of the texts have each entropy, 0 to 1000."""
    data, offsets = _long_enough(data, offsets)
    e = entropies(data)
    inside = np.repeat(offsets[1:], np.diff(offsets))[: len(e)] - np.arange(len(e)) >= WINDOW
    return np.bincount(e[inside], minlength=1001)


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy: the rarest first, of equally rare ones the higher; those below WEAK last."""
    weak = np.arange(1001) < WEAK * 1000
    rank = np.empty(1001, np.int64)
    rank[np.lexsort((-np.arange(1001), counts, weak))] = np.arange(1001)
    return rank


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected windows of each document, in text order, each once. `rank` is that of each entropy."""
    data, offsets = _long_enough(data, offsets)
    n_docs, size = len(offsets) - 1, np.diff(offsets)
    up, down = kernel.powers(len(data) + 1)
    run = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], dtype=U64)])
    e = entropies(data)
    windows = np.maximum(size - WINDOW + 1, 0)
    doc = np.repeat(np.arange(n_docs), windows)
    upto = np.cumsum(windows) - windows
    at = np.arange(len(doc)) + (offsets[:-1] - upto)[doc]  # where each window begins
    key = (rank[e[at]] << 40) | np.arange(len(at))
    # runs reach over both ends of a text, so that every window is in RUN of them; those of two texts do not meet
    wide = np.full(len(at) + (RUN - 1) * (n_docs + 1), np.int64(1) << 60)
    wide[np.arange(len(at)) + (RUN - 1) * (doc + 1)] = key
    best = _slide(wide, RUN) if len(at) else wide[:0]
    popular = np.bincount(best[best < 1 << 60] & ((1 << 40) - 1), minlength=len(at))
    chosen = (popular >= POPULAR) & (e[at] >= WEAK * 1000)
    for d in np.flatnonzero((windows > 0) & (np.bincount(doc[chosen], minlength=n_docs) == 0)):  # an even text: the one best window
        chosen[upto[d] + int(np.argmin(key[upto[d] : upto[d] + windows[d]]))] = True
    pick = at[chosen]
    h = kernel.mix((run[pick + WINDOW] - run[pick]) * down[pick]) if len(pick) else np.zeros(0, U64)
    cuts = np.searchsorted(doc[chosen], np.arange(n_docs + 1))
    out = []
    for d in range(n_docs):
        own = h[cuts[d] : cuts[d + 1]]
        _, first = np.unique(own, return_index=True)
        out.append(own[np.sort(first)])
    return out


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (rows of 256 bytes) of features in order."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    if n:
        where = np.arange(len(hashes)) // PER_FILTER
        for j in range(HASHES):
            bits[where, ((hashes >> U64(11 * j)) & U64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def encode(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap beyond chance with one of the other, averaged. Equal digests: 1."""
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a):
        return 0.0
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64)[:, None], np.bitwise_count(b).sum(1, dtype=np.int64)[None]
    both = np.bitwise_count(a[:, None] & b[None]).sum(2, dtype=np.int64)
    most, chance = np.minimum(na, nb), na * nb / BITS
    floor = chance + ABOVE_CHANCE * (most - chance)
    return float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(1).mean())


def fingerprints(texts: list[str], rank: np.ndarray) -> list[np.ndarray]:
    out = []
    for _, _, data, off in kernel.slices(pa.array([t.encode() for t in texts], pa.large_binary())):
        out += [digest(h) for h in features(data, off, rank)]
    return out


def rarity_table(docs: DataFrame) -> list[int]:
    """`rarity` of the entropies of all windows of all texts (text): 1001 counts a task are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for b in batches:
            for _, _, data, off in kernel.slices(b.column(0)):
                total += entropy_counts(data, off)
        yield pa.record_batch([pa.array(np.arange(1001)), pa.array(total)], names=["entropy", "n"])

    rows = docs.select("text").mapInArrow(run, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1001, np.int64)
    for r in rows:
        counts[r["entropy"]] = r["n"]
    return rarity(counts).tolist()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _deal(docs: DataFrame) -> DataFrame:
    """Rows (ghost, doc_id, text) dealt by ranges of doc_id and sorted downwards; each partition ends with a copy of the row that follows its last (ghost = 1), which is the first row of all for the last partition."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    n = partitions(spark)
    bounds = np.array(sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])), float)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(float), "left"))

    tops = sorted(((r["p"], r["m"]) for r in rows.select("id", part("id").alias("p")).groupBy("p").agg(F.max("id").alias("m")).collect()), reverse=True)  # a row a partition
    dealt = rows.select(F.lit(0).alias("ghost"), "doc_id", "text", "id", part("id").alias("p"))
    if tops:
        to = {tops[(i + 1) % len(tops)][1]: tops[i][0] for i in range(len(tops))}
        where = spark.createDataFrame(list(to.items()), T.StructType([T.StructField("top", T.LongType()), T.StructField("p", T.IntegerType())]))
        ghosts = rows.where(F.col("id").isin(list(to))).join(F.broadcast(where), F.col("id") == F.col("top"))
        dealt = dealt.unionByName(ghosts.select(F.lit(1).alias("ghost"), "doc_id", "text", "id", "p"))
    return dealt.repartitionById(n, F.col("p")).sortWithinPartitions("ghost", F.desc("id"), "text").select("ghost", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, rank: list[int] | None = None) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness to each other and to the next document's.

    The next document is the following one by descending doc_id (rows that repeat a doc_id by text), the first after the
    last; a table of one row has itself. A null text is empty, a null doc_id comes last; an empty text has an empty chain.
    An empty table gives an empty result; other columns are ignored. `rank` is a rarity table of 1001 ranks, by default that
    of these documents; digests can be compared if they were made with the same one.
    """
    table = np.array(rarity_table(docs) if rank is None else rank, np.int64)

    def done(rows: list[tuple], nxt: tuple) -> pa.RecordBatch:
        """rows: (doc_id, text, fingerprint); nxt: the row after the last of them."""
        after = [*rows[1:], nxt]
        edited = []
        for (_, text, _), (_, other, _) in zip(rows, after, strict=True):
            h = len(text) // 2
            edited.append(text[: len(text) - h] + other[:h])
        prints = fingerprints(edited, table)
        return pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([encode(r[2]) for r in rows]), pa.array([encode(p) for p in prints]),
                pa.array([likeness(r[2], p) for r, p in zip(rows, prints, strict=True)], pa.float64()), pa.array([likeness(r[2], a[2]) for r, a in zip(rows, after, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ended = False
        for b in batches:
            ghost, ids, texts = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(texts) and not ended:
                end, size = at, 0
                while end < len(texts) and size < 1 << 20:
                    size += len(texts[end])
                    end += 1
                for g, d, t, f in zip(ghost[at:end], ids[at:end], texts[at:end], fingerprints(texts[at:end], table), strict=True):
                    if g and ended:
                        break
                    ended |= bool(g)
                    held.append((d, t, f))
                at = end
                if len(held) > 1:
                    yield done(held[:-1], held[-1])
                    held = held[-1:]

    return _deal(docs).mapInArrow(run, SCHEMA)
