"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A dictionary is trained on windows of ordinary text and one on windows of toxic text. The toxic compressor also has the
ordinary dictionary behind the toxic one, at the same offsets as the ordinary compressor, so that clean windows compress
alike under both and only what is typical of toxic text is cheaper under the toxic one. The byte differences of a document's
windows are calibrated to a probability on labelled documents that the dictionaries have not seen; the size of the toxic
dictionary is the one that tells these apart best.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCS = 6000  # labelled documents of either class that a fit reads at most
FIT_WINDOWS = 256  # windows of a labelled document that a fit reads at most, spread evenly over it
WINDOW_WORDS, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 12, 6, 96 << 10, (2 << 10, 4 << 10, 6 << 10, 8 << 10)
SEGMENT, PART = 32, 6  # bytes that a dictionary is put together from, and those whose frequency tells which


def windows(text: str) -> list[bytes]:
    """Lower-cased runs of WINDOW_WORDS words, a blank around each."""
    w = text.lower().split()
    return [f" {' '.join(w[i : i + WINDOW_WORDS])} ".encode() for i in range(0, len(w), WINDOW_WORDS)]


class Distance:
    """Compression lengths under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        filler = bytes(0xF8 + i % 8 for i in range(len(toxic)))  # no text has these bytes; offsets into the shared part are then equal
        self.plain, self.toxic = self._compressor(filler + ordinary), self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content or b"\xff" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def features(self, parts: list[bytes]) -> list[float]:
        """Of the windows of a text."""
        p, t = self.plain.compress, self.toxic.compress
        d = np.array([len(p(w)) - len(t(w)) for w in parts] or [0])
        n = len(d)
        over = [int((d >= k).sum()) for k in (1, 2, 3, 4, 5)]
        return [*np.log1p(over), float(d.max()), float(d.mean()), float(np.log1p(n)), *(o / n for o in over[1:]), float(np.clip(d, 0, None).sum() ** 0.5)]


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> dict:
    """Ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, keep = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], pull)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist()}


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.c_[np.ones(len(x)), (x - np.array(model["mean"])) / np.array(model["scale"])]
    return 1 / (1 + np.exp(-np.clip(z @ np.array(model["w"]), -30, 30)))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about `size` bytes trained on the windows; their last bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(samples: list[list[bytes]], toxic: list[bool]) -> dict | None:
    """A model from the windows of labelled texts in random order: three parts of five train the dictionaries, two calibrate. None without both classes."""
    y = np.array(toxic, bool)
    part = np.arange(len(samples)) % 5 < 3
    if not (y & part).any() or not (~y & part).any():
        return None
    rest = np.flatnonzero(~part) if (y & ~part).any() and (~y & ~part).any() else np.arange(len(samples))
    order = np.random.default_rng(11)

    def pool(which: np.ndarray) -> list[bytes]:
        w = [x for i in np.flatnonzero(which) for x in samples[i]]
        return [w[i] for i in order.permutation(len(w))]

    ordinary, bad, label = trained(pool(part & ~y), ORDINARY_BYTES), pool(part & y), y[rest].astype(float)
    best = None
    for size in TOXIC_BYTES:
        content = trained(bad, size)
        distance = Distance(ordinary, content)
        x = np.array([distance.features(samples[i]) for i in rest])
        loss = 0.0
        for half in (0, 1):  # what one half of them learns is held against the other
            learn, see = np.arange(len(rest)) % 2 == half, np.arange(len(rest)) % 2 != half
            if learn.any() and see.any():
                p = np.clip(probability(x[see], logistic(x[learn], label[learn])), 1e-6, 1 - 1e-6)
                loss -= float(np.sum(label[see] * np.log(p) + (1 - label[see]) * np.log(1 - p)))
        if best is None or loss < best[0]:
            best = (loss, content, logistic(x, label))
    return {"ordinary": ordinary.hex(), "toxic": best[1].hex(), "calibration": best[2]}


def fit_model(docs: DataFrame, labels: DataFrame) -> str | None:
    """Fit on labelled documents: labels (doc_id, toxic), documents (doc_id, text).

    At most FIT_DOCS of either class, those of least hash of doc_id, are read, and FIT_WINDOWS windows of each; they are cut
    before they are gathered. The fit is one task on that bounded sample and gives back some 250 kB. Contradictory labels of a doc_id count as toxic; null labels are left out.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    sample = None
    for bad in (True, False):
        some = known.where(F.col("bad") == bad).orderBy("order", "doc_id").limit(FIT_DOCS)
        sample = some if sample is None else sample.unionByName(some)
    sample = spark.createDataFrame(sample.toArrow()) if not sample.isEmpty() else None  # 2 x FIT_DOCS short rows
    if sample is None:
        return None
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(sample), F.col("d") == F.col("doc_id")).select("order", "d", "bad", F.coalesce("text", F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for text in b.column(3).to_pylist():
                w = windows(text)
                parts.append(w if len(w) <= FIT_WINDOWS else [w[i * len(w) // FIT_WINDOWS] for i in range(FIT_WINDOWS)])
            yield pa.record_batch([*b.columns[:3], pa.array(parts, pa.list_(pa.binary()))], names=["order", "d", "bad", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, parts = [], []
        for b in batches:
            toxic += b.column(2).to_pylist()
            parts += b.column(3).to_pylist()
        if toxic:
            yield pa.record_batch([pa.array([json.dumps(fit(parts, toxic))])], names=["model"])

    small = texts.mapInArrow(cut_up, "order long, d long, bad boolean, parts array<binary>")
    got = small.repartition(1).sortWithinPartitions("order", "d", "parts").mapInArrow(run, "model string").collect()
    return got[0]["model"] if got else None


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 where score >= threshold) and the columns in keep of every document (doc_id, text).

    Only text goes into a score. A null text is empty and has one empty window; without labels of both classes every
    score is the share of toxic labels, 0 without any. Rows that repeat are scored alike; an empty table gives an empty result.
    """
    keep = keep or []
    model = fit_model(docs, labels)
    known = json.loads(model) if model else None
    prior = 0.0
    if not known:
        prior = float(labels.where("toxic is not null").agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
    shared = docs.sparkSession.sparkContext.broadcast(known)  # some 250 kB, whatever the input
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        distance = Distance(bytes.fromhex(m["ordinary"]), bytes.fromhex(m["toxic"])) if m else None
        for b in batches:
            texts = b.column(1).to_pylist()
            p = probability(np.array([distance.features(windows(t or "")) for t in texts]).reshape(len(texts), -1), m["calibration"]) if m and texts else np.full(len(texts), prior)
            yield pa.record_batch([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), *b.columns[2:]], names=["doc_id", "score", "predicted", *names])

    ddl = "doc_id long, score double, predicted int" + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return rows.mapInArrow(run, ddl).withColumnsRenamed(dict(zip(names, keep, strict=True)))
