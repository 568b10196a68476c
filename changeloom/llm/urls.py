"""URL filters: explicit rules, then a character language-model ratio for the URLs that no rule decides.

Two variable-order Markov models over bytes, one of accepted and one of rejected URLs, are smoothed by
recursive interpolation from order 0 up. A URL is accepted if its log-likelihood difference a byte is at
least the threshold calibrated on labelled URLs that were left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernel
from changeloom.llm.shared import cut

ORDER, PULL, BINS = 5, 4.0, 400
WIDTH, FRACTION = 9, 32  # bits of a byte in a gram, of a weight's fraction
MOST_SHARED, HOT = 500_000, 1000  # weights that are broadcast at once; beyond it only grams of more than 1/HOT of all places are


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) by host and path. rules: (verdict, host, path); the longest host and path wins, then the earlier."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte: itself and the ORDER bytes before it, WIDTH bits each, the byte lowest. A byte is its value and one; 0 stands before the start of the URL."""
    pos = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    value = data.astype(np.int64) + 1
    out = value.copy()
    for o in range(1, ORDER + 1):
        back = np.zeros(len(data), np.int64)
        back[o:] = value[:-o]
        back[pos < o] = 0
        out |= back << (WIDTH * o)
    return out


def url_grams(df: DataFrame) -> DataFrame:
    """id, kind and the grams of each text of df (id, kind, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in kernel.slices(b.column(2)):
                yield pa.record_batch([b.column(0)[i:j], b.column(1)[i:j], kernel.ragged(_grams(data, off), np.diff(off), pa.int64())], names=["id", "kind", "grams"])

    return df.select("id", "kind", "text").mapInArrow(run, "id long, kind int, grams array<long>")


def weights(rows: DataFrame) -> DataFrame:
    """gram, n, f of every gram in rows (kind, gram): how often it stands and its log-likelihood of accepted less that of rejected, in units of 2**-FRACTION.

    Rows of kind 0 (rejected) and 1 (accepted) are counted, the others only looked up. A gram holds its cell of each order
    in its low bits and, above its byte, that cell's context, so the counts are sums over whole keys. A context
    has at most 256 cells and a cell at most 257 longer ones, so no key of these joins is hot.
    """
    seen = cut(rows.groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1")), "grams")
    p = None
    for o in range(ORDER + 1):
        last = (1 << (WIDTH * o)) - 1
        cells = seen.groupBy(F.col("gram").bitwiseAND((1 << (WIDTH * (o + 1))) - 1).alias("cell")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        contexts = cells.groupBy(F.shiftright("cell", WIDTH).alias("context")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        x = cells.join(F.broadcast(contexts) if o < 2 else contexts, F.shiftright("cell", WIDTH) == F.col("context"))
        if p is None:
            x = x.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        else:
            x = x.withColumn("low", F.col("cell").bitwiseAND(last)).join(F.broadcast(p) if o < 2 else p, "low")  # fewer than 300 rows up to order 1
        smooth = lambda k: ((F.col(f"n{k}") + PULL * F.col(f"p{k}")) / (F.col(f"c{k}") + PULL)).alias(f"p{k}")
        p = x.select(F.col("cell").alias("low"), smooth(0), smooth(1))
    f = F.round((F.log("p1") - F.log("p0")) * float(1 << FRACTION)).cast("long")
    return cut(p.select(F.col("low").alias("gram"), f.alias("f")).join(seen.select("gram", "n"), "gram").select("gram", "n", "f"), "weights")


def score(rows: DataFrame, table: DataFrame) -> DataFrame:
    """id, ratio: the mean of f over the grams of each id of rows (id, gram). Sums are of integers, so their order does not matter."""
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
    f = table.select("gram", "f")
    if n <= MOST_SHARED:
        x = rows.join(F.broadcast(f), "gram")
    else:
        hot = table.where(F.col("n") > max(1, total // HOT)).select("gram", "f")  # fewer than HOT rows
        x = rows.join(F.broadcast(hot), "gram").select("id", "f").unionByName(rows.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(f, "gram").select("id", "f"))
    return x.groupBy("id").agg((F.sum("f") / F.count("*") / float(1 << FRACTION)).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The ratio that splits labelled rows (ratio, accepted) with the least mean of the two error rates, from counts in fixed bins; 0 if a class is missing."""
    b = F.least(F.greatest(F.floor((F.col("ratio") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored.groupBy(b.alias("bin"), "accepted").count().collect()  # at most 2 x BINS rows
    n = np.zeros((2, BINS))
    for r in rows:
        n[int(r["accepted"]), r["bin"]] += r["count"]
    if not n.sum(1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, 1)], 1) / n.sum(1, keepdims=True)
    error = below[1] + 1 - below[0]  # accepted below the threshold, rejected at or above it
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] * 8 / BINS - 4)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], held_out: int = 5) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, ratio.

    The models count every URL that a rule decides, save one in `held_out` (by hash of its text), which
    calibrate the threshold. A null URL or one without `://` has an empty host and path and fits no rule; an
    empty text has ratio 0. Counts are kept by whole grams in tables of any size. Where a class has no examples the threshold is 0 and both models fall back to
    what they have. Repeated rows are judged alike; an empty table gives an empty result. Columns other than
    page_id and url are left out.
    """
    host, path = split_url(F.col("url"))
    base = apply_rules(pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url")).withColumns({"host": host, "path": path}), rules)
    base = cut(base.drop("url").withColumn("id", F.monotonically_increasing_id()), "urls")
    text = F.concat("host", "path")
    fold = F.pmod(F.xxhash64(text), F.lit(held_out)) == 0
    counted = F.col("rule_verdict").isNotNull() & ~fold
    kind = F.when(counted, (F.col("rule_verdict") == "allow").cast("int")).otherwise(2)
    grams = cut(url_grams(base.select("id", kind.alias("kind"), text.alias("text"))), "url-grams")
    rows = grams.select("id", "kind", F.explode("grams").alias("gram"))
    ratio = cut(score(rows.select("id", "gram"), weights(rows.select("kind", "gram"))), "ratios")
    scored = base.join(ratio, "id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    limit = calibrate(scored.where(F.col("rule_verdict").isNotNull() & fold).select("ratio", (F.col("rule_verdict") == "allow").alias("accepted")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("ratio") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
