"""Old and new versions: pairing, line counts, similarity, alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import text as T
from changeloom.operators import blocks
from changeloom.sources.tables import settle

PART = 64
MOST_CELLS = 4_000_000  # beyond it the middle of a diff is a removed and an added block


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(F.col(key), F.posexplode(T.lines(F.col(text))).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def nontrivial_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, norm of the lines that carry meaning."""
    return explode_lines(df, key, text).select(key, "line_no", T.norm_line(F.col("line")).alias("norm")).where(T.is_nontrivial(F.col("norm")))


def version_pairs(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """a < b, shared: texts with `least` or more different meaningful lines in common, however many texts hold them.

    Null keys are left out, null texts have no lines; rows that repeat a key are one text. The output grows with the square of
    a family's size, since its pairs are what is asked for.
    Texts with equal line sets are one class. Two classes that share `least` lines share one even without the `least` - 1
    commonest of each, so only classes that meet in the rest are compared. Their pairs are pairs of all their members. Lines meet by
    their MD5, of 128 bits, so their texts are not shuffled.
    """
    one = nontrivial_lines(df, key, text).select(F.col(key).alias("k"), F.unhex(F.md5("norm")).alias("norm")).where("k is not null").distinct()
    lines = one.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1")
    lines = settle(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    s = F.sort_array(F.collect_list(F.struct("n", "id")))
    sets = one.join(lines, "norm").groupBy("k").agg(F.transform(s, lambda x: x["id"]).alias("s")).where(F.size("s") >= least)
    sets = settle(sets, "sets")
    classes = settle(sets.groupBy("s").agg(F.min("k").alias("rep"), F.count("*").alias("c")), "classes")
    member = settle(sets.join(classes, "s").select("k", "rep", "c"), "members")

    first = classes.select("rep", F.explode(F.slice("s", F.lit(1), F.size("s") - (least - 1))).alias("id"))
    met = first.select("id", F.col("rep").alias("x")).join(first.select("id", F.col("rep").alias("y")), "id").where("x < y").select("x", "y").distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("s").alias(f"s{x}"))
    shared = met.join(side("x"), "x").join(side("y"), "y").select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("shared")).where(F.col("shared") >= least)
    shared = shared.unionByName(classes.where("c > 1").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.size("s").cast("long").alias("shared")))
    # large classes are cut into parts of some PART members, each of which meets all members of the other side
    parts = F.ceil(F.col("c") / PART)
    left = member.select(F.col("rep").alias("x"), F.col("k").alias("p"), F.pmod(F.xxhash64("k"), parts).alias("part"))
    right = member.select(F.col("rep").alias("y"), F.col("k").alias("q"))
    split = shared.join(classes.select(F.col("rep").alias("x"), parts.alias("parts")), "x").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = split.join(left, ["x", "part"]).join(right, "y").where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")


def line_multiset_diff(df: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """a, b, added, removed, kept lines of each pair (each once), whatever their order. Pairs without any line are left out."""

    def work(texts: list[list[str]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        both, n = blocks.shared_counts(texts, x, y)
        at = np.flatnonzero(n[x] + n[y])
        yield at, [pa.array(c[at]) for c in (n[y] - both, n[x] - both, both)]

    lines = df.select(key, T.lines(F.col(text)).alias("units"))
    return blocks.over_pairs(lines, pairs, key, work, "added long, removed long, kept long")


def token_dice(df: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """a, b, common2 (twice the tokens in common, with their number), total (tokens of both) of each pair (each once): their ratio is the Dice similarity. Pairs without any token are left out."""

    def work(texts: list[list[str]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        both, n = blocks.shared_counts(texts, x, y)
        at = np.flatnonzero(n[x] + n[y])
        yield at, [pa.array(c[at]) for c in (2 * both, n[x] + n[y])]

    words = df.select(key, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), "").alias("units"))
    return blocks.over_pairs(words, pairs, key, work, "common2 long, total long")


def exact_moves(df: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """key, origin, place, origin_place: texts equal but for white space to the first of their kind, which lies in another place. Null and blank texts move nowhere."""
    norm = df.select(F.col(key), F.col(place).alias("place"), T.norm_line(F.coalesce(F.col(text), F.lit(""))).alias("norm")).where("norm <> ''").select(key, "place", F.sha2("norm", 256).alias("h"))
    first = norm.groupBy("h").agg(F.min(F.struct(key, "place")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", F.col(f"f.{key}").alias("origin"), F.col("f.place").alias("origin_place"))
    return norm.join(first, "h").where("place <> origin_place").select(key, "origin", "place", "origin_place")


def match_kth(old: DataFrame, new: DataFrame, group: list[str], order: str) -> DataFrame:
    """group, kth, old_id, new_id: the k-th of a name on one side with the k-th on the other; what has no partner is null there."""
    w = Window.partitionBy(*group).orderBy(order)
    o = old.select(*group, F.row_number().over(w).cast("long").alias("kth"), F.col(order).alias("old_id"))
    n = new.select(*group, F.row_number().over(w).cast("long").alias("kth"), F.col(order).alias("new_id"))
    return o.join(n, [*group, "kth"], "full_outer")


def align(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(kind, old line, new line) in order, lines from 1, 0 where a side has none: a longest common subsequence between the equal ends. Where it is free to choose, removed lines come before added ones."""
    p = 0
    while p < min(len(old), len(new)) and old[p] == new[p]:
        p += 1
    s = 0
    while s < min(len(old), len(new)) - p and old[-1 - s] == new[-1 - s]:
        s += 1
    a, b = old[p : len(old) - s], new[p : len(new) - s]
    out = [("context", i + 1, i + 1) for i in range(p)]
    if len(a) * len(b) > MOST_CELLS:
        out += [("removed", p + i + 1, 0) for i in range(len(a))] + [("added", 0, p + j + 1) for j in range(len(b))]
    else:
        ids: dict[str, int] = {}
        x, y = (np.array([ids.setdefault(t, len(ids)) for t in side], np.int64) for side in (a, b))
        best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a)):  # one row at a time: a match adds to the diagonal, the rest is a running maximum
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(y == x[i], best[i, :-1] + 1, 0)))
        i, j, back = len(a), len(b), []
        while i or j:
            if i and j and x[i - 1] == y[j - 1]:
                back.append(("context", p + i, p + j))
                i, j = i - 1, j - 1
            elif j and (not i or best[i, j - 1] >= best[i - 1, j]):
                back.append(("added", 0, p + j))
                j -= 1
            else:
                back.append(("removed", p + i, 0))
                i -= 1
        out += back[::-1]
    return out + [("context", len(old) - k + 1, len(new) - k + 1) for k in range(s, 0, -1)]


def line_diff(df: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """a, b, seq, kind, old_no, new_no, line of each pair's aligned lines, for keys (long) that stand once in df.

    Between its equal ends a pair of more than MOST_CELLS line combinations is not aligned: its old lines are removed, its new
    ones added, as the interactive tool does. Null texts have no lines; a pair of two empty texts gives no rows.
    """
    kinds = pa.array(["context", "removed", "added"])

    def work(texts: list[list[str]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        lines = pa.array([line for t in texts for line in t], pa.string())
        first = np.cumsum([0, *map(len, texts)])
        for left, part in blocks.by_left(x, y):
            known: dict[int, tuple] = {}
            for places in np.split(part, range(ROWS, len(part), ROWS)):
                at, cols, size = [], [], 0
                for k in places.tolist():
                    right = int(y[k])
                    if right not in known:
                        found = align(texts[left], texts[right])
                        kind, old, new = (np.array(c) for c in zip(*[(CODE[c], i, j) for c, i, j in found], strict=True)) if found else (np.zeros(0, np.int64),) * 3
                        known[right] = (kind, old, new, np.where(old > 0, first[left] + old - 1, first[right] + new - 1))
                    cols.append((np.arange(len(known[right][0])), *known[right]))
                    at.append(np.full(len(known[right][0]), k))
                    size += len(at[-1])
                    if size >= ROWS:
                        yield np.concatenate(at), _rows(cols, kinds, lines)
                        at, cols, size = [], [], 0
                if size:
                    yield np.concatenate(at), _rows(cols, kinds, lines)

    units = df.select(key, T.lines(F.col(text)).alias("units"))
    return blocks.over_pairs(units, pairs, key, work, "seq long, kind string, old_no long, new_no long, line string")


ROWS, CODE = 8192, {"context": 0, "removed": 1, "added": 2}


def _rows(cols: list[tuple], kinds: pa.Array, lines: pa.Array) -> list[pa.Array]:
    seq, kind, old, new, at = (np.concatenate(c) for c in zip(*cols, strict=True))
    return [pa.array(seq), kinds.take(pa.array(kind)), pa.array(old, mask=old == 0), pa.array(new, mask=new == 0), lines.take(pa.array(at))]


# what (?U)\s is to Spark, which Python's \s is not quite
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _mechanical(old: list[str], new: list[str]) -> tuple[int, int]:
    """Changed lines of two texts, and how many of them are mechanical."""
    changed = mechanical = 0
    counts: dict[str, list[int]] = {}

    def close() -> int:
        done = sum(p + m if t == "" else 2 * min(p, m) for t, (p, m) in counts.items())
        counts.clear()
        return done

    for kind, i, j in align(old, new):
        if kind == "context":
            mechanical += close() if counts else 0
            continue
        changed += 1
        counts.setdefault(_WHITE.sub("", old[i - 1] if i else new[j - 1]), [0, 0])[kind == "removed"] += 1
    return changed, mechanical + close()


def pair_stats(df: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """review_stats of line_diff, without its lines: a, b, changed, mechanical, needs_review of each pair (each once) that has a changed line."""

    def work(texts: list[list[str]], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for left, part in blocks.by_left(x, y):
            right, back = np.unique(y[part], return_inverse=True)
            got = np.array([_mechanical(texts[left], texts[r]) if r != left else (0, 0) for r in right.tolist()], np.int64)[back]
            some = np.flatnonzero(got[:, 0])
            changed, mechanical = got[some].T
            yield part[some], [pa.array(c) for c in (changed, mechanical, changed - mechanical)]

    lines = df.select(key, T.lines(F.col(text)).alias("units"))
    return blocks.over_pairs(lines, pairs, key, work, "changed long, mechanical long, needs_review long")


def review_stats(diff: DataFrame) -> DataFrame:
    """a, b, changed, mechanical, needs_review: blank changed lines, and lines that differ in white space only from one on the other side of their block, are mechanical.

    A block is a run of changed lines. Within it equal normal forms pair off one to one.
    """
    w = Window.partitionBy("a", "b").orderBy("seq")
    runs = diff.withColumn("turn", (F.col("kind") == "context").cast("int")).withColumn("block", F.sum("turn").over(w)).where("kind <> 'context'").withColumn("norm", T.norm_line(F.col("line")))
    per = runs.groupBy("a", "b", "block", "norm").agg(F.count_if(F.col("kind") == "added").alias("p"), F.count_if(F.col("kind") == "removed").alias("m"))
    mech = F.when(F.col("norm") == "", F.col("p") + F.col("m")).otherwise(2 * F.least("p", "m"))
    return per.groupBy("a", "b").agg(F.sum(F.col("p") + F.col("m")).alias("changed"), F.sum(mech).alias("mechanical")).withColumn("needs_review", F.col("changed") - F.col("mechanical"))
