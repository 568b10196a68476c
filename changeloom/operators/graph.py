"""Reachability over edge tables, level by level, and reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.sources.tables import settle


def reach(edges: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """node, depth: the least number of steps (at most `most`) from a root (node) along edges (src, dst)."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    e = edges.select("src", "dst").where("src <> dst").distinct()
    front = seen
    for d in range(1, most + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = settle(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d).cast("long")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def changed_callees(edges: DataFrame, changed: DataFrame, tests: DataFrame, most: int = 3) -> DataFrame:
    """root, node, depth: changed nodes that a changed node calls, directly or through at most `most` - 1 unchanged nodes that are no tests.

    A path ends at the first changed node; a node that calls itself through others is left out. Nodes are those of edges (src,
    dst), changed (node) and tests (node).
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    hit, bad = changed.select("node").distinct(), tests.select("node").distinct()
    front = settle(hit.join(e, F.col("node") == F.col("src")).select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).cast("long").alias("depth")), "front")
    seen = front
    for d in range(2, most + 1):
        through = front.join(hit, "node", "left_anti").join(bad, "node", "left_anti")
        step = through.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).where("root <> node").distinct()
        front = settle(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(hit, "node", "left_semi").select("root", "node", "depth")


def test_reach(edges: DataFrame, tests: DataFrame, most: int = 8, origins: int = 3) -> DataFrame:
    """node, depth, origins: how many calls away the nearest tests (node) are, and the first `origins` of those at that distance. Tests themselves are at 0."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    first = lambda d: d.groupBy("node", "depth").agg(F.slice(F.sort_array(F.collect_set("origin")), 1, origins).alias("origins"))
    front = settle(first(tests.select("node", F.lit(0).cast("long").alias("depth"), F.col("node").alias("origin"))), "front")
    seen = front
    for d in range(1, most + 1):
        step = front.select("node", F.explode("origins").alias("origin")).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(d).cast("long").alias("depth"), "origin").distinct()
        front = settle(first(step.join(seen.select("node"), "node", "left_anti")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def test_paths(edges: DataFrame, tests: DataFrame, most: int = 8) -> DataFrame:
    """node, depth, path: for each node that a test reaches, a shortest chain of calls from a test to it, both ends included; of equally short ones the least, compared node by node.

    Each level keeps one parent a node, the one whose own chain is least; chains are unrolled level by level, so a node's row is as long as its depth.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    front = settle(tests.select("node").distinct().select("node", F.lit(0).cast("long").alias("depth"), F.array("node").alias("path")), "front")
    seen = front
    for d in range(1, most + 1):
        step = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        fresh = step.join(seen.select("node"), "node", "left_anti")
        front = settle(fresh.select("node", F.lit(d).cast("long").alias("depth"), F.concat("path", F.array("node")).alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def descends(parents: DataFrame) -> DataFrame:
    """child, ancestor for every chain of parents (child, parent), cycles included; each round is a table, and the rounds are as many as the longest chain has doublings."""
    closed = settle(parents.select("child", F.col("parent").alias("ancestor")).where("child <> parent").distinct(), "closed")
    n = closed.count()
    while n:
        longer = closed.select("child", F.col("ancestor").alias("mid")).join(closed.select(F.col("child").alias("mid"), "ancestor"), "mid").select("child", "ancestor").where("child <> ancestor")
        closed = settle(closed.union(longer).distinct(), "closed")
        more = closed.count()
        if more == n:
            break
        n = more
    return closed


def reading_order(nodes: DataFrame, edges: DataFrame, change: str) -> DataFrame:
    """change, step (from 0), node, depth, repeat: callers before callees, from the nodes that nobody calls and reach most; a node that was shown is not followed again, and what only cycles hold comes last.

    nodes (change, node), edges (change, src, dst); null nodes and edges to what is no node are none. One change's graph comes into one row, and batches of changes go to Python.
    """

    def walk(known: list[int], links: list[dict]) -> Iterator[tuple[int, int, bool]]:
        known.sort()
        out: dict = {n: [] for n in known}
        for a, b in sorted([(x["src"], x["dst"]) for x in links]):
            if a in out and b in out:
                out[a].append(b)

        def reach(n: int) -> int:
            seen, todo = {n}, [n]
            while todo:
                for m in out[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            return len(seen)

        called = {m for v in out.values() for m in v}
        roots = [n for n in known if n not in called]
        if len(roots) > 1:
            roots.sort(key=lambda n: (-reach(n), n))
        seen = set()
        for root in [*roots, *known]:
            if root in seen:
                continue
            todo = [(root, 0)]
            while todo:
                n, depth = todo.pop()
                yield n, depth, n in seen
                if n not in seen:
                    seen.add(n)
                    todo += [(m, depth + 1) for m in reversed(out[n])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, steps = [], []
            for known, links in zip(b.column("known").to_pylist(), b.column("links").to_pylist(), strict=True):
                was = len(steps)
                steps += walk(known, links)
                sizes.append(len(steps) - was)
            at = np.repeat(np.arange(b.num_rows), sizes)
            step = np.arange(len(steps)) - np.repeat(np.cumsum([0, *sizes[:-1]])[: len(sizes)], sizes)
            node, depth, repeat = zip(*steps, strict=True) if steps else ((), (), ())
            yield pa.record_batch([b.column(change).take(pa.array(at)), pa.array(step, pa.int64()), pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(repeat, pa.bool_())], names=[change, "step", "node", "depth", "repeat"])

    link = F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    side = lambda d, node, link: d.select(change, node.alias("node"), link.alias("link"))
    both = side(nodes.where("node IS NOT NULL"), F.col("node").cast("long"), F.when(F.lit(False), F.struct(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))))
    both = both.unionByName(side(edges.where("src <> dst"), F.lit(None).cast("long"), link))
    per = both.groupBy(change).agg(F.collect_set("node").alias("known"), F.collect_set("link").alias("links"))
    return per.mapInArrow(run, f"{change} {nodes.schema[change].dataType.simpleString()}, step long, node long, depth long, repeat boolean")
