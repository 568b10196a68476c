"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word shingles. Equal sets are one class. Similar classes are put into groups;
for each group the union of its members' tokens is stored (only tokens that a qualifying pair must share),
a query's overlap with a group is bounded by it, and only groups whose bound reaches the threshold are opened.

The tokens of a set are ordered with frequent tokens last. If two sets qualify, the first
n - ceil(t n) + 1 tokens of each have one in common, whatever the order, so these stand for the set in the matrix.
Classes that cheap rounds have already linked make up one group's worth of work: a token whose documents
are all in one component opens nothing.

Near copies that do not qualify share nearly all tokens, so tokens tell them apart badly. Those that resemble one head make up
a family and are compared by where they differ from it (`_within`); the matrix leaves out pairs of one family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm import kernel
from changeloom.llm.components import components
from changeloom.llm.shared import cut

U64 = np.uint64
HOT_LEAST, HOT_MOST, GROUP, ROUNDS, BITMAP = 12, 1 << 19, 16, 3, 1024
FAMILY = 50  # percent of likeness to a head from which a class may be one of its family
STARS = 3  # in how many stars of its entries a class is compared by whole sets; the rest meet later if they are still apart
SAMPLED = U64(1 << 62)  # tokens below it, a quarter of all, are all counted: prefixes of texts with enough rare tokens hardly reach beyond
HELD = 1 << 20  # of the others those are counted that repeat among so many tokens of a task, as those of large families do


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each document, A-Z lower-cased; of all its words if they are fewer; none without words."""
    w = kernel.Words(data, offsets, lower=True)
    g = kernel.grams(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([kernel.sequence_hash(w.hash[a:b])], U64) if b > a else np.zeros(0, U64))
    return out


def _each(docs: DataFrame, k: int, make, ddl: str) -> DataFrame:
    """make(ids, sets) gives the columns of a record batch for a run of documents (doc_id, text)."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in kernel.slices(b.column(1)):
                yield pa.record_batch(make(b.column(0).slice(i, j - i), shingle_sets(data, off, k)), names=names)

    return docs.mapInArrow(run, ddl)


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, U64)


def hot_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent tokens, HOT_MOST at most, sorted. All documents are counted; the bound only shapes the token order, never the result."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(_flat(held))
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        n, x = np.diff(np.append(start, len(x))), x[start]
        keep = (n > 1) | (x < SAMPLED)
        return pa.record_batch([pa.array(x[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, _, data, off in kernel.slices(b.column(1)):
                held += shingle_sets(data, off, k)
                size += len(off) + sum(map(len, held[1 - len(off) :]))
                if size > HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    counts = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count")).where(F.col("count") >= HOT_LEAST)
    counts = cut(counts.withColumn("bin", F.floor(F.log2("count") * 4).cast("int")), "df")
    bins = sorted(((r["bin"], r["count"]) for r in counts.groupBy("bin").count().collect()), reverse=True)  # some 200 rows
    least, total = None, 0
    for b, n in bins:
        if total + n > HOT_MOST:
            break
        least, total = b, total + n
    if least is None:
        return np.zeros(0, U64)
    return np.sort(counts.where(F.col("bin") >= least).select("token").toArrow()["token"].to_numpy().view(U64))


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of documents (doc_id, text): sets of k-word shingles link when 100 x intersection >= percent x union.

    class_id is the least doc_id with the same set, component_id the least that links reach. A text without words, or
    null, has no shingles and stands alone. Rows that repeat a doc_id are judged each. An empty table gives an empty
    result; other columns are ignored. Tokens are 64-bit hashes.
    """
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    hot = docs.sparkSession.sparkContext.broadcast(hot_tokens(base.select(F.lit(0).cast("long"), "text"), k))  # 4 MB at most

    def rows(ids, sets):
        n = np.array([len(s) for s in sets], np.int64)
        prefix, low, sums = [], np.zeros((len(sets), ROUNDS), np.int64), np.zeros((len(sets), 2), np.int64)
        last = np.zeros(len(sets), np.int64)
        for i, s in enumerate(sets):
            if not len(s):
                prefix.append(s)
                continue
            p = len(s) + (-percent * len(s)) // 100 + 1
            h = hot.value
            take = s[: 2 * p + 8]
            while True:
                cold = take[h[np.minimum(np.searchsorted(h, take), len(h) - 1)] != take] if len(h) else take
                if len(cold) >= p or len(take) == len(s):
                    break
                take = s[: 2 * len(take)]
            prefix.append(cold[:p] if len(cold) >= p else np.concatenate([cold, np.setdiff1d(s, cold)[: p - len(cold)]]))
            last[i] = (int(len(cold) < p) << 62) + (int(prefix[i][-1]) >> 2)
            m = kernel.mix(s ^ U64(0x5851F42D4C957F2D))
            low[i, 0] = s[:1].view(np.int64)[0]
            low[i, 1], low[i, 2] = np.min(m).view(np.int64), np.min(m[: len(m)] * U64(0xDA942042E4DD58B5)).view(np.int64)
            sums[i] = np.sum(m, dtype=U64).view(np.int64), np.sum(kernel.mix(m), dtype=U64).view(np.int64)
        return [ids, pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), kernel.ragged(_flat(prefix).view(np.int64), np.array([len(p) for p in prefix]), pa.int64()), kernel.ragged(low.ravel(), np.full(len(sets), ROUNDS), pa.int64()), pa.array(last)]

    sets = cut(_each(base, k, rows, "doc_id long, n long, d1 long, d2 long, prefix array<long>, low array<long>, last long"), "sets")
    some = sets.where("n > 0")
    names = cut(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "names")
    one = names.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep")
    classes = some.join(one, (F.col("doc_id") == F.col("rep")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("d1", "d2", "n", "rep", "prefix", "low", "last")
    comp = _components_of(base, classes, k, percent)
    known = names.select("d1", "d2", F.col("n").alias("m"), "rep").join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", "m", "rep", F.coalesce("comp", "rep").alias("comp"))
    known = cut(known, "known")
    out = sets.select("doc_id", "n", "d1", "d2").join(known.withColumnsRenamed({"d1": "e1", "d2": "e2"}), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("comp", "doc_id").alias("component_id"))


def _full_sets(base: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, size, bits, tokens of the whole sets of the given documents, computed again from their texts; rows that repeat a doc_id give several.

    bits is the parity of the tokens in each of BITMAP cells: two sets of which d cells differ share at most (na + nb - d) / 2 tokens.
    """

    def rows(ids, sets):
        n = [len(s) for s in sets]
        bits = np.zeros((len(sets), BITMAP), np.uint8)
        for i, s in enumerate(sets):
            bits[i] = np.bincount((s & U64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
        packed = np.packbits(bits, axis=1).view(np.int64).ravel()
        return [ids, pa.array(n, pa.int64()), kernel.ragged(packed, np.full(len(sets), BITMAP // 64), pa.int64()), kernel.ragged(_flat(sets).view(np.int64), np.array(n, np.int64), pa.int64())]

    wanted = base.join(ids, F.col("doc_id") == F.col("want"), "left_semi")
    return cut(_each(wanted, k, rows, "id long, size long, bits array<long>, tokens array<long>"), "full")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb, ...) that qualify, by their whole sets, with how many tokens are in both; those that the bitmaps rule out never meet."""
    side = lambda x: full.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    differ = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = (F.col("na") + F.col("nb") - differ) / 2
    pairs = pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"]).where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).drop("ba", "bb")
    pairs = cut(pairs.distinct(), "near")
    left = full.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("ta"))
    right = full.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, ["a", "na"]).join(right, ["b", "nb"]).withColumn("both", F.size(F.array_intersect("ta", "tb")).cast("long")).drop("ta", "tb")
    return both.where(_reaches(F.col("both"), F.col("na"), F.col("nb"), percent))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (percent * a <= 100 * b) & (percent * b <= 100 * a)


def _enough(met: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b tokens whose first n - ceil(t n) + 1 tokens share `met` may qualify.

    All that they share beyond those tokens lies among the ceil(t n) - 1 last of one of them, and they must share t (a + b) / (1 + t).
    """
    return (100 + percent) * (100 * met + percent * F.greatest(a, b)) > 100 * percent * (a + b)


def _reaches(most: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b tokens that share `most` tokens at most may qualify."""
    return (100 + percent) * most >= percent * (a + b)


def _families(near: DataFrame, full: DataFrame, level: int) -> DataFrame:
    """rep, size, head, width, both: one head for each class of the pairs (a, na, b, nb, both) of classes and heads, that with most of them.

    A class whose head has a larger one itself goes over to that if it resembles it. An id with several sets has no family.
    """
    single = full.groupBy("id").agg(F.count("*").alias("c")).where("c = 1").select("id")
    near = cut(near.select("a", "na", "b", "nb", "both").join(single, F.col("a") == F.col("id"), "left_semi").join(single, F.col("b") == F.col("id"), "left_semi"), "like")
    heads = near.groupBy("b", "nb").agg(F.count("*").alias("m"))
    to = near.join(heads, ["b", "nb"]).select("a", "na", "b", "nb", "both", "m").union(heads.select("b", "nb", "b", "nb", "nb", "m"))
    to = cut(to.groupBy("a", "na").agg(F.max(F.struct("m", "b", "nb", "both")).alias("f")).select("a", "na", "f.b", "f.nb", "f.both"), "heads")
    over = to.select(F.col("a").alias("h"), F.col("b").alias("q"), F.col("nb").alias("nq")).where("h <> q")
    moved = to.select("a", "na", F.col("b").alias("h")).join(over, "h").where("a <> q").select("a", "na", F.col("q").alias("b"), F.col("nq").alias("nb"))
    moved = _verified(moved, full, level).select("a", F.struct("b", "nb", "both").alias("new"))
    f = F.coalesce("new", F.struct("b", "nb", "both"))
    return cut(to.join(moved, "a", "left").select("a", "na", f.alias("f")).select(F.col("a").alias("rep"), F.col("na").alias("size"), F.col("f.b").alias("head"), F.col("f.nb").alias("width"), F.col("f.both").alias("both")), "families")


def _within(family: DataFrame, one: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: the links `one`, and those that join their components in each family wherever pairs of it qualify.

    Let d be what a set has and its family's centre lacks, or the other way round. Two sets of x common entries of d share
    (na + nb - |da| - |db|) / 2 + x tokens, whatever the centre, so they qualify if gain a + gain b + 2 (100 + percent) x >= 0, with
    gain = (100 + percent) (n - |d|) - 2 percent n. The centre is the head with those tokens turned round in which more than half of
    its family differ from it; else all of them would share the lack of what the head alone has.

    If two need no x, neither needs one with the set of largest gain: all such are linked with that one. Each is also compared
    with the set of largest gain among those with one of its entries. So what qualifies in great numbers is joined by stars first.
    The components that are left meet by entries in an order with frequent ones last; room is how many entries
    from this one on other components have too, so the first common entry tells how large x may be.
    """
    tokens = lambda x, n, t: full.select(F.col("id").alias(x), F.col("size").alias(n), F.col("tokens").alias(t))
    differ = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    reach = lambda x: 2 * (100 + percent) * x
    of = lambda comp: F.coalesce(comp["comp"], F.col("rep")).alias("comp")
    comp = components(one)
    who = cut(family.join(comp, F.col("rep") == F.col("node"), "left").select("rep", "size", "head", "width", of(comp)), "who")
    several = who.groupBy("head", "width").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x < y")
    heads = cut(several.select("head", "width", "m").join(tokens("head", "width", "h"), ["head", "width"]), "heads")
    who = who.join(tokens("rep", "size", "t"), ["rep", "size"])
    turned = who.join(heads, ["head", "width"]).select("head", "m", F.explode(differ("t", "h")).alias("entry")).groupBy("head", "m", "entry").agg(F.count("*").alias("c")).where("2 * c > m")
    turned = turned.groupBy("head").agg(F.collect_list("entry").alias("turned"))  # no more than twice what one of the family differs by on average
    centre = heads.join(turned, "head", "left").select("head", F.when(F.col("turned").isNull(), F.col("h")).otherwise(differ("h", "turned")).alias("centre"))
    who = who.join(cut(centre, "centre"), "head").select("rep", "size", "head", "comp", differ("t", "centre").alias("d"))
    who = cut(who.withColumn("gain", (100 + percent) * (F.col("size") - F.size("d")) - 2 * percent * F.col("size")), "gains")

    best = who.groupBy("head").agg(F.max(F.struct("gain", "rep")).alias("m"))
    sure = who.join(best, "head").where((F.col("gain") + F.col("m.gain") >= 0) & (F.col("rep") != F.col("m.rep"))).select(F.col("rep").alias("a"), F.col("m.rep").alias("b"))
    entries = cut(who.select("rep", "size", "head", "comp", "gain", F.explode("d").alias("entry")), "differences")
    stars = entries.groupBy("head", "entry").agg(F.max(F.struct("gain", "rep", "size", "comp")).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("head", "entry", "m")
    # x: in how many entries it has met that one, at least; most: how many there may be
    stars = entries.join(stars, ["head", "entry"]).groupBy("rep", "size", "comp", "gain", "m").agg(F.count("*").alias("x"))
    mine = Window.partitionBy("rep")
    stars = stars.withColumn("most", F.sum("x").over(mine)).where("comp <> m.comp and rep <> m.rep").withColumn("rank", F.row_number().over(mine.orderBy(F.desc("x"), F.desc("m"))))
    stars = cut(stars.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("m.rep").alias("b"), F.col("m.size").alias("nb"), (F.col("gain") + F.col("m.gain")).alias("gain"), "x", "most", "rank"), "entry-stars")
    likely = stars.where((reach(F.col("x")) + F.col("gain") < 0) & (reach(F.col("most")) + F.col("gain") >= 0) & (F.col("rank") <= STARS)).select("a", "na", "b", "nb")
    one = one.union(sure).union(stars.where(reach(F.col("x")) + F.col("gain") >= 0).select("a", "b")).union(_verified(likely, full, percent).select("a", "b"))
    one = cut(one, "star-links")

    comp = components(one)
    who = cut(who.drop("comp").join(comp, F.col("rep") == F.col("node"), "left").select("rep", "size", "head", "gain", "d", of(comp)), "who")
    # the largest gain of another component, for each component of a family
    tops = who.groupBy("head", "comp").agg(F.max("gain").alias("top"))
    first = tops.groupBy("head").agg(F.max(F.struct("top", "comp")).alias("f"))
    second = tops.join(first, "head").where(F.col("comp") != F.col("f.comp")).groupBy("head", "f").agg(F.max("top").alias("second"))
    top = F.when(F.col("comp") == F.col("f.comp"), F.col("second")).otherwise(F.col("f.top")).alias("top")
    entries = cut(who.join(second, "head").select("rep", "size", "head", "gain", "comp", top, F.explode("d").alias("entry")), "entries")
    known = entries.groupBy("head", "entry").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("head", "entry", "c")
    room = F.row_number().over(Window.partitionBy("head", "rep").orderBy(F.desc("c"), F.desc("entry")))
    entries = entries.join(known, ["head", "entry"]).withColumn("room", room).where(reach(F.col("room")) + F.col("gain") + F.col("top") >= 0)
    entries = cut(entries.select("rep", "size", "head", "gain", "comp", "entry", "room"), "rooms")
    other = entries.withColumnsRenamed({"rep": "b", "size": "nb", "head": "h", "gain": "gb", "comp": "cb", "entry": "e", "room": "rb"})
    fits = (F.col("comp") < F.col("cb")) & (reach(F.least("room", "rb")) + F.col("gain") + F.col("gb") >= 0)
    pairs = entries.join(other, (F.col("head") == F.col("h")) & (F.col("entry") == F.col("e")) & fits).select(F.col("rep").alias("a"), F.col("size").alias("na"), "b", "nb")
    return one.union(_verified(cut(pairs.distinct(), "inner"), full, percent).select("a", "b"))


def _components_of(base: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, comp of the classes that have links."""
    # cheap rounds: those that share a least hash are each compared with the first of them
    keys = classes.select("rep", "n", F.posexplode("low").alias("round", "key"))
    first = keys.groupBy("round", "key").agg(F.min(F.struct("rep", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("round", "key", F.col("f.rep").alias("b"), F.col("f.n").alias("nb"))
    stars = keys.join(first, ["round", "key"]).where("rep <> b").select(F.col("rep").alias("a"), F.col("n").alias("na"), "b", "nb")
    stars = cut(stars.where(_sizes_fit(F.col("na"), F.col("nb"), percent)).distinct(), "stars")
    ids = lambda p: p.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    full = _full_sets(base, cut(ids(stars), "ids"), k)
    level = min(FAMILY, percent)
    near = cut(_verified(stars, full, level), "alike")
    family = _families(near, full, level)
    one = near.where(_reaches(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    one = cut(_within(family, cut(one, "alike-links"), full, percent), "links")
    comp = cut(components(one), "comp")

    # the matrix: tokens of those that must share one, by group; tokens within one component open nothing
    sizes = comp.groupBy("comp").agg(F.count("*").alias("c"))
    where = cut(comp.join(sizes, "comp").select("node", "comp", "c", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / GROUP)).alias("bucket")), "where")
    band = F.when(F.col("c") > GROUP, F.floor(F.log("n") * 50) * (1 << 40) + F.col("bucket")).otherwise(0)  # sizes within 2 percent
    member = classes.select("rep", "n", "last", "prefix").join(where, F.col("rep") == F.col("node"), "left").join(family.select("rep", "head"), "rep", "left")
    member = member.select("rep", "n", "last", F.coalesce("comp", "rep").alias("comp"), F.coalesce("c", F.lit(1)).alias("c"), band.alias("bucket"), F.coalesce("head", "rep").alias("head"), "prefix")
    several = member.select(F.explode("prefix").alias("token"), "comp", "head").groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("head").alias("u"), F.max("head").alias("v"))
    several = cut(several.where("x < y and u < v").select("token"), "several")
    # tokens travel with no more than whose they are; the rest is joined to those that are left
    kept = cut(classes.select(F.explode("prefix").alias("token"), "rep", "n").join(several, "token"), "kept")
    # those of its first tokens that no other component and family has among its own are lost to its pairs with sets whose first tokens go as
    # far in the order (last is where they end): reach is the most that it can share with such a set
    firsts = F.col("n") - F.expr(f"cast(ceil({percent} * n / 100.0) as long)") + 1
    held = kept.groupBy("rep", "n").agg(F.count("*").alias("held"))
    own = member.drop("prefix").join(held, ["rep", "n"]).withColumn("reach", F.col("n") - F.greatest(firsts - F.col("held"), F.lit(0))).drop("held")
    shared = cut(kept.join(own, ["rep", "n"]), "shared")
    union = shared.groupBy("token", "comp", "c", "bucket", "head").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("gr"), F.min("last").alias("gl"), F.max("last").alias("gm"))
    group = union.select(F.col("token").alias("t"), F.col("comp").alias("gc"), F.col("c").alias("gn"), F.col("bucket").alias("gb"), F.col("head").alias("gh"), "least", "most", "gr", "gl", "gm")
    smaller = (F.struct("c", "comp") < F.struct(F.col("gn"), F.col("gc"))) & (F.col("head") != F.col("gh"))
    fits = (percent * F.col("n") <= 100 * F.col("most")) & (percent * F.col("least") <= 100 * F.col("n"))
    # the bound: how many of its first n - ceil(t n) + 1 tokens a query has in a group's union
    reaches = (F.col("last") <= F.col("gm")) & _reaches(F.col("reach"), F.col("n"), F.col("least"), percent) | (F.col("gl") <= F.col("last")) & _reaches(F.col("gr"), F.col("n"), F.col("least"), percent)
    met = shared.join(group, (F.col("token") == F.col("t")) & smaller & fits & reaches).groupBy("rep", "n", "reach", "last", "comp", "gc", "gb", "gh").agg(F.count("*").alias("met"), F.min("least").alias("least"), F.max("most").alias("most"))
    low, high = F.greatest("least", F.expr(f"cast(ceil({percent} * n / 100.0) as long)")), F.least("most", F.expr(f"cast(floor(100 * n / {percent}.0) as long)"))
    opened = cut(met.where(_enough(F.col("met"), F.col("n"), low, percent) | _enough(F.col("met"), F.col("n"), high, percent)).select("rep", "n", "reach", "last", "comp", "gc", "gb", "gh"), "opened")
    # a group is opened at its head first; the rest meet only those whose component that did not join
    place = F.row_number().over(Window.partitionBy("gc", "gb", "gh").orderBy("b", "nb"))
    inside = shared.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"), F.col("last").alias("lb"), F.col("comp").alias("gc"), F.col("bucket").alias("gb"), F.col("head").alias("gh")).distinct()
    inside = cut(inside.withColumn("first", place == 1), "inside")

    def joins(opened: DataFrame, members: DataFrame) -> DataFrame:
        reaches = _reaches(F.when(F.col("last") < F.col("lb"), F.col("reach")).when(F.col("lb") < F.col("last"), F.col("rb")).otherwise(F.greatest("reach", "rb")), F.col("na"), F.col("nb"), percent)
        pairs = opened.select(F.col("rep").alias("a"), F.col("n").alias("na"), "reach", "last", "comp", "gc", "gb", "gh").join(members.drop("first"), ["gc", "gb", "gh"]).where(_sizes_fit(F.col("na"), F.col("nb"), percent) & reaches)
        pairs = cut(pairs.select("a", "na", "b", "nb", "comp", "gc"), "pairs")
        found = _verified(pairs, _full_sets(base, cut(ids(pairs), "ids"), k), percent)
        return cut(found.select(F.col("comp").alias("a"), F.col("gc").alias("b")).distinct(), "joins")

    by_head = joins(opened, inside.where("first"))
    label = components(by_head)
    of = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"new_{x}"))
    apart = opened.join(of("comp"), "comp", "left").join(of("gc"), "gc", "left").where(F.coalesce("new_comp", "comp") != F.coalesce("new_gc", "gc"))
    by_rest = joins(apart, inside.where("not first"))
    joined = components(by_head.union(by_rest)).withColumnsRenamed({"node": "old", "comp": "new"})
    both = comp.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("comp"))).distinct()
    return both.join(joined, F.col("comp") == F.col("old"), "left").groupBy("node").agg(F.min(F.coalesce("new", "comp")).alias("comp"))
