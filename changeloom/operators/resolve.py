"""Which definition a call means: receivers' types through aliases and fields, tiers of nearness, and guesses only within one hierarchy.

Names are looked up by equi-joins: by owner where the receiver's type is known, by module where it names one, and by the name
alone only where few definitions have it, so a common name never meets all of its definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.operators import graph, hunks
from changeloom.sources.tables import settle

ALIAS_STEPS, MOST_DEFINITIONS, LEAST_NAME = 3, 4, 3
# fixed values: wrappers that leave what they hold in view
WRAPPERS = ["Result", "Option", "Optional", "Box", "Rc", "Arc", "Promise", "Awaitable", "Ref", "RefMut"]
# fixed values: methods of built-in containers, strings and promises in Python and JavaScript
BUILTIN = [
    "get", "pop", "popitem", "setdefault", "update", "copy", "clear", "keys", "values", "items", "append", "extend",
    "insert", "remove", "index", "count", "sort", "reverse", "add", "discard", "union", "intersection", "difference",
    "join", "split", "rsplit", "splitlines", "strip", "lstrip", "rstrip", "replace", "format", "startswith", "endswith",
    "lower", "upper", "encode", "decode", "find", "read", "write", "readline", "flush", "seek",
    "push", "shift", "unshift", "map", "filter", "forEach", "reduce", "some", "every", "findIndex", "includes", "indexOf",
    "slice", "splice", "concat", "entries", "set", "has", "delete", "then", "catch", "finally", "toString", "trim",
    "startsWith", "endsWith", "match", "test", "apply", "call", "bind",
]
# fixed values: methods of standard interfaces and traits in other languages
INTERFACE = [
    "String", "Error", "ServeHTTP", "Read", "Write", "Close", "Len", "Less", "Swap", "Unwrap", "Format",
    "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText", "Is", "As", "Seek", "Flush", "Lock", "Unlock",
    "Wait", "Done", "Err", "Value", "Deadline",
    "fmt", "clone", "eq", "ne", "cmp", "partial_cmp", "hash", "from", "into", "try_from", "try_into", "default", "drop",
    "next", "deref", "deref_mut", "as_ref", "as_mut", "borrow", "borrow_mut", "to_string", "to_owned", "write", "read",
    "flush", "len", "is_empty", "iter", "into_iter",
    "toString", "equals", "hashCode", "compareTo", "close",
    "ToString", "Equals", "GetHashCode", "CompareTo", "Dispose", "DisposeAsync", "GetEnumerator", "MoveNext",
]
DYNAMIC = ["python", "typescript", "tsx"]
SELVES = ["self", "this", "Self", "cls"]


def type_name(annotation: Column) -> Column:
    """The type that an annotation names: without references, modules and what stands in its brackets; null where it begins in lower case, as built-in ones do."""
    t = F.regexp_replace(F.trim(annotation), r"^[&*\s]+", "")
    for word in ("mut", "dyn", "impl", "final"):
        t = F.regexp_replace(t, rf"^{word} ", "")
    head = F.regexp_extract(t, r"^([^<>\[\](), ]*)", 1)
    last = C.bare_name(head)
    return F.when(last.rlike(r"^[A-Z]"), last)


def returned_type(annotation: Column) -> Column:
    """The type that a function says it returns, through up to three wrappers (`Result<T, E>`, `Optional[T]`, `T | None`, `(*T, error)`)."""
    t = F.trim(F.regexp_replace(F.trim(annotation), r"^(?:->\s*)?\"?\(?|\"$", ""))
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda p: F.trim(p)), lambda p: ~p.isin("None", "null", "undefined"))
    t = F.coalesce(F.get(parts, F.lit(0)), t)
    for _ in range(3):
        t = F.regexp_replace(t, rf"^(?:[\w.:]*(?:::|\.))?(?:{'|'.join(WRAPPERS)})\s*[<\[]\s*", "")
    return type_name(t)


def _agreed(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, type: null where a key's types disagree."""
    return rows.groupBy(*key).agg(F.min("type").alias("a"), F.max("type").alias("z")).select(*key, F.when(F.col("a") == F.col("z"), F.col("a")).alias("type"))


def unalias(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """rows (change_id, column, ...) with aliases (change_id, alias, type) followed, ALIAS_STEPS of them at most; an alias that is declared in different ways is none."""
    step = _agreed(aliases.where("alias <> type"), ["change_id", "alias"]).where("type IS NOT NULL")
    for _ in range(ALIAS_STEPS):
        rows = rows.join(step.select("change_id", F.col("alias").alias(column), F.col("type").alias("_t")), ["change_id", column], "left").withColumn(column, F.coalesce("_t", column)).drop("_t")
    return rows


def one_hierarchy(guesses: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """The keys (change_id and others) of guesses (key, owner) whose owners are one, or all descend from one among them, by parents (change_id, child, parent). A null owner among several is no type."""
    owners = settle(guesses.select(*key, F.coalesce("owner", F.lit("")).alias("owner")).distinct(), "owners")
    per = owners.groupBy(*key).agg(F.count("*").alias("n"), F.min("owner").alias("least"))
    single = per.where("n = 1").select(*key)
    name = lambda c: F.concat_ws("\x02", F.col("change_id").cast("string"), F.col(c))
    up = graph.descends(parents.select(name("child").alias("child"), name("parent").alias("parent")))
    many = owners.join(per.where("n > 1 AND least <> ''").select(*key, "n"), key)
    pairs = many.withColumn("child", name("owner")).join(up, "child").select(*key, "n", "child", F.col("ancestor").alias("root"))
    roots = many.select(*key, name("owner").alias("root"))
    rooted = pairs.join(roots, [*key, "root"], "left_semi").groupBy(*key, "n", "root").agg(F.countDistinct("child").alias("below"))
    return single.unionByName(rooted.where("below >= n - 1").select(*key).distinct())


def resolve_calls(nodes: DataFrame, calls: DataFrame, binds: DataFrame, fields: DataFrame, aliases: DataFrame, parents: DataFrame, words: DataFrame) -> DataFrame:
    """change_id, src, dst: the functions that each node's calls mean, each pair once.

    nodes (change_id, node, path, language, kind: function, method or class, name, owner, start, end, test), node unique in its change; calls (change_id,
    node, form, qualifier, name): form is none (`f(`), self, named (`x.f(`), field (`self.x.f(`), path (`x::f`) or unknown
    (`g().f(`); binds (change_id, node, var, type, declared); fields (change_id, owner, field, type); aliases (change_id, alias, type);
    parents (change_id, child, parent); words (change_id, path, node, word): the names in each node's text, node null for those of the rest of a file. Types are bare names.

    A receiver of known type, or one that names a type or a module, settles a call, whatever the name. A declared type without
    methods in the change ends it. A method that the caller's own type lacks may be any function of that name. Otherwise a name of LEAST_NAME characters or more with at most MOST_DEFINITIONS candidates is a guess: for a receiver of unknown
    type any function (a method if the receiver is a result), but not for built-in names; for none, free functions, methods of the caller's own type (not in Rust and Go) and constructors
    named like their class. Of several candidates those stay whose type the caller names, then those of its folder, then of its file. A guess
    needs the caller's file to name the callee's module or type, and owners that are one hierarchy. Calls of a class's name mean its constructors. Test functions are never meant; a call to itself, or to what lies in the caller, is none.
    """
    n = settle(nodes.withColumns({"dir": F.regexp_extract("path", r"^(.*)/", 1), "module": C.module_name(F.col("path"))}), "nodes")
    funcs = n.where("kind <> 'class' AND NOT test").select("change_id", F.col("node").alias("dst"), "name", F.col("owner").alias("o"), F.col("module").alias("m"), F.col("path").alias("dst_path"), F.col("dir").alias("dst_dir"))
    me = n.select("change_id", "node", F.col("path").alias("src_path"), F.col("dir").alias("src_dir"), "language", F.when(F.col("kind") == "class", F.col("name")).otherwise(F.col("owner")).alias("mine"))
    owners = funcs.where("o IS NOT NULL").select("change_id", F.col("o").alias("t")).distinct().withColumn("known", F.lit(True))
    c = calls.select("change_id", "node", "form", F.coalesce("qualifier", F.lit("")).alias("q"), "name").distinct().join(me, ["change_id", "node"])
    c = c.withColumn("call", F.struct("form", "q", "name"))

    # the receiver's type: declared, bound, or the caller's own
    var = unalias(_agreed(binds, ["change_id", "node", "var"]).where("type IS NOT NULL"), aliases, "type").select("change_id", "node", F.col("var").alias("q"), F.col("type").alias("bt"))
    declared = binds.where("declared").select("change_id", "node", F.col("var").alias("q")).distinct().withColumn("decl", F.lit(True))
    field = unalias(_agreed(fields, ["change_id", "owner", "field"]).where("type IS NOT NULL"), aliases, "type").select("change_id", F.col("owner").alias("mine"), F.col("field").alias("q"), F.col("type").alias("ft"))
    c = c.join(var, ["change_id", "node", "q"], "left").join(declared, ["change_id", "node", "q"], "left").join(field, ["change_id", "mine", "q"], "left")
    kind = F.when(F.col("form") == "field", F.col("ft")).when(F.col("form").isin("named", "path"), F.col("bt"))
    c = c.withColumn("t", kind).join(owners, ["change_id", "t"], "left").fillna(False, ["known", "decl"])
    leaves = ~F.col("known") & F.col("t").isNotNull() & ((F.col("form") == "field") | ((F.col("form") == "named") & F.col("decl")))
    c = c.where(~leaves).withColumn("bound", F.col("known"))
    c = c.withColumn("by", F.when(F.col("form") == "self", F.col("mine")).when(F.col("bound"), F.col("t")).when(F.col("form").isin("named", "path", "field"), F.col("q")))
    c = settle(c.select("change_id", "node", "form", "q", "name", "call", "src_path", "src_dir", "language", "mine", "bound", "by"), "receivers")

    near = ["change_id", "node", "call"]
    side = ["src_path", "src_dir", "language", "mine", "form", "bound"]
    shape = lambda d, settled: d.select(*near, *side, "dst", "o", "m", "dst_path", "dst_dir", F.lit(settled).alias("settled"))
    owned = shape(c.where("by IS NOT NULL").join(funcs, (c["change_id"] == funcs["change_id"]) & (c["name"] == funcs["name"]) & (c["by"] == funcs["o"])).drop(funcs["change_id"], funcs["name"]), True)
    owned = settle(owned, "owned")
    left = c.join(owned.select(*near).distinct(), near, "left_anti")
    free = funcs.where("o IS NULL")
    housed = shape(left.where("form IN ('named', 'path', 'field')").join(free, (left["change_id"] == free["change_id"]) & (left["name"] == free["name"]) & (left["by"] == free["m"])).drop(free["change_id"], free["name"]), True)
    # a call of a class's name: its constructors
    ctors = funcs.where(F.col("name").isin(C.CONSTRUCTORS) & F.col("o").isNotNull()).select("change_id", F.col("o").alias("name"), "dst", "o", "m", "dst_path", "dst_dir")
    made = shape(c.where("form IN ('none', 'named')").join(ctors, ["change_id", "name"]), False).withColumn("built", F.lit(True))

    plain_left = left.join(housed.select(*near).distinct(), near, "left_anti").where("NOT bound")
    bare = funcs.withColumn("kin", F.col("o").isNull() | (F.col("o") == F.col("name")))
    few = lambda d, key: d.join(d.groupBy("change_id", *key).agg(F.count("*").alias("_c")).where(F.col("_c") <= MOST_DEFINITIONS).select("change_id", *key), ["change_id", *key], "left_semi")
    # unqualified: free ones and constructors are counted with the caller's own methods, which come by owner
    none = c.where("form = 'none'")
    kin = none.join(few(bare.where("kin"), ["name"]), ["change_id", "name"])
    own = none.where(~F.col("language").isin("rust", "go")).join(few(funcs.where("o IS NOT NULL"), ["name", "o"]), (none["change_id"] == funcs["change_id"]) & (none["name"] == funcs["name"]) & (none["mine"] == funcs["o"])).drop(funcs["change_id"], funcs["name"])
    plain = shape(kin, False).unionByName(shape(own, False)).distinct()
    # what is too common among kin, or as a method of the caller's own type, drops the call, even if the other has few
    many = lambda d, key: d.groupBy("change_id", *key).agg(F.count("*").alias("_c")).where(F.col("_c") > MOST_DEFINITIONS).select("change_id", *key)
    plain = plain.withColumns({"name": F.col("call.name"), "_own": F.when(~F.col("language").isin("rust", "go"), F.col("mine"))})
    plain = plain.join(many(bare.where("kin"), ["name"]), ["change_id", "name"], "left_anti")
    plain = plain.join(many(funcs.where("o IS NOT NULL"), ["name", "o"]).withColumnRenamed("o", "_own"), ["change_id", "name", "_own"], "left_anti").drop("name", "_own")
    sizes = plain.groupBy(*near).agg(F.count("*").alias("_c")).where(F.col("_c") <= MOST_DEFINITIONS)
    plain = plain.join(sizes.select(*near), near, "left_semi")
    common = F.when(F.col("language").isin(DYNAMIC), F.col("name").isin(BUILTIN)).otherwise(F.col("name").isin(INTERFACE))
    blind = plain_left.where(F.col("form").isin("named", "field", "unknown") & ~common)
    guess = shape(blind.where("form <> 'unknown'").join(few(funcs, ["name"]), ["change_id", "name"]), False).unionByName(shape(blind.where("form = 'unknown'").join(few(funcs.where("o IS NOT NULL"), ["name"]), ["change_id", "name"]), False))
    # what its own type lacks a caller may have from a parent: any function, by the same tiers, and no guess about types
    inherited = shape(plain_left.where("form = 'self'").join(few(funcs, ["name"]), ["change_id", "name"]), False).withColumn("guessed", F.lit(False))
    guess = guess.withColumn("guessed", F.lit(True)).unionByName(inherited)

    all_ = owned.unionByName(housed).withColumn("built", F.lit(False)).withColumn("guessed", F.lit(False))
    all_ = all_.unionByName(plain.withColumns({"built": F.lit(False), "guessed": F.lit(False)})).unionByName(guess.withColumn("built", F.lit(False)).select(*all_.columns)).unionByName(made.withColumn("guessed", F.lit(False)).select(*all_.columns))
    all_ = all_.where(F.col("settled") | F.col("built") | (F.length("call.name") >= LEAST_NAME))
    refs = words.where("node IS NOT NULL").select("change_id", "node", F.col("word").alias("o")).distinct().withColumn("names_owner", F.lit(True))
    seen = words.select("change_id", F.col("path").alias("src_path"), "word").distinct()
    all_ = all_.join(refs, ["change_id", "node", "o"], "left").join(seen.select("change_id", "src_path", F.col("word").alias("m")).withColumn("sees", F.lit(True)), ["change_id", "src_path", "m"], "left").join(seen.select("change_id", "src_path", F.col("word").alias("o")).withColumn("sees_type", F.lit(True)), ["change_id", "src_path", "o"], "left")
    all_ = settle(all_, "candidates")
    picked = hunks.prefer(all_, [*near, "built"], [F.col("names_owner"), F.col("src_dir") == F.col("dst_dir"), F.col("src_path") == F.col("dst_path")])
    picked = picked.where(F.col("settled") | (F.col("src_path") == F.col("dst_path")) | F.coalesce("sees", "sees_type", F.lit(False)))
    sure = picked.where("NOT guessed")
    unsure = settle(picked.where("guessed"), "guesses")
    kept = one_hierarchy(unsure.select(*near, F.col("o").alias("owner")), parents, near)
    found = sure.unionByName(unsure.join(kept, near, "left_semi")).select("change_id", F.col("node").alias("src"), "dst").where("src <> dst").distinct()
    place = lambda s: n.select("change_id", F.col("node").alias(s), F.col("path").alias(f"{s}_p"), F.col("start").alias(f"{s}_s"), F.col("end").alias(f"{s}_e"))
    within = (F.col("src_p") == F.col("dst_p")) & (F.col("src_s") <= F.col("dst_s")) & (F.col("dst_e") <= F.col("src_e"))
    return found.join(place("src"), ["change_id", "src"]).join(place("dst"), ["change_id", "dst"]).where(~within).select("change_id", "src", "dst")
