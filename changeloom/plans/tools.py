"""Queries of numbering, credit, seeded orders, saved results, includes and call chains, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import lexer, seeded
from changeloom.operators import credit, enrich, graph, includes, numbering, resolve
from changeloom.sinks import store
from changeloom.sources.tables import read, scratch


def entry_numbers(spark, d):
    """Every event's number over all events, by type, user and id."""
    e = read(spark, d, "events").select("event_type", "user_id", "event_id")
    return numbering.number_rows(e, [F.col("event_type"), F.col("user_id"), F.col("event_id")]).select("event_id", F.col("id").alias("number"))


def decision_credit(spark, d):
    """Events as a trace: views are a person's. Each event is also a decision that names an event a few places from it."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    trace = e.select("user_id", F.col("event_id").alias("n"), F.when(F.col("event_type") == "view", "user").otherwise("agent").alias("who"))
    who = F.element_at(F.array(*map(F.lit, ["you", "approved", "agent", "unseen"])), (F.col("k") % 4 + 1).cast("int"))
    decisions = e.select("user_id", F.col("event_id").alias("id"), who.alias("who"), (F.col("event_id") + F.col("k") % 3 - 1).alias("event"))
    return credit.repair_credit(decisions, trace, ["user_id"]).select("user_id", "id", "who", "at_event")


def seeded_orders(spark, d):
    """A hash of each page's address and number, and the order in which the address shuffles up to five choices."""
    p = read(spark, d, "pages").select("page_id", "url")
    n = (F.col("page_id") % 4 + 2).cast("int")
    order = F.array_join(F.transform(seeded.shuffled(n, F.coalesce("url", F.lit(""))), lambda x: x.cast("string")), " ")
    return p.select("page_id", seeded.fnv_hex([F.col("url"), F.col("page_id").cast("string")]).alias("key"), order.alias("shuffled"))


def saved_results(spark, d):
    """Each user's events saved by type in two parts, the second one twice; then what is kept."""
    e = read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("long").alias("at"), "props")
    rows = e.select("kind", "key", "at", F.col("props").alias("value"))
    path = scratch(spark, "saved")
    for part in (rows.where("at % 3 = 0"), rows.where("at % 3 <> 0"), rows.where("at % 3 <> 0")):
        store.save(part, path)
    return store.load(spark, path).select("kind", "key", "at")


def compiled_files(spark, d):
    """Suppliers' parts as files: each includes a header named by its supplier, and a header another one or a source by its part."""
    x = read(spark, d, "lineitem").select(F.concat(F.lit("src/f"), (F.col("l_partkey") % 97).cast("string"), F.when(F.col("l_returnflag") == "A", ".c").otherwise(".h")).alias("path"), F.concat(F.lit('#include "../src/f'), (F.col("l_suppkey") % 97).cast("string"), F.when(F.col("l_linestatus") == "F", '.c"').otherwise('.h"')).alias("line")).distinct()
    return includes.compiled_in(includes.include_table(x))


def call_chains(spark, d):
    """A shortest chain of calls from a test to each function: events call the next one's value; values below 8 are tests."""
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("k").alias("dst"))
    edges = e.withColumnRenamed("k", "src").join(after, "event_id").where("abs(src - dst) <= 12 AND src <> dst").select("src", "dst").distinct()
    tests = edges.select(F.col("src").alias("node")).where("node < 8").distinct()
    return graph.test_paths(edges, tests, 5).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("chain"))


def resolved_calls(spark, d):
    """An order as a change: each of its lines is a method of one of five classes in one of three files, and calls a method of another line through a variable of a declared type, bare, by its own type or on a result."""
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).distinct()
    x = numbering.number_rows(x, [F.col("change_id"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("q")], "node")
    text = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    nodes = x.select("change_id", "node", F.concat(text("d", "l_suppkey", 2), F.lit("/"), text("mod", "l_partkey", 3), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.when(F.col("q") % 5 == 0, "function").otherwise("method").alias("kind"), text("meth", "l_partkey", 4).alias("name"), F.when(F.col("q") % 5 > 0, text("Type", "l_suppkey", 3)).alias("owner"), (F.col("node") * 10).alias("start"), (F.col("node") * 10 + 5).alias("end"), F.lit(False).alias("test"))
    form = F.element_at(F.array(*map(F.lit, ["none", "self", "named", "unknown"])), (F.col("q") % 4 + 1).cast("int"))
    calls = x.select("change_id", "node", form.alias("form"), F.when(F.col("q") % 4 == 2, "v").otherwise("").alias("qualifier"), text("meth", "l_suppkey", 4).alias("name"))
    # the variable's type is an alias for a class for some, the class itself for others
    binds = x.select("change_id", "node", F.lit("v").alias("var"), F.when(F.col("q") % 3 == 0, text("Alias", "l_partkey", 3)).otherwise(text("Type", "l_partkey", 3)).alias("type"), F.lit(True).alias("declared"))
    ids = x.select("change_id").distinct()
    aliases = ids.select("change_id", F.explode(F.array(*[F.struct(F.lit(f"Alias{i}").alias("alias"), F.lit(f"Type{(i + 1) % 3}").alias("type")) for i in range(3)])).alias("a")).select("change_id", "a.*")
    parents = ids.where("change_id % 2 = 0").select("change_id", F.explode(F.array(*[F.struct(F.lit(f"Type{i}").alias("child"), F.lit("Type0").alias("parent")) for i in (1, 2)])).alias("p")).select("change_id", "p.*")
    words = nodes.select("change_id", "path", F.lit(None).cast("long").alias("node"), F.explode(F.array(*[F.lit(f"mod{i}") for i in range(3)])).alias("word"))
    fields = ids.select("change_id", F.lit("Type9").alias("owner"), F.lit("f").alias("field"), F.lit("Type9").alias("type"))
    return resolve.resolve_calls(nodes, calls, binds, fields, aliases, parents, words)


def whole_json(spark, d):
    """Replies with an object that holds braces in its texts, behind words and before other braces: the object's values."""
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    reply = F.concat(F.lit("Sure: "), F.lit('{"a": {"k": '), "k", F.lit('}, "t": "} \\"'), "event_type", F.lit('{"} and then {y} ```json {"a": 1}```'))
    found = e.select("event_id", C.whole_json(reply).alias("j"), C.whole_json(F.concat(F.lit("{"), reply)).alias("open"))
    return found.select("event_id", F.get_json_object("j", "$.a.k").cast("long").alias("k"), F.get_json_object("j", "$.t").alias("t"), F.col("open").isNull().alias("open"))


USES = ["fnN(x)", "obj.fnN(x)", "mod.fnN(x)", '"fnN" # fnN']


def repo_references(spark, d):
    """Orders as a repository's files, with a use of a name for each of their lines; every seventh name vanished in one change, and those that a file still defines are nobody's."""
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    use = F.replace(F.element_at(F.array(*map(F.lit, USES)), (F.col("l_partkey") % 4 + 1).cast("int")), F.lit("N"), (F.col("l_suppkey") % 97).cast("string"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", use.alias("u")))), lambda y: y["u"]), "\n")
    path = F.concat(F.when(F.col("l_orderkey") % 5 == 0, "docs/f").otherwise("src/f"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 5 == 0, ".md").otherwise(".py"))
    files = x.groupBy("l_orderkey").agg(text.alias("source")).select(path.alias("path"), "source")
    defined = x.where("l_suppkey % 97 % 10 = 3").select(F.lit("src/defs.py").alias("path"), F.concat(F.lit("def fn"), (F.col("l_suppkey") % 97).cast("string"), F.lit("(a):")).alias("source")).distinct()
    files = files.unionByName(defined.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("source")), "\n").alias("source"))).withColumn("language", F.lit("python"))
    lines = lexer.line_facts(files, ["path"]).select(F.lit("r").alias("repo"), "path", F.col("line_no").alias("line"), "code", F.col("line").alias("text"))
    n = x.select((F.col("l_suppkey") % 97).alias("n")).distinct()
    vanished = n.select((F.col("n") % 7).cast("long").alias("change_id"), F.lit("r").alias("repo"), F.concat(F.lit("fn"), F.col("n").cast("string")).alias("name"), F.lit("lib/mod.py").alias("origin"), F.lit(True).alias("exported"))
    changed = x.where("l_orderkey % 3 = 0").select(F.lit(1).cast("long").alias("change_id"), path.alias("path")).distinct()
    return enrich.repo_references(vanished, changed, lines).select("change_id", "name", "path", "line")


QUERIES = {f.__name__: f for f in (entry_numbers, decision_credit, seeded_orders, saved_results, compiled_files, call_chains, resolved_calls, whole_json, repo_references)}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_HASH = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform({0}, lambda y: y::UHUGEINT)), lambda h, y: (xor(h, y) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i - 1, 2) AS INTEGER))"
# one place after the other, from the fifth down: the number is rolled on, and the place changes with one up to it
_ROUNDS = ",\n".join(f"""a{i} AS (SELECT page_id, n, o, CASE WHEN {i} < n THEN xor(s, (s * 8192) % 18446744073709551616::UHUGEINT) ELSE s END AS s FROM z{i + 1}),
b{i} AS (SELECT page_id, n, o, CASE WHEN {i} < n THEN xor(s, s // 128) ELSE s END AS s FROM a{i}),
c{i} AS (SELECT page_id, n, o, CASE WHEN {i} < n THEN xor(s, (s * 131072) % 18446744073709551616::UHUGEINT) ELSE s END AS s FROM b{i}),
z{i} AS (SELECT page_id, n, s, CASE WHEN {i} < n THEN list_transform(range(0, n), lambda k: CASE WHEN k = {i} THEN o[CAST(s % {i + 1} AS BIGINT) + 1] WHEN k = CAST(s % {i + 1} AS BIGINT) THEN o[{i + 1}] ELSE o[k + 1] END) ELSE o END AS o FROM c{i})""" for i in (4, 3, 2, 1))
ORACLE = {
    "repo_references": """WITH x AS (SELECT l_orderkey AS o, l_partkey % 4 AS t, l_suppkey % 97 AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem),
u AS (SELECT n % 7 AS c, 'fn' || n AS name, 'src/f' || o || '.py' AS path, line FROM x WHERE o % 5 <> 0 AND t IN (0, 2) AND n % 10 <> 3 AND NOT (n % 7 = 1 AND o % 3 = 0))
SELECT CAST(c AS BIGINT) AS change_id, name, path, line FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line) <= 10""",
    "whole_json": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '} "' || event_type || '{' AS t, true AS open FROM events""",
    "seeded_orders": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, CAST(page_id % 4 + 2 AS BIGINT) AS n FROM pages),
z5 AS (SELECT page_id, n, range(0, n) AS o, {_HASH.format(_BYTES.format('u'))} AS s FROM p), {_ROUNDS},
k AS (SELECT page_id, {_HASH.format("list_concat(" + _BYTES.format('u') + ", [255], " + _BYTES.format('CAST(page_id AS VARCHAR)') + ", [255])")} AS h FROM p)
SELECT page_id, lower(lpad(hex(CAST(h AS UBIGINT)), 16, '0')) AS key, array_to_string(o, ' ') AS shuffled FROM z1 JOIN k USING (page_id)""",
    "entry_numbers": "SELECT event_id, row_number() OVER (ORDER BY event_type, user_id, event_id) AS number FROM events",
    "decision_credit": f"""WITH e AS (SELECT user_id, event_id AS n, event_type = 'view' AS mine, {_K} AS k FROM events),
d AS (SELECT user_id, n AS id, CASE k % 4 WHEN 0 THEN 'you' WHEN 1 THEN 'approved' ELSE 'agent' END AS who, n + k % 3 - 1 AS event FROM e),
u AS (SELECT user_id, n AS said FROM e WHERE mine),
x AS (SELECT d.*, t.mine, b.said AS before FROM d LEFT JOIN e t ON t.user_id = d.user_id AND t.n = d.event ASOF LEFT JOIN u b ON b.user_id = d.user_id AND b.said < d.event),
y AS (SELECT x.*, a.said AS after FROM x ASOF LEFT JOIN u a ON a.user_id = x.user_id AND a.said > x.event)
SELECT user_id, id, CASE WHEN who = 'agent' OR mine IS NULL OR mine THEN who WHEN who = 'you' AND before IS NOT NULL THEN 'you' WHEN after IS NOT NULL THEN 'approved' ELSE 'agent' END AS who,
CASE WHEN who = 'agent' OR mine IS NULL OR mine THEN event WHEN who = 'you' AND before IS NOT NULL THEN before WHEN after IS NOT NULL THEN after ELSE event END AS at_event FROM y""",
    "saved_results": """SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS BIGINT) AS at FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) <= 50""",
    "compiled_files": """WITH RECURSIVE x AS (SELECT DISTINCT 'src/f' || l_partkey % 97 || CASE l_returnflag WHEN 'A' THEN '.c' ELSE '.h' END AS path, 'src/f' || l_suppkey % 97 || CASE l_linestatus WHEN 'F' THEN '.c' ELSE '.h' END AS target FROM lineitem),
r AS (SELECT path, target AS via, 0 AS steps FROM x UNION SELECT r.path, x.target, steps + 1 FROM r JOIN x ON via = x.path WHERE steps < 2 AND via LIKE '%.h')
SELECT path, via AS target, CAST(min(steps) AS BIGINT) AS steps FROM r WHERE via LIKE '%.c' AND via <> path GROUP BY ALL""",
    "call_chains": f"""WITH RECURSIVE e AS (SELECT event_id, {_K} AS k FROM events),
g AS (SELECT DISTINCT x.k AS src, y.k AS dst FROM e x JOIN e y ON y.event_id = x.event_id + 1 WHERE abs(x.k - y.k) <= 12 AND x.k <> y.k),
r AS (SELECT DISTINCT src AS node, 0 AS depth, [src] AS path FROM g WHERE src < 8 UNION ALL
  SELECT dst, depth + 1, list_append(path, dst) FROM (SELECT r.depth, r.path, g.dst, row_number() OVER (PARTITION BY dst ORDER BY path) AS o FROM r JOIN g ON r.node = g.src) WHERE depth < 5 AND o = 1)
SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, ' ') AS chain FROM r QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, path) = 1""",
    "resolved_calls": """WITH x AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
n AS (SELECT *, row_number() OVER (ORDER BY c, ln, p, s, q) AS id, 'd' || s % 2 AS dir, p % 3 AS mod, 'meth' || p % 4 AS name, CASE WHEN q % 5 > 0 THEN s % 3 END AS own FROM x),
k AS (SELECT *, 'meth' || s % 4 AS callee, CASE WHEN q % 3 = 0 THEN (p % 3 + 1) % 3 ELSE p % 3 END AS t FROM n),
j AS (SELECT k.c, k.id AS src, n.id AS dst, k.q % 4 AS form, k.own AS mine, k.t, n.own, n.dir = k.dir AS near, n.dir = k.dir AND n.mod = k.mod AS here FROM k JOIN n ON n.c = k.c AND n.name = k.callee),
has AS (SELECT DISTINCT c, own FROM n WHERE own IS NOT NULL),
f AS (SELECT *, CASE form WHEN 0 THEN own IS NULL OR own IS NOT DISTINCT FROM mine WHEN 1 THEN coalesce(own = mine, false) OR NOT coalesce(bool_or(own = mine) OVER (PARTITION BY c, src), false) WHEN 2 THEN own = t ELSE own IS NOT NULL END AS fits FROM j),
g AS (SELECT *, count(*) OVER (PARTITION BY c, src) AS m FROM f WHERE fits),
h AS (SELECT * FROM g WHERE form = 2 OR form = 1 AND coalesce(own = mine, false) OR m <= 4),
a AS (SELECT * FROM h QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY c, src)),
b AS (SELECT *, count(DISTINCT own) OVER (PARTITION BY c, src) AS owners, min(own) OVER (PARTITION BY c, src) AS least FROM (SELECT * FROM a QUALIFY here OR NOT bool_or(here) OVER (PARTITION BY c, src)))
SELECT c AS change_id, src, dst FROM b WHERE src <> dst AND (form <> 3 OR owners = 1 OR c % 2 = 0 AND least = 0)""",
}
