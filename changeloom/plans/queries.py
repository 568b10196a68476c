"""The reference's operators over the driver's tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import paths
from changeloom.functions import text as T
from changeloom.operators import events as E
from changeloom.operators import graph, mentions, pairs
from changeloom.sources.tables import read, settle

NAMES = ["Apache", "License", "Licensed", "Version", "Stack", "password", "All", "rights"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text", "source")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return settle(pairs.version_pairs(_docs(spark, d), "doc_id", "text"), "pairs")


def line_explode(spark, d):
    return pairs.explode_lines(_docs(spark, d), "doc_id", "text")


def nontrivial_lines(spark, d):
    return pairs.nontrivial_lines(_docs(spark, d), "doc_id", "text")


def version_pairs(spark, d):
    return pairs.version_pairs(_docs(spark, d), "doc_id", "text")


def line_multiset_diff(spark, d):
    return pairs.line_multiset_diff(_docs(spark, d), _pairs(spark, d), "doc_id", "text")


def token_dice(spark, d):
    return pairs.token_dice(_docs(spark, d), _pairs(spark, d), "doc_id", "text")


def exact_moves(spark, d):
    return pairs.exact_moves(_docs(spark, d), "doc_id", "text", "source")


def line_diff(spark, d):
    return pairs.line_diff(_docs(spark, d), _pairs(spark, d), "doc_id", "text")


def review_stats(spark, d):
    return pairs.pair_stats(_docs(spark, d), _pairs(spark, d), "doc_id", "text")


def change_totals(spark, d):
    m = line_multiset_diff(spark, d)
    return m.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "removed", "kept")], F.count("*").alias("n_pairs"))


def page_role(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://[^/]*/([^?#]*)", 1)
    return read(spark, d, "pages").select("page_id", path.alias("path"), paths.role(path).alias("role"), paths.language(path).alias("language"), paths.is_changelog(path).alias("changelog"))


def identifier_mentions(spark, d):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return mentions.identifier_mentions(line_explode(spark, d), names, "doc_id")


def quote_check(spark, d):
    return mentions.quote_check(read(spark, d, "benchmark"), _docs(spark, d).select("doc_id", "text"), "item_id", "doc_id")


def requirements(spark, d):
    c = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.requirement(F.col("text")).alias("requirement")).where("requirement is not null")
    return E.number_newest(c, "conv_id", "turn").select("conv_id", "turn", "number", "requirement")


def trace_budget(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return E.within_budget(c, "conv_id", "turn", F.col("size"), 1500)


def session_cut(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    kind = F.col("event_type")
    return E.session_cut(e, "user_id", "ts", "event_id", kind == "error", kind == "view", kind == "purchase").select("user_id", "event_id", "event_type")


def context_hunks(spark, d):
    return E.context_hunks(line_explode(spark, d), "doc_id", "line_no", F.col("line").rlike("[0-9]"))


def span_merge(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 200).alias("s"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("long")).alias("e"))
    return E.merge_spans(s, "k", "s", "e")


def _attempts(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("question"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("choice"))


def quiz_score(spark, d):
    return E.quiz_score(_attempts(spark, d), ["user_id"], "question", "event_id", F.col("choice") == 0)


def grade_fold(spark, d):
    return E.grade_fold(_attempts(spark, d), ["user_id", "question"], "choice", "event_id", F.col("choice") == 0)


def top_sessions(spark, d):
    s = read(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"), F.max("event_id").alias("last"))
    return E.top_by(s, [F.desc("kinds"), F.desc("n"), F.desc("last")], 4)


def cap_per_symbol(spark, d):
    return E.cap_each(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")], 5)


def kth_match(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return pairs.match_kth(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "event_id")


def import_diff(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    half = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"))
    side = lambda c: half.join(items, F.col(c) == F.col("k")).select("o_custkey", "part")
    both = E.set_diff(side("first"), side("last"), ["o_custkey"], "part")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return both.select("o_custkey", text("added"), text("removed"))


def unreferenced_parts(spark, d):
    return E.unreferenced(read(spark, d, "part").select("p_partkey", "p_brand"), read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def call_reach(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    calls = e.join(e.select(F.col("user_id").alias("u"), (F.col("event_id") - 1).alias("before"), F.col("k").alias("dst")), (F.col("event_id") == F.col("before")) & (F.col("user_id") <= F.col("u"))).select(F.col("k").alias("src"), "dst")
    narrow = calls.where("abs(src - dst) <= 7")
    return graph.reach(narrow, spark.createDataFrame([(0,), (1,)], "node long"), 8)


QUERIES = {f.__name__: f for f in (
    line_explode, nontrivial_lines, version_pairs, line_multiset_diff, token_dice, exact_moves, line_diff, review_stats, change_totals, page_role, identifier_mentions, quote_check, requirements, trace_budget,
    session_cut, context_hunks, span_merge, quiz_score, grade_fold, top_sessions, cap_per_symbol, kth_match, import_diff, unreferenced_parts, call_reach,
)}

LINES = r"""t AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
u AS (SELECT doc_id, source, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM t),
l AS (SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS line_no, p FROM u),
lines AS (SELECT doc_id, source, line_no, regexp_replace(p[line_no], '\r$', '') AS line FROM l)"""
NORM = LINES + r""",
n AS (SELECT doc_id, line_no, regexp_replace(line, '\s+', '', 'g') AS norm FROM lines),
norms AS (SELECT * FROM n WHERE octet_length(encode(norm)) >= 4 AND regexp_matches(norm, '[\p{L}\p{N}]') AND norm NOT IN ('else{', '}else{', 'return;', 'break;', 'pass', 'continue;', '});', 'end'))"""
PAIRS = NORM + """,
one AS (SELECT DISTINCT doc_id, norm FROM norms),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM one x JOIN one y USING (norm) WHERE x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 3)"""
MULTI = PAIRS + """,
per AS (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY ALL),
c AS (SELECT a, b, line, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, line, n AS x, 0 AS y FROM pairs JOIN per ON a = doc_id UNION ALL SELECT a, b, line, 0, n FROM pairs JOIN per ON b = doc_id) GROUP BY ALL),
m AS (SELECT a, b, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(least(x, y)) AS BIGINT) AS kept FROM c GROUP BY ALL)"""
ATTEMPTS = "t AS (SELECT user_id, event_id, event_type AS question, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS choice FROM events)"

ORACLE = {
    "line_explode": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "nontrivial_lines": f"WITH {NORM} SELECT doc_id, line_no, norm FROM norms",
    "version_pairs": f"WITH {PAIRS} SELECT a, b, shared FROM pairs",
    "line_multiset_diff": f"WITH {MULTI} SELECT a, b, added, removed, kept FROM m",
    "change_totals": f"WITH {MULTI} SELECT CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed, CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept, count(*) AS n_pairs FROM m",
    "token_dice": rf"""WITH {PAIRS}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS unit FROM documents), per AS (SELECT doc_id, unit, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT a, b, unit, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, unit, n AS x, 0 AS y FROM pairs JOIN per ON a = doc_id UNION ALL SELECT a, b, unit, 0, n FROM pairs JOIN per ON b = doc_id) GROUP BY ALL)
SELECT a, b, CAST(2 * sum(least(x, y)) AS BIGINT) AS common2, CAST(sum(x + y) AS BIGINT) AS total FROM c GROUP BY ALL""",
    "exact_moves": r"""WITH n AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS h FROM documents WHERE regexp_matches(text, '\S')),
f AS (SELECT h, min(doc_id) AS origin FROM n GROUP BY h HAVING count(*) > 1)
SELECT n.doc_id, f.origin, n.source AS place, o.source AS origin_place FROM n JOIN f USING (h) JOIN n o ON o.doc_id = f.origin WHERE n.source <> o.source""",
    "page_role": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS s, regexp_extract(path, '[^/]*$') AS file FROM p)
SELECT page_id, path, CASE WHEN list_has_any(s, ['node_modules', 'vendor', 'third_party', 'third-party', 'bower_components', 'Pods', '.yarn']) THEN 'vendored' WHEN list_has_any(s, ['dist', '__pycache__']) OR regexp_matches(file, '\.(min\.js|map|snap|o|d|pyc|class)$') THEN 'generated'
WHEN list_has_any(s[:len(s) - 1], ['test', 'tests', 'spec', 'specs', 'testdata', 'e2e']) OR regexp_matches(file, '\.test\.|\.spec\.|_spec\.') THEN 'test'
WHEN regexp_matches(lower(file), '\.(md|mdx|rst|adoc|txt)$') OR list_has_any(s[:len(s) - 1], ['docs', 'doc', 'documentation']) THEN 'docs' ELSE 'source' END AS role, 'unknown' AS language,
regexp_matches(lower(file), '^(changelog|changes|history|news|release_notes|release-notes|releases)(\.|$)') AS changelog FROM q""",
    "identifier_mentions": f"WITH {LINES}, w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_$]+')) AS name FROM lines) SELECT * FROM w WHERE name IN ('Apache', 'License', 'Licensed', 'Version', 'Stack', 'password', 'All', 'rights')",
    "quote_check": r"""WITH q AS (SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '^["''…\s]+|["''…\s]+$', '', 'g'), '\s+', ' ', 'g'))) AS q FROM benchmark), t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON octet_length(encode(q)) >= 3 AND contains(t, q)""",
    "requirements": r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '(?s)<system-reminder>.*?(</system-reminder>|$)', '', 'g')) AS t FROM conversations WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE NOT regexp_matches(t, '^(<|Caveat:|\[Request interrupted|# AGENTS\.md instructions)') AND NOT contains(t, '<INSTRUCTIONS>') AND len(regexp_extract_all(t, '\S+')) >= 4)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || '…' ELSE t END AS requirement FROM r WHERE back <= 20""",
    "trace_budget": "WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size FROM conversations), u AS (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM c) SELECT * FROM u WHERE used <= 1500",
    "session_cut": """WITH n AS (SELECT user_id, event_id, ts, event_type AS t, row_number() OVER w AS n, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, max(n) AS k FROM n WHERE t = 'error' GROUP BY 1), a AS (SELECT n.*, k FROM n JOIN k USING (user_id)),
x AS (SELECT user_id, min(n) FILTER (WHERE n > k AND t = 'view' AND floor(gap) > 7200) AS pause, min(n) FILTER (WHERE n > k AND t = 'purchase') AS away FROM a GROUP BY 1),
y AS (SELECT x.*, (SELECT max(n) FROM a WHERE a.user_id = x.user_id AND n > k AND n < away AND t = 'view') AS ask FROM x),
z AS (SELECT user_id, CASE WHEN pause < coalesce(away, 2147483647) THEN pause ELSE coalesce(ask, away) END AS cut FROM y)
SELECT user_id, event_id, t AS event_type FROM a JOIN z USING (user_id) WHERE cut IS NULL OR n < cut""",
    "context_hunks": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, CAST(regexp_matches(line, '[0-9]') AS INT) AS c FROM lines), k AS (SELECT *, max(c) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS k FROM c),
g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM k WHERE k = 1) SELECT doc_id, min(line_no) AS first, max(line_no) AS last, CAST(sum(c) AS BIGINT) AS n_changed FROM g GROUP BY doc_id, g""",
    "span_merge": """WITH s AS (SELECT l_orderkey AS k, l_partkey % 200 AS s, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), f AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
g AS (SELECT *, sum(CASE WHEN s <= far + 8 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT k, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY k, g""",
    "quiz_score": f"WITH {ATTEMPTS}, q AS (SELECT user_id, question, arg_min(CAST(choice = 0 AS INT), event_id) AS f, arg_max(CAST(choice = 0 AS INT), event_id) AS l, count(*) AS n FROM t GROUP BY ALL) SELECT user_id, count(*) AS answered, CAST(sum(f) AS BIGINT) AS first_right, CAST(sum(l) AS BIGINT) AS latest_right, max(n) AS most_tries FROM q GROUP BY 1",
    "grade_fold": f"WITH {ATTEMPTS} SELECT user_id, question, arg_min(choice, event_id) AS first_choice, max(choice = 0) AS ever_right FROM t GROUP BY ALL",
    "top_sessions": "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC LIMIT 4",
    "cap_per_symbol": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 5",
    "kth_match": """WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS kth, event_id AS old_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS kth, event_id AS new_id FROM events WHERE event_type = 'purchase')
SELECT user_id, kth, old_id, new_id FROM v FULL JOIN p USING (user_id, kth)""",
    "import_diff": """WITH h AS (SELECT o_custkey, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders GROUP BY 1), o AS (SELECT DISTINCT o_custkey, l_partkey AS p FROM h JOIN lineitem ON f = l_orderkey), n AS (SELECT DISTINCT o_custkey, l_partkey AS p FROM h JOIN lineitem ON l = l_orderkey),
b AS (SELECT o_custkey, p, o.p IS NOT NULL AS was, n.p IS NOT NULL AS isn FROM o FULL JOIN n USING (o_custkey, p))
SELECT o_custkey, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (WHERE NOT was), '') AS added, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (WHERE NOT isn), '') AS removed FROM b GROUP BY 1""",
    "unreferenced_parts": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "call_reach": """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT DISTINCT x.k AS src, y.k AS dst FROM e x JOIN e y ON y.event_id = x.event_id + 1 AND x.user_id <= y.user_id WHERE abs(x.k - y.k) <= 7 AND x.k <> y.k),
r(node, depth) AS (SELECT unnest([0, 1]), 0 UNION SELECT dst, depth + 1 FROM r JOIN c ON node = src WHERE depth < 8)
SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1""",
}
