"""The SQL that the derived queries must agree with. Where a query builds text and reads it back, the SQL starts from the tables and never sees the text."""

from __future__ import annotations

from changeloom.plans.derived import COMMANDS, ROLE_FILES, ROLE_LANGUAGES
from changeloom.plans.queries import LINES, NORM, PAIRS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in values) + "]"


PARAMS = "CASE l_returnflag WHEN 'R' THEN 'qty: int, price' WHEN 'A' THEN 'qty: int' ELSE 'price, qty: int = 1' END"
GAP = "CASE WHEN l_linestatus = 'O' THEN ' ' ELSE '' END"
ITEMS = f"""h AS (SELECT o_custkey AS c, min(o_orderkey) AS o, max(o_orderkey) AS n FROM orders GROUP BY 1 HAVING min(o_orderkey) < max(o_orderkey)),
s AS (SELECT c, 'old' AS side, o AS k FROM h UNION ALL SELECT c, 'new', n FROM h),
b AS (SELECT c, side, l_linenumber AS ln, 'f' || l_partkey % 7 AS name, l_returnflag AS flag, l_partkey % 3 AS const, l_linestatus AS st,
  'def f' || l_partkey % 7 || '(' || {PARAMS} || '):' || chr(10) || '    total = qty' || {GAP} || '*' || {GAP} || l_partkey % 3 AS body FROM s JOIN lineitem ON l_orderkey = k),
it AS (SELECT *, row_number() OVER (PARTITION BY c, side ORDER BY ln, body) AS idx FROM b)"""
MATCH = ITEMS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY c, side, name ORDER BY idx) AS kth FROM it),
j1 AS (SELECT o.c, o.idx AS oi, n.idx AS ni, o.flag AS f, n.flag AS g, o.const AS x, n.const AS y, o.name AS oname, n.name AS nname,
  CASE WHEN (o.flag, o.const, o.st) = (n.flag, n.const, n.st) THEN 'exact' WHEN (o.flag, o.const) = (n.flag, n.const) THEN 'formatting' ELSE 'modified' END AS match FROM k o JOIN k n ON o.c = n.c AND o.name = n.name AND o.kth = n.kth AND o.side = 'old' AND n.side = 'new'),
l AS (SELECT it.*, row_number() OVER (PARTITION BY it.c, side, flag, const ORDER BY idx) AS kth FROM it WHERE NOT EXISTS (SELECT 1 FROM j1 WHERE j1.c = it.c AND (side = 'old' AND oi = idx OR side = 'new' AND ni = idx))),
m AS (SELECT * FROM j1 UNION ALL SELECT o.c, o.idx, n.idx, o.flag, n.flag, o.const, n.const, o.name, n.name, 'rename' FROM l o JOIN l n ON o.c = n.c AND o.flag = n.flag AND o.const = n.const AND o.kth = n.kth AND o.side = 'old' AND n.side = 'new')"""
SAID = """CASE f || g WHEN 'RA' THEN 'removed param `price`' WHEN 'AR' THEN 'added param `price`' WHEN 'RN' THEN 'params reordered' WHEN 'NR' THEN 'params reordered' WHEN 'AN' THEN 'added param `price`' WHEN 'NA' THEN 'removed param `price`' END"""
HREF = '<a href="([^"]*)">([^<]*)</a>'
LINKS = f"""p AS (SELECT page_id, html, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host FROM pages),
q AS (SELECT page_id, html, list_aggregate(list_reverse(list_reverse(string_split(host, '.'))[:2]), 'string_agg', '.') AS site FROM p),
x AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}')) AS a FROM q),
own AS (SELECT page_id, substr(regexp_extract(a, '"([^"]*)"', 1), 1, 2) AS module, lower(regexp_extract(a, '"([^"]*)"', 1)) AS symbol, substr(regexp_extract(a, '>([^<]*)<', 1), 1, 4) AS local FROM x),
got AS (SELECT * FROM own WHERE local <> ''),
nx AS (SELECT page_id, lead(page_id) OVER (PARTITION BY site ORDER BY page_id) AS change_id FROM q),
old AS (SELECT DISTINCT change_id, module, symbol, local FROM nx JOIN got USING (page_id) WHERE change_id IS NOT NULL),
new AS (SELECT DISTINCT g.page_id AS change_id, module, symbol, local FROM got g WHERE page_id IN (SELECT change_id FROM nx))"""
ANSWERS = "t AS (SELECT user_id, event_id, event_type AS question, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS choice FROM events)"
SPANS = "sp AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS id, l_partkey % 200 AS s, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
CALLS = """e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT DISTINCT x.k AS src, y.k AS dst FROM e x JOIN e y ON y.event_id = x.event_id + 1 WHERE abs(x.k - y.k) <= 12 AND x.k <> y.k)"""
TOKENS = r'''"(?:\\(?s:.)|[^"\\])*(?:"|$)|''(?:\\(?s:.)|[^''\\])*(?:''|$)|`(?:\\(?s:.)|[^`\\])*(?:`|$)|\s+|[^\s"''`]+'''
CALLERS = f"""b AS (SELECT l_orderkey AS c, l_linenumber AS ln, 'f' || l_partkey % 7 AS name, 'f' || l_suppkey % 7 AS callee, l_returnflag AS flag, 'def f' || l_partkey % 7 || '(' || {PARAMS} || '):' || chr(10) || '    return f' || l_suppkey % 7 AS body FROM lineitem),
it AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ln, body) AS idx FROM b)"""
_ENTRIES = """SELECT c AS change_id, 'renamed' AS category, 'function' AS kind, nname AS name, oname AS detail, oi AS old_idx, ni AS new_idx FROM u WHERE match = 'rename'
UNION ALL SELECT c, 'signature', 'function', nname, said || ' (callers break)', oi, ni FROM u WHERE said IS NOT NULL
UNION ALL SELECT c, 'logic', 'function', nname, 'body modified', oi, ni FROM u WHERE match = 'modified' AND x <> y
UNION ALL SELECT c, 'formatting', 'function', nname, NULL, oi, ni FROM u WHERE match = 'formatting'
UNION ALL SELECT c, 'removed', 'function', name, NULL, idx, NULL FROM it WHERE side = 'old' AND NOT EXISTS (SELECT 1 FROM m WHERE m.c = it.c AND oi = idx)
UNION ALL SELECT c, 'added', 'function', name, NULL, NULL, idx FROM it WHERE side = 'new' AND NOT EXISTS (SELECT 1 FROM m WHERE m.c = it.c AND ni = idx)"""
ENTRIES = f"{MATCH}, u AS (SELECT *, {SAID} AS said FROM m)"
ORACLE = {
    "call_edges": f"""WITH {CALLERS}, n AS (SELECT c, name, count(*) AS k FROM it GROUP BY ALL) SELECT DISTINCT a.c AS change_id, a.idx AS src_idx, z.idx AS dst_idx FROM it a JOIN it z ON a.c = z.c AND a.callee = z.name AND a.idx <> z.idx JOIN n ON n.c = z.c AND n.name = z.name WHERE k <= 4""",
    "dead_items": f"""WITH {CALLERS}, w AS (SELECT DISTINCT c, idx, unnest([name, callee]) AS name FROM it), n AS (SELECT c, name, count(*) AS n FROM w GROUP BY ALL) SELECT c AS change_id, idx, name FROM it JOIN n USING (c, name) WHERE n <= 1""",
    "signature_impacts": f"""WITH {CALLERS}, d AS (SELECT c, name, min(flag) AS flag FROM it GROUP BY ALL HAVING count(*) = 1) SELECT it.c AS change_id, d.name, count(*) AS n_calls, CAST(count(*) FILTER (WHERE d.flag = 'R') AS BIGINT) AS n_stale FROM it JOIN d ON it.c = d.c AND it.callee = d.name GROUP BY 1, 2""",
    "moved_runs": f"""WITH {PAIRS}, z AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM norms), k AS (SELECT doc_id, norm FROM z GROUP BY ALL HAVING count(*) <= 64),
j AS (SELECT a, b, x.p AS i, y.p AS j FROM pairs JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b AND x.norm = y.norm JOIN k ON k.doc_id = b AND k.norm = y.norm),
g AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM j) SELECT a, b, min(i) AS old_first, min(j) AS new_first, count(*) AS n FROM g GROUP BY a, b, i - j, g HAVING count(*) >= 3""",
    "resolved_paths": """WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path FROM pages), q AS (SELECT * FROM p WHERE path LIKE '%/%'), a AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN string_split(path, '/')[-1] ELSE 'x/' || path END AS w FROM q), k AS (SELECT DISTINCT path FROM q),
m AS (SELECT page_id, path, CASE WHEN w = path THEN 0 WHEN ends_with('/' || path, '/' || w) THEN 1 WHEN ends_with('/' || w, '/' || path) THEN 2 END AS r FROM a, k) SELECT page_id, path FROM m WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY r, path) = 1""",
    "word_search": f"""WITH {LINES}, w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_$]+')) AS name FROM lines) SELECT * FROM w WHERE name IN ('License', 'password', 'the') ORDER BY name, doc_id, line_no LIMIT 3000""",
    "report_entries": f"""WITH {ENTRIES}, e AS ({_ENTRIES}) SELECT category, count(*) AS n, count(DISTINCT change_id) AS n_changes, count(detail) AS n_details, CAST(sum(coalesce(new_idx, 0)) AS BIGINT) AS places FROM e GROUP BY 1""",
    "source_items": f"""WITH {ITEMS} SELECT c AS change_id, side, idx, 'function' AS kind, name, idx * 4 - 3 AS "start", idx * 4 - 1 AS "end",
CASE flag WHEN 'R' THEN 'qty int,price' WHEN 'A' THEN 'qty int' ELSE 'price,qty int ?' END AS params, CAST(CASE flag WHEN 'R' THEN 17 WHEN 'A' THEN 15 ELSE 19 END AS BIGINT) AS n_tokens, true AS exported FROM it""",
    "item_match": f"WITH {MATCH} SELECT c AS change_id, oi AS old_idx, ni AS new_idx, match FROM m",
    "change_entries": f"WITH {ENTRIES} {_ENTRIES}",
    "vanished_names": f"""WITH {ITEMS} SELECT c AS change_id, name, min(idx) AS "first" FROM it o WHERE side = 'old' AND NOT EXISTS (SELECT 1 FROM it n WHERE n.side = 'new' AND n.c = o.c AND n.name = o.name) GROUP BY 1, 2""",
    "signature_pairs": f"""WITH {ITEMS}, p AS (SELECT c, o.flag AS f, n.flag AS g FROM it o JOIN it n USING (c) WHERE o.side = 'old' AND n.side = 'new' AND o.idx = 1 AND n.idx = 1)
SELECT c AS change_id, f <> g AS differs, f <> g AS breaks, {SAID} AS said FROM p""",
    "definitions": f"""WITH {ITEMS} SELECT c AS change_id, name, min(idx) * 4 - 3 AS "start", min(idx) * 4 - 1 AS "end" FROM it WHERE side = 'new' AND name IN ('f1', 'f5') GROUP BY 1, 2""",
    "code_keys": rf"""WITH {LINES}, tk AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '{TOKENS}') AS t FROM lines),
k AS (SELECT doc_id, line_no, line, array_to_string(list_transform(t, lambda x, i : CASE WHEN NOT regexp_matches(x, '^\s+$') THEN x WHEN i > 1 AND i < len(t) AND regexp_matches(t[i - 1], '[\p{{L}}\p{{M}}\p{{N}}_]$') AND regexp_matches(t[i + 1], '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN ' ' ELSE '' END), '') AS code_key FROM tk)
SELECT doc_id, line_no, code_key, regexp_extract(line, '^\s*') || code_key AS with_indent FROM k""",
    "snippets": rf"""WITH {LINES}, sn AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, trim(regexp_replace(line, '\s+', ' ', 'g')) AS o FROM lines)
SELECT doc_id, line_no, CASE WHEN t = '' THEN 'line ' || line_no WHEN length(t) > 48 THEN substr(t, 1, 48) || '…' ELSE t END AS snippet, CASE WHEN length(o) > 48 THEN substr(o, 1, 47) || '…' ELSE o END AS one_line FROM sn""",
    "renamed_lines": rf"""WITH {LINES}, w AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') AS w FROM lines)
SELECT doc_id, line_no, array_to_string(list_transform(w, lambda x : CASE x WHEN 'the' THEN 'le$1' WHEN 'THE' THEN 'le$1' WHEN 'of' THEN 'von' ELSE x END), '') AS line FROM w""",
    "single_fixes": "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) - length(replace(t, 'License', '')) = 7 THEN replace(t, 'License', 'Licence') ELSE t END) AS fixed FROM t",
    "comment_payloads": r"SELECT doc_id, md5(text) AS back, CAST(length(text) + 5 * (length(text) - length(replace(text, '-', ''))) + 14 AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%u002d%' AND text <> ''",
    "context_sizes": f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), c AS (SELECT doc_id, CAST(ceil(4 * length(coalesce(text, '')) / 8192.0) * 8192 AS BIGINT) AS c FROM documents)
SELECT doc_id, CASE WHEN c <= 65536 THEN c END AS context, CAST(CASE WHEN coalesce(n, 0) < 80 THEN 1 WHEN n < 400 THEN 2 ELSE 3 END AS BIGINT) AS concepts FROM c LEFT JOIN n USING (doc_id)""",
    "url_names": """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '.') AS h, string_split(regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1), '/') AS s FROM pages)
SELECT page_id, h[-1] AS bare, CASE WHEN len(h) > 1 THEN array_to_string(h[:len(h) - 1], '.') END AS owner, CASE WHEN page_id % 4 = 3 THEN 'a.tar' WHEN page_id % 4 = 1 AND s[-1] = '' THEN '.py' ELSE s[-1] END AS module FROM p""",
    "remotes": """WITH u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS u FROM pages), p AS (SELECT page_id, url, string_split(regexp_extract(u, '://([^/]*)', 1), ':')[1] AS h, list_filter(string_split(regexp_extract(u, '://[^/]*/(.*)$', 1), '/'), lambda x : x <> '') AS s FROM u)
SELECT page_id, CASE WHEN len(s) >= 2 THEN s[-2] || '/' || s[-1] END AS repo, CASE WHEN len(s) >= 2 THEN 'https://' || h || '/' || array_to_string(s, '/') END AS link,
starts_with(url, 'https://') AND regexp_matches(h, '(^|\\.)example\\.(org|net)$') AND NOT regexp_matches(url, '[?@]') AS allowed FROM p""".replace("\\\\.", "\\."),
    "file_roles": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, CAST(page_id % {len(ROLE_FILES)} + 1 AS INT) AS i FROM pages),
r AS (SELECT page_id, host, 'pkg/' || page_id || '/' || ({_list(ROLE_FILES)})[i] AS path, ({_list(ROLE_FILES.values())})[i] AS role, ({_list(ROLE_LANGUAGES)})[i] AS language FROM p)
SELECT page_id, path, role, language, row_number() OVER (PARTITION BY host ORDER BY CASE role WHEN 'source' THEN 0 WHEN 'test' THEN 1 WHEN 'docs' THEN 2 ELSE 3 END, page_id) AS file_order FROM r""",
    "parsed_times": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    "name_lines": f"WITH {LINES}, w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[A-Za-z0-9_$]+') AS w FROM lines) SELECT doc_id, line_no FROM w WHERE list_has_any(w, ['License', 'password'])",
    "change_runs": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE regexp_matches(line, '[0-9]')), r AS (SELECT doc_id, min(line_no) AS f, max(line_no) AS l FROM c GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS run, f AS "first", l AS "last" FROM r""",
    "split_runs": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[0-9]') THEN CAST(length(line) % 2 = 0 AS INT) END AS t FROM lines), d AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
SELECT doc_id, line_no, CAST(sum(CASE WHEN t <> b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS part FROM d""",
    "hunk_labels": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, length(line) AS n, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE length(line) % 3 > 0), r AS (SELECT *, CASE WHEN n % 5 < 2 THEN 'comment' WHEN n % 5 < 4 THEN 'formatting' END AS l FROM c),
s AS (SELECT doc_id, g, min(line_no) AS f, count(*) AS n, count(l) AS k, count(*) FILTER (WHERE l = 'comment') AS a, bool_and(n % 2 = 0) AS t FROM r GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS run, CAST(n AS BIGINT) AS n_changed, CASE WHEN k = n THEN CASE WHEN 2 * a >= n THEN 'comment' ELSE 'formatting' END END AS noise, t AS test FROM s""",
    "smallest_spans": f'''WITH {SPANS}, a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey * 7 % 250 AS p FROM lineitem) SELECT k, p AS "at", arg_min(id, struct_pack(d := e - s, s := s, i := id)) AS id FROM a JOIN sp USING (k) WHERE p BETWEEN s AND e GROUP BY k, p''',
    "linked_changes": f"""WITH {SPANS}, c AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS p, l_suppkey % 2 AS side, l_suppkey * 7 % 250 AS line, l_suppkey * 3 % 250 AS next FROM lineitem),
o AS (SELECT k, p AS "at", id FROM c JOIN sp USING (k) WHERE side = id % 2 AND line BETWEEN s AND e)
SELECT * FROM o UNION ALL SELECT k, p, id FROM c JOIN sp USING (k) WHERE side = 0 AND id % 2 = 1 AND next BETWEEN s AND e AND (k, p) NOT IN (SELECT (k, "at") FROM o)""",
    "merged_hunks": """WITH h AS (SELECT l_orderkey AS k, l_partkey % 200 + 1 AS os, l_partkey % 200 + 1 + CAST(l_quantity AS BIGINT) AS oe, CASE WHEN l_suppkey % 3 > 0 THEN l_partkey % 200 + 3 ELSE 0 END AS ns, CASE WHEN l_suppkey % 3 > 0 THEN l_partkey % 200 + 3 + CAST(l_quantity AS BIGINT) ELSE 0 END AS ne FROM lineitem),
b AS (SELECT *, CASE WHEN ns > 0 THEN ns ELSE os END AS b FROM h), f AS (SELECT *, max(greatest(oe, ne)) OVER (PARTITION BY k ORDER BY b, os, oe, ne ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b),
g AS (SELECT *, sum(CASE WHEN b <= far + 8 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY b, os, oe, ne ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT k, min(os) AS old_start, max(oe) AS old_end, coalesce(min(ns) FILTER (WHERE ns > 0), 0) AS new_start, max(ne) AS new_end, count(*) AS n FROM g GROUP BY k, g""",
    "preferred": """WITH a AS (SELECT user_id, event_id, event_id % 4 = 0 AS m FROM events e WHERE event_type = 'purchase' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase'))
SELECT user_id, event_id FROM a WHERE m OR NOT EXISTS (SELECT 1 FROM a x WHERE x.user_id = a.user_id AND x.m)""",
    "link_changes": f"""WITH {LINKS}, o AS (SELECT DISTINCT change_id, module, symbol FROM old), n AS (SELECT DISTINCT change_id, module, symbol FROM new)
SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""",
    "link_renames": f"""WITH {LINKS}, o AS (SELECT change_id, module, symbol, min(local) AS l FROM old GROUP BY ALL HAVING count(DISTINCT local) = 1), n AS (SELECT change_id, module, symbol, min(local) AS l FROM new GROUP BY ALL HAVING count(DISTINCT local) = 1)
SELECT change_id, module, symbol, o.l AS old_local, n.l AS new_local FROM o JOIN n USING (change_id, module, symbol) WHERE o.l <> n.l AND (change_id, o.l) NOT IN (SELECT (change_id, local) FROM new) AND (change_id, n.l) NOT IN (SELECT (change_id, local) FROM old)""",
    "swapped_links": f"""WITH {LINKS}, o AS (SELECT change_id, local, min(module) AS m, min(symbol) AS s FROM old GROUP BY ALL HAVING count(DISTINCT (module, symbol)) = 1), n AS (SELECT change_id, local, min(module) AS m, min(symbol) AS s FROM new GROUP BY ALL HAVING count(DISTINCT (module, symbol)) = 1)
SELECT change_id, local, o.m AS old_module, o.s AS old_symbol, n.m AS new_module, n.s AS new_symbol FROM o JOIN n USING (change_id, local) WHERE (o.m, o.s) <> (n.m, n.s)""",
    "broken_links": f"""WITH {LINKS}, u AS (SELECT DISTINCT change_id, symbol, local FROM old WHERE (change_id, symbol) NOT IN (SELECT (change_id, symbol) FROM new)) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY change_id, symbol ORDER BY local) <= 2""",
    "extractions": f"""WITH {NORM}, one AS (SELECT DISTINCT doc_id, norm FROM norms), z AS (SELECT doc_id, count(*) AS n FROM one GROUP BY 1),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, x.norm FROM one x JOIN one y USING (norm) WHERE x.doc_id <> y.doc_id), r AS (SELECT a, b FROM m GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT a, count(DISTINCT norm) AS c, count(DISTINCT b) AS k FROM m JOIN r USING (a, b) GROUP BY a), rc AS (SELECT a, string_agg(b, ',' ORDER BY b) AS l FROM r GROUP BY a)
SELECT g.a AS doc_id, n AS n_lines, c AS n_covered, l AS receivers FROM g JOIN z ON g.a = doc_id JOIN rc ON rc.a = g.a WHERE n >= 3 AND k >= 2 AND 100 * c >= 70 * n""",
    "document_units": f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(node, top) AS (SELECT DISTINCT a, a FROM e UNION SELECT b, top FROM r JOIN e ON node = a WHERE top < b) SELECT node, min(top) AS unit FROM r GROUP BY 1""",
    "stale_calls": "SELECT l_partkey, count(*) AS n_calls, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_stale FROM lineitem GROUP BY 1",
    "agreed_types": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    "answer_log": f"WITH {ANSWERS}, l AS (SELECT *, lag(choice) OVER (PARTITION BY user_id, question ORDER BY event_id) AS b FROM t) SELECT user_id, event_id, question, choice, row_number() OVER (PARTITION BY user_id, question ORDER BY event_id) AS attempt FROM l WHERE b IS NULL OR b <> choice",
    "ungraded": f"""WITH {ANSWERS}, m AS (SELECT * FROM t WHERE choice = 1), o AS (SELECT user_id, max(event_id) AS u FROM m WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id, t.user_id FROM t LEFT JOIN o USING (user_id) WHERE event_id NOT IN (SELECT event_id FROM m WHERE event_id % 3 > 0) AND (u IS NULL OR event_id > u)""",
    "latest_answers": f"WITH {ANSWERS} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "merge_gate": f"""WITH {ANSWERS}, q AS (SELECT user_id, question, arg_max(CAST(choice < 3 AS INT), event_id) AS l FROM t GROUP BY ALL), s AS (SELECT user_id, count(*) AS n, sum(l) AS r, user_id % 3 = 0 AS p FROM q GROUP BY 1),
w AS (SELECT *, user_id % 2 = 0 AND NOT (n = 5 AND r = 5) AS a, user_id % 5 > 0 AND NOT p AS v, CASE WHEN p THEN 'Quiz passed by u' || user_id ELSE '' END AS y FROM s)
SELECT user_id, a AS author_waits, v AS reviewer_waits, CASE WHEN a OR v THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN a AND v THEN 'Waiting on the author''s quiz and a reviewer''s' WHEN a THEN 'Waiting on the author''s quiz' || CASE WHEN p THEN ' · ' || y ELSE '' END WHEN v THEN 'Waiting on a reviewer''s quiz' ELSE y END AS lead FROM w""",
    "group_votes": f"WITH {ANSWERS}, c AS (SELECT user_id, choice, count(*) AS n FROM t GROUP BY ALL) SELECT user_id, choice FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, choice) = 1",
    "group_files": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3) AS shown, count(*) FILTER (WHERE r > 3) AS more FROM r GROUP BY 1""",
    "fitted_traces": """WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations), t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS t FROM c), u AS (SELECT * FROM t WHERE t <= 1200 OR role IS NULL OR role <> 'tool'),
v AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS s FROM u), w AS (SELECT * FROM v WHERE s <= 1200 OR role IS NULL OR role <> 'system'),
x AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn DESC ROWS UNBOUNDED PRECEDING) AS f FROM w)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM x WHERE f <= 1200""",
    "quiz_replies": f"WITH {ANSWERS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, event_id % 9 AS question, choice FROM t",
    "recovered_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "command_effects": f"SELECT event_id, ({_list(COMMANDS.values())})[CAST(event_id % {len(COMMANDS)} + 1 AS INT)] AS writes, user_id % 4 = 1 AS leaves FROM events",
    "path_mentions": """WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT a.page_id AS command_id, count(*) AS n, min(b.page_id) AS "first" FROM p a JOIN p b ON b.path LIKE '%/%' AND (a.path = b.path OR ends_with('/repo/' || a.path, '/' || b.path)) WHERE a.path <> '' GROUP BY 1""",
    "changed_callees": f"""WITH RECURSIVE {CALLS}, n AS (SELECT DISTINCT k FROM e), r(root, node, depth) AS (SELECT src, dst, 1 FROM c WHERE src % 9 = 0 UNION SELECT root, dst, depth + 1 FROM r JOIN c ON node = src WHERE depth < 3 AND node % 9 <> 0 AND node % 7 <> 3)
SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node % 9 = 0 AND root <> node GROUP BY 1, 2""",
    "test_reach": f"""WITH RECURSIVE {CALLS}, r(node, depth, origin) AS (SELECT DISTINCT k, 0, k FROM e WHERE k % 25 = 4 UNION SELECT dst, depth + 1, origin FROM r JOIN c ON node = src WHERE depth < 8),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), o AS (SELECT DISTINCT node, depth, origin FROM r JOIN m USING (node, depth)), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY origin) AS p FROM o)
SELECT node, CAST(depth AS BIGINT) AS depth, string_agg(CAST(origin AS VARCHAR), ',' ORDER BY origin) AS origins FROM k WHERE p <= 3 GROUP BY 1, 2""",
    "descendants": """WITH RECURSIVE p AS (SELECT c_custkey AS child, CAST(c_custkey // 3 AS BIGINT) AS parent FROM customer WHERE c_custkey <> c_custkey // 3), r(child, ancestor) AS (SELECT * FROM p UNION SELECT r.child, p.parent FROM r JOIN p ON r.ancestor = p.child) SELECT child, ancestor FROM r WHERE child <> ancestor""",
    "patch_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "status_lists": """SELECT user_id AS change_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, (['M', 'A', 'R', 'D', 'C'])[CAST(event_id % 5 + 1 AS INT)] AS status, 'a/' || event_id AS old_path,
CASE event_id % 5 WHEN 2 THEN 'M' || event_id WHEN 4 THEN 'R' ELSE 'a/' || event_id END AS new_path FROM events""",
    "file_changes": """WITH t AS (SELECT doc_id, doc_id % 3 AS s, doc_id % 11 = 0 AS b, length(coalesce(text, '')) AS n FROM documents), u AS (SELECT *, CASE WHEN b THEN 0 ELSE n END AS n2 FROM t)
SELECT doc_id AS seq, (['A', 'M', 'D'])[CAST(s + 1 AS INT)] AS status, CAST(CASE WHEN s = 0 THEN 0 ELSE n2 END AS BIGINT) AS old_chars, CAST(CASE WHEN s = 2 THEN 0 ELSE n2 END AS BIGINT) AS new_chars, b AS binary,
CASE WHEN b THEN 'unknown' ELSE 'python' END AS language, 'source' AS role, CASE WHEN doc_id % 2 = 0 AND NOT b THEN 'patch' ELSE '' END AS raw_diff FROM u""",
    "quoted_paths": r"""WITH t AS (SELECT doc_id, substr(coalesce(text, ''), 1, 40) AS t FROM documents), h AS (SELECT *, list_transform(range(0, octet_length(encode(t))), lambda i : substr(hex(encode(t)), 2 * i + 1, 2)) AS h FROM t)
SELECT doc_id, CASE WHEN regexp_matches(t, '[^\x20-\x7e]|["\\]') THEN '"' || array_to_string(list_transform(h, lambda x : CASE x WHEN '22' THEN '\"' WHEN '5C' THEN '\\' WHEN '09' THEN '\t' WHEN '0A' THEN '\n' WHEN '07' THEN '\a' WHEN '08' THEN '\b' WHEN '0B' THEN '\v' WHEN '0C' THEN '\f' WHEN '0D' THEN '\r'
  ELSE CASE WHEN x BETWEEN '20' AND '7E' THEN chr(CAST('0x' || x AS INT)) ELSE '\' || lpad(CAST(CAST('0x' || x AS INT) // 64 * 100 + CAST('0x' || x AS INT) // 8 % 8 * 10 + CAST('0x' || x AS INT) % 8 AS VARCHAR), 3, '0') END END), '') || '"' ELSE t END AS quoted FROM h""",
    "transcript_lines": "SELECT conv_id, turn, coalesce(role, '') AS role, 'text' AS kind, coalesce(text, '') AS text FROM conversations WHERE turn % 5 <> 4",
    "file_source": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines WHERE line_no <= 200 GROUP BY 1",
}
