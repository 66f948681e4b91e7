"""DuckDB SQL of the registered queries: what each must return, said without the engine."""

from __future__ import annotations

from grantlake import queries as Q

_ID = "regexp_full_match(subject_name, '[A-Za-z0-9_./@+=-]{1,256}')"
_REACH = """WITH RECURSIVE e AS ({edges}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src, dst FROM r {where}"""
_PATHS = "p AS (SELECT src, dst FROM e UNION ALL SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


def _reach(edges: str = Q.EDGES, where: str = "") -> str:
    return _REACH.format(edges=edges, where=where)


#: One row for each tuple of ORG and relation that it reaches.
_ORG_EDGES = f"""SELECT subject_predicate AS src_pred, subject_type AS src_type, subject_name AS src_name, d AS dst_pred, object_type AS dst_type, object_name AS dst_name
FROM (SELECT *, unnest(CASE WHEN relation = 'owner' THEN ['owner', 'reader', 'held'] ELSE [relation] END) AS d FROM ({{tuples}}) AS t) AS u"""
_ADMITTED = f"SELECT DISTINCT * FROM ({Q.RAW}) AS t WHERE {_ID} AND ((relation = 'owner' AND object_type IN ('order', 'customer')) OR (relation = 'parent' AND object_type = 'nation'))"

_DOCS = """listed AS (SELECT DISTINCT concat('d', doc_id) AS o_name FROM labels WHERE quality = 1),
withheld AS (SELECT DISTINCT concat('d', doc_id) AS o_name FROM labels WHERE toxic = 1),
errors AS (SELECT DISTINCT concat('u', user_id) AS u FROM events WHERE event_type = 'error'),
authors AS (SELECT DISTINCT concat('d', doc_id) AS o_name, concat('u', doc_id % 150) AS u FROM documents),
viewer AS (
  SELECT o_name, 'star' AS kind, '*' AS s_name FROM listed
  UNION ALL SELECT o_name, 'pos', u FROM authors WHERE o_name NOT IN (SELECT o_name FROM listed)
  UNION ALL SELECT o_name, 'neg', u FROM (SELECT o_name, u FROM listed JOIN withheld USING (o_name), errors EXCEPT SELECT o_name, u FROM authors) AS x
),
pinned AS (SELECT o_name, 'pos' AS kind, u AS s_name FROM (SELECT o_name, u FROM authors UNION SELECT o_name, u FROM withheld, errors) AS x JOIN listed USING (o_name)),
conv AS (SELECT DISTINCT concat('v', conv_id) AS v, concat('d', conv_id) AS d FROM conversations),
page AS (SELECT DISTINCT concat('p', page_id) AS v, concat('d', page_id) AS d FROM pages),
conv_viewer AS (SELECT v AS o_name, kind, '...' AS s_pred, 'user' AS s_type, s_name FROM conv JOIN viewer ON o_name = d UNION ALL SELECT v, 'pos', 'viewer', 'doc', d FROM conv),
page_reader AS (SELECT v AS o_name, kind, '...' AS s_pred, 'user' AS s_type, s_name FROM page JOIN viewer ON o_name = d UNION ALL SELECT v, 'pos', 'viewer', 'doc', d FROM page)"""
_ROWS = "o_name, kind, '...' AS s_pred, 'user' AS s_type, s_name"
_ALLOWED = """SELECT q.*, (EXISTS (SELECT 1 FROM authors AS e WHERE e.o_name = object_name AND e.u = subject_name))
  OR (object_name IN (SELECT o_name FROM listed) AND NOT (object_name IN (SELECT o_name FROM withheld) AND subject_name IN (SELECT u FROM errors))) AS allowed FROM q"""


def _ask(*statements: str) -> str:
    return f"WITH {_DOCS}, q AS ({' UNION '.join(statements)}) {_ALLOWED}"


_viewer_of = lambda s: Q._tuple("...", "user", s, "viewer", "doc", "concat('d', doc_id)") + " FROM documents"


_FOLD = "SELECT subject_predicate, subject_type, subject_name, relation, object_type, object_name FROM (SELECT *, row_number() OVER (PARTITION BY subject_name, object_name ORDER BY log_id DESC) AS k FROM ({log}) AS l) AS x WHERE k = 1 AND op = 'ADD'"


_JOINS = "j AS (SELECT DISTINCT user_id, event_type FROM events)"


def _sets(holds: str) -> str:
    """A set operation said by membership: who is in either set, decided for every name that one of them
    mentions and for the star, and kept where it differs from the star."""
    inside = lambda s: f"(bool_or(src = '{s}' AND kind = 'pos') OR (bool_or(src = '{s}' AND kind = 'star') AND NOT bool_or(src = '{s}' AND kind = 'neg')))"
    return f"""WITH {_DOCS}, both_sets AS (
  SELECT 'a' AS src, o_name, kind, s_name FROM viewer UNION ALL SELECT 'b', o_name, kind, s_name FROM ({Q.OTHERS}) AS x
), stars AS (
  SELECT DISTINCT src, o_name, kind FROM both_sets WHERE kind = 'star'
), said AS (
  SELECT src, o_name, kind, s_name FROM both_sets
  UNION ALL SELECT stars.src, o_name, 'star', s_name FROM (SELECT DISTINCT o_name, s_name FROM both_sets WHERE s_name <> '*') AS n JOIN stars USING (o_name)
), judged AS (
  SELECT o_name, s_name, {inside("a")} AS a, {inside("b")} AS b FROM said GROUP BY o_name, s_name
), decided AS (
  SELECT o_name, s_name, coalesce({holds}, false) AS held, bool_or(s_name = '*' AND coalesce({holds}, false)) OVER (PARTITION BY o_name) AS starred FROM judged
)
SELECT o_name, CASE WHEN s_name = '*' THEN 'star' WHEN held THEN 'pos' ELSE 'neg' END AS kind, '...' AS s_pred, 'user' AS s_type, s_name
FROM decided WHERE CASE WHEN s_name = '*' THEN held ELSE held <> starred END"""


SQL = {
    "snapshot_scan": f"SELECT relation, object_type, count(*) AS n, count(DISTINCT (subject_predicate, subject_type, subject_name, object_name)) AS n_distinct FROM ({Q.ORG}) AS t GROUP BY relation, object_type",
    "tuple_admission": _ADMITTED,
    "reject_reasons": f"SELECT relation, object_type, CASE WHEN subject_name <> '*' AND NOT {_ID} THEN 'identifier' WHEN relation = 'watcher' OR subject_name = '*' THEN 'restriction' ELSE 'none' END AS reason, count(*) AS n FROM ({Q.RAW}) AS t GROUP BY ALL",
    "pattern_match": f"SELECT DISTINCT subject_predicate, subject_type, subject_name, 'held' AS relation, object_type, object_name FROM ({Q.RAW}) AS t WHERE subject_type = 'user' AND relation = 'owner' AND object_type = 'order' AND subject_name <> '*'",
    "rewrite_fixpoint": _ORG_EDGES.format(tuples=_ADMITTED),
    "direct_multiplicity": f"SELECT *, count(*) AS multiplicity FROM ({_ORG_EDGES.format(tuples=Q.ORG)}) AS e GROUP BY ALL",
    "reference_counts": f"WITH e AS ({_ORG_EDGES.format(tuples=f'SELECT DISTINCT * FROM ({Q.ORG}) AS o')}) SELECT pred, type, name, count(*) AS refcount FROM (SELECT src_pred AS pred, src_type AS type, src_name AS name FROM e UNION ALL SELECT dst_pred, dst_type, dst_name FROM e) AS n GROUP BY ALL",
    "closure": _reach(),
    "path_counts": f"WITH RECURSIVE e AS ({Q.EDGES} UNION ALL SELECT concat('region|r', n_regionkey), concat('customer|c', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey), {_PATHS} SELECT src, dst, count(*) AS paths FROM p GROUP BY src, dst",
    "topo_levels": f"WITH RECURSIVE e AS ({Q.EDGES}), p(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM p JOIN e ON p.node = e.src) SELECT node, max(level) AS level FROM p GROUP BY node",
    "reach_forward": _reach(where="WHERE src LIKE 'region|%'"),
    "reach_reverse": _reach(where="WHERE dst LIKE 'order|%'"),
    "point_reachability": "SELECT 'region|r0' AS src, concat('order|o', o_orderkey) AS dst, coalesce(n_regionkey = 0, false) AS reachable FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "insert_edge_delta": f"WITH RECURSIVE e AS ({Q.EDGES}), {_PATHS} SELECT 'world|w' AS src, dst, count(*) AS paths FROM (SELECT dst FROM p WHERE src LIKE 'region|%' UNION ALL SELECT concat('region|r', r_regionkey) FROM region) AS x GROUP BY dst",
    "remove_edge_delta": f"WITH RECURSIVE e AS (SELECT * FROM ({Q.EDGES}) AS a WHERE src NOT LIKE 'region|%'), {_PATHS} SELECT src, dst, count(*) AS paths FROM p GROUP BY src, dst",
    "remove_node": _reach(edges=f"SELECT * FROM ({Q.EDGES}) AS a WHERE src <> 'nation|n0' AND dst <> 'nation|n0'"),
    "batch_delta": f"WITH RECURSIVE e AS ({Q.EDGES} UNION ALL {Q._BATCH}), {_PATHS} SELECT src, dst, count(*) AS paths FROM p GROUP BY src, dst",
    "remove_node_counts": f"WITH RECURSIVE gone AS ({Q._GONE}), e AS (SELECT * FROM ({Q.EDGES}) AS a WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)), {_PATHS} SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst UNION ALL SELECT node, '', count(*) FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) AS x GROUP BY node",
    "cycle_check": "SELECT concat('customer|c', o_custkey) AS dst, count(*) AS n FROM orders GROUP BY o_custkey",
    "outbox_delta": f"SELECT 'REMOVED' AS action, src, dst FROM ({_reach(where="WHERE dst LIKE 'supplier|%'")}) AS a UNION ALL SELECT 'ADDED', 'world|w', dst FROM (SELECT DISTINCT dst FROM ({_reach(where="WHERE src LIKE 'region|%' AND dst NOT LIKE 'supplier|%'")}) AS b UNION SELECT concat('region|r', r_regionkey) FROM region) AS c",
    "bridges": "SELECT 'member' AS src_pred, 'group' AS src_type, event_type AS src_name, 'member' AS dst_pred, 'group' AS dst_type, '*' AS dst_name FROM (SELECT DISTINCT event_type FROM events) AS e UNION ALL SELECT 'viewer', 'nation', '*all', 'viewer', 'nation', concat('n', n_nationkey) FROM nation",
    "population": f"SELECT DISTINCT * FROM (SELECT subject_type AS type, subject_predicate AS predicate, subject_name AS name FROM ({Q.DOCS}) AS a UNION ALL SELECT object_type, relation, object_name FROM ({Q.DOCS}) AS b) AS n WHERE name <> '*'",
    "wildcard_check": "SELECT '...' AS subject_predicate, 'user' AS subject_type, u AS subject_name, 'viewer' AS relation, 'nation' AS object_type, n AS object_name, u = 'u0' OR u IN (SELECT concat('u', user_id) FROM events) AS allowed FROM (SELECT u, concat('n', n_nationkey) AS n FROM nation, (VALUES ('u0'), ('u1'), ('nobody')) AS v(u) UNION ALL SELECT 'u0', 'atlantis') AS q",
    "check_batch": _ask(_viewer_of("concat('u', doc_id % 150)"), _viewer_of("concat('u', doc_id % 149)")),
    "ghost_check": _ask(_viewer_of("'ghost'"), _viewer_of("'*'")),
    "expand": f"WITH {_DOCS} SELECT 'viewer' AS o_pred, 'doc' AS o_type, {_ROWS} FROM viewer",
    "lookup": f"WITH {_DOCS} SELECT DISTINCT '...' AS s_pred, 'user' AS s_type, u AS s_name, 'viewer' AS o_pred, 'doc' AS o_type, o_name, false AS marker FROM (SELECT u, o_name FROM errors, listed WHERE o_name NOT IN (SELECT o_name FROM withheld) UNION ALL SELECT u, o_name FROM authors JOIN errors USING (u)) AS x",
    "lookup_markers": f"WITH {_DOCS} SELECT kind, '...' AS s_pred, 'user' AS s_type, s_name, 'viewer' AS o_pred, 'doc' AS o_type, o_name FROM viewer WHERE kind = 'star' OR s_name IN (SELECT u FROM errors)",
    "one_subject": f"WITH {_DOCS} SELECT {_ROWS} FROM viewer WHERE kind = 'star' OR s_name IN ('u1', 'u2')",
    "lookup_reverse": f"WITH n AS (SELECT concat('n', n_nationkey) AS o_name, concat('r', n_regionkey) AS r FROM nation), v AS ({Q.VIEWERS}), g AS (SELECT o_name, r, subject_name AS g FROM n JOIN v ON r = object_name), m AS ({Q.MEMBERS}) SELECT DISTINCT 'viewer' AS o_pred, 'nation' AS o_type, o_name, 'pos' AS kind, s_pred, s_type, s_name FROM (SELECT o_name, 'viewer' AS s_pred, 'region' AS s_type, r AS s_name FROM n UNION ALL SELECT o_name, 'member', 'group', g FROM g UNION ALL SELECT o_name, '...', 'user', subject_name FROM g JOIN m ON g = object_name) AS x",
    "inherited_access": f"WITH v AS ({Q.VIEWERS}), m AS ({Q.MEMBERS}) SELECT concat('c', c_custkey) AS o_name, count(DISTINCT m.subject_name) AS n_viewers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN v ON concat('r', n_regionkey) = v.object_name JOIN m ON m.object_name = v.subject_name GROUP BY c_custkey",
    "boolean_exclusion": f"WITH {_DOCS} SELECT {_ROWS} FROM viewer",
    "boolean_intersection": f"WITH {_DOCS} SELECT {_ROWS} FROM pinned",
    "derived_ttu": f"WITH {_DOCS} SELECT * FROM conv_viewer",
    "derived_userset": f"WITH {_DOCS} SELECT * FROM page_reader",
    "stratified_cascade": f"WITH {_DOCS} SELECT o_type, o_pred, kind, count(*) AS n FROM (SELECT 'doc' AS o_type, 'viewer' AS o_pred, kind FROM viewer UNION ALL SELECT 'doc', 'pinned', kind FROM pinned UNION ALL SELECT 'conv', 'viewer', kind FROM conv_viewer UNION ALL SELECT 'page', 'reader', kind FROM page_reader) AS x GROUP BY ALL",
    "set_union": _sets("a OR b"),
    "set_intersect": _sets("a AND b"),
    "set_subtract": _sets("a AND NOT b"),
    "star_normalize": f"WITH {_DOCS} SELECT {_ROWS} FROM viewer WHERE kind <> 'neg'",
    "materialize": f"WITH {_DOCS}, users AS (SELECT concat('u', user_id) AS u FROM events UNION SELECT u FROM authors) SELECT o_name, count(*) AS n FROM (SELECT o_name, u FROM listed, users EXCEPT SELECT o_name, s_name FROM viewer WHERE kind = 'neg' UNION ALL SELECT o_name, s_name FROM viewer WHERE kind = 'pos') AS x GROUP BY o_name",
    "log_fold": f"SELECT subject_predicate, subject_type, subject_name, relation, object_type, object_name FROM (SELECT *, row_number() OVER (PARTITION BY subject_name, object_name ORDER BY log_id DESC) AS k FROM ({Q.LOG}) AS l) AS x WHERE k = 1 AND op = 'ADD'",
    "log_head": f"SELECT coalesce(max(log_id), 0) AS head FROM ({Q.LOG}) AS l",
    "log_tail": f"SELECT log_id, op, subject_name, object_name FROM ({Q.LOG}) AS l WHERE log_id > (SELECT max(event_id) // 2 FROM events)",
    "log_gap": f"SELECT log_id FROM ({Q.LOG}) AS l WHERE op = 'REMOVE'",
    "index_lag": "SELECT count(*) AS lag FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)",
    "outbox_prune": f"SELECT log_id AS id, store_id, op AS action, subject_name AS src, object_name AS dst FROM ({Q.LOG}) AS l WHERE log_id >= (SELECT max(event_id) * 2 // 3 FROM events) OR log_id = (SELECT max(event_id) FROM events)",
    "affected_keys": f"WITH {_DOCS} SELECT 'doc' AS type, r AS relation, o_name AS name FROM withheld, (VALUES ('withheld'), ('viewer'), ('pinned')) AS v(r) UNION ALL SELECT 'conv', r, v FROM conv JOIN withheld ON o_name = d, (VALUES ('viewer'), ('silent')) AS w(r) UNION ALL SELECT 'page', 'reader', v FROM page JOIN withheld ON o_name = d",
    "invariants": f"""WITH {_DOCS} SELECT kind, violations FROM (VALUES ('missing', 0), ('unsupported', 0), ('form', 0), ('deltas', 0)) AS v(kind, violations)
UNION ALL SELECT 'missing_damaged', 2 * (SELECT count(*) FROM supplier)
UNION ALL SELECT 'unsupported_damaged', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'form_damaged', (SELECT count(*) FROM authors JOIN listed USING (o_name)) + (SELECT count(*) FROM authors) + (SELECT count(*) FROM (SELECT o_name, u FROM authors EXCEPT SELECT o_name, u FROM authors JOIN listed USING (o_name)) AS twice)
UNION ALL SELECT 'deltas_damaged', 2 * (SELECT count(*) FROM supplier)""",
    "audit": f"""WITH n(suppliers, nations, docs, regions, loops, errors, idle) AS (SELECT (SELECT count(*) FROM supplier), (SELECT count(*) FROM nation), (SELECT count(*) FROM documents),
  (SELECT count(DISTINCT n_regionkey) FROM nation), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(DISTINCT event_type) FROM events WHERE event_type = 'error'),
  (SELECT count(*) FROM (SELECT op, lag(op, 1, 'REMOVE') OVER (PARTITION BY subject_name, object_name ORDER BY log_id) AS before FROM ({Q.LOG}) AS l) AS x WHERE op = before))
SELECT kind, violations FROM n, LATERAL (VALUES ('counts', 0), ('references', 0), ('cycles', 0), ('bridges', 0), ('placement', 0), ('outbox', 0), ('drift', 0), ('counts_damaged', 2 * suppliers + nations),
  ('references_damaged', suppliers + regions), ('cycles_damaged', loops), ('bridges_damaged', errors + nations), ('placement_damaged', 2 * docs), ('outbox_damaged', idle), ('drift_damaged', 2 * suppliers)) AS v(kind, violations)""",
    "direct_edges": "SELECT 'nation|n0' AS src, concat('customer|c', c_custkey) AS dst, c_nationkey = 0 AS direct FROM customer UNION ALL SELECT 'nation|n0', concat('supplier|s', s_suppkey), s_nationkey = 0 FROM supplier UNION ALL SELECT 'nation|n0', concat('order|o', o_orderkey), false FROM orders",
    "edge_fanout": f"WITH down AS (SELECT src AS dst, count(*) AS d FROM ({_reach(where="WHERE src LIKE 'nation|%'")}) AS r GROUP BY src) SELECT concat('region|r', n_regionkey) AS src, concat('nation|n', n_nationkey) AS dst, coalesce(d, 0) + 1 AS touched FROM nation LEFT JOIN down ON dst = concat('nation|n', n_nationkey)",
    "store_follow": f"SELECT object_name AS o_name, count(*) AS n, min(subject_name) AS least, max(subject_name) AS most FROM ({_FOLD.format(log=Q.LOG)}) AS f GROUP BY object_name",
    "store_outbox": f"SELECT concat('...|user|', subject_name) AS src, concat('member|group|', object_name) AS dst, 1 AS n FROM ({_FOLD.format(log=Q.LOG)}) AS f",
    "store_race": f"WITH {_JOINS} SELECT 1 AS step, CAST(0 AS BIGINT) AS token, count(*) AS n FROM j WHERE event_type = 'purchase' UNION ALL SELECT 2, count(*), count(DISTINCT user_id) FROM j WHERE event_type IN ('view', 'purchase')",
    "store_gap": f"WITH {_JOINS} SELECT CAST(1 AS BIGINT) AS first, count(*) AS last, count(*) FILTER (event_type = 'click') AS missing, true AS refused FROM j WHERE event_type IN ('view', 'click') HAVING missing > 0",
    "store_cascade": f"""WITH {_DOCS.replace("toxic = 1", "toxic = 1 AND doc_id % 3 <> 0")}, freed AS (
  SELECT DISTINCT concat('d', doc_id) AS o_name FROM labels WHERE toxic = 1 AND doc_id % 3 = 0
), sets AS (
  SELECT 'doc' AS o_type, r AS o_pred, o_name FROM freed, (VALUES ('withheld'), ('viewer'), ('pinned')) AS v(r)
  UNION ALL SELECT 'conv', r, v FROM conv JOIN freed ON o_name = d, (VALUES ('viewer'), ('silent')) AS w(r)
  UNION ALL SELECT 'page', 'reader', v FROM page JOIN freed ON o_name = d
), written AS (
  SELECT 'doc' AS o_type, 'viewer' AS o_pred, o_name FROM viewer UNION ALL SELECT 'doc', 'pinned', o_name FROM pinned
  UNION ALL SELECT 'conv', 'viewer', o_name FROM conv_viewer UNION ALL SELECT 'page', 'reader', o_name FROM page_reader
), counted AS (
  SELECT o_type, o_pred, o_name, count(*) AS n FROM written GROUP BY ALL
)
SELECT o_type, o_pred, count(*) AS n_sets, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM sets LEFT JOIN counted USING (o_type, o_pred, o_name) GROUP BY ALL""",
    "store_replay": _FOLD.format(log=f"SELECT * FROM ({Q.LOG}) AS h WHERE log_id <= (SELECT max(event_id) // 2 FROM events)"),
}
SQL |= {"probe_check": SQL["check_batch"], "probe_reverse": SQL["expand"]}
SQL |= {
    "symbolic_check": SQL["check_batch"],
    "symbolic_lookup": SQL["lookup"],
    "symbolic_rows": f"""WITH t AS (SELECT DISTINCT * FROM ({Q.DOCS}) AS x)
SELECT concat(object_type, '#', relation) AS rel, CASE WHEN relation = 'reader' THEN 0 ELSE -1 END AS leaf, count(*) AS n FROM t WHERE relation <> 'topic' GROUP BY ALL
UNION ALL SELECT 'conv#topic', -1, count(*) FROM t WHERE relation = 'topic' HAVING count(*) > 0
UNION ALL SELECT rel, leaf, count(*) FROM t, (VALUES ('conv#viewer', 0), ('conv#silent', 1)) AS v(rel, leaf) WHERE relation = 'topic' GROUP BY ALL
UNION ALL SELECT 'doc#shelved', -1, count(*) FROM (SELECT object_name, 'viewer' AS p, subject_name FROM t WHERE relation = 'parent' UNION SELECT d.object_name, 'member', f.subject_name FROM t AS d JOIN t AS f ON d.relation = 'parent' AND f.object_type = 'folder' AND f.object_name = d.subject_name) AS s HAVING count(*) > 0
UNION ALL SELECT 'group#member', NULL, count(*) FROM t WHERE relation = 'member' HAVING count(*) > 0""",
}
