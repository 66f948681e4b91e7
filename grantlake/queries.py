"""Registered queries of the relation engine over the star-schema tables.

Relation tuples are derived from whole tables by the statements below, which the SQL
of ``grantlake.query_sql`` uses as they are; everything after that is this
package's operators here and plain SQL there."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE, matches, replace
from grantlake.operators import closure as C
from grantlake.operators import engine as E
from grantlake.operators import invariants as I
from grantlake.operators import members as M
from grantlake.operators import rewrite as R
from grantlake.operators import shared as S
from grantlake.operators.incremental import affected, touched
from grantlake.operators.symbolic import Symbolic, rel_of
from grantlake.plans.compile import compile_schema
from grantlake.plans.errors import LogGap
from grantlake.plans.schema import parse
from grantlake.sources import tables as T
from grantlake.sources.probes import Probes
from grantlake.sources.storage import cut, numbered, shared_dir
from grantlake.streaming.store import Store

_T = "'{sp}' AS subject_predicate, '{st}' AS subject_type, {s} AS subject_name, '{r}' AS relation, '{ot}' AS object_type, {o} AS object_name"


def _tuple(sp: str, st: str, s: str, r: str, ot: str, o: str) -> str:
    return "SELECT " + _T.format(sp=sp, st=st, s=s, r=r, ot=ot, o=o)


#: Where each kind of tuple comes from: containment, ownership, groups and documents.
PARENTS = {
    "region_nation": _tuple("...", "region", "concat('r', n_regionkey)", "parent", "nation", "concat('n', n_nationkey)") + " FROM nation",
    "nation_customer": _tuple("...", "nation", "concat('n', c_nationkey)", "parent", "customer", "concat('c', c_custkey)") + " FROM customer",
    "nation_supplier": _tuple("...", "nation", "concat('n', s_nationkey)", "parent", "supplier", "concat('s', s_suppkey)") + " FROM supplier",
    "customer_order": _tuple("...", "customer", "concat('c', o_custkey)", "parent", "order", "concat('o', o_orderkey)") + " FROM orders",
}
OWNERS = _tuple("...", "user", "concat('u', o_custkey)", "owner", "order", "concat('o', o_orderkey)") + " FROM orders"
MEMBERS = _tuple("...", "user", "concat('u', user_id)", "member", "group", "event_type") + " FROM (SELECT DISTINCT user_id, event_type FROM events) AS e"
VIEWERS = _tuple("member", "group", "g", "viewer", "region", "concat('r', k)") + " FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3), ('error', 4)) AS v(g, k)"
PLACED = _tuple("...", "folder", "source", "parent", "doc", "concat('d', doc_id)") + " FROM documents"
FOLDERS = _tuple("member", "group", "g", "viewer", "folder", "k") + " FROM (VALUES ('view', 'src0'), ('click', 'src1'), ('purchase', 'src2')) AS v(g, k)"
LISTED = _tuple("...", "user", "'*'", "listed", "doc", "concat('d', doc_id)") + " FROM labels WHERE quality = 1"
WITHHELD = _tuple("member", "group", "'error'", "withheld", "doc", "concat('d', doc_id)") + " FROM labels WHERE toxic = 1"
AUTHORS = _tuple("...", "user", "concat('u', doc_id % 150)", "author", "doc", "concat('d', doc_id)") + " FROM documents"
TOPICS = _tuple("...", "doc", "concat('d', conv_id)", "topic", "conv", "concat('v', conv_id)") + " FROM (SELECT DISTINCT conv_id FROM conversations) AS c"
READERS = _tuple("viewer", "doc", "concat('d', page_id)", "reader", "page", "concat('p', page_id)") + " FROM pages"
#: Tuples as they might come in: names with a character that is not allowed, an undeclared relation.
RAW = " UNION ALL ".join(
    [OWNERS, _tuple("...", "user", "c_name", "owner", "customer", "concat('c', c_custkey)") + " FROM customer", _tuple("...", "user", "concat('u', o_custkey)", "watcher", "order", "concat('o', o_orderkey)") + " FROM orders WHERE o_orderstatus = 'F'", PARENTS["region_nation"], _tuple("...", "user", "'*'", "owner", "order", "concat('o', o_orderkey)") + " FROM orders WHERE o_orderstatus = 'P'"]
)
#: A log of joining and leaving.
LOG = "SELECT event_id AS log_id, 'main' AS store_id, CASE WHEN event_type IN ('error', 'click') THEN 'REMOVE' ELSE 'ADD' END AS op, " + _T.format(sp="...", st="user", s="concat('u', user_id)", r="member", ot="group", o="concat('g', user_id % 7)") + ", CAST(0 AS DOUBLE) AS created_at FROM events"
ORG = " UNION ALL ".join([*PARENTS.values(), OWNERS])
ACCESS = " UNION ALL ".join([PARENTS["region_nation"], PARENTS["nation_customer"], MEMBERS, VIEWERS])
DOCS = " UNION ALL ".join([MEMBERS, LISTED, WITHHELD, AUTHORS, PLACED, FOLDERS, TOPICS, READERS])
EDGES = " UNION ALL ".join(f"SELECT concat(subject_type, '|', subject_name) AS src, concat(object_type, '|', object_name) AS dst FROM ({p}) AS t" for p in PARENTS.values())

_TOXIC = "(SELECT DISTINCT doc_id AS d FROM labels WHERE toxic = 1)"
#: Canonical member sets beside those of documents' viewers.
OTHERS = f"""SELECT concat('d', d) AS o_name, 'star' AS kind, '...' AS s_pred, 'user' AS s_type, '*' AS s_name FROM {_TOXIC} AS t
UNION ALL SELECT concat('d', doc_id), CASE WHEN d IS NULL THEN 'pos' ELSE 'neg' END, '...', 'user', concat('u', (doc_id + k) % 150)
FROM documents LEFT JOIN {_TOXIC} AS t ON doc_id = d CROSS JOIN (VALUES (0), (149)) AS v(k)"""

ORG_SCHEMA = """
type user
type region
type nation
  relations
    define parent: [region]
type customer
  relations
    define parent: [nation]
    define owner: [user]
type supplier
  relations
    define parent: [nation]
type order
  relations
    define parent: [customer]
    define owner: [user]
    define reader: owner
    define held: owner or reader
"""

ACCESS_SCHEMA = """
type user
type group
  relations
    define member: [user]
type region
  relations
    define viewer: [group#member]
type nation
  relations
    define parent: [region]
    define viewer: viewer from parent
type customer
  relations
    define parent: [nation]
    define viewer: viewer from parent
"""

DOC_SCHEMA = """
type user
type group
  relations
    define member: [user]
type folder
  relations
    define viewer: [group#member]
type doc
  relations
    define parent: [folder]
    define author: [user]
    define withheld: [group#member]
    define listed: [user:*]
    define pinned: listed and (author or withheld)
    define shelved: viewer from parent
    define viewer: (listed or author) but not (withheld but not author)
type conv
  relations
    define topic: [doc]
    define viewer: viewer from topic
    define silent: [user] but not (pinned from topic)
type page
  relations
    define reader: [doc#viewer]
"""

_TABLES = ("nation", "customer", "supplier", "orders", "events", "documents", "labels", "pages", "conversations", "region")


def load(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run one of the statements above over the tables of ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"FROM {t}\b", statement)}
    for name in frames:
        statement = re.sub(rf"FROM {name}\b", f"FROM {{{name}}}", statement)
    return spark.sql(statement, **frames)


def _engine(spark, sf_dir, statement, schema) -> E.Engine:
    return E.Engine(schema, load(spark, sf_dir, statement))


def _docs(spark, sf_dir) -> E.Engine:
    return _engine(spark, sf_dir, DOCS, DOC_SCHEMA)


def _edges(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, EDGES)


def snapshot_scan(spark, sf_dir):
    return load(spark, sf_dir, ORG).groupBy("relation", "object_type").agg(F.count("*").alias("n"), F.countDistinct(*TUPLE).alias("n_distinct"))


def tuple_admission(spark, sf_dir):
    return R.admit(load(spark, sf_dir, RAW), compile_schema(parse(ORG_SCHEMA)))


def reject_reasons(spark, sf_dir):
    rows = R.reject_reasons(load(spark, sf_dir, RAW), compile_schema(parse(ORG_SCHEMA)))
    return rows.groupBy("relation", "object_type", F.coalesce("reject_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def pattern_match(spark, sf_dir):
    """Strict pattern match and replacement: concrete owners of orders, moved to another relation."""
    rows = load(spark, sf_dir, RAW).where(matches({"subject_type": "user", "subject_name": None, "relation": "owner", "object_type": "order"}))
    return rows.select(*replace({"relation": "held"})).distinct()


def rewrite_fixpoint(spark, sf_dir):
    c = compile_schema(parse(ORG_SCHEMA))
    return R.derive_edges(R.admit(load(spark, sf_dir, RAW), c), c)


def direct_multiplicity(spark, sf_dir):
    c = compile_schema(parse(ORG_SCHEMA))
    return R.multiplicity(R.derive_edges(load(spark, sf_dir, ORG), c))


def reference_counts(spark, sf_dir):
    c = compile_schema(parse(ORG_SCHEMA))
    return R.reference_counts(R.derive_edges(R.admit(load(spark, sf_dir, ORG), c), c))


def closure(spark, sf_dir):
    return C.reach(_edges(spark, sf_dir))


def path_counts(spark, sf_dir):
    edges = _edges(spark, sf_dir).union(load(spark, sf_dir, f"SELECT concat('region|r', n_regionkey) AS src, concat('customer|c', c_custkey) AS dst FROM (SELECT * FROM customer) AS c JOIN (SELECT * FROM nation) AS n ON c_nationkey = n_nationkey"))
    return C.path_counts(edges.groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))).select("src", "dst", F.col("paths").cast("long").alias("paths"))


def topo_levels(spark, sf_dir):
    return C.levels(_edges(spark, sf_dir))[0]


def reach_forward(spark, sf_dir):
    regions = load(spark, sf_dir, "SELECT concat('region|r', r_regionkey) AS node FROM region")
    return C.reach(_edges(spark, sf_dir), sources=regions)


def reach_reverse(spark, sf_dir):
    orders = load(spark, sf_dir, "SELECT concat('order|o', o_orderkey) AS node FROM orders")
    return C.reach(_edges(spark, sf_dir), targets=orders)


def point_reachability(spark, sf_dir):
    """For every order, is it in region r0?"""
    asked = load(spark, sf_dir, "SELECT 'region|r0' AS src, concat('order|o', o_orderkey) AS dst FROM orders")
    found = C.reach(_edges(spark, sf_dir), sources=asked.select(F.col("src").alias("node"))).withColumn("reachable", F.lit(True))
    return asked.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("reachable", F.lit(False)).alias("reachable"))


_NEW = "SELECT 'world|w' AS src, concat('region|r', r_regionkey) AS dst FROM region"


def direct_edges(spark, sf_dir):
    """Which customers and suppliers does nation n0 hold directly, and which orders?"""
    asked = load(spark, sf_dir, "SELECT 'nation|n0' AS src, concat('customer|c', c_custkey) AS dst FROM customer UNION ALL SELECT 'nation|n0' AS src, concat('supplier|s', s_suppkey) AS dst FROM supplier UNION ALL SELECT 'nation|n0' AS src, concat('order|o', o_orderkey) AS dst FROM orders")
    return C.has_edges(_edges(spark, sf_dir), asked)


def edge_fanout(spark, sf_dir):
    """How many closure rows a new edge from a world to each nation would touch."""
    asked = load(spark, sf_dir, "SELECT concat('region|r', n_regionkey) AS src, concat('nation|n', n_nationkey) AS dst FROM nation")
    return C.fanout(C.reach(_edges(spark, sf_dir)), asked)


def insert_edge_delta(spark, sf_dir):
    """What new edges above all regions add to the path counts."""
    counts = cut(C.path_counts(_edges(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))))
    return C.edge_effect(counts, load(spark, sf_dir, _NEW)).select("src", "dst", F.col("paths").cast("long").alias("paths"))


def remove_edge_delta(spark, sf_dir):
    """The path counts without the edges from regions to nations."""
    edges = _edges(spark, sf_dir)
    counts = cut(C.path_counts(edges.groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))))
    return C.remove_edges(counts, edges.where("src like 'region|%'")).select("src", "dst", F.col("paths").cast("long").alias("paths"))


def remove_node(spark, sf_dir):
    return C.reach(C.remove_node(_edges(spark, sf_dir), "nation|n0"))


#: Edges that depend on each other: two levels above the regions, and from regions straight to customers.
_BATCH = "SELECT 'galaxy|g' AS src, 'world|w' AS dst FROM (SELECT min(r_regionkey) AS k FROM region) AS x UNION ALL SELECT 'world|w' AS src, concat('region|r', r_regionkey) AS dst FROM region UNION ALL SELECT concat('region|r', n_regionkey) AS src, concat('customer|c', c_custkey) AS dst FROM (SELECT * FROM customer) AS c JOIN (SELECT * FROM nation) AS n ON c_nationkey = n_nationkey"
_GONE = "SELECT concat('region|r', r_regionkey) AS node FROM region WHERE r_regionkey = 0 UNION ALL SELECT concat('nation|n', n_nationkey) AS node FROM nation WHERE n_nationkey % 5 = 0"


def _multi(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("src", "dst").agg(F.count("*").alias("multiplicity")))


def batch_delta(spark, sf_dir):
    """Path counts maintained under a batch of new edges of which some lead into others."""
    edges = _multi(_edges(spark, sf_dir))
    return C.add_batch(C.path_counts(edges), edges, _multi(load(spark, sf_dir, _BATCH))).select("src", "dst", F.col("paths").cast("long").alias("paths"))


def remove_node_counts(spark, sf_dir):
    """Path counts and reference counts after a region and some nations, partly its own, are gone."""
    edges = _multi(_edges(spark, sf_dir))
    sides = edges.select(F.explode(F.array("src", "dst")).alias("node"), "multiplicity").groupBy("node").agg(F.sum("multiplicity").alias("refcount"))
    counts, references = C.remove_nodes(C.path_counts(edges), sides, edges, load(spark, sf_dir, _GONE))
    return counts.select("src", "dst", F.col("paths").cast("long").alias("n")).unionByName(references.select(F.col("node").alias("src"), F.lit("").alias("dst"), F.col("refcount").alias("n")))


def cycle_check(spark, sf_dir):
    """Edges from every order back to its customer close a cycle; edges to a new node do not."""
    back = load(spark, sf_dir, "SELECT concat('order|o', o_orderkey) AS src, concat('customer|c', o_custkey) AS dst FROM orders UNION ALL SELECT concat('order|o', o_orderkey) AS src, 'sink|x' AS dst FROM orders")
    return C.closes_cycle(C.reach(_edges(spark, sf_dir)), back).groupBy("dst").agg(F.count("*").alias("n"))


def outbox_delta(spark, sf_dir):
    """Reachability that goes when suppliers go and comes when a world joins."""
    before = _edges(spark, sf_dir)
    after = before.where("dst not like 'supplier|%'").union(load(spark, sf_dir, _NEW))
    return C.flips(C.reach(before), C.reach(after))


GROUP_SCHEMA = """
type user
type group
  relations
    define member: [user]
"""

WILD_SCHEMA = """
type user
type group
  relations
    define member: [user]
type region
  relations
    define viewer: [group:*#member]
type nation
  relations
    define parent: [region]
    define viewer: [user] or viewer from parent
"""
_WILD = " UNION ALL ".join([MEMBERS, PARENTS["region_nation"], _tuple("member", "group", "'*'", "viewer", "region", "concat('r', r_regionkey)") + " FROM region", _tuple("...", "user", "'u0'", "viewer", "nation", "'*'") + " FROM (SELECT min(n_nationkey) AS k FROM nation) AS x"])
_WILD_SHAPES = {("nation", "viewer")}


def bridges(spark, sf_dir):
    c = compile_schema(parse(WILD_SCHEMA, _WILD_SHAPES))
    return R.bridges(load(spark, sf_dir, _WILD), c)


def population(spark, sf_dir):
    return R.population(load(spark, sf_dir, DOCS))


def wildcard_check(spark, sf_dir):
    """Users against all nations where any group's members see every region, and u0 every nation."""
    engine = _engine(spark, sf_dir, _WILD, parse(WILD_SCHEMA, _WILD_SHAPES))
    asked = load(spark, sf_dir, _tuple("...", "user", "u", "viewer", "nation", "concat('n', n_nationkey)") + " FROM nation, (VALUES ('u0'), ('u1'), ('nobody')) AS v(u) UNION ALL " + _tuple("...", "user", "'u0'", "viewer", "nation", "'atlantis'") + " FROM (SELECT min(n_nationkey) AS k FROM nation) AS x")
    return engine.check(asked)


def check_batch(spark, sf_dir):
    """Does each document's author, and does a ghost, view it?"""
    asked = load(spark, sf_dir, _tuple("...", "user", "concat('u', doc_id % 150)", "viewer", "doc", "concat('d', doc_id)") + " FROM documents UNION ALL " + _tuple("...", "user", "concat('u', doc_id % 149)", "viewer", "doc", "concat('d', doc_id)") + " FROM documents")
    return _docs(spark, sf_dir).check(asked.distinct())


def ghost_check(spark, sf_dir):
    asked = load(spark, sf_dir, _tuple("...", "user", "'ghost'", "viewer", "doc", "concat('d', doc_id)") + " FROM documents UNION ALL " + _tuple("...", "user", "'*'", "viewer", "doc", "concat('d', doc_id)") + " FROM documents")
    return _docs(spark, sf_dir).check(asked)


def _objects(spark, sf_dir, relation):
    return load(spark, sf_dir, f"SELECT '{relation}' AS o_pred, 'doc' AS o_type, concat('d', doc_id) AS o_name FROM documents")


def expand(spark, sf_dir):
    return S.expand(_docs(spark, sf_dir), _objects(spark, sf_dir, "viewer"))


def lookup(spark, sf_dir):
    """All that the users with errors reach in documents' viewer."""
    users = load(spark, sf_dir, "SELECT DISTINCT '...' AS s_pred, 'user' AS s_type, concat('u', user_id) AS s_name FROM events WHERE event_type = 'error'")
    return S.lookup(_docs(spark, sf_dir), users, [("doc", "viewer")])


def lookup_markers(spark, sf_dir):
    """The same with listed documents as one row each, and each user's exceptions."""
    users = load(spark, sf_dir, "SELECT DISTINCT '...' AS s_pred, 'user' AS s_type, concat('u', user_id) AS s_name FROM events WHERE event_type = 'error'")
    return S.lookup_markers(_docs(spark, sf_dir), users, [("doc", "viewer")])


def symbolic_check(spark, sf_dir):
    """The questions of ``check_batch`` put to a model that names usersets instead of their members."""
    asked = load(spark, sf_dir, _tuple("...", "user", "concat('u', doc_id % 150)", "viewer", "doc", "concat('d', doc_id)") + " FROM documents UNION ALL " + _tuple("...", "user", "concat('u', doc_id % 149)", "viewer", "doc", "concat('d', doc_id)") + " FROM documents")
    return Symbolic.build(_docs(spark, sf_dir)).check(asked.distinct())


def symbolic_lookup(spark, sf_dir):
    """What the users with errors reach in documents' viewer, from such a model."""
    users = load(spark, sf_dir, "SELECT DISTINCT '...' AS s_pred, 'user' AS s_type, concat('u', user_id) AS s_name FROM events WHERE event_type = 'error'")
    return Symbolic.build(_docs(spark, sf_dir)).lookup(users, [("doc", "viewer")])


def symbolic_rows(spark, sf_dir):
    """How many rows such a model has, by relation and leaf, and how many memberships of groups (leaf null)."""
    symbolic = Symbolic.build(_docs(spark, sf_dir))
    grants = symbolic.grants.groupBy("rel", "leaf").agg(F.count("*").alias("n"))
    held = symbolic.held.groupBy(rel_of(F.col("dst")).alias("rel"), F.lit(None).cast("int").alias("leaf")).agg(F.count("*").alias("n"))
    return grants.unionByName(held)


def one_subject(spark, sf_dir):
    """The boolean relation doc#viewer evaluated anew for two users alone."""
    users = spark.createDataFrame([("...", "user", "u1"), ("...", "user", "u2")], "s_pred string, s_type string, s_name string")
    return _docs(spark, sf_dir).evaluate(("doc", "viewer"), users)


def lookup_reverse(spark, sf_dir):
    nations = load(spark, sf_dir, "SELECT 'viewer' AS o_pred, 'nation' AS o_type, concat('n', n_nationkey) AS o_name FROM nation")
    return _engine(spark, sf_dir, ACCESS, ACCESS_SCHEMA).lookup_reverse(nations)


def inherited_access(spark, sf_dir):
    """Viewers of every customer, inherited from nation and region."""
    viewers = S.share(_engine(spark, sf_dir, ACCESS, ACCESS_SCHEMA), [("customer", "viewer")], about=F.col("s_type") == "user")
    return viewers.sizes().select("o_name", F.col("n").alias("n_viewers"))


def _derived(key):
    def query(spark, sf_dir):
        return S.share(_docs(spark, sf_dir), [key]).model().select("o_name", "kind", *M.SUBJECT)

    return query


boolean_exclusion = _derived(("doc", "viewer"))
boolean_intersection = _derived(("doc", "pinned"))
derived_ttu = _derived(("conv", "viewer"))
derived_userset = _derived(("page", "reader"))


def stratified_cascade(spark, sf_dir):
    """Member rows of every relation that depends on a boolean, by kind."""
    sets = S.share(_docs(spark, sf_dir), [("doc", "viewer"), ("doc", "pinned"), ("conv", "viewer"), ("page", "reader")])
    return sets.sizes("kind").groupBy("o_type", "o_pred", "kind").agg(F.sum("n").alias("n"))


def _sets(spark, sf_dir):
    """Two member sets for each document, with stars, exceptions and members on both sides: viewers,
    and (where the label is toxic) all but the document's own user and the one before, or else these two."""
    others = load(spark, sf_dir, OTHERS).select(F.lit("viewer").alias("o_pred"), F.lit("doc").alias("o_type"), "o_name", "kind", *M.SUBJECT)
    return S.share(_docs(spark, sf_dir), [("doc", "viewer")]).together(others)


def _of_both(placed: DataFrame, people: DataFrame, rows: DataFrame) -> DataFrame:
    """What was found for one document and one user of each class, for all of them."""
    return S.unfold(placed, cut(rows.withColumnRenamed("o_name", "rep")), people).select("o_name", "kind", *M.SUBJECT)


def set_union(spark, sf_dir):
    placed, people, a, b = _sets(spark, sf_dir)
    return _of_both(placed, people, M.union(a, b, E.OBJECT))


def set_intersect(spark, sf_dir):
    placed, people, a, b = _sets(spark, sf_dir)
    return _of_both(placed, people, M.intersect(a, b, E.OBJECT))


def set_subtract(spark, sf_dir):
    placed, people, a, b = _sets(spark, sf_dir)
    return _of_both(placed, people, M.subtract(a, b, E.OBJECT))


def star_normalize(spark, sf_dir):
    """The union of stars and authors in canonical form."""
    engine = _docs(spark, sf_dir).focus([("doc", "listed"), ("doc", "author")])
    return M.normalize(engine.of(("doc", "listed")).union(engine.of(("doc", "author"))), ["o_name"])


def materialize(spark, sf_dir):
    """How many of the users that tuples mention view each document."""
    engine = _docs(spark, sf_dir)
    users = R.instances(engine.tuples).where("type = 'user'").select(F.lit("...").alias("s_pred"), F.col("type").alias("s_type"), F.col("name").alias("s_name"))
    return S.share(engine, [("doc", "viewer")]).members(users).select("o_name", "n")


def log_fold(spark, sf_dir):
    return T.fold_log(load(spark, sf_dir, LOG)).select(*TUPLE)


def log_head(spark, sf_dir):
    return T.log_head(load(spark, sf_dir, LOG))


def log_tail(spark, sf_dir):
    """Rows past a cursor at half of the head."""
    log = load(spark, sf_dir, LOG)
    return T.log_tail(log, T.log_head(log).first()[0] // 2).select("log_id", "op", "subject_name", "object_name")


def log_gap(spark, sf_dir):
    """Rows that a reader which applied only ADDs has passed over."""
    log = load(spark, sf_dir, LOG)
    return T.log_gaps(log, log.where("op = 'ADD'"), T.log_head(log).first()[0]).select("log_id")


def index_lag(spark, sf_dir):
    log = load(spark, sf_dir, LOG)
    return T.log_lag(log, T.log_head(log).first()[0] // 2)


def outbox_prune(spark, sf_dir):
    """Changes of the log as an outbox, drained up to its last third."""
    log = load(spark, sf_dir, LOG).select(F.col("log_id").alias("id"), "store_id", F.col("op").alias("action"), F.col("subject_name").alias("src"), F.col("object_name").alias("dst"))
    return T.prune(log, T.outbox_head(log).first()[0] * 2 // 3)


def affected_keys(spark, sf_dir):
    """The sets that may change when no document is withheld any more."""
    engine = _docs(spark, sf_dir)
    return affected(engine.compiled, engine.stored, touched(engine.compiled, load(spark, sf_dir, WITHHELD)))


def invariants(spark, sf_dir):
    """Violations of each kind in sound state (none) and in state with planted damage: a closure without its
    pairs into suppliers and with every supplier above its nation, member sets with
    authors put in again under stars and exceptions without them, deltas that lack the supplier rows."""
    edges = cut(_edges(spark, sf_dir))
    reached, viewers = C.reach(edges), S.share(_docs(spark, sf_dir), [("doc", "viewer")])
    kept = reached.where("dst like 'nation|%'")
    deltas = cut(C.flips(reached, kept))
    author = load(spark, sf_dir, AUTHORS).select(F.lit("viewer").alias("o_pred"), F.lit("doc").alias("o_type"), F.col("object_name").alias("o_name"), F.lit("pos").alias("kind"), F.lit("...").alias("s_pred"), F.lit("user").alias("s_type"), F.col("subject_name").alias("s_name"))
    upward = edges.where("dst like 'supplier|%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    # form is a matter of one set and of one shape, so documents that are alike are judged by one of them, and by one of users that are
    placed, people, model, authors = viewers.together(author)
    many = placed.groupBy("o_pred", "o_type", F.col("rep").alias("o_name")).agg(F.count("*").alias("objects"))
    some = people.groupBy(*M.SHAPE, F.col("s_rep").alias("s_name")).agg(F.count("*").alias("subjects"))
    faults = lambda rows: I.uncanonical(rows).join(many, list(E.OBJECT)).join(some, list(M.SUBJECT)).select(*E.ROW, (F.col("objects") * F.col("subjects")).alias("many"))
    starless = author.withColumn("kind", F.lit("neg")).withColumn("o_pred", F.lit("starless"))
    kinds = {
        "missing": I.missing_steps(reached, edges),
        "missing_damaged": I.missing_steps(reached.where("dst not like 'supplier|%'"), edges),
        "unsupported": I.unsupported_pairs(reached, edges),
        "unsupported_damaged": I.unsupported_pairs(reached.union(upward), edges),
        "form": faults(model),
        "form_damaged": faults(model.unionByName(authors)).unionByName(I.uncanonical(starless).withColumn("many", F.lit(1).cast("long"))),
        "deltas": I.wrong_deltas(deltas, reached, kept),
        "deltas_damaged": I.wrong_deltas(deltas.where("dst not like 'supplier|%'"), reached, kept),
    }
    number = lambda df: F.coalesce(F.sum("many"), F.lit(0)) if "many" in df.columns else F.count("*")
    return reduce(DataFrame.union, [df.agg(number(df).alias("violations")).select(F.lit(k).alias("kind"), "violations") for k, df in kinds.items()])


def audit(spark, sf_dir):
    """More violations, in sound state and in planted damage: counts of supplier pairs put to 0 and of nations dropped; a
    reference too many for each supplier and none for regions; loops at finished orders; bridges of the group ``error`` gone and
    of nations added; rows of no relation and stars with a name; an outbox that follows events as they
    come, and one that lacks the suppliers."""
    edges = _multi(_edges(spark, sf_dir))
    counts, reached = C.path_counts(edges), C.reach(edges.select("src", "dst"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    references = ends.groupBy("node").agg(F.count("*").alias("refcount"))
    supplier = lambda c: F.col(c).like("supplier|%")
    loops = load(spark, sf_dir, "SELECT concat('order|o', o_orderkey) AS src, concat('order|o', o_orderkey) AS dst, 1 AS multiplicity FROM orders WHERE o_orderstatus = 'F'")
    wild = _engine(spark, sf_dir, _WILD, parse(WILD_SCHEMA, _WILD_SHAPES))
    starred = wild.edges()
    added = load(spark, sf_dir, "SELECT concat('viewer|nation|n', n_nationkey) AS src, 'viewer|nation|*' AS dst FROM nation")
    docs = _docs(spark, sf_dir).focus([("group", "member")])
    model = docs.model()
    author = load(spark, sf_dir, AUTHORS).select(F.lit("author").alias("o_pred"), F.lit("doc").alias("o_type"), F.col("object_name").alias("o_name"), F.lit("star").alias("kind"), F.lit("...").alias("s_pred"), F.lit("user").alias("s_type"), F.col("subject_name").alias("s_name"))
    nowhere = author.withColumn("kind", F.lit("pos")).withColumn("o_pred", F.lit("nothing"))
    outbox = numbered(C.flips(reached.limit(0), reached), 0, ["action", "src", "dst"], "id")
    events = load(spark, sf_dir, LOG).select(F.col("log_id").alias("id"), F.when(F.col("op") == "ADD", "ADDED").otherwise("REMOVED").alias("action"), F.col("subject_name").alias("src"), F.col("object_name").alias("dst"))
    kinds = {
        "counts": I.miscounted(counts, edges),
        "counts_damaged": I.miscounted(counts.where("dst not like 'nation|%'").withColumn("paths", F.when(supplier("dst"), 0).otherwise(F.col("paths"))), edges),
        "references": I.wrong_references(references, edges),
        "references_damaged": I.wrong_references(references.where("node not like 'region|%'").withColumn("refcount", F.col("refcount") + supplier("node").cast("int")), edges),
        "cycles": I.looped(edges),
        "cycles_damaged": I.looped(edges.select("src", "dst").union(loops.select("src", "dst"))),
        "bridges": I.wrong_bridges(starred, wild.stored, wild.compiled),
        "bridges_damaged": I.wrong_bridges(starred.where("src <> 'member|group|error'").union(added), wild.stored, wild.compiled),
        "placement": I.misplaced(model, docs.compiled),
        "placement_damaged": I.misplaced(model.unionByName(author).unionByName(nowhere), docs.compiled),
        "outbox": I.unsound_outbox(outbox),
        "outbox_damaged": I.unsound_outbox(events),
        "drift": I.outbox_drift(outbox, reached),
        "drift_damaged": I.outbox_drift(outbox.where(~supplier("dst")), reached),
    }
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("kind"), "violations") for k, df in kinds.items()])


def _laid_out(spark, sf_dir) -> Probes:
    """The model of documents' viewers, laid out for probes."""
    return Probes.write(S.share(_docs(spark, sf_dir), [("doc", "viewer")]), f"{shared_dir(spark)}/grantlake-probes-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def probe_check(spark, sf_dir):
    """The questions of ``check_batch`` put to a model that is laid out for them."""
    asked = load(spark, sf_dir, " UNION ALL ".join(_tuple("...", "user", f"concat('u', doc_id % {n})", "viewer", "doc", "concat('d', doc_id)") + " FROM documents" for n in (150, 149)))
    return _laid_out(spark, sf_dir).check(asked.distinct())


def probe_reverse(spark, sf_dir):
    """Members, stars and exceptions of every document's viewers, read from the layout by object."""
    return _laid_out(spark, sf_dir).lookup_reverse(_objects(spark, sf_dir, "viewer"))


def _store(spark, sf_dir, tuples: str, schema: str):
    """A store whose log is written in two files (in no order of ids), then followed file by file."""
    store = Store(spark, f"{shared_dir(spark)}/grantlake-store-{uuid.uuid4().hex}", parse(schema))
    T.append_log(load(spark, sf_dir, tuples).repartition(2, "object_name"), f"{store.path}/log")
    store.advance(files=1)
    return store


def store_follow(spark, sf_dir):
    """The log of joining and leaving, followed by a store: members of each group in its newest version."""
    rows = _store(spark, sf_dir, LOG, GROUP_SCHEMA).model()
    return rows.groupBy("o_name").agg(F.count("*").alias("n"), F.min("s_name").alias("least"), F.max("s_name").alias("most"))


def store_outbox(spark, sf_dir):
    """What came and went over all versions of that store: added less removed is what is there."""
    rows = _store(spark, sf_dir, LOG, GROUP_SCHEMA).outbox()
    return rows.groupBy("src", "dst").agg(F.sum(F.when(F.col("action") == "ADDED", 1).otherwise(-1)).alias("n")).where("n <> 0")


def store_replay(spark, sf_dir):
    """The state at a cursor: the log folded up to half of its head."""
    log = load(spark, sf_dir, LOG)
    return T.fold_log(log.where(F.col("log_id") <= T.log_head(log).first()[0] // 2)).select(*TUPLE)


def _joins(spark, sf_dir, kind: str) -> DataFrame:
    """Who joins which group by events of one kind."""
    return load(spark, sf_dir, _tuple("...", "user", "concat('u', user_id)", "member", "group", "concat('g', user_id % 7)") + f" FROM (SELECT DISTINCT user_id, event_type FROM events) AS e WHERE event_type = '{kind}'")


def _new_store(spark, schema: str) -> Store:
    return Store(spark, f"{shared_dir(spark)}/grantlake-store-{uuid.uuid4().hex}", parse(schema))


def store_race(spark, sf_dir):
    """Two writers, of whom the one with the lower ids logs last: token and members once only the other has logged, and at the end."""
    store, views, buys = _new_store(spark, GROUP_SCHEMA), _joins(spark, sf_dir, "view"), _joins(spark, sf_dir, "purchase")
    slow, fast = store.ids.reserve(views.count()), store.ids.reserve(buys.count())
    steps = []
    for step, (mine, rows) in enumerate(((fast, buys), (slow, views)), 1):
        store.stage(mine, "ADD", rows)
        store.publish(mine)
        token = store.advance()
        steps.append(store.model().agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(token).cast("long").alias("token"), "n"))
    return reduce(DataFrame.union, steps)


def store_gap(spark, sf_dir):
    """A writer whose rows for clicks got lost after it settled: what is missing, and whether the follower refuses to go on."""
    store, views, clicks = _new_store(spark, GROUP_SCHEMA), _joins(spark, sf_dir, "view"), _joins(spark, sf_dir, "click")
    mine = store.ids.reserve(views.count() + clicks.count())
    store.stage(mine, "ADD", views)
    store.publish(mine)
    try:
        store.advance()
        refused = False
    except LogGap:
        refused = True
    return store.gaps().withColumn("refused", F.lit(refused))


def store_cascade(spark, sf_dir):
    """A store of the documents' tuples in which every third withheld document is withheld no more: the sets that
    this version evaluates and the rows that they hold then, by relation."""
    store = _new_store(spark, DOC_SCHEMA)
    rows = numbered(load(spark, sf_dir, DOCS), 0, list(TUPLE), "log_id")
    T.append_log(rows.select("log_id", F.lit("main").alias("store_id"), F.lit("ADD").alias("op"), *TUPLE, F.lit(0.0).alias("created_at")), f"{store.path}/log")
    store.advance()
    store.write("REMOVE", load(spark, sf_dir, WITHHELD + " AND doc_id % 3 = 0"))
    store.advance()
    version = store.manifest()[0]
    by = ["o_type", "o_pred"]
    keys = store._model.changed(version).groupBy(*by).agg(F.count("*").alias("n_sets"))
    written = S.Shared(*store._model.overlay(version)).sizes().groupBy(*by).agg(F.sum("n").alias("n_rows"))
    return keys.join(written, by, "left").fillna(0, ["n_rows"])


_NAMES = """snapshot_scan tuple_admission reject_reasons pattern_match rewrite_fixpoint direct_multiplicity reference_counts
closure path_counts topo_levels reach_forward reach_reverse point_reachability direct_edges edge_fanout insert_edge_delta remove_edge_delta remove_node batch_delta remove_node_counts cycle_check
outbox_delta bridges population wildcard_check check_batch ghost_check expand lookup lookup_markers symbolic_check symbolic_lookup symbolic_rows one_subject lookup_reverse inherited_access boolean_exclusion
boolean_intersection derived_ttu derived_userset stratified_cascade set_union set_intersect set_subtract star_normalize materialize
log_fold log_head log_tail log_gap index_lag outbox_prune affected_keys invariants audit probe_check probe_reverse
store_follow store_outbox store_replay store_race store_gap store_cascade""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
