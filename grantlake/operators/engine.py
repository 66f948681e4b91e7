"""The model of a schema over stored tuples, and the questions asked of it.

Relations without booleans come from one reachability closure over the derived
edges. Boolean relations follow stratum by stratum: every leaf contributes tagged
member rows, and one aggregate by object and subject decides (members.combine).
The result is rows

    o_pred, o_type, o_name, kind (pos, star, neg), s_pred, s_type, s_name

Questions are batches: a DataFrame of checks is joined with the model, never a
loop over single calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE
from grantlake.operators import closure as C
from grantlake.operators import members as M
from grantlake.operators import rewrite as R
from grantlake.plans.compile import Compiled, compile_schema, dependencies, dependency_rows, stored_restrictions
from grantlake.plans.schema import BARE, STAR, Computed, Direct, Exclusion, Inherited, Intersection, Key, Schema, leaves, parse
from grantlake.sources.storage import cut, cut_or_empty

OBJECT = ("o_pred", "o_type", "o_name")
ROW = (*OBJECT, "kind", *M.SUBJECT)


def compiled_of(schema: Compiled | Schema | str) -> Compiled:
    schema = parse(schema) if isinstance(schema, str) else schema
    return compile_schema(schema) if isinstance(schema, Schema) else schema


class Engine:
    """``tuples`` has the six tuple columns; rows that the schema does not admit take no part.
    ``ready``: they are distinct and admitted, and as cheap to read as a table."""

    def __init__(self, schema: Compiled | Schema | str, tuples: DataFrame, ready: bool = False):
        self.compiled = compiled_of(schema)
        self.spark = tuples.sparkSession
        self.tuples = tuples.select(*TUPLE) if ready else cut(R.admit(tuples, self.compiled))
        self.stored = cut(R.spread(self.tuples)) if self.compiled.object_wildcards else self.tuples
        self._reset(None, None, None)

    def _reset(self, needed: frozenset[Key] | None, sources: DataFrame | None, targets: DataFrame | None, demand: DataFrame | None = None, given: DataFrame | None = None) -> None:
        self.needed = needed  # None: every relation
        self._sources, self.targets = sources, targets  # (node); None: all
        self.demand = demand  # OBJECT of the sets to evaluate; None: all
        self._given = given  # ROW of the sets that are not evaluated but read
        self._closure: DataFrame | None = None
        self._plain: DataFrame | None = None
        self._derived: dict[Key, DataFrame] = {}

    def _with(self, *state) -> Engine:
        """An engine over the same tuples."""
        out = object.__new__(Engine)
        out.__dict__ |= self.__dict__
        out._reset(*state)
        return out

    def focus(self, keys, objects: DataFrame | None = None, subjects: DataFrame | None = None) -> Engine:
        """An engine over the same tuples that evaluates only the relations ``keys`` and
        what they read. With ``subjects`` (s_pred, s_type, s_name), only for those and the stars of their
        shapes: a membership never depends on other subjects. With ``objects`` (o_pred, o_type, o_name), only
        those objects' sets and the sets that these are made of."""
        needed, more = set(), set(keys) & self.compiled.schema.relations.keys()
        while more:
            needed |= more
            more = {d for k in more for d in dependencies(self.compiled.schema, k)} - needed
        sources = targets = demand = None
        if subjects is not None:
            name = F.explode(F.array("s_name", F.lit(STAR))).alias("s_name")
            sources = subjects.select("s_pred", "s_type", name).select(F.concat_ws("|", "s_pred", "s_type", "s_name").alias("node")).distinct()
        if objects is not None:
            demand = self.demanded(objects) if needed & self.compiled.tainted else objects.select(*OBJECT)
            targets = self.nodes(demand, F.lit(R.ALL))
        return self._with(frozenset(needed), None if sources is None else cut(sources), targets, demand)

    def nodes(self, objects: DataFrame, *more) -> DataFrame:
        """(node): where paths to these objects' sets without booleans end; with ``more`` names, at those too."""
        plain = objects.where(~F.concat_ws("#", "o_type", "o_pred").isin(["#".join(k) for k in self.compiled.tainted]))
        named = F.when(F.col("o_name") == STAR, R.ALL).otherwise(F.col("o_name"))
        return plain.select("o_pred", "o_type", F.explode(F.array(named, *more)).alias("o_name")).select(F.concat_ws("|", *OBJECT).alias("node")).distinct()

    def demanded(self, objects: DataFrame) -> DataFrame:
        """OBJECT of every set that has to be known for those of ``objects``: from a boolean relation down
        to what its leaves read on the same object, or on the subjects of its stored tuples. A set without booleans ends the
        search, as its paths are searched backwards from it. As many rounds as there are strata at most."""
        tainted, rows = self.compiled.tainted, dependency_rows(self.compiled.schema)
        table = F.broadcast(self.spark.createDataFrame([r for r in rows if r[5:] in tainted], "kind string, s_type string, s_relation string, via string, pred string, d_type string, d_relation string"))
        found = [cut(objects.select(*OBJECT).distinct(), "o_type", "o_pred")]
        for _ in self.compiled.strata:
            met = found[-1].join(table, (F.col("o_type") == F.col("d_type")) & (F.col("o_pred") == F.col("d_relation")))
            same = met.where("kind = 'computed'").select(F.col("s_relation").alias("o_pred"), "o_type", "o_name")
            on = (
                (F.col("object_type") == F.col("o_type")) & (F.col("object_name") == F.col("o_name")) & (F.col("relation") == F.col("via"))
                & (F.col("subject_type") == F.col("s_type")) & (F.col("subject_predicate") == F.col("pred"))
            )
            over = met.where("kind <> 'computed'").join(self.stored, on).select(F.col("s_relation").alias("o_pred"), F.col("subject_type").alias("o_type"), F.col("subject_name").alias("o_name"))
            if self.compiled.flowing:  # a star stands for every instance
                live = R.instances(self.stored).toDF("o_type", "i_name")
                stars = over.where(F.col("o_name") == STAR).distinct().join(live, "o_type").select("o_pred", "o_type", F.col("i_name").alias("o_name"))
                over = over.where(F.col("o_name") != STAR).unionByName(stars)
            new = cut_or_empty(same.unionByName(over).distinct().join(reduce(DataFrame.unionByName, found), list(OBJECT), "left_anti"))
            if new is None:
                break
            found.append(new)
        return reduce(DataFrame.unionByName, found)

    def update(self, keys: DataFrame, given: DataFrame) -> Engine:
        """An engine that evaluates the sets of ``keys`` (OBJECT) alone; all others are read from ``given``, the rows
        of a model in which they are right."""
        keys = cut(keys.select(*OBJECT).distinct(), "o_type", "o_pred")
        known = self.compiled.schema.relations.keys()
        needed = {(r["o_type"], r["o_pred"]) for r in keys.select("o_type", "o_pred").distinct().collect()} & known  # no more than the schema has
        targets = self.nodes(keys)
        flows = [f"{t}#{p}" for t, p in sorted(self.compiled.flowing & needed)]
        if flows:  # the shape's star changes with its instances
            targets = targets.union(keys.where(F.concat_ws("#", "o_type", "o_pred").isin(flows)).select(F.concat_ws("|", "o_pred", "o_type", F.lit(STAR)).alias("node")).distinct())
        out = self._with(None, None, cut(targets), keys, given.select(*ROW))
        out._evaluated = frozenset(needed)
        return out

    def about(self, asked: DataFrame, type_: str, relation: str) -> list[Key]:
        """The relations that a batch asks about: no more than the schema has."""
        rows = asked.select(F.concat_ws("#", type_, relation).alias("k")).where(F.col("k").isin(["#".join(k) for k in self.compiled.schema.relations])).distinct().collect()
        return [tuple(r["k"].split("#")) for r in rows]

    # -- building -----------------------------------------------------------

    def edges(self) -> DataFrame:
        """(src, dst) with one row for each tuple and rule, bridges included."""
        edges = R.derive_edges(self.stored, self.compiled, self.needed)
        if self.compiled.flowing:
            edges = edges.union(R.bridges(self.stored, self.compiled).where(F.col("src_name") != R.ALL))
        return C.keyed(edges)

    def closure(self) -> DataFrame:
        if self._closure is None:
            self._closure = C.reach(self.edges(), self._sources, self.targets)
        return self._closure

    def plain(self) -> DataFrame:
        """Member rows of relations without booleans, laid out by relation."""
        if self._plain is not None:
            return self._plain
        pairs = C.unkeyed(self.closure()).where((F.col("src_name") != R.ALL) & (F.col("dst_name") != STAR))
        name = F.when(F.col("dst_name") == R.ALL, STAR).otherwise(F.col("dst_name"))
        kind = F.when(F.col("src_name") == STAR, "star").otherwise("pos")
        rows = pairs.select(F.col("dst_pred").alias("o_pred"), F.col("dst_type").alias("o_type"), name.alias("o_name"), kind.alias("kind"), F.col("src_pred").alias("s_pred"), F.col("src_type").alias("s_type"), F.col("src_name").alias("s_name"))
        self._plain = cut(rows, "o_type", "o_pred")
        return self._plain

    def _names(self, key: Key) -> DataFrame:
        """(o_name): the objects of one relation whose sets are evaluated."""
        return self.demand.where((F.col("o_type") == key[0]) & (F.col("o_pred") == key[1])).select("o_name")

    def of(self, key: Key) -> DataFrame:
        """Member rows (o_name, kind, subject) of one relation."""
        only = lambda rows: rows.where((F.col("o_type") == key[0]) & (F.col("o_pred") == key[1])).select("o_name", "kind", *M.SUBJECT)
        if self._given is not None and key not in self._evaluated:
            return only(self._given)
        rows = self._derived[key] if key in self._derived else only(self.plain())
        return rows if self._given is None else rows.unionByName(only(self._given).join(self._names(key), "o_name", "left_anti"))

    def derive(self) -> None:
        """Evaluate the boolean relations, lower strata first; a stratum is written as one
        table, laid out by relation."""
        for stratum in self.compiled.strata:
            keys = [k for k in stratum if k not in self._derived and (self.needed is None or k in self.needed) and (self._given is None or k in self._evaluated)]
            if not keys:
                continue
            parts = [self._evaluate(k).select(F.lit(k[1]).alias("o_pred"), F.lit(k[0]).alias("o_type"), "o_name", "kind", *M.SUBJECT) for k in keys]
            if len(keys) == 1:
                self._derived[keys[0]] = cut(parts[0].drop("o_pred", "o_type"))
                continue
            table = cut(reduce(DataFrame.unionByName, parts), "o_type", "o_pred")
            for t, r in keys:
                self._derived[t, r] = table.where((F.col("o_type") == t) & (F.col("o_pred") == r)).select("o_name", "kind", *M.SUBJECT)

    def _evaluate(self, key: Key) -> DataFrame:
        e = self.compiled.schema.relations[key]
        parts = [self._leaf(key, leaf).withColumn("leaf", F.lit(i)) for i, leaf in enumerate(leaves(e))]
        rows = reduce(DataFrame.unionByName, parts).where(F.col("o_name") != STAR)
        # a leaf's rows are distinct: stored tuples, closures and evaluated sets are, and a source is told apart
        return M.combine(rows, ["o_name"], len(parts), lambda truths: _truth(e, iter(truths)), distinct=True)

    def _asked(self, rows: DataFrame) -> DataFrame:
        """Those of member rows whose subject is asked for."""
        if self._sources is None:
            return rows
        node = F.concat_ws("|", *M.SUBJECT)
        return rows.join(self._sources.withColumnRenamed("node", "__asked"), node == F.col("__asked"), "left_semi")

    def shapes(self, key: Key, leaf: Direct | Inherited) -> dict[Key, bool]:
        """What the schema lets a leaf read: shapes through which members flow, and those that may be starred."""
        if isinstance(leaf, Direct):
            return {(x.type, x.predicate): x.star for x in sorted(leaf.restrictions) if x.predicate != BARE}
        return {(x.type, leaf.target): x.star for x in stored_restrictions(self.compiled.schema, (key[0], leaf.tupleset)) if x.predicate == BARE}

    def granted(self, key: Key, leaf: Direct | Inherited) -> DataFrame:
        """(o_name, p_type, p_name, via): what the stored tuples of one leaf take in: subjects, or sets by their relation ``via``."""
        t, r = key
        if isinstance(leaf, Direct):
            admits = [(F.col("subject_type") == x.type) & (F.col("subject_predicate") == x.predicate) & ((F.col("subject_name") == STAR) == F.lit(x.star)) for x in leaf.restrictions]
            rows = self.stored.where((F.col("object_type") == t) & (F.col("relation") == r) & reduce(lambda a, b: a | b, admits)).withColumn("via", F.col("subject_predicate"))
        else:
            rows = self.stored.where((F.col("object_type") == t) & (F.col("relation") == leaf.tupleset) & (F.col("subject_predicate") == BARE)).withColumn("via", F.lit(leaf.target))
        return rows.select(F.col("object_name").alias("o_name"), F.col("subject_type").alias("p_type"), F.col("subject_name").alias("p_name"), "via")

    def _leaf(self, key: Key, leaf) -> DataFrame:
        """(o_name, source, kind, subject) of one leaf."""
        t, r = key
        asked = (lambda rows: rows) if self.demand is None else lambda rows: rows.join(self._names(key), "o_name", "left_semi")
        if isinstance(leaf, Computed):
            return asked(self.of((t, leaf.relation))).withColumn("source", F.lit(""))
        granted = asked(self.granted(key, leaf))
        kind = F.when(F.col("p_name") == STAR, "star").otherwise("pos")
        rows = granted.select("o_name", F.lit("").alias("source"), kind.alias("kind"), F.col("via").alias("s_pred"), F.col("p_type").alias("s_type"), F.col("p_name").alias("s_name"))
        rows = self._asked(rows)  # what flows below is of asked subjects already
        flowing = granted.where(F.col("via") != BARE)
        for shape, starred in sorted(self.shapes(key, leaf).items()):
            if shape not in self.compiled.schema.relations:
                continue
            of_shape = flowing.where((F.col("p_type") == shape[0]) & (F.col("via") == shape[1]))
            one = of_shape.where(F.col("p_name") != STAR).select("o_name", F.col("p_name").alias("source"))
            if starred:
                live = R.instances(self.stored).toDF("i_type", "i_name").where(F.col("i_type") == shape[0])
                one = one.union(of_shape.where(F.col("p_name") == STAR).join(live, F.col("p_type") == F.col("i_type")).select("o_name", F.col("i_name").alias("source")))
            inner = self.of(shape).select(F.col("o_name").alias("source"), "kind", *M.SUBJECT)
            # a source is told apart by its type and name, and is the same by whichever grant it comes
            found = one.distinct().join(inner, "source").withColumn("source", F.concat(F.lit(f"{shape[0]}#{shape[1]}@"), "source"))
            rows = rows.unionByName(found)
        return rows

    # -- the model and its reads ----------------------------------------------

    def model(self) -> DataFrame:
        self.derive()
        return reduce(DataFrame.unionByName, [rows.select(F.lit(k[1]).alias("o_pred"), F.lit(k[0]).alias("o_type"), "o_name", "kind", *M.SUBJECT) for k, rows in self._derived.items()], self.plain().select(*ROW))

    def check(self, queries: DataFrame) -> DataFrame:
        """``queries`` with ``allowed``: up to four probes for each row of what the asked subjects have."""
        objects = queries.select(F.col("relation").alias("o_pred"), F.col("object_type").alias("o_type"), F.col("object_name").alias("o_name")).distinct()
        subjects = queries.select(*(F.col(c).alias(s) for c, s in zip(TUPLE, M.SUBJECT))).distinct()
        return check(self.focus(self.about(queries, "object_type", "relation"), objects, subjects).model(), queries)

    def evaluate(self, key: Key, subjects: DataFrame) -> DataFrame:
        """Member rows of one relation for these subjects alone, and the stars of their shapes."""
        engine = self.focus([key], subjects=subjects)
        engine.derive()
        return engine.of(key)

    def lookup(self, subjects: DataFrame, relations=None) -> DataFrame:
        """All that each subject reaches, by name. ``relations``: only in these (type, relation)."""
        return lookup(self._reached(subjects, relations), subjects)

    def lookup_markers(self, subjects: DataFrame, relations=None) -> DataFrame:
        """What each subject reaches with stars left as they are (``lookup_markers``)."""
        return lookup_markers(self._reached(subjects, relations), subjects)

    def _reached(self, subjects: DataFrame, relations) -> DataFrame:
        engine = self.focus(self.compiled.schema.relations if relations is None else relations, subjects=subjects)
        if relations is None:
            return engine.model()
        engine.derive()
        named = [engine.of(k).select(F.lit(k[1]).alias("o_pred"), F.lit(k[0]).alias("o_type"), "o_name", "kind", *M.SUBJECT) for k in sorted(relations)]
        return reduce(DataFrame.unionByName, named).select(*ROW)

    def lookup_reverse(self, objects: DataFrame) -> DataFrame:
        return lookup_reverse(self.focus(self.about(objects, "o_type", "o_pred"), objects).model(), objects)

    def expand(self, objects: DataFrame) -> DataFrame:
        keys = self.about(objects, "o_type", "o_pred")
        model = self.focus(keys, objects).model()
        if self.compiled.tainted.issuperset(keys) and not self.compiled.object_wildcards:  # evaluated sets are canonical
            return model.join(objects.select(*OBJECT).distinct(), list(OBJECT), "left_semi").select(*ROW)
        return expand(model, objects)


def _truth(e, truths) -> Column:
    match e:
        case Exclusion(a, b):
            left = _truth(a, truths)
            return left & ~_truth(b, truths)
        case Intersection(c):
            return reduce(lambda x, y: x & y, [_truth(x, truths) for x in c])
        case Direct() | Computed() | Inherited():
            return next(truths)
    return reduce(lambda x, y: x | y, [_truth(x, truths) for x in e.children])


def check(model: DataFrame, queries: DataFrame) -> DataFrame:
    """A concrete object also takes what its type's wildcard object has, and a concrete
    subject what its shape's star has; queries about names that no tuple has find those alone."""
    q = queries.select(*TUPLE).distinct()
    names = lambda c: F.array_distinct(F.array(F.col(c), F.lit(STAR)))
    probes = q.withColumn("p_object", F.explode(names("object_name"))).withColumn("p_subject", F.explode(names("subject_name")))
    on = (
        (F.col("relation") == F.col("o_pred")) & (F.col("object_type") == F.col("o_type")) & (F.col("p_object") == F.col("o_name"))
        & (F.col("subject_predicate") == F.col("s_pred")) & (F.col("subject_type") == F.col("s_type")) & (F.col("p_subject") == F.col("s_name"))
    )
    has = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    found = probes.join(model, on).groupBy(*TUPLE).agg((has("pos") | (has("star") & ~has("neg"))).alias("allowed"))
    return queries.join(found, list(TUPLE), "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def lookup(model: DataFrame, subjects: DataFrame) -> DataFrame:
    """(s_pred, s_type, s_name, o_pred, o_type, o_name, marker): all that each subject
    reaches by name, as many rows as answers; marker is true for a wildcard object."""
    s = subjects.select(*M.SUBJECT).distinct()
    named = s.join(model.where("kind = 'pos'"), list(M.SUBJECT)).select(*M.SUBJECT, *OBJECT)
    stars = model.where("kind = 'star'").select(*OBJECT, *M.SHAPE)
    # exceptions, and in relations without booleans those that have the object by name too; of asked subjects alone
    apart = model.where("kind <> 'star'").select(*OBJECT, *M.SUBJECT).join(s, list(M.SUBJECT), "left_semi")
    starred = s.join(stars, list(M.SHAPE)).select(*M.SUBJECT, *OBJECT).join(apart, [*M.SUBJECT, *OBJECT], "left_anti")
    return named.unionByName(starred).withColumn("marker", F.col("o_name") == STAR)


def lookup_markers(model: DataFrame, subjects: DataFrame) -> DataFrame:
    """The same answer without paying for each pair of a subject and a public object: (kind, subject,
    object) with ``pos`` an object that the subject has by name, ``star`` one that all of the subject's
    shape have (once, subject name ``*``), ``neg`` one of those that this subject has not. A plain
    relation may hold both pos and star of one object."""
    s = subjects.select(*M.SUBJECT).distinct()
    own = s.join(model.where("kind <> 'star'"), list(M.SUBJECT)).select("kind", *M.SUBJECT, *OBJECT)
    stars = model.where("kind = 'star'").join(F.broadcast(s.select(*M.SHAPE).distinct()), list(M.SHAPE), "left_semi")  # shapes: as many as the schema has
    return own.union(stars.select("kind", *M.SUBJECT, *OBJECT)).distinct()


def lookup_reverse(model: DataFrame, objects: DataFrame) -> DataFrame:
    """(object, kind, subject): members, star markers and exceptions of each object."""
    o = objects.select(*OBJECT).distinct()
    own = o.join(model, list(OBJECT)).select(*ROW)
    wild = o.where(F.col("o_name") != STAR).join(model.where(F.col("o_name") == STAR).drop("o_name"), ["o_pred", "o_type"]).select(*ROW)
    return own.union(wild).distinct()


def expand(model: DataFrame, objects: DataFrame) -> DataFrame:
    """The canonical member set of each object."""
    return M.normalize(lookup_reverse(model, objects), OBJECT)
