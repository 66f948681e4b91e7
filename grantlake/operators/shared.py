"""Member sets evaluated once for all objects that have the same.

Objects whose stored tuples take in the same subjects and the same sets hold the same subjects. ``classes`` tells
them by a fingerprint of what they take in, bottom up over the schema, and ``share`` evaluates one object of
each class. A group that a thousand objects withhold is then read for as many classes as differ otherwise, and what has to
be said for each object (``spread``) is one join of classes with their objects: pairs of an object and a member are
neither shuffled nor written before they are the answer. Where no two objects are alike, each is its own class.

Subjects are alike in the same way (``people``): those that the same stored tuples name are in the same sets. So a class of objects is evaluated for
one subject of each class, and both sides are named last (``unfold``), from lists of names.

Usersets as subjects (``viewer|doc|d1``) mostly differ from object to object, so they take no part in the classes and are evaluated by
object; they are as many as the stored tuples give. A subject's membership never depends on subjects of other shapes.

A fingerprint is the number of items and two sums over 60 bits each of their SHA-256: two sets that differ share one
with a chance of about 2^-120. Schemas with starred usersets or wildcard objects are evaluated by object."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE
from grantlake.operators import closure as C
from grantlake.operators import engine as E
from grantlake.operators import members as M
from grantlake.operators import rewrite as R
from grantlake.operators.engine import OBJECT, ROW, Engine
from grantlake.plans.schema import BARE, STAR, Computed, Key, leaves
from grantlake.sources.storage import cut

#: A class's members are dealt over so many keys, so that a large class is spread by as many tasks.
SALTS = 16
#: About so many names are in one list of ``unfold``.
NAMES = 1024


@dataclass
class Shared:
    """``placed`` (OBJECT, rep): each object's class, named by one of its objects; ``rows`` (o_pred, o_type, rep, kind,
    subject): what a class holds; ``own`` (ROW): further members of single objects. If given, ``people`` (subject, s_rep) has each
    subject's class, named by one of its subjects (stars stand for themselves), and ``held`` is ``rows`` for these alone."""

    placed: DataFrame
    rows: DataFrame
    own: DataFrame
    held: DataFrame | None = None
    people: DataFrame | None = None

    def of(self, key: Key) -> Shared:
        mine = lambda df: df if df is None else df.where((F.col("o_type") == key[0]) & (F.col("o_pred") == key[1]))
        return Shared(mine(self.placed), mine(self.rows), mine(self.own), mine(self.held), self.people)

    def _named(self, placed: DataFrame) -> DataFrame:
        """The members of the classes of objects, by name."""
        return spread(placed, self.rows) if self.people is None else unfold(placed, self.held, self.people)

    def model(self) -> DataFrame:
        """ROW of every object."""
        return self._named(self.placed).select(*ROW).unionByName(self.own)

    def among(self, objects: DataFrame) -> Shared:
        """The sets of ``objects`` (OBJECT) alone."""
        placed, own = self.placed.join(objects, list(OBJECT), "left_semi").select(*self.placed.columns), self.own.join(objects, list(OBJECT), "left_semi").select(*ROW)
        return Shared(placed, self.rows, own, self.held, self.people)

    def beyond(self, other: Shared) -> Shared:
        """These sets and those of ``other``; no object of one relation and class name is in both."""
        return Shared(*(getattr(self, part).unionByName(getattr(other, part)) for part in ("placed", "rows", "own")))

    def check(self, queries: DataFrame) -> DataFrame:
        """``queries`` with ``allowed``, as ``engine.check`` says it: an object's class is asked for it. What a class holds and
        what an object has of its own are of other shapes or other objects, so one answer of the two is enough."""
        q = queries.select(*TUPLE).distinct()
        objects = self.placed.toDF("relation", "object_type", "object_name", "rep")
        named = q.join(objects, ["relation", "object_type", "object_name"]).select(*TUPLE, "rep")
        asked = named.withColumn("object_name", F.col("rep")).select(*TUPLE)
        by_class = E.check(self.rows.withColumnRenamed("rep", "o_name"), asked.distinct()).where("allowed").withColumnRenamed("object_name", "rep").drop("allowed")
        by_class = named.join(by_class, [c for c in (*TUPLE, "rep") if c != "object_name"]).select(*TUPLE)
        yes = by_class.unionByName(E.check(self.own, q).where("allowed").select(*TUPLE)).distinct().withColumn("allowed", F.lit(True))
        return queries.join(yes, list(TUPLE), "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))

    def lookup(self, subjects: DataFrame) -> DataFrame:
        """``engine.lookup``: what subjects reach is found by class, and then named."""
        if self.people is not None:
            asked = _asked(self.people, subjects)
            by_class = E.lookup(self.held.withColumnRenamed("rep", "o_name"), _reps(asked)).drop("marker").withColumnRenamed("o_name", "rep")
            named = unfold(self.placed, cut(by_class), asked).select(*M.SUBJECT, *OBJECT).withColumn("marker", F.lit(False))
            return named.unionByName(E.lookup(self.own, subjects))
        by_class = E.lookup(self.rows.withColumnRenamed("rep", "o_name"), subjects).drop("marker").withColumnRenamed("o_name", "rep")
        named = spread(self.placed, by_class).select(*M.SUBJECT, *OBJECT).withColumn("marker", F.lit(False))  # no wildcard object has a class
        return named.unionByName(E.lookup(self.own, subjects))

    def lookup_reverse(self, objects: DataFrame) -> DataFrame:
        """``engine.lookup_reverse``: of the classes of the asked objects alone."""
        o = objects.select(*OBJECT).distinct()
        return self._named(self.placed.join(o, list(OBJECT), "left_semi")).select(*ROW).unionByName(E.lookup_reverse(self.own, o))

    def lookup_markers(self, subjects: DataFrame) -> DataFrame:
        """``engine.lookup_markers``, in the same way as ``lookup``."""
        if self.people is None:
            by_class = E.lookup_markers(self.rows.withColumnRenamed("rep", "o_name"), subjects).withColumnRenamed("o_name", "rep")
            named = spread(self.placed, by_class)
        else:
            asked = _asked(self.people, subjects)
            by_class = E.lookup_markers(self.held.withColumnRenamed("rep", "o_name"), _reps(asked)).withColumnRenamed("o_name", "rep")
            named = unfold(self.placed, cut(by_class), asked.unionByName(self.people.where(F.col("s_name") == STAR)).distinct())
        return named.select("kind", *M.SUBJECT, *OBJECT).unionByName(E.lookup_markers(self.own, subjects))

    def members(self, population: DataFrame) -> DataFrame:
        """(OBJECT, n): how many of ``population`` each set of canonical rows holds (``members.count_members``)."""
        if self.people is None:
            held = M.count_members(self.rows, population, ["o_pred", "o_type", "rep"])
        else:
            held = self._count(population)
        each = self.placed.join(held, ["o_pred", "o_type", "rep"]).select(*OBJECT, "n")
        return each.unionByName(M.count_members(self.own, population, OBJECT)).groupBy(*OBJECT).agg(F.sum("n").alias("n"))

    def _count(self, population: DataFrame) -> DataFrame:
        """(o_pred, o_type, rep, n): ``members.count_members`` of the classes: a class of subjects counts as many as it has."""
        there = population.select(*M.SUBJECT).distinct()
        sizes = there.groupBy(*M.SHAPE).agg(F.count("*").alias("size"))
        many = self.people.join(there.withColumn("__there", F.lit(1)), list(M.SUBJECT), "left")
        many = many.groupBy(*M.SHAPE, F.col("s_rep").alias("s_name")).agg(F.count("*").alias("all"), F.count("__there").alias("some"))
        rows = self.held.join(many, list(M.SUBJECT)).join(sizes, list(M.SHAPE), "left")
        n = F.when(F.col("kind") == "star", F.coalesce("size", F.lit(0))).when(F.col("kind") == "neg", -F.col("some")).otherwise(F.col("all"))
        return rows.groupBy("o_pred", "o_type", "rep").agg(F.sum(n).alias("n")).where("n > 0")

    def together(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(placed, people, mine, others): classes as those of ``beside``, also of the subjects whose sets here and rows in ``rows`` (ROW) are
        alike, and both sides for one object and one subject of each (ROW). ``unfold`` names what is found of them."""
        if self.people is None:
            placed, mine, others = self.beside(rows)
            every = mine.unionByName(others).select(*M.SUBJECT).distinct()
            return placed, every.withColumn("s_rep", F.col("s_name")), mine, others
        counted = lambda df, tag, by, of: df.groupBy(*OBJECT, "kind", *M.SUBJECT).agg(F.count("*").alias("n")).select(*by, F.concat_ws("|", F.lit(tag), "kind", *of, F.col("n").cast("string")).alias("item"))
        shared = self.placed.select(*OBJECT, F.concat_ws("|", F.lit("rep"), "rep").alias("item"))
        alike = fingerprint(shared.unionByName(counted(self.own, "own", OBJECT, M.SUBJECT)).unionByName(counted(rows, "beside", OBJECT, M.SUBJECT)), *OBJECT)
        placed = cut(by_least(alike, ["o_pred", "o_type"], "o_name", "rep"))
        known = self.people.select(*M.SUBJECT, F.concat_ws("|", F.lit("rep"), "s_rep").alias("item"))
        alike = fingerprint(known.unionByName(counted(self.own, "own", M.SUBJECT, OBJECT)).unionByName(counted(rows, "beside", M.SUBJECT, OBJECT)), *M.SUBJECT)
        people = cut(by_least(alike.withColumn("cls", F.when(F.col("s_name") == STAR, STAR).otherwise(F.col("cls"))), list(M.SHAPE), "s_name", "s_rep"))
        objects, subjects = cut(placed.select("o_pred", "o_type", F.col("rep").alias("o_name")).distinct()), cut(_reps(people))
        only = lambda df: df.join(objects, list(OBJECT), "left_semi")
        both = lambda df: only(df).join(subjects, list(M.SUBJECT), "left_semi").select(*ROW)
        # a class here is part of one before, whose rows it has
        parts = self.people.join(subjects, list(M.SUBJECT), "left_semi").select(*M.SHAPE, F.col("s_rep").alias("__rep"), "s_name")
        mine = spread(only(self.placed), self.held.withColumnRenamed("s_name", "__rep")).join(parts, [*M.SHAPE, "__rep"]).select(*ROW)
        return placed, people, cut(mine.unionByName(both(self.own))), cut(both(rows))

    def beside(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(placed, mine, others): classes of objects whose sets here and rows in ``rows`` (ROW) are alike, copies counted, and
        both for one object of each (ROW). What is said of the two together holds for all objects of the class."""
        counted = lambda df, tag: df.groupBy(*OBJECT, "kind", *M.SUBJECT).agg(F.count("*").alias("n")).select(*OBJECT, F.concat_ws("|", F.lit(tag), "kind", *M.SUBJECT, F.col("n").cast("string")).alias("item"))
        shared = self.placed.select(*OBJECT, F.concat_ws("|", F.lit("rep"), "rep").alias("item"))
        alike = cut(fingerprint(shared.unionByName(counted(self.own, "own")).unionByName(counted(rows, "beside")), *OBJECT))
        reps = alike.groupBy("o_pred", "o_type", "cls").agg(F.min("o_name").alias("rep"))
        placed = cut(alike.join(reps, ["o_pred", "o_type", "cls"]).select(*OBJECT, "rep"))
        one = cut(reps.select("o_pred", "o_type", F.col("rep").alias("o_name")))
        only = lambda df: df.join(one, list(OBJECT), "left_semi")
        return placed, cut(spread(only(self.placed), self.rows).select(*ROW).unionByName(only(self.own))), cut(only(rows.select(*ROW)))

    def sizes(self, *by: str) -> DataFrame:
        """(OBJECT, by, n): how many rows each object has."""
        if self.people is None:
            held = self.rows.groupBy("o_pred", "o_type", "rep", *by).agg(F.count("*").alias("n"))
        else:
            many = self.people.groupBy(*M.SHAPE, F.col("s_rep").alias("s_name")).agg(F.count("*").alias("n"))
            held = self.held.join(many, list(M.SUBJECT)).groupBy("o_pred", "o_type", "rep", *by).agg(F.sum("n").alias("n"))
        each = self.placed.join(held, ["o_pred", "o_type", "rep"]).select(*OBJECT, *by, "n")
        return each.unionByName(self.own.groupBy(*OBJECT, *by).agg(F.count("*").alias("n"))).groupBy(*OBJECT, *by).agg(F.sum("n").alias("n"))


def fingerprint(items: DataFrame, *by: str) -> DataFrame:
    """(by, cls): the same for those that have the same set of ``item``."""
    digest = items.distinct().withColumn("__h", F.sha2("item", 256))
    part = lambda start: F.sum(F.conv(F.substring("__h", start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return digest.groupBy(*by).agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(16)).alias("cls"))


def by_least(alike: DataFrame, by: list[str], name: str, rep: str) -> DataFrame:
    """(by, name, rep): the least name of each ``cls``."""
    least = alike.groupBy(*by, "cls").agg(F.min(name).alias(rep))
    return alike.join(least, [*by, "cls"]).select(*by, name, rep)


def _reps(people: DataFrame) -> DataFrame:
    return people.select(*M.SHAPE, F.col("s_rep").alias("s_name")).distinct()


def _asked(people: DataFrame, subjects: DataFrame) -> DataFrame:
    """``people`` of ``subjects``; names that are not known are in no set but stars, each by itself."""
    return cut(subjects.select(*M.SUBJECT).distinct().join(people, list(M.SUBJECT), "left").select(*M.SUBJECT, F.coalesce("s_rep", "s_name").alias("s_rep")))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def listed(rows: DataFrame, by: list[str], name: str, names: str) -> DataFrame:
    """(by, part, names): the names of each key in lists of about NAMES, however many they are."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / NAMES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(name), F.col("parts")).cast("int").alias("part")
    return rows.join(sizes, by).select(*by, name, part).groupBy(*by, "part").agg(F.collect_list(name).alias(names))


def unfold(placed: DataFrame, pairs: DataFrame, people: DataFrame) -> DataFrame:
    """``pairs`` (o_pred, o_type, rep, subject by its class's name, more) by name: ``placed`` (OBJECT, rep) has the objects of each
    class, ``people`` (SUBJECT, s_rep) the subjects. Lists of objects meet lists of subjects, so what is shuffled and sorted grows
    with the names of either side, and pairs of names come into being in the task that puts them out, list by list."""
    on, n = ["o_pred", "o_type", "rep", "__salt"], _tasks(placed)
    more = [c for c in pairs.columns if c not in ("o_pred", "o_type", "rep", *M.SUBJECT)]
    names = cut(listed(people, [*M.SHAPE, "s_rep"], "s_name", "__names"))
    held = spread(pairs.withColumnRenamed("s_name", "s_rep"), names)
    held = held.withColumn("__salt", F.pmod(F.xxhash64("s_rep", "part", *more), F.lit(SALTS)).cast("int")).select(*on, *more, *M.SHAPE, "__names").repartition(n, *on)
    objects = listed(placed, ["o_pred", "o_type", "rep"], "o_name", "__objects").select("o_pred", "o_type", "rep", "__objects")
    objects = objects.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(n, *on)
    return paired(objects.join(held.hint("merge"), on), ["o_pred", "o_type"], [*more, *M.SHAPE])


def paired(met: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left, o_name, right, s_name): every name of a row's ``__objects`` with every one of its ``__names``."""
    # a higher-order function is in no generated code: else that of the join before, which returns when a row of it is done, would keep all pairs of two lists
    each = met.select(*left, *right, "__names", F.explode(F.transform("__objects", lambda o: o)).alias("o_name"))
    return each.select(*left, "o_name", *right, F.explode("__names").alias("s_name"))


def spread(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects with the rows of their classes (joined by the columns that both have). The number of tasks is fixed: what is
    joined is small, and what comes out may be any number of times as much."""
    spark = placed.sparkSession
    by = [c for c in rows.columns if c in placed.columns]
    held = [c for c in rows.columns if c not in by]
    on, n = [*by, "__salt"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    every = placed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(n, *on)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*held), F.lit(SALTS)).cast("int")).repartition(n, *on)
    return every.join(dealt.hint("merge"), on).drop("__salt")


def _plain(engine: Engine, keys: set[Key]) -> DataFrame:
    """(OBJECT, cls) of relations without booleans: sets with the same edges into them."""
    node = F.concat_ws("|", "src_pred", "src_type", "src_name")
    edges = R.derive_edges(engine.stored, engine.compiled, frozenset(keys))
    return fingerprint(edges.select(F.col("dst_pred").alias("o_pred"), F.col("dst_type").alias("o_type"), F.col("dst_name").alias("o_name"), node.alias("item")), *OBJECT)


def classes(engine: Engine, keys) -> DataFrame:
    """(OBJECT, cls) of the sets of ``keys`` that take in anything but usersets: those of one relation and class hold the same
    subjects, usersets aside."""
    schema, tainted = engine.compiled.schema, engine.compiled.tainted
    needed, more = set(), set(keys) & schema.relations.keys()
    while more:
        needed |= more
        more = {d for k in more & tainted for d in _read(engine, k)} - needed
    found: dict[Key, DataFrame] = {}
    plain = needed - tainted
    if plain:
        table = cut(_plain(engine, plain), "o_type", "o_pred")
        found = {(t, r): table.where((F.col("o_type") == t) & (F.col("o_pred") == r)).select("o_name", "cls") for t, r in plain}
    for stratum in engine.compiled.strata:
        for key in stratum:
            if key in needed:
                found[key] = cut(fingerprint(_items(engine, key, found), "o_name"))
    asked = [found[t, r].select(F.lit(r).alias("o_pred"), F.lit(t).alias("o_type"), "o_name", "cls") for t, r in sorted(set(keys) & needed)]
    return reduce(DataFrame.unionByName, asked)


def _read(engine: Engine, key: Key) -> set[Key]:
    """Relations whose sets a boolean relation takes in."""
    out: set[Key] = set()
    for leaf in leaves(engine.compiled.schema.relations[key]):
        out |= {(key[0], leaf.relation)} if isinstance(leaf, Computed) else set(engine.shapes(key, leaf))
    return out & engine.compiled.schema.relations.keys()


def _items(engine: Engine, key: Key, found: dict[Key, DataFrame]) -> DataFrame:
    """(o_name, item): the subjects and classes of sets that each leaf of a boolean relation takes in."""
    parts = []
    of = lambda i, *item: F.concat_ws("|", F.lit(i), *item).alias("item")
    for i, leaf in enumerate(leaves(engine.compiled.schema.relations[key])):
        if isinstance(leaf, Computed):
            if (key[0], leaf.relation) in found:
                parts.append(found[key[0], leaf.relation].select("o_name", of(i, F.lit("^"), "cls")))
            continue
        granted = engine.granted(key, leaf)
        parts.append(granted.where(F.col("via") == BARE).select("o_name", of(i, "p_type", "p_name")))
        for shape in sorted(engine.shapes(key, leaf).keys() & found.keys()):
            sets = granted.where((F.col("p_type") == shape[0]) & (F.col("via") == shape[1])).select("o_name", F.col("p_name").alias("source"))
            inner = found[shape].select(F.col("o_name").alias("source"), "cls")
            parts.append(sets.join(inner, "source").select("o_name", of(i, F.lit("^"), F.lit(shape[0]), F.lit(shape[1]), "cls")))
    return reduce(DataFrame.unionByName, parts)


def closed(engine: Engine, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The closure of the engine's edges by classes of nodes with the same edges into them, which are reached from the same
    nodes, usersets too: (dst, rep), each node's class, named by one of its nodes; (rep, src), what reaches it; and (src, dst) of
    the nodes that are like no other. ``targets`` (node): paths into these alone."""
    edges = engine.edges()
    into = edges if targets is None else edges.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi")
    alike = cut(fingerprint(into.select("dst", F.col("src").alias("item")), "dst").withColumn("shape", F.substring_index("dst", "|", 2)))
    groups = cut(alike.groupBy("shape", "cls").agg(F.min("dst").alias("rep"), (F.count("*") > 1).alias("many")))
    placed = cut(alike.join(groups.where("many"), ["shape", "cls"]).select("dst", "rep"))
    if placed.isEmpty():
        return placed, placed.select("rep", F.col("dst").alias("src")), C.reach(edges, targets=targets)
    pairs = C.reach(edges, targets=groups.select(F.col("rep").alias("node"))).join(groups.select(F.col("rep").alias("dst"), "many"), "dst")
    return placed, cut(pairs.where("many").select(F.col("dst").alias("rep"), "src")), cut(pairs.where("not many").select("src", "dst"))


def of_closure(placed: DataFrame, rows: DataFrame, own: DataFrame) -> Shared:
    """The sets of relations without booleans, from their closure by class (``closed``)."""
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    object_of = lambda c, name: [part(c, 1).alias("o_pred"), part(c, 2).alias("o_type"), part(c, 3).alias(name)]
    subject = [F.when(part("src", 3) == STAR, "star").otherwise("pos").alias("kind"), *(part("src", i).alias(c) for i, c in enumerate(M.SUBJECT, 1))]
    return Shared(placed.select(*object_of("dst", "o_name"), part("rep", 3).alias("rep")), rows.select(*object_of("rep", "rep"), *subject), own.select(*object_of("dst", "o_name"), *subject))


def people(engine: Engine, keys, subjects: DataFrame | None = None) -> DataFrame:
    """(SUBJECT, s_rep): the classes of bare subjects, of ``subjects`` alone if given, and the stars of their shapes. A subject is in sets by
    the stored tuples that name it, and no others: those with the same tuples of the relations that ``keys`` read are alike."""
    needed = ["#".join(k) for k in sorted(engine.focus(keys).needed)]
    mine = engine.stored.where((F.col("subject_predicate") == BARE) & F.concat_ws("#", "object_type", "relation").isin(needed))
    subject = [F.col(c).alias(s) for c, s in zip(TUPLE, M.SUBJECT)]
    alike = fingerprint(mine.where(F.col("subject_name") != STAR).select(*subject, F.concat_ws("|", "relation", "object_type", "object_name").alias("item")), *M.SUBJECT)
    if subjects is not None:
        bare = subjects.where((F.col("s_pred") == BARE) & (F.col("s_name") != STAR)).select(*M.SUBJECT).distinct()
        alike = bare.join(alike, list(M.SUBJECT), "left").fillna("", ["cls"])  # those that no tuple names are alike, too
    stars = mine.where(F.col("subject_name") == STAR).select(*subject).distinct()
    return cut(by_least(alike, list(M.SHAPE), "s_name", "s_rep").unionByName(stars.withColumn("s_rep", F.lit(STAR))))


def _usersets(engine: Engine, keys) -> DataFrame:
    """(s_pred, s_type, s_name) of all usersets that edges come from, or that boolean relations take in."""
    focused = engine.focus(keys)
    parts = [R.derive_edges(engine.stored, engine.compiled, focused.needed).select(*(F.col(f"src_{c}").alias(f"s_{c}") for c in ("pred", "type", "name")))]
    for key in sorted(focused.needed & engine.compiled.tainted):
        for leaf in leaves(engine.compiled.schema.relations[key]):
            if not isinstance(leaf, Computed):
                parts.append(engine.granted(key, leaf).select(F.col("via").alias("s_pred"), F.col("p_type").alias("s_type"), F.col("p_name").alias("s_name")))
    return reduce(DataFrame.unionByName, parts).where(F.col("s_pred") != BARE).distinct()


def share(engine: Engine, keys, objects: DataFrame | None = None, subjects: DataFrame | None = None, about: Column | None = None, changed: DataFrame | None = None, given: Shared | None = None) -> Shared:
    """The sets of ``keys``, of ``objects`` (OBJECT) alone, for ``subjects`` (s_pred, s_type, s_name) alone and the stars of
    their shapes, if given. ``about``: a condition on subject columns; only those rows. With ``changed`` (OBJECT) and ``given``, sets that
    a class is made of and that have not changed are read from those given, in which they are right."""
    keys, about = sorted(set(keys) & engine.compiled.schema.relations.keys()), F.lit(True) if about is None else about
    asked = None if objects is None else objects.select(*OBJECT).distinct()
    mine = F.concat_ws("#", "o_type", "o_pred").isin(["#".join(k) for k in keys]) & about
    within = lambda rows: rows if asked is None else rows.join(asked, list(OBJECT), "left_semi")
    if not keys or engine.compiled.flowing or engine.compiled.object_wildcards:
        model = within(engine.focus(keys, asked, subjects).model().where(mine))
        nothing = model.limit(0)
        return Shared(nothing.select(*OBJECT, F.col("o_name").alias("rep")), nothing.withColumnRenamed("o_name", "rep"), model.select(*ROW))
    # a class is named by its least object, which is then the one evaluated
    known = cut(within(classes(engine, keys)))
    reps = known.groupBy("o_pred", "o_type", "cls").agg(F.min("o_name").alias("rep"))
    placed = cut(known.join(reps, ["o_pred", "o_type", "cls"]).select(*OBJECT, "rep"), "o_type", "o_pred")
    reps = cut(reps.select("o_pred", "o_type", F.col("rep").alias("o_name")))
    if given is None:
        everyone = people(engine, keys, subjects)
        evaluated = engine.focus(keys, reps, cut(_reps(everyone)))
    else:
        everyone, demand = None, cut(engine.demanded(reps), "o_type", "o_pred")
        evaluated = engine.update(demand.join(changed, list(OBJECT), "left_semi"), cut(given.among(demand).model(), "o_type", "o_pred"))
    model = evaluated.model().where(mine & (F.col("s_pred") == BARE))
    held = cut(model.join(reps, list(OBJECT), "left_semi").select("o_pred", "o_type", F.col("o_name").alias("rep"), "kind", *M.SUBJECT), "o_type", "o_pred")
    rows = held if everyone is None else spread(held.withColumnRenamed("s_name", "s_rep"), everyone).select(*held.columns)
    sets = cut((_usersets(engine, keys) if subjects is None else subjects.select(*M.SUBJECT).where(F.col("s_pred") != BARE).distinct()).where(about))
    if sets.isEmpty():
        own = held.limit(0).withColumnRenamed("rep", "o_name").select(*ROW)
    else:
        own = within(engine.focus(keys, asked, sets).model().where(mine & (F.col("s_pred") != BARE))).select(*ROW)
    return Shared(placed, rows, own) if everyone is None else Shared(placed, rows, own, held, everyone)


def expand(engine: Engine, objects: DataFrame) -> DataFrame:
    """The canonical sets (ROW) of objects of boolean relations."""
    return share(engine, engine.about(objects, "o_type", "o_pred"), objects).model()


def lookup(engine: Engine, subjects: DataFrame, relations) -> DataFrame:
    """``engine.lookup`` of the sets of ``relations``."""
    return share(engine, relations, subjects=subjects).lookup(subjects)


def lookup_markers(engine: Engine, subjects: DataFrame, relations) -> DataFrame:
    """``engine.lookup_markers`` in the same way."""
    return share(engine, relations, subjects=subjects).lookup_markers(subjects)
