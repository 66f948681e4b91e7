import pytest
from pyspark.sql import functions as F

from grantlake import queries as Q
from grantlake.operators import engine as E
from grantlake.operators import members as M
from grantlake.operators import shared as S
from grantlake.operators.engine import OBJECT, ROW, Engine
from grantlake.plans.compile import compile_schema
from grantlake.plans.schema import parse
from grantlake.sources.probes import Probes
from tests import schemas
from tests.test_engine import COLUMNS

BOOTHS = 40
MEMBERS = 60


def fair(spark):
    """A troupe barred from many starred booths, of which some sell its first member a ticket."""
    rows = [("...", "visitor", f"v{k}", "cast", "troupe", "big") for k in range(MEMBERS)]
    for k in range(BOOTHS):
        rows += [("...", "visitor", "*", "gate", "booth", f"b{k}"), ("cast", "troupe", "big", "barred", "booth", f"b{k}"), ("...", "booth", f"b{k}", "stands", "street", f"s{k}")]
    rows += [("...", "visitor", "v0", "ticket", "booth", f"b{k}") for k in range(0, BOOTHS, 4)]
    return Engine(compile_schema(parse(schemas.FAIR)), spark.createDataFrame(rows, COLUMNS))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("name,seed", [("fair", 1), ("lab", 2), ("jury", 4), ("lines", 5)])
def test_shared_sets_are_those_of_the_model(spark, name, seed):
    schema = parse(schemas.ALL[name][0])
    compiled = compile_schema(schema)
    engine = Engine(compiled, spark.createDataFrame(schemas.tuples_of(schema, compiled, seed, 44), COLUMNS))
    same(S.share(engine, schema.relations).model(), engine.model().select(*ROW))


def test_alike_objects_are_evaluated_once(spark):
    """Two classes of booths and of streets, whatever their number; streets differ by the booth that they name."""
    engine = fair(spark)
    keys = [("booth", "inside"), ("street", "crowd")]
    shared = S.share(engine, keys)
    assert shared.rows.count() == 2 * (1 + MEMBERS + 1 + MEMBERS - 1)  # the star and the members barred, or all but one
    assert shared.own.count() == BOOTHS
    same(shared.sizes("kind"), shared.model().groupBy(*OBJECT, "kind").agg(F.count("*").alias("n")))
    same(shared.model(), engine.focus(keys).model().where("o_pred in ('inside', 'crowd')").select(*ROW))


def test_inherited_sets_are_counted_by_class(spark):
    """F8: customers of a nation have one set between them."""
    rows = [("...", "user", f"u{k}", "member", "group", "g") for k in range(9)] + [("member", "group", "g", "viewer", "region", "r")]
    rows += [("...", "region", "r", "parent", "nation", f"n{k}") for k in range(2)] + [("...", "nation", f"n{k % 2}", "parent", "customer", f"c{k}") for k in range(30)]
    engine = Engine(Q.ACCESS_SCHEMA, spark.createDataFrame(rows, COLUMNS))
    viewers = S.share(engine, [("customer", "viewer")], about=F.col("s_type") == "user")
    assert viewers.rows.count() == 2 * 9
    same(viewers.sizes().select("o_name", "n"), spark.createDataFrame([(f"c{k}", 9) for k in range(30)], "o_name string, n long"))


def test_answers_about_shared_sets(spark, tmp_path):
    """Lookups, expansion, counts, sets beside others and probes say of shared sets what is said of the model; the layout
    holds a class once, however many objects have it."""
    engine, key = fair(spark), ("booth", "inside")
    model = engine.focus([key]).model().where("o_pred = 'inside'").select(*ROW)
    who = spark.createDataFrame([("...", "visitor", v) for v in ("v0", "v1", "ghost")], "s_pred string, s_type string, s_name string")
    same(S.lookup(engine, who, [key]), E.lookup(model, who))
    same(S.lookup_markers(engine, who, [key]), E.lookup_markers(model, who))
    objects = model.select(*OBJECT).distinct()
    same(S.expand(engine, objects.where("o_name in ('b0', 'b1')")), model.where("o_name in ('b0', 'b1')"))
    shared, people = S.share(engine, [key]), who.unionByName(spark.createDataFrame([("...", "visitor", "v2")], who.schema))
    same(shared.members(people).select("o_name", "n"), M.count_members(model, people, ["o_name"]))
    other = [("inside", "booth", f"b{k}", *row) for k in range(10, 20) for row in (("pos", "...", "visitor", "v3"), ("pos", "...", "visitor", "v3"))] + [("inside", "booth", "else", "star", "...", "visitor", "*")]
    other = spark.createDataFrame(other, model.schema)
    placed, a, b = shared.beside(other)
    assert a.select("o_name").distinct().count() == 4 and placed.count() == BOOTHS + 1
    for op in (M.union, M.intersect, M.subtract):
        same(S.spread(placed, op(a, b, OBJECT).withColumnRenamed("o_name", "rep")).select(*ROW), op(model, other, OBJECT).select(*ROW))
    laid, plain = Probes.write(shared, f"file://{tmp_path}/s", 3), Probes.write(model, f"file://{tmp_path}/p", 3)
    assert laid.table("pairs").count() == shared.rows.count() < plain.table("pairs").count()
    asked = spark.createDataFrame([("...", "visitor", v, "inside", "booth", o) for v in ("v0", "v1", "ghost", "*") for o in ("b0", "b1", "nowhere")], COLUMNS)
    same(laid.check(asked), plain.check(asked))
    same(laid.lookup_reverse(objects), plain.lookup_reverse(objects))
    same(laid.lookup_markers(who), plain.lookup_markers(who))


def test_alike_subjects_are_evaluated_once(spark):
    """all members of the troupe but the one with tickets are one class, whatever their number."""
    engine = fair(spark)
    keys = [("booth", "inside"), ("street", "crowd")]
    shared = S.share(engine, keys)
    assert shared.held.count() == 2 * (1 + 2 + 1 + 1)  # the star and both classes barred, or the star and one
    assert sorted(shared.people.groupBy("s_rep").count().collect()) == [("*", 1), ("v0", 1), ("v1", MEMBERS - 1)]
    same(shared.model(), engine.focus(keys).model().where("o_pred in ('inside', 'crowd')").select(*ROW))
    who = spark.createDataFrame([("...", "visitor", v) for v in ("v0", "v1", "v2", "ghost", "spirit")], "s_pred string, s_type string, s_name string")
    asked = S.share(engine, keys, subjects=who)
    assert asked.people.where("s_name <> '*'").select("s_rep").distinct().count() == 3  # names that no tuple has are alike
    same(asked.lookup(who), E.lookup(shared.model(), who))
    same(shared.lookup(who), E.lookup(shared.model(), who))
    same(shared.lookup_markers(who), E.lookup_markers(shared.model(), who))


def test_sets_beside_others_by_classes_of_subjects(spark):
    """rows beside shared sets part the subjects that they name from those that they do not."""
    engine, key = fair(spark), ("booth", "inside")
    model = engine.focus([key]).model().where("o_pred = 'inside'").select(*ROW)
    other = [("inside", "booth", f"b{k}", *row) for k in range(10, 20) for row in (("pos", "...", "visitor", "v3"), ("pos", "...", "visitor", "v3"), ("neg", "...", "visitor", "v4"))]
    other = spark.createDataFrame(other + [("inside", "booth", "else", "star", "...", "visitor", "*"), ("inside", "booth", "b11", "pos", "...", "visitor", "new")], model.schema)
    placed, people, a, b = S.share(engine, [key]).together(other)
    assert a.select("s_name").distinct().count() == 5  # *, v0, v3, v4 and all others
    for op in (M.union, M.intersect, M.subtract):
        same(S.unfold(placed, op(a, b, OBJECT).withColumnRenamed("o_name", "rep"), people).select(*ROW), op(model, other, OBJECT).select(*ROW))


def test_long_lists_of_names(spark, monkeypatch):
    """More names than one list has, on both sides."""
    monkeypatch.setattr(S, "NAMES", 7)
    engine, key = fair(spark), ("booth", "inside")
    same(S.share(engine, [key]).model(), engine.focus([key]).model().where("o_pred = 'inside'").select(*ROW))
