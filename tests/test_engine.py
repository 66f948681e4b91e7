import itertools

import pytest

from grantlake.functions.columns import TUPLE
from grantlake.operators.engine import Engine, lookup, lookup_markers
from grantlake.plans.compile import compile_schema, dependency_rows
from grantlake.plans.schema import BARE, parse
from tests import schemas
from tests.pointwise import Pointwise

COLUMNS = ", ".join(f"{c} string" for c in TUPLE)


def grid(schema, compiled):
    """Every question over the names, one that no tuple has, and the wildcard."""
    names = ["a", "b", "c", "ghost"]
    shapes = sorted({(BARE, t) for t in schema.types} | {(p, t) for t, p in schema.relations})
    for (p, t), n in itertools.product(shapes, [*names, "*"]):
        for (ot, r), on in itertools.product(schema.relations, [*names, "*"]):
            yield (p, t, n, r, ot, on)


@pytest.mark.parametrize("name,seed", [(n, s) for s, n in enumerate(schemas.ALL)])
def test_checks_agree_with_pointwise_ones(spark, name, seed):
    text, wild = schemas.ALL[name]
    schema = parse(text, wild)
    compiled = compile_schema(schema)
    tuples = schemas.tuples_of(schema, compiled, seed, 36)
    oracle = Pointwise(schema, tuples)
    engine = Engine(compiled, spark.createDataFrame(tuples, COLUMNS))
    asked = [q for q in grid(schema, compiled) if not (q[5] == "*" and (q[4], q[3]) in compiled.tainted)]
    got = {tuple(r[:6]): r[6] for r in engine.check(spark.createDataFrame(asked, COLUMNS)).collect()}
    by_subject = {}
    for q in asked:
        by_subject.setdefault(q[:3], []).append(q)
    wrong = []
    for subject, qs in by_subject.items():
        true = oracle.satisfied(subject, {(q[4], q[5]) for q in qs})
        wrong += [(q, got[q]) for q in qs if got[q] != ((q[4], q[5], q[3]) in true)]
    assert not wrong, (len(wrong), wrong[:5], tuples)


def test_asked_subjects_alone(spark):
    """Lookups and one-relation evaluations for some subjects are those of the whole model."""
    schema = parse(schemas.FAIR)
    compiled = compile_schema(schema)
    engine = Engine(compiled, spark.createDataFrame(schemas.tuples_of(schema, compiled, 5, 40), COLUMNS))
    subjects = [(BARE, "visitor", "a"), (BARE, "visitor", "ghost"), ("cast", "troupe", "b")]
    asked = spark.createDataFrame(subjects, "s_pred string, s_type string, s_name string")
    model = engine.model().cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(engine.lookup(asked)) == rows(lookup(model, asked)) != []
    key = ("booth", "inside")
    assert rows(engine.lookup_markers(asked, [key])) == rows(lookup_markers(model.where("o_type = 'booth' and o_pred = 'inside'"), asked)) != []
    mine = model.where("o_type = 'booth' and o_pred = 'inside'").collect()
    want = [(r["o_name"], r["kind"], *r[4:7]) for r in mine if r["kind"] == "star" or tuple(r[4:7]) in subjects]
    assert rows(engine.evaluate(key, asked)) == sorted(want) != []


@pytest.mark.parametrize("name,key", [("lab", ("run", "sealed")), ("jury", ("trial", "sealed"))])
def test_asked_objects_alone(spark, name, key):
    """Sets of some objects are those of the whole model, from no other sets than those that they are made of."""
    schema = parse(schemas.ALL[name][0])
    compiled = compile_schema(schema)
    engine = Engine(compiled, spark.createDataFrame(schemas.tuples_of(schema, compiled, 4, 45), COLUMNS))
    asked = spark.createDataFrame([(key[1], key[0], "a"), (key[1], key[0], "ghost")], "o_pred string, o_type string, o_name string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    mine = engine.model().where(f"o_type = '{key[0]}' and o_pred = '{key[1]}' and o_name = 'a'")
    assert rows(engine.expand(asked)) == rows(mine) == rows(engine.lookup_reverse(asked)) != []
    needed = {(r["o_type"], r["o_pred"], r["o_name"]) for r in engine.focus([key], asked).demand.collect()}
    assert (key[0], key[1], "b") not in needed and (key[0], key[1], "a") in needed
    # by hand: what each needed boolean set reads is needed, and everything but the asked sets is read by one that is needed
    links = {(x[5], x[6]): [] for x in dependency_rows(schema)}
    for kind, st, sr, via, pred, dt, dr in dependency_rows(schema):
        links[dt, dr].append((kind, st, sr, via, pred))
    stored = [tuple(r) for r in engine.stored.collect()]
    names = {(t, n) for sp, st, sn, r, ot, on in stored for t, n in ((st, sn), (ot, on)) if n != "*"}
    want, more = set(), {(key[0], key[1], n) for n in ("a", "ghost")}
    while more:
        want |= more
        reads = set()
        for t, r, n in more:
            for kind, st, sr, via, pred in links.get((t, r), []) if (t, r) in compiled.tainted else []:
                who = {n} if kind == "computed" else {x[2] for x in stored if x[0] == pred and x[1] == st and x[3] == via and x[4:] == (t, n)}
                reads |= {(st, sr, w) for x in who for w in ({m for u, m in names if u == st} if x == "*" else {x})}
        more = reads - want
    assert needed == want
