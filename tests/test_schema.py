import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grantlake.plans.compile import compile_schema, fan_out
from grantlake.plans.errors import CyclicDerivedDependency, DoublyBridgedShape, SchemaError, UnsupportedSchema
from grantlake.plans.schema import Computed, Direct, Exclusion, Inherited, Intersection, Restriction, Schema, Union, json_to_text, parse, parse_json, unparse
from tests import schemas

R = Restriction


def test_parse_forms():
    s = parse("type user\ntype doc\n relations\n define a: [user, user:*, group#member, group:*#member]\n define b: (a but not c) or a from p")
    assert s.relations["doc", "a"] == Direct((R("user"), R("user", "...", True), R("group", "member"), R("group", "member", True)))
    assert s.relations["doc", "b"] == Union((Exclusion(Computed("a"), Computed("c")), Inherited("a", "p")))


@pytest.mark.parametrize("body", ["x or y and z", "x but y", "[user, group#m", "m]", "((x)", "x y", "and x", "x from", "from p", "[g#m#n]", "[g m]", "x or p.q", ""])
def test_malformed(body):
    with pytest.raises(SchemaError):
        parse(f"type doc\n define r: {body}")


@pytest.mark.parametrize("text", ["define a: [user]", "type a\ntype a", "type a\ndefine x: [a]\ndefine x: [a]", "type a\ndefine x.y: [a]"])
def test_malformed_text(text):
    with pytest.raises(SchemaError):
        parse(text)


@pytest.mark.parametrize("name", schemas.ALL)
def test_round_trip(name):
    s = parse(schemas.ALL[name][0])
    assert parse(unparse(s)) == s


names = st.sampled_from(["a", "b", "c"])
leaf = st.one_of(st.builds(Computed, names), st.builds(Inherited, names, names), st.builds(lambda r: Direct((r,)), st.builds(R, st.just("user"), st.sampled_from(["...", "a"]), st.booleans())))
many = lambda kind, inner: st.lists(inner, min_size=2, max_size=3).map(lambda c: kind(tuple(c)))
expression = st.recursive(leaf, lambda inner: st.one_of(many(Union, inner), many(Intersection, inner), st.builds(Exclusion, inner, inner)), max_leaves=8)


@given(expression)
@settings(max_examples=150, deadline=None)
def test_any_expression_round_trips(e):
    s = Schema({("doc", "r"): e}, ["user", "doc"])
    assert parse(unparse(s)).relations == s.relations


def test_json():
    model = {"schema_version": "1.1", "type_definitions": [{"type": "user"}, {"type": "doc", "relations": {"parent": {"this": {}}, "viewer": {"union": {"child": [{"this": {}}, {"difference": {"base": {"computedUserset": {"relation": "parent"}}, "subtract": {"tupleToUserset": {"tupleset": {"relation": "parent"}, "computedUserset": {"relation": "viewer"}}}}}]}}}, "metadata": {"relations": {"parent": {"directly_related_user_types": [{"type": "doc"}]}, "viewer": {"directly_related_user_types": [{"type": "user", "wildcard": {}}]}}}}]}
    s = parse_json(model)
    assert s.relations["doc", "viewer"] == Union((Direct((R("user", "...", True),)), Exclusion(Computed("parent"), Inherited("viewer", "parent"))))
    assert parse(json_to_text(model)).relations == s.relations
    for bad in ({"conditions": {"c": {}}}, {"type_definitions": [{"type": "a"}, {"type": "a"}]}, {"type_definitions": [{"type": "a", "relations": {"r": {"union": {"child": []}}}}]}):
        with pytest.raises(SchemaError):
            parse_json(bad)


def test_strata_and_scope():
    c = compile_schema(parse(schemas.LAB))
    assert c.strata == [[("lab", "cleared")], [("bench", "booked")], [("bench", "operator")], [("bench", "watcher"), ("run", "signer")], [("run", "observer")], [("run", "sealed")]]
    assert ("bench", "operator") in fan_out(c)["lab", "cleared"]
    with pytest.raises(CyclicDerivedDependency):
        compile_schema(parse("type user\ntype doc\n define p: [doc]\n define v: [user] but not w\n define w: v from p"))
    with pytest.raises(UnsupportedSchema):
        compile_schema(parse("type g\n define m: [g]\ntype doc\n define p: [g#m]\n define v: m from p"))
    with pytest.raises(UnsupportedSchema):
        compile_schema(parse("type user\ntype doc\n define a: [user]\n define v: [user] and a", {("doc", "v")}))
    with pytest.raises(DoublyBridgedShape):
        compile_schema(parse("type user\ntype doc\n define v: [user, doc:*#v]", {("doc", "v")}))
