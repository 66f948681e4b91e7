"""What a schema means for data: rewrite rules, strata and shapes.

Everything here depends on the schema alone and runs on the driver. The result
is a small rule table for one broadcast join, and an order of evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from grantlake.plans.errors import CyclicDerivedDependency, DoublyBridgedShape, SchemaError, UnsupportedSchema
from grantlake.plans.schema import BARE, Computed, Direct, Exclusion, Inherited, Key, Schema, Union, children, has_boolean, leaves

Shape = tuple[str, str]


@dataclass(frozen=True, order=True)
class Rule:
    """A stored tuple on (object_type, relation) whose subject is of (subject_type,
    subject_predicate, star) gives an edge into ``target``. ``predicate`` replaces
    the subject's predicate, if the edge comes from an inherited relation."""

    object_type: str
    relation: str
    subject_type: str
    subject_predicate: str
    star: bool
    predicate: str
    target: str


@dataclass
class Compiled:
    schema: Schema
    tainted: frozenset[Key]
    strata: list[list[Key]]
    rules: list[Rule]
    admitted: list[tuple[str, str, str, str, bool]]
    #: Shapes of subject wildcards with a predicate: their instances' members flow through them.
    flowing: frozenset[Shape]
    subject_wildcards: frozenset[Shape]
    object_wildcards: frozenset[Key]

    def is_tainted(self, type_: str, relation: str) -> bool:
        return (type_, relation) in self.tainted


def stored_restrictions(schema: Schema, key: Key) -> list:
    """What may be stored on a relation: the brackets of its own expression."""
    e = schema.relations.get(key)
    return [] if e is None else sorted({r for leaf in leaves(e) if isinstance(leaf, Direct) for r in leaf.restrictions})


def dependencies(schema: Schema, key: Key) -> set[Key]:
    """Relations that ``key`` reads."""
    out: set[Key] = set()
    for leaf in leaves(schema.relations[key]):
        match leaf:
            case Direct(rs):
                out |= {(r.type, r.predicate) for r in rs if r.predicate != BARE}
            case Computed(r):
                out.add((key[0], r))
            case Inherited(t, p):
                out |= {(r.type, t) for r in stored_restrictions(schema, (key[0], p)) if r.predicate == BARE}
    return {k for k in out if k in schema.relations}


def dependency_rows(schema: Schema) -> list[tuple[str, str, str, str, str, str, str]]:
    """(kind, source type, source relation, stored relation, stored predicate, type, relation):
    a change of the source reaches the relation on the same object (computed), or on
    the objects of stored tuples whose subject is the source (userset, inherited)."""
    out = set()
    for (t, r), e in schema.relations.items():
        for leaf in leaves(e):
            match leaf:
                case Computed(other):
                    out.add(("computed", t, other, "", "", t, r))
                case Direct(rs):
                    out |= {("userset", x.type, x.predicate, r, x.predicate, t, r) for x in rs if x.predicate != BARE}
                case Inherited(target, p):
                    out |= {("inherited", x.type, target, p, BARE, t, r) for x in stored_restrictions(schema, (t, p)) if x.predicate == BARE}
    return sorted(out)


def taint(schema: Schema) -> frozenset[Key]:
    """Relations that hold, or read one that holds, an intersection or exclusion."""
    found = {k for k, e in schema.relations.items() if has_boolean(e)}
    while more := {k for k in schema.relations if k not in found and dependencies(schema, k) & found}:
        found |= more
    return frozenset(found)


def stratify(schema: Schema, tainted: frozenset[Key]) -> list[list[Key]]:
    """Tainted relations in an order in which each reads only earlier ones."""
    left, out = {k: dependencies(schema, k) & tainted for k in tainted}, []
    while left:
        ready = sorted(k for k, needs in left.items() if not needs & left.keys())
        if not ready:
            raise CyclicDerivedDependency(f"relations depend on themselves through a boolean: {sorted(left)}")
        out.append(ready)
        for k in ready:
            del left[k]
    return out


def _readers(schema: Schema, tainted: frozenset[Key], key: Key) -> set[str]:
    """Untainted relations that include ``key`` by computed references, itself too."""
    out, more = set(), {key[1]}
    while more:
        out |= more
        more = {r for r in schema.of_type(key[0]) if r not in out and (key[0], r) not in tainted and any(isinstance(x, Computed) and x.relation in more for x in leaves(schema.relations[key[0], r]))}
    return {r for r in out if (key[0], r) not in tainted}


def rules_of(schema: Schema, tainted: frozenset[Key]) -> list[Rule]:
    """The closure of all rewrites: a rule matches on the tuple's object type,
    relation and subject shape alone, so none has to be applied twice."""
    out: set[Rule] = set()
    for (t, r), e in schema.relations.items():
        if (t, r) in tainted:
            continue
        readers = _readers(schema, tainted, (t, r))
        for leaf in leaves(e):
            match leaf:
                case Direct(rs):
                    out |= {Rule(t, r, x.type, x.predicate, x.star, "", to) for x in rs for to in readers}
                case Inherited(target, p):
                    parents = [x for x in stored_restrictions(schema, (t, p)) if x.predicate == BARE]
                    out |= {Rule(t, p, x.type, BARE, x.star, target, to) for x in parents for to in readers}
    return sorted(out)


def check_scope(schema: Schema, tainted: frozenset[Key]) -> None:
    for key, e in schema.relations.items():
        t, r = key
        for leaf in leaves(e):
            source = schema.relations.get((t, leaf.tupleset)) if isinstance(leaf, Inherited) else None
            if source is not None:  # an undeclared relation has no members
                stored = stored_restrictions(schema, (t, leaf.tupleset))
                if any(x.predicate != BARE for x in stored):
                    raise UnsupportedSchema(f"{t}#{leaf.tupleset} admits usersets, so nothing can inherit through it")
                if (t, leaf.tupleset) not in tainted and not all(isinstance(x, Direct) for x in leaves(source)):
                    raise UnsupportedSchema(f"{t}#{leaf.tupleset} must be stored directly")
                if (t, leaf.tupleset) in schema.object_wildcards and any(x.star for x in stored):
                    raise DoublyBridgedShape(f"{t}#{leaf.tupleset} has wildcards on both sides")
    for key in schema.object_wildcards:
        if key not in schema.relations:
            raise SchemaError(f"object wildcard on unknown relation {key}")
        if key in tainted:
            raise UnsupportedSchema(f"object wildcard on the derived relation {key}")
    star_usersets = {(x.type, x.predicate) for k in schema.relations for x in stored_restrictions(schema, k) if x.star and x.predicate != BARE}
    if both := star_usersets & schema.object_wildcards:
        raise DoublyBridgedShape(f"wildcards on both sides of {sorted(both)}")


def compile_schema(schema: Schema) -> Compiled:
    tainted = taint(schema)
    check_scope(schema, tainted)
    strata, rules = stratify(schema, tainted), rules_of(schema, tainted)
    admitted = sorted({(t, r, x.type, x.predicate, x.star) for t, r in schema.relations for x in stored_restrictions(schema, (t, r))})
    wild = {(x[2], x[3]) for x in admitted if x[4]}
    through = {(x.subject_type, x.predicate) for x in rules if x.star and x.predicate}
    for key in tainted:  # star parents of derived relations, whose instances' members flow too
        for leaf in leaves(schema.relations[key]):
            if isinstance(leaf, Inherited):
                through |= {(x.type, leaf.target) for x in stored_restrictions(schema, (key[0], leaf.tupleset)) if x.star}
    flowing = {s for s in wild | through if s[1] != BARE}
    return Compiled(schema, tainted, strata, rules, admitted, frozenset(flowing), frozenset(wild | through), schema.object_wildcards)


def fan_out(compiled: Compiled) -> dict[Key, set[Key]]:
    """For each relation, those that have to be looked at again when it changes."""
    out: dict[Key, set[Key]] = {}
    for key in compiled.schema.relations:
        for other in dependencies(compiled.schema, key):
            out.setdefault(other, set()).add(key)
    return out


__all__ = ["Compiled", "Rule", "compile_schema", "dependencies", "fan_out", "stratify", "taint", "Union", "Exclusion", "children"]
