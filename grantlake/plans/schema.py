"""The relation schema: expressions, the DSL and JSON forms, and their checks.

    type mooring
      relations
        define harbour: [port]
        define berthed: [ship] and cleared from harbour
        define visits: (berthed or [crew#aboard, ship:*]) but not quarantined

A schema is driver-side metadata: a dict from (type, relation) to an expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from grantlake.plans.errors import SchemaError

BARE, STAR = "...", "*"


@dataclass(frozen=True, order=True)
class Restriction:
    """Subjects that a bracket admits: of a type, bare or with a relation, one or all."""

    type: str
    predicate: str = BARE
    star: bool = False

    def __str__(self) -> str:
        return self.type + (":*" if self.star else "") + ("" if self.predicate == BARE else f"#{self.predicate}")


@dataclass(frozen=True)
class Direct:
    restrictions: tuple[Restriction, ...]


@dataclass(frozen=True)
class Computed:
    relation: str


@dataclass(frozen=True)
class Inherited:
    """``target from tupleset``."""

    target: str
    tupleset: str


@dataclass(frozen=True)
class Union:
    children: tuple


@dataclass(frozen=True)
class Intersection:
    children: tuple


@dataclass(frozen=True)
class Exclusion:
    base: object
    subtract: object


Expression = Direct | Computed | Inherited | Union | Intersection | Exclusion
Key = tuple[str, str]


def children(e: Expression) -> tuple:
    match e:
        case Union(c) | Intersection(c):
            return c
        case Exclusion(a, b):
            return (a, b)
    return ()


def leaves(e: Expression) -> Iterator[Direct | Computed | Inherited]:
    """The leaves from left to right."""
    inner = children(e)
    if not inner:
        yield e
    for c in inner:
        yield from leaves(c)


def has_boolean(e: Expression) -> bool:
    return isinstance(e, (Intersection, Exclusion)) or any(map(has_boolean, children(e)))


@dataclass
class Schema:
    relations: dict[Key, Expression]
    types: list[str] = field(default_factory=list)
    #: (type, relation) on which tuples may have a ``*`` object.
    object_wildcards: frozenset[Key] = frozenset()

    def of_type(self, type_: str) -> list[str]:
        return [r for t, r in self.relations if t == type_]


# -- the text form --------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<bracket>\[[^\]]*\])|(?P<paren>[()])|(?P<word>[^\s()\[\]]+))")
_WORDS = {"or", "and", "but", "not", "from"}
_NAME = re.compile(r"[A-Za-z0-9_@+=/-]+\Z")


def _tokens(body: str) -> list[tuple[str, str]]:
    out, at, body = [], 0, body.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise SchemaError(f"unmatched bracket in {body!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse_restrictions(bracket: str) -> tuple[Restriction, ...]:
    out = []
    for part in filter(None, map(str.strip, bracket.strip()[1:-1].split(","))):
        left, has_predicate, predicate = (x.strip() for x in part.partition("#"))
        if has_predicate and not _NAME.match(predicate):
            raise SchemaError(f"malformed userset restriction {part!r}")
        star = left.endswith(":*")
        name = left[:-2].strip() if star else left
        if not _NAME.match(name):
            raise SchemaError(f"malformed restriction {part!r}")
        out.append(Restriction(name, predicate or BARE, star))
    return tuple(out)


class _Reader:
    """expr := chain ['but' 'not' chain]; chain := unit (('or' | 'and') unit)*;
    unit := '(' expr ')' | bracket | name ['from' name]."""

    def __init__(self, body: str, where: str):
        self.tokens, self.at, self.where = _tokens(body), 0, where

    def fail(self, what: str):
        raise SchemaError(f"{self.where}: {what}")

    def next_is(self, *words: str) -> bool:
        return [t for _, t in self.tokens[self.at : self.at + len(words)]] == list(words) and self.tokens[self.at][0] != "bracket"

    def take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            self.fail("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Expression:
        e = self.expression()
        if self.at < len(self.tokens):
            self.fail(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def expression(self) -> Expression:
        base = self.chain()
        if self.next_is("but", "not"):
            self.at += 2
            return Exclusion(base, self.chain())
        return base

    def chain(self) -> Expression:
        parts, joined = [self.unit()], None
        while self.next_is("or") or self.next_is("and"):
            word = self.take()[1]
            if joined not in (None, word):
                self.fail("'or' and 'and' need parentheses between them")
            joined = word
            parts.append(self.unit())
        return parts[0] if joined is None else (Union if joined == "or" else Intersection)(tuple(parts))

    def name(self) -> str:
        kind, text = self.take()
        if kind != "word" or text in _WORDS:
            self.fail(f"unexpected {text!r}")
        if "." in text:
            self.fail(f"'.' is reserved in relation names: {text!r}")
        return text

    def unit(self) -> Expression:
        if self.next_is("("):
            self.at += 1
            e = self.expression()
            if self.take()[1] != ")":
                self.fail("missing ')'")
            return e
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "bracket":
            return Direct(parse_restrictions(self.take()[1]))
        name = self.name()
        if self.next_is("from"):
            self.at += 1
            return Inherited(name, self.name())
        return Computed(name)


def parse(text: str, object_wildcards: frozenset[Key] | set[Key] = frozenset()) -> Schema:
    """Read the text form. Lines of ``model``, ``schema`` and ``relations``, empty
    lines and comments say nothing."""
    relations, types = {}, []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("type "):
            types.append(line[5:].strip())
            if types.count(types[-1]) > 1:
                raise SchemaError(f"type {types[-1]!r} stands twice")
        elif line.startswith("define "):
            if not types:
                raise SchemaError("a relation outside of a type")
            name, colon, body = line[7:].partition(":")
            key = types[-1], name.strip()
            if not colon or not _NAME.match(key[1]):
                raise SchemaError(f"malformed relation {line!r}")
            if key in relations:
                raise SchemaError(f"relation {key} stands twice")
            relations[key] = _Reader(body, "#".join(key)).whole()
    return Schema(relations, types, frozenset(object_wildcards))


def render(e: Expression, outer: bool = True) -> str:
    match e:
        case Direct(r):
            return "[" + ", ".join(map(str, r)) + "]"
        case Computed(r):
            return r
        case Inherited(t, p):
            return f"{t} from {p}"
        case Exclusion(a, b):
            text = f"{render(a, False)} but not {render(b, False)}"
        case _:
            text = (" or " if isinstance(e, Union) else " and ").join(render(c, False) for c in e.children)
    return text if outer else f"({text})"


def unparse(schema: Schema) -> str:
    """A text that reads back as the same schema."""
    lines = ["model", "  schema 1.1"]
    for t in schema.types:
        lines += ["", f"type {t}"]
        own = schema.of_type(t)
        lines += ["  relations"] * bool(own) + [f"    define {r}: {render(schema.relations[t, r])}" for r in own]
    return "\n".join(lines) + "\n"


# -- the JSON form ----------------------------------------------------------------


def parse_json(model: str | dict) -> Schema:
    """Read an authorization model of JSON schema version 1.1."""
    model = json.loads(model) if isinstance(model, str) else model
    relations, types = {}, []
    if model.get("conditions"):
        raise SchemaError("conditions are not supported")
    for definition in model.get("type_definitions", []):
        t = definition["type"]
        if t in types:
            raise SchemaError(f"type {t!r} stands twice")
        types.append(t)
        meta = ((definition.get("metadata") or {}).get("relations")) or {}
        for r, rewrite in (definition.get("relations") or {}).items():
            allowed = (meta.get(r) or {}).get("directly_related_user_types") or []
            if any("condition" in x for x in allowed):
                raise SchemaError("conditions are not supported")
            direct = Direct(tuple(Restriction(x["type"], x.get("relation") or BARE, "wildcard" in x) for x in allowed))
            relations[t, r] = _from_json(rewrite, direct, f"{t}#{r}")
    return Schema(relations, types)


def _from_json(node: dict, direct: Direct, where: str) -> Expression:
    read = lambda x: _from_json(x, direct, where)
    match node:
        case {"this": _}:
            return direct
        case {"computedUserset": {"relation": r}}:
            return Computed(r)
        case {"tupleToUserset": {"tupleset": {"relation": p}, "computedUserset": {"relation": t}}}:
            return Inherited(t, p)
        case {"difference": {"base": a, "subtract": b}}:
            return Exclusion(read(a), read(b))
        case {"union": {"child": [_, *_] as c}}:
            return Union(tuple(map(read, c))) if len(c) > 1 else read(c[0])
        case {"intersection": {"child": [_, *_] as c}}:
            return Intersection(tuple(map(read, c))) if len(c) > 1 else read(c[0])
    raise SchemaError(f"{where}: unknown or empty rewrite {node!r}")


def json_to_text(model: str | dict) -> str:
    return unparse(parse_json(model))
