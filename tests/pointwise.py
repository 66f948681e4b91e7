"""A plain evaluator of one check at a time, to hold the engine against.

Works on the parsed schema and a list of tuples (s_pred, s_type, s_name, relation,
o_type, o_name), by naive iteration: the set of satisfied (type, name, relation) nodes for
one fixed subject is computed relation layer by relation layer to a fixpoint."""

from grantlake.plans.compile import dependencies
from grantlake.plans.schema import BARE, STAR, Computed, Direct, Exclusion, Inherited, Intersection


class Pointwise:
    def __init__(self, schema, tuples):
        self.schema, self.tuples = schema, set(tuples)
        self.names = {}
        for sp, st, sn, r, ot, on in self.tuples:
            for t, n in ((st, sn), (ot, on)):
                if n != STAR:
                    self.names.setdefault(t, set()).add(n)

    def _layers(self):
        """Strongly connected relations together, dependencies first."""
        keys = list(self.schema.relations)
        reach = {k: set(dependencies(self.schema, k)) for k in keys}
        for k in keys:
            todo = list(reach[k])
            while todo:
                for n in reach.get(todo.pop(), ()):
                    if n not in reach[k]:
                        reach[k].add(n)
                        todo.append(n)
        left, out = set(keys), []
        while left:
            for k in sorted(left):
                group = {k} | {x for x in reach[k] if k in reach[x]}
                if not (reach[k] - group) & left:
                    out.append(group)
                    left -= group
                    break
            else:
                raise ValueError("no order")
        return out

    def satisfied(self, subject, objects):
        """All true (type, name, relation) for a subject (pred, type, name); ``objects``
        are more (type, name) to decide on."""
        true = set()
        nodes = {(t, n) for t, ns in self.names.items() for n in ns} | set(objects) | {(t, STAR) for t in self.schema.types}
        for layer in self._layers():
            while True:
                more = {(t, n, r) for t, r in layer for ot, n in nodes if ot == t and (t, n, r) not in true and self._holds(self.schema.relations[t, r], subject, t, n, r, true)}
                if not more:
                    break
                true |= more
        return true

    def _holds(self, e, subject, t, n, r, true):
        match e:
            case Exclusion(a, b):
                return self._holds(a, subject, t, n, r, true) and not self._holds(b, subject, t, n, r, true)
            case Intersection(c):
                return all(self._holds(x, subject, t, n, r, true) for x in c)
            case Computed(other):
                return (t, n, other) in true
            case Direct(allowed):
                return any(self._grants(g, subject, true) for g in self._stored(t, n, r) if any((a.type, a.predicate, a.star) == (g[1], g[0], g[2] == STAR) for a in allowed))
            case Inherited(target, p):
                return any(self._grants((target, g[1], g[2]), subject, true) for g in self._stored(t, n, p) if g[0] == BARE)
        return any(self._holds(x, subject, t, n, r, true) for x in e.children)

    def _stored(self, t, n, r):
        return [x[:3] for x in self.tuples if x[3:5] == (r, t) and x[5] in {n, STAR}]

    def _grants(self, grant, subject, true):
        """Does a granted (pred, type, name) cover the subject?"""
        pred, t, n = grant
        if grant == subject or (n == STAR and (pred, t) == subject[:2]):
            return True
        if pred == BARE:
            return False
        inside = self.names.get(t, ()) if n == STAR else (n,)
        return any((t, i, pred) in true for i in inside)

    def check(self, sp, st, sn, r, ot, on):
        return (ot, on, r) in self.satisfied((sp, st, sn), [(ot, on)])
