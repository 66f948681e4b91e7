"""Column expressions of relation tuples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlake.plans.schema import BARE, STAR

#: The columns of a tuple, in order.
TUPLE = ("subject_predicate", "subject_type", "subject_name", "relation", "object_type", "object_name")
SUBJECT, OBJECT = TUPLE[:3], TUPLE[3:]

#: Fixed rule of identifiers. ``\\z`` and not ``$``, which would allow a line end.
IDENTIFIER = r"^[A-Za-z0-9_./@+=-]{1,256}\z"


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def is_name(c: Column) -> Column:
    """An identifier or the wildcard."""
    return is_identifier(c) | F.coalesce(c == STAR, F.lit(False))


def is_predicate(c: Column) -> Column:
    return is_identifier(c) | F.coalesce(c == BARE, F.lit(False))


def position(name: Column, star_word: str) -> Column:
    """'' for a concrete name; 'any' for a wildcard subject, 'all' for a wildcard object."""
    return F.when(name == STAR, star_word).otherwise("")


def matches(pattern: dict[str, str | None], star: str = "strict") -> Column:
    """A conjunctive pattern over tuple columns; None leaves a column open. A strict
    pattern's open name does not match the wildcard, a permissive one's does."""
    out = F.lit(True)
    for c in TUPLE:
        want = pattern.get(c)
        if want is not None:
            out = out & (F.col(c) == want)
        elif c.endswith("_name") and c in pattern and star == "strict":
            out = out & (F.col(c) != STAR)
    return out


def replace(pattern: dict[str, str | None]) -> list[Column]:
    """The tuple columns with the pattern's pinned values in place."""
    return [F.lit(pattern[c]).alias(c) if pattern.get(c) is not None else F.col(c) for c in TUPLE]
