import random

import pytest

from grantlake.functions.columns import TUPLE
from grantlake.operators import invariants as I
from grantlake.operators.engine import Engine
from grantlake.operators.incremental import affected, refresh, touched
from grantlake.plans.compile import compile_schema
from grantlake.plans.schema import parse
from tests import schemas

COLUMNS = ", ".join(f"{c} string" for c in TUPLE)


@pytest.mark.parametrize("name", ["mine", "lab"])
def test_only_affected_sets_change(spark, name):
    text, wild = schemas.ALL[name]
    schema = parse(text, wild)
    compiled = compile_schema(schema)
    tuples = [t for t in schemas.tuples_of(schema, compiled, 11, 24) if t[5] != "*"]
    gone = set(random.Random(1).sample(tuples, 2))
    before = Engine(compiled, spark.createDataFrame(tuples, COLUMNS))
    after = Engine(compiled, spark.createDataFrame([t for t in tuples if t not in gone], COLUMNS))
    keys = affected(compiled, before.stored, touched(compiled, spark.createDataFrame(sorted(gone), COLUMNS)))
    got = refresh(before.model(), after, keys)
    assert I.changed(got, after.model()).isEmpty()
