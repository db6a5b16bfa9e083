"""Components of long chains, and the error when rounds do not suffice."""

import random

import pytest

from spanforge.llm.common import connected_components
from spanforge.operators import dedup


def test_components_of_long_paths(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:]), (2000, 2001), (2001, 2000), (2002, 2002)], "a long, b long")
    got = {r["node"]: r["component"] for r in dedup.components(e).collect()}
    assert got == dict.fromkeys(ids, 0) | {2000: 2000, 2001: 2000}
    for f in (lambda: dedup.components(e, rounds=2), lambda: connected_components(e, max_rounds=2)):
        with pytest.raises(RuntimeError):
            f()
