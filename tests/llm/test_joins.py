import random

import pytest

from gaugeline.llm.joins import components


@pytest.mark.parametrize("per_task", [10**6, 60])
def test_components_of_chains_stars_and_pairs(spark, per_task):
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(90)] + [(1000, 1001 + i) for i in range(80)] + [(2000 + 2 * i, 2001 + 2 * i) for i in range(30)] + [(7, 7), (5, 4), (4, 5)]
    pick.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint"), per_task).collect()
    assert len(rows) == len({r.v for r in rows}) == 91 + 81 + 60
    parts = {}
    for r in rows:
        parts.setdefault(r.root, set()).add(r.v)
    assert sorted(map(sorted, parts.values())) == sorted([list(range(91)), list(range(1000, 1081))] + [[2000 + 2 * i, 2001 + 2 * i] for i in range(30)])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
