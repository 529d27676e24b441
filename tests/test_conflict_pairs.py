"""Conflicts of small cases come from one row a case, and pairs that are far apart go before paths are looked at."""

import random

import pytest

from ostiary.operators import resolve, spatial

POINT = "struct<x:double,y:double,z:double>"
SCHEMA = f"case_id string, rank long, ostium {POINT}, seed {POINT}, radius_mm double, path array<{POINT}>"


def rows(spark):
    pick = random.Random(5)
    made = []
    for case in range(30):
        for rank in range(1, 10):
            at = [pick.uniform(0, 9) for _ in range(3)]
            path = [tuple(at)]
            for _ in range(pick.randrange(4)):
                path.append(tuple(v + pick.uniform(-3, 4) for v in path[-1]))
            made.append((f"c{case}", rank, tuple(at), path[-1], pick.choice([None, 0.4, 1.0, 3.0]), path))
    nan = float("nan")
    made += [("odd", 1, (0.0, 0.0, 0.0), (9.0, 0.0, 0.0), 1.0, []), ("odd", 2, (20.0, 0.0, 0.0), None, 1.0, None), ("odd", 4, None, None, 1.0, [(0.0, 0.0, 0.0)] * 2),
             ("odd", 3, (40.0, 0.0, 0.0), (45.0, 0.0, 0.0), 1.0, [(40.0, 0.0, 0.0), (nan, 0.0, 0.0), (0.5, 0.0, 0.0)])]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("parallel", [0.0, 2.5])
def test_same_edges_as_by_cells(spark, monkeypatch, parallel):
    def found():
        edges = resolve.conflict_edges(branches, ["case_id"], parallel, 1.0)
        return sorted((tuple(r) for r in edges.select("case_id", "rank", "earlier", "reason", "on_other", "under").collect()), key=str)

    branches = rows(spark)
    small = found()
    monkeypatch.setattr(spatial, "CASE_ROWS", 0)
    assert small == found() and len(small) > 50 and len({e[3:] for e in small}) >= (2 if parallel == 0 else 5)


def test_a_small_case_is_not_joined_with_itself(spark):
    edges = resolve.conflict_edges(rows(spark), ["case_id"], 2.5, 1.0)
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
