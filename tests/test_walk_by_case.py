"""Roots of small cases are relocated in one pass over their cells, with the places and lengths that the joins give."""

import random

import pytest

from ostiary.operators import cells
from ostiary.plans import q_cells

SCHEMA = "case_id string, z int, y int, x int, parent boolean, support boolean, excluded boolean"


def grids(spark):
    pick = random.Random(3)
    made = []
    for case in range(12):
        low = pick.choice([0, -5, 1_000_000_000])
        for z in range(6):
            for y in range(5):
                for x in range(9):
                    if pick.random() < 0.75:
                        made.append((f"c{case}", z * (1 + case % 2), y - 2, low + x, x == 0 and pick.random() < 0.4, pick.random() < 0.85, pick.random() < 0.1))
    made += [("none", 1, 1, 1, False, True, False), ("wall", 1, 1, 1, True, True, False), ("c0", None, 1, 1, True, True, False), (None, 1, 1, 1, True, True, False)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("maximum", [0.0, 2.0, 6.0])
def test_same_walk_as_in_joins(spark, monkeypatch, maximum):
    rows = grids(spark)
    roots = rows.select("case_id", "z", "y", "x").filter("x > 1")

    def found(limit, batch):
        monkeypatch.setattr(cells, "BATCH_CELLS", batch)
        moved = cells.relocate_root(roots, rows, maximum=maximum, task_cells=limit)
        return sorted((tuple(r) for r in moved.select("case_id", "z", "y", "x", "relocated", "walk_mm").collect()), key=str)

    joins = found(0, 100)
    assert found(100_000, 100_000) == joins == found(100_000, 1) == found(200, 300)
    assert len(joins) == roots.count() and (maximum == 0 or len({r[5] for r in joins}) > 2)


def test_small_cases_make_no_pairs(spark, monkeypatch):
    """Each round joined, shuffled and wrote the pairs of neighbours."""
    def refuse(*_):
        raise AssertionError("pairs of neighbours")

    monkeypatch.setattr(cells, "neighbour_pairs", refuse)
    rows = grids(spark)
    assert cells.relocate_root(rows.select("case_id", "z", "y", "x"), rows).filter("relocated IS NOT NULL").count() > 0


def test_supported_cells_are_made_once(spark, monkeypatch):
    made = []
    build = q_cells.supported
    monkeypatch.setattr(q_cells, "supported", lambda *given: made.append(given) or build(*given))
    q_cells.moved_roots(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
