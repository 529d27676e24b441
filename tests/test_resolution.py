"""Candidate resolution in rounds: the same decisions as the sequential walk, on chains, wide rows and whole cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_semantics import POINT, brute_resolve

from ostiary.operators import resolve

SCHEMA = f"case_id int, id string, radius_mm double, ostium {POINT}, seed {POINT}, path array<{POINT}>"
def _order():
    return [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]


def _random_cases(seed, cases, rows, spread):
    rng = np.random.default_rng(seed)
    by_case, table = {}, []
    for case in range(cases):
        for i in range(rows):
            path = [tuple(float(v) for v in rng.random(3) * spread)]
            for _ in range(4):
                path.append(tuple(float(v) for v in np.add(path[-1], rng.normal(size=3) * 1.5)))
            row = {"id": f"{case}-{i}", "r": float(0.8 + rng.random() * 2), "path": path, "seed": path[2]}
            by_case.setdefault(case, []).append(row)
            table.append((case, row["id"], row["r"], path[0], row["seed"], path))
    return by_case, table


@pytest.mark.parametrize("parallel", [0.0, 2.5])
@pytest.mark.parametrize("slow, chunk", [(0.0, 1), (2.0, 7), (0.5, 5)])
def test_rounds_equal_the_sequential_walk(spark, monkeypatch, parallel, slow, chunk):
    """Rounds of joins alone, chunks alone, and both mixed."""
    monkeypatch.setattr(resolve, "SLOW_ROUND", slow)
    by_case, table = _random_cases(3, 3, 40, 11)
    got = resolve.resolve_candidates(spark.createDataFrame(table, SCHEMA), ["case_id"], _order(), parallel_clearance=parallel, case_edges=0, chunk_rows=chunk).collect()
    want = {}
    for rows in by_case.values():
        want.update(brute_resolve(rows, parallel))
    assert len(got) == len(table) and {r["id"]: r["reason"] for r in got if r["reason"]} == want
    assert not parallel or resolve.ON_PATH in want.values()


def _chain(spark, n):
    """Row i competes with row i - 1 only; every second one is merged."""
    x = F.col("id").cast("double") * 2.4
    point = F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    up = F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("z"))
    return spark.range(n).select(F.lit(0).alias("case_id"), F.col("id").cast("string").alias("id"), F.lit(0.5).alias("radius_mm"), point.alias("ostium"),
                                 up.alias("seed"), F.array(point, up).alias("path"), F.col("id").alias("n"))


def test_chain_longer_than_a_task_may_hold(spark):
    n = 100_000
    done = resolve.resolve_candidates(_chain(spark, n), ["case_id"], ["n"], case_edges=1_000, chunk_rows=30_000)
    rows = done.groupBy(F.col("n") % 2, "reason").count().collect()
    assert sorted(tuple(r) for r in rows) == [(0, None, n // 2), (1, "same_opening_and_path", n // 2)]


def test_a_wide_row_adds_its_own_pairs_only(spark):
    rows = _chain(spark, 2_000).withColumn("radius_mm", F.when(F.col("n") == 7, 1_000.0).otherwise(F.col("radius_mm")))
    whole = rows.withColumn("rank", F.col("n") + 1)
    reach = F.greatest(F.lit(2.5), 2 * F.col("radius_mm"))
    pairs = resolve.pairs_by_reach(whole.select("case_id", "rank", "radius_mm", "ostium"), ["case_id"], "rank", "ostium", reach, 2.5)
    assert pairs.filter("row_later.rank = 8 OR row_earlier.rank = 8").count() == len([i for i in range(2_000) if i != 7 and abs(i - 7) * 2.4 < 2_000])
    assert pairs.filter("row_later.rank <> 8 AND row_earlier.rank <> 8").count() == 1_999 - 2


def test_pairs_by_reach_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(c, i, tuple(float(v) for v in rng.random(3) * 40 - 20), float(rng.choice([0.1, 1.25, 2.5, 3.0, 9.0, 40.0]))) for c in range(2) for i in range(60)]
    frame = spark.createDataFrame(rows, f"case_id int, k int, p {POINT}, r double")
    found = resolve.pairs_by_reach(frame, ["case_id"], "k", "p", F.greatest(F.lit(0.5), F.col("r")), 0.5)
    got = sorted((r["case_id"], r["a"], r["b"]) for r in found.selectExpr("case_id", "row_later.k a", "row_earlier.k b").collect())
    want = sorted((c, i, j) for c, i, p, r in rows for d, j, q, s in rows if c == d and j < i and np.linalg.norm(np.subtract(p, q)) < max(0.5, r, s))
    assert got == want
    assert resolve.pairs_by_reach(frame.limit(0), ["case_id"], "k", "p", F.col("r"), 0.5).count() == 0
