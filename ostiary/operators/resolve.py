"""Ranking, capping and merging of proposals into final branches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.operators import spatial
from ostiary.operators.ordering import rank_within
from ostiary.operators.polyline import on_path, same_trunk
from ostiary.operators.spatial import keep_within, pairs_by_reach, pairs_within
from ostiary.operators.suppress import suppress

OVER_LIMIT = "over_candidate_limit"
ON_PATH = "opening_on_another_path"
# Competing pairs of a case that one task walks in order; a case with more goes through rounds.
CASE_EDGES = 50_000
# Earliest open rows of a case that one task walks when a round of joins settles less than this share of the open rows.
CHUNK_ROWS = 20_000
SLOW_ROUND = 0.2


def rank_candidates(roots: DataFrame, by: list[str], order: list, cap: int | None = None) -> DataFrame:
    """All rows with their ``rank`` in the case and a ``reason``: set for rows beyond ``cap``, the profile's setting
    of how many candidates a case may put forward (none by default)."""
    ranked = rank_within(roots, by, order, "rank")
    beyond = F.col("rank") > cap if cap is not None else F.lit(False)
    return ranked.withColumn("reason", F.when(beyond, OVER_LIMIT))


def over_limit(roots: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Cases whose weaker candidates the cap leaves out."""
    return roots.groupBy(*by).agg(F.count("*").alias("candidates")).filter(F.col("candidates") > cap)


def renumber(branches: DataFrame, by: list[str], tie: list[str], large: bool | None = None) -> DataFrame:
    """New ``branch_%03d`` ids in z, y, x order of the ostium; ``large`` as for :func:`rank_within`."""
    order = [F.col("ostium.z"), F.col("ostium.y"), F.col("ostium.x"), *[F.col(t) for t in tie]]
    ranked = rank_within(branches, by, order, "_n", large=large)
    return ranked.withColumn("instance_id", F.format_string("branch_%03d", F.col("_n"))).drop("_n")


def pool_union(review: DataFrame, strict: DataFrame, by: list[str], rank: str, radius: float = 3.0) -> DataFrame:
    """Review rows plus strict rows at least ``radius`` from every review row and every strict row added
    before them; added rows carry a flag."""
    far = keep_within(strict, review, by, "ostium", "ostium", radius, inclusive=False, found=False)
    added = suppress(far, by, rank, "ostium", radius, sized=strict).filter("decision = 'retained'").select(*strict.columns)
    return review.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def conflict_edges(branches: DataFrame, by: list[str], parallel_clearance: float = 0.0, spacing: float = 1.0) -> DataFrame:
    """Pairs (later, earlier in rank) that compete for one opening: the ``reason`` they would merge, ``on_other`` if the later
    opening lies on the earlier path, ``under`` if the earlier one lies on the later path.

    Cases of up to CASE_ROWS rows are one row each, and the path predicates run on its pairs that are near enough. In the
    others every pair is found at the scale of its larger radius, so a wide row meets its neighbours and leaves the pairs of
    narrow ones alone; openings meet path vertices in cells of their own.
    """
    fields = ["rank", "ostium", "seed", "radius_mm", "path", "prefix"]
    prefix = g.truncate_path(F.col("path"), F.col("_arcs"), F.lit(3.0))
    rows = branches.withColumn("_arcs", g.arc_lengths(F.col("path"))).withColumn("prefix", prefix).select(*by, *fields)
    (few, _), (many, _) = scale.small_cases(rows, rows, by, spatial.CASE_ROWS)
    found = []
    if few is not None:
        found.append(_edges_inside(few, by, fields, parallel_clearance, spacing))
    if many is not None:
        found.append(_edges_by_cells(scale.checkpoint(many), by, fields, parallel_clearance, spacing))
    return reduce(DataFrame.unionByName, found)


def _competing(gap: Column) -> Column:
    return gap < F.greatest(F.lit(2.5), F.col("row_later.radius_mm") + F.col("row_earlier.radius_mm"))


def _merging(gap: Column) -> Column:
    """Why the rows of a pair ``gap`` apart would merge; the path predicates are evaluated only where the CASE gets to them."""
    later, earlier = F.col("row_later"), F.col("row_earlier")
    same_opening = (gap < 2.5) & (g.distance(g.xyz(later["seed"]), g.xyz(earlier["seed"])) < 3)
    trunk = same_trunk(*[side[c] for side in (later, earlier) for c in ("path", "prefix", "radius_mm")])
    return F.when(_competing(gap), F.when(same_opening, "same_opening_and_path").when(trunk, "common_trunk"))


def _edges_inside(rows: DataFrame, by: list[str], fields: list[str], parallel_clearance: float, spacing: float) -> DataFrame:
    """The pairs of each case from one row that holds the case in rank order, so that its rows are worked out once.

    Most pairs neither compete nor have an opening in reach of the box around the other's later vertices; they go before any
    path is looked at.
    """
    later, earlier = F.col("row_later"), F.col("row_earlier")
    ends = {"head": F.slice("path", 1, 2), "tail": F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))}
    boxes = [end(vertices[axis]).alias(f"{name}_{side}_{axis}") for name, vertices in ends.items()
             for axis in "xyz" for side, end in (("low", F.array_min), ("high", F.array_max))]
    boxed = rows.select(*by, F.struct(*fields, *(boxes if parallel_clearance > 0 else [])).alias("_row"))
    cases = boxed.groupBy(*by).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))  # ranks are the first field and unique
    placed = cases.select(*by, "_rows", F.posexplode("_rows").alias("_at", "row_later"))
    pairs = placed.select(*by, "row_later", F.explode(F.slice("_rows", F.lit(1), F.col("_at"))).alias("row_earlier"))
    gap = g.distance(g.xyz(later["ostium"]), g.xyz(earlier["ostium"]))

    def in_reach(path: Column, other: Column) -> Column:
        """False only if no opening or first point of ``path`` can lie on ``other``."""
        reach = 1.5 * spacing * (1 + 1e-9)  # the margin is for rounding
        gaps = [low - high for a in "xyz" for low, high in (
            (path[f"head_low_{a}"], other[f"tail_high_{a}"]), (other[f"tail_low_{a}"], path[f"head_high_{a}"]))]
        return ~reduce(lambda p, q: p | q, [F.coalesce((d > reach) & ~F.isnan(d), F.lit(False)) for d in gaps])

    def lies(path: Column, other: Column) -> Column:
        return F.coalesce(on_path(path["path"], other["path"], spacing), F.lit(False)) if parallel_clearance > 0 else F.lit(False)

    near = F.coalesce(_competing(gap), F.lit(False))
    if parallel_clearance > 0:
        near = near | in_reach(later, earlier) | in_reach(earlier, later)
    edge = F.struct(_merging(gap).alias("reason"), lies(later, earlier).alias("on_other"), lies(earlier, later).alias("under"))
    # The generator evaluates the predicates once and drops pairs without a conflict.
    conflicts = F.filter(F.array(edge), lambda e: e["reason"].isNotNull() | e["on_other"] | e["under"])
    return pairs.filter(near).select(*by, later["rank"].alias("rank"), earlier["rank"].alias("earlier"), F.inline(conflicts))


def _edges_by_cells(branches: DataFrame, by: list[str], fields: list[str], parallel_clearance: float, spacing: float) -> DataFrame:
    reach = F.greatest(F.lit(2.5), 2 * F.coalesce("radius_mm", F.lit(0.0)))
    near = pairs_by_reach(branches.select(*by, *fields), by, "rank", "ostium", reach, 2.5)
    later, earlier = F.col("row_later"), F.col("row_earlier")
    # The generator evaluates the path predicates once and drops pairs without a conflict.
    merging = near.select(*by, later["rank"].alias("rank"), earlier["rank"].alias("earlier"), F.explode(
        F.filter(F.array(_merging(F.col("distance"))), lambda r: r.isNotNull())).alias("reason"))
    if parallel_clearance <= 0:
        return merging.select(*by, "rank", "earlier", "reason", F.lit(False).alias("on_other"), F.lit(False).alias("under"))
    openings = branches.select(*by, F.col("rank").alias("_own"), F.explode(F.slice("path", 1, 2)).alias("_p"))
    vertices = branches.select(*by, F.col("rank").alias("_other"), F.explode(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))).alias("_q"))
    lying = pairs_within(openings, vertices, by, "_p", "_q", 1.5 * spacing, inclusive=False).filter("_own <> _other").select(
        *by, F.greatest("_own", "_other").alias("rank"), F.least("_own", "_other").alias("earlier"), F.lit(None).cast("string").alias("reason"),
        (F.col("_own") > F.col("_other")).alias("on_other"), (F.col("_own") < F.col("_other")).alias("under"))
    either = merging.select(*by, "rank", "earlier", "reason", F.lit(False).alias("on_other"), F.lit(False).alias("under")).unionByName(lying)
    return either.groupBy(*by, "rank", "earlier").agg(
        F.max("reason").alias("reason"), F.bool_or("on_other").alias("on_other"), F.bool_or("under").alias("under"))


class _Walk:
    """The sequential walk over one case's edges, which come in order of rank and earlier rank."""

    def __init__(self) -> None:
        self.taken: dict[int, int] = {}     # accepted rows that were taken back, and by which row
        self.rejected: set[int] = set()
        self.out: list[tuple[int, str | None, int | None]] = []   # rank, reason, taken back by
        self.rank: int | None = None

    def edge(self, rank: int, earlier: int, reason: str | None, on_other: bool, under: bool, taken_at: int | None = None) -> None:
        if rank != self.rank:
            self.settle()
            self.rank, self.reason, self.blocked, self.below = rank, None, False, []
        if earlier in self.rejected or min(self.taken.get(earlier, rank), rank if taken_at is None else taken_at) < rank:
            return
        if self.reason is None:
            self.reason = reason
        self.blocked |= on_other
        if under:
            self.below.append(earlier)

    def settle(self) -> None:
        """Decide the row whose edges have all come."""
        if self.rank is None:
            return
        reason = self.reason or (ON_PATH if self.blocked else None)
        self.out.append((self.rank, reason, None))
        if reason is not None:
            self.rejected.add(self.rank)
        else:
            for earlier in self.below:
                self.taken[earlier] = self.rank
                self.out.append((earlier, None, self.rank))
        self.rank = None


def _walked(edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, rank, reason, taken_by``: decisions of the rows of ``edges``, case by case in one stream over sorted rows.

    A row of a decision has no ``taken_by``; a row that was accepted and is taken back has one more row, with it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema if f.name in by}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in by] + ["rank bigint", "reason string", "taken_by bigint"])
    fields = ["rank", "earlier", "reason", "on_other", "under", "taken_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, walk = None, None
        kind: list[pa.DataType] = []
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind + [pa.int64(), pa.string(), pa.int64()])],
                                              names=[*by, "rank", "reason", "taken_by"])

        for batch in batches:
            kind = [batch.column(n).type for n in by]
            keys = zip(*(batch.column(n).to_pylist() for n in by)) if by else iter([()] * batch.num_rows)
            for key, *row in zip(keys, *(batch.column(n).to_pylist() for n in fields)):
                if walk is None or key != case:
                    if walk is not None:
                        walk.settle()
                        done.extend((*case, *o) for o in walk.out)
                    case, walk = key, _Walk()
                walk.edge(*row)
            if done:
                yield batch_of()
                done = []
        if walk is not None:
            walk.settle()
            done = [(*case, *o) for o in walk.out]
            if done:
                yield batch_of()

    known = edges if "taken_at" in edges.columns else edges.withColumn("taken_at", F.lit(None).cast("bigint"))
    sorted_rows = known.select(*by, *fields)
    sorted_rows = sorted_rows.repartition(*by) if by else sorted_rows.coalesce(1)
    return sorted_rows.sortWithinPartitions(*by, "rank", "earlier").mapInArrow(run, schema)


def _settled_by_rounds(edges: DataFrame, by: list[str], chunk_rows: int) -> DataFrame:
    """The same decisions for cases whose edges no task should hold.

    A round settles every row whose earlier rivals are all settled and whose accepted rivals no open row before it can
    still take back. Where rounds get slow, as on a long chain, the earliest ``chunk_rows`` open rows of each case are
    walked by one task, given what is settled. Edges to rejected rows are dropped, and each round is checkpointed.
    """
    key = [*by, "rank"]
    # settled: the earlier row is accepted; taken_at: when it was taken back
    started = edges.select(*key).distinct().withColumnRenamed("rank", "earlier").withColumn("_open", F.lit(True))
    open_edges = scale.checkpoint(edges.join(started, [*by, "earlier"], "left").select(
        *key, "earlier", "reason", "on_other", "under", F.col("_open").isNull().alias("settled"), F.lit(None).cast("bigint").alias("taken_at")))
    open_rows = scale.checkpoint(open_edges.select(*key).distinct())
    waiting = open_rows.count()
    found: DataFrame | None = None
    slow = False
    while waiting:
        if slow:
            first = rank_within(open_rows, by, [F.col("rank")], "_n").filter(F.col("_n") <= chunk_rows).drop("_n")
            alone = first.join(open_edges, key, "left_anti").select(*key, F.lit(None).cast("string").alias("reason"), F.lit(None).cast("bigint").alias("taken_by"))
            events = _walked(open_edges.join(first, key, "left_semi"), by).unionByName(alone)
        else:
            takers = open_edges.filter("under").groupBy(*by, "earlier").agg(F.min("rank").alias("_taker"))
            judged = open_edges.join(takers, [*by, "earlier"], "left").groupBy(*key).agg(
                F.bool_or(~F.col("settled") | F.coalesce(F.col("_taker") < F.col("rank"), F.lit(False))).alias("_waits"),
                F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("earlier"))).alias("_merged"),
                F.bool_or("on_other").alias("_blocked"))
            ready = open_rows.join(judged, key, "left").filter("_waits IS NULL OR NOT _waits").select(
                *key, F.coalesce("_merged", F.when(F.col("_blocked"), ON_PATH)).alias("reason"), F.lit(None).cast("bigint").alias("taken_by"))
            ready = scale.checkpoint(ready)
            takes = open_edges.filter("under").join(ready.filter("reason IS NULL"), key, "left_semi").select(
                *by, F.col("earlier").alias("rank"), F.lit(None).cast("string").alias("reason"), F.col("rank").alias("taken_by"))
            events = ready.unionByName(takes)
        events = scale.checkpoint(events)
        found = events if found is None else found.unionByName(events)
        own = events.filter("taken_by IS NULL").select(*key, "reason")
        taken = events.filter("taken_by IS NOT NULL").groupBy(*by, F.col("rank").alias("earlier")).agg(F.min("taken_by").alias("_taken"))
        of_earlier = own.select(*by, F.col("rank").alias("earlier"), F.lit(True).alias("_now"), F.col("reason").isNotNull().alias("_rejected"))
        left = open_edges.join(own, key, "left_anti").join(of_earlier, [*by, "earlier"], "left").join(taken, [*by, "earlier"], "left")
        left = left.withColumn("taken_at", F.least("taken_at", "_taken")).filter(
            "NOT coalesce(_rejected, false) AND coalesce(taken_at >= rank, true)").withColumn("settled", F.col("settled") | F.coalesce("_now", F.lit(False)))
        open_edges = scale.checkpoint(left.select(*open_edges.columns))
        open_rows = scale.checkpoint(open_rows.join(own, key, "left_anti"))
        before, waiting = waiting, open_rows.count()
        slow = before - waiting < SLOW_ROUND * before
    return found


def resolve_candidates(
    branches: DataFrame, by: list[str], order: list, cap: int | None = None, parallel_clearance: float = 0.0, spacing: float = 1.0,
    case_edges: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Accept candidates in rank order; add ``rank`` and ``reason`` (NULL for accepted rows).

    A row merges into the first accepted row it competes with. With parallel clearance a row on an accepted
    path is dropped, and accepted rows on the new row's path are taken back. Rows beyond ``cap`` take no part and
    keep the reason that :func:`rank_candidates` gave them.

    Only pairs that compete are walked. A case with up to ``case_edges`` of them is walked in one pass by one task; a
    larger one is settled in rounds of joins, see :func:`_settled_by_rounds`.
    """
    # Ties go by all other columns: the ranking is computed where it is needed, and each time it must be the same.
    rest = [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in branches.schema]
    ranked = rank_candidates(branches, by, [*order, *rest], cap)
    taking_part = ranked.filter(F.col("reason").isNull()).drop("reason")
    edges = scale.checkpoint(conflict_edges(taking_part, by, parallel_clearance, spacing))
    small, large = scale.split_by_size(edges, by, CASE_EDGES if case_edges is None else case_edges)
    events = _walked(small, by)
    if large is not None:
        events = events.unionByName(_settled_by_rounds(scale.checkpoint(large), by, chunk_rows or CHUNK_ROWS))
    reason = F.when(F.col("taken_by").isNotNull(), ON_PATH).otherwise(F.col("reason"))
    rejected = events.withColumn("_rejected", reason).filter("_rejected IS NOT NULL").select(*by, "rank", "_rejected")
    return ranked.join(rejected, [*by, "rank"], "left").withColumn("reason", F.coalesce("reason", "_rejected")).drop("_rejected")
