"""Landmark-shaped views over the TPC-H-like test tables (see FIXTURES.md).

Each view exists twice: as a DataFrame and as the SQL common table expression the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.functions import geometry as g
from ostiary.functions.features import evidence_score
from ostiary.operators.ordering import rank_within


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate per order line; a case is an order."""
    lines = rank_within(table(spark, folder, "lineitem"), ["l_orderkey"], LINE_ORDER, "ord")
    order = F.col("ord").cast("double")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    placed = lines.select(
        F.col("l_orderkey").alias("case_id"), "ord",
        F.concat(F.lit("cand_"), F.col("ord")).alias("instance_id"),
        F.when(F.col("l_returnflag") == "R", "review").otherwise("strict").alias("profile"),
        F.col("l_linestatus").alias("side"),
        ((F.col("l_partkey") % 13).cast("double") + order * 0.0137 + (price % 1) * 0.01).alias("ox"),
        ((F.col("l_suppkey") % 11).cast("double") + order * order * 0.0019 + (price % 7) * 0.001).alias("oy"),
        ((quantity.cast("bigint") % 9).cast("double") + order * 0.0043 + (price % 3) * 0.001).alias("oz"),
        (discount + 0.01).alias("ux"), (tax + 0.01).alias("uy"), F.lit(0.05).alias("uz"),
        (0.7 + quantity / 10).alias("radius_mm"), (discount * 4.87).alias("mean_vesselness"),
        tax.alias("tax"), discount.alias("discount"), quantity.alias("quantity"), price.alias("price"),
        "l_partkey", "l_suppkey",
    ).withColumn("length", g.norm(g.cols("ux", "uy", "uz")))
    ostium = g.cols("ox", "oy", "oz")
    direction = tuple(F.col(name) / F.col("length") for name in ("ux", "uy", "uz"))
    seed = g.add_scaled(ostium, direction, 5)
    tail = (seed[0] + 1.5, seed[1] + F.col("tax") * 10, seed[2] + F.col("discount") * 20)
    shaped = placed.select(
        "case_id", "ord", "instance_id", "profile", "side", "radius_mm", "mean_vesselness",
        g.point(*ostium).alias("ostium"), g.point(*seed).alias("seed"), g.point(*direction).alias("direction"),
        F.array(
            g.point(*ostium), g.point(*g.add_scaled(ostium, direction, 2)), g.point(*seed), g.point(*tail),
        ).alias("path"),
        F.create_map(
            F.lit("path_hu_relative"), F.col("price") / 97531, F.lit("bone_distance_mm"), F.col("quantity"),
            F.lit("parent_angle_degrees"), (F.col("l_partkey") % 90).cast("double"),
            F.lit("arc_position"), F.col("discount") * 10, F.lit("native_spacing_mm"), F.col("tax") + 0.5,
            F.lit("connector_gap"), F.col("tax") * 0.987,
            F.lit("candidate_volume_mm3"), (F.col("l_suppkey") % 100).cast("double"),
        ).alias("features"),
    )
    return shaped.withColumn("evidence_score", evidence_score(
        F.col("mean_vesselness"), g.distance(g.xyz("seed"), g.xyz("ostium")),
        g.path_length(F.col("path")), F.col("features")["connector_gap"],
    ))


def side(rows: DataFrame, value: str) -> DataFrame:
    """Predictions are lines with status O, references lines with status F."""
    return rows.filter(F.col("side") == value).select(
        "case_id", "ord", "instance_id", "ostium", "seed", "direction", "radius_mm",
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("family"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse 16 x 16 x 16 grid per supplier; the parent is the slab x < 3."""
    lines = table(spark, folder, "lineitem")
    grid = lines.groupBy(
        F.col("l_suppkey").alias("case_id"), (F.col("l_partkey") % 16).cast("int").alias("z"),
        (F.col("l_quantity").cast("bigint") % 16).cast("int").alias("y"),
        (F.col("l_extendedprice").cast("bigint") % 16).cast("int").alias("x"),
    ).agg(
        (F.max("l_extendedprice") / 100).alias("value"), (F.max("l_discount") * 10).alias("tubular"),
        (F.max("l_tax") * 20 + 0.5).alias("radius"),
    )
    return grid.select(
        "*", (F.col("x") < 3).alias("parent"),
        F.greatest(F.col("x") - 2, F.lit(0)).cast("double").alias("outside"),
        F.greatest(3 - F.col("x"), F.lit(0)).cast("double").alias("inside"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Label events per (user, props.k)."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("case_id"),
        F.get_json_object("props", "$.k").alias("instance_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "confirmed")
        .when(F.col("event_type") == "error", "unreviewed").otherwise("rejected").alias("label"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")).alias("labeller"),
        F.col("value"), F.col("ts").alias("reviewed_at"), F.col("event_id"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


# name -> (names it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], f"""
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS BIGINT) AS ord
        FROM lineitem"""),
    "placed": (["lines"], """
        SELECT l_orderkey AS case_id, ord, 'cand_' || ord AS instance_id,
          CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'strict' END AS profile, l_linestatus AS side,
          CAST(l_partkey % 13 AS DOUBLE) + ord * 0.0137::DOUBLE + (l_extendedprice % 1) * 0.01::DOUBLE AS ox,
          CAST(l_suppkey % 11 AS DOUBLE) + ord * ord * 0.0019::DOUBLE + (l_extendedprice % 7) * 0.001::DOUBLE AS oy,
          CAST(CAST(l_quantity AS BIGINT) % 9 AS DOUBLE) + ord * 0.0043::DOUBLE
            + (l_extendedprice % 3) * 0.001::DOUBLE AS oz,
          l_discount + 0.01::DOUBLE AS ux, l_tax + 0.01::DOUBLE AS uy, 0.05::DOUBLE AS uz,
          0.7::DOUBLE + l_quantity / 10 AS radius_mm, l_discount * 4.87::DOUBLE AS mean_vesselness,
          l_tax AS tax, l_discount AS discount, l_quantity AS quantity, l_extendedprice AS price,
          l_partkey, l_suppkey
        FROM lines"""),
    "directed": (["placed"], """
        SELECT *, ux / sqrt(ux*ux + uy*uy + uz*uz) AS dx, uy / sqrt(ux*ux + uy*uy + uz*uz) AS dy,
          uz / sqrt(ux*ux + uy*uy + uz*uz) AS dz FROM placed"""),
    "traced": (["directed"], """
        SELECT *, ox + dx*5 AS sx, oy + dy*5 AS sy, oz + dz*5 AS sz,
          5 + sqrt(1.5*1.5 + (tax*10)*(tax*10) + (discount*20)*(discount*20)) AS path_length,
          sqrt((dx*5 + 1.5)*(dx*5 + 1.5) + (dy*5 + tax*10)*(dy*5 + tax*10)
            + (dz*5 + discount*20)*(dz*5 + discount*20)) AS chord
        FROM directed"""),
    "cand": (["traced"], """
        SELECT *, greatest(0, least(1, (0.4*least(mean_vesselness/0.5, 1) + 0.35*least(1, 1)
          + 0.25*least(path_length/10, 1)) * (1 - tax*0.987::DOUBLE))) AS evidence_score FROM traced"""),
    "pred": (["cand"], "SELECT * FROM cand WHERE side = 'O'"),
    "ref": (["cand"], "SELECT * FROM cand WHERE side = 'F'"),
    "cases": ([], "SELECT o_orderkey AS case_id, o_orderpriority AS family FROM orders"),
    "cells": ([], """
        SELECT *, x < 3 AS parent, CAST(greatest(x - 2, 0) AS DOUBLE) AS outside,
          CAST(greatest(3 - x, 0) AS DOUBLE) AS inside
        FROM (SELECT l_suppkey AS case_id, CAST(l_partkey % 16 AS INTEGER) AS z,
            CAST(CAST(l_quantity AS BIGINT) % 16 AS INTEGER) AS y,
            CAST(CAST(trunc(l_extendedprice) AS BIGINT) % 16 AS INTEGER) AS x,
            max(l_extendedprice) / 100 AS value, max(l_discount) * 10 AS tubular, max(l_tax) * 20 + 0.5 AS radius
          FROM lineitem GROUP BY 1, 2, 3, 4)"""),
    "reviews": ([], """
        SELECT user_id AS case_id, json_extract_string(props, '$.k') AS instance_id,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'confirmed'
               WHEN event_type = 'error' THEN 'unreviewed' ELSE 'rejected' END AS label,
          CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS labeller,
          value, ts AS reviewed_at, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
        FROM events"""),
}


def oracle(final: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views (and their needs) and ``extra`` ones, then ``final``."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        required, text = CTES[name]
        for other in required:
            add(other)
        parts.setdefault(name, text)

    for name in needs:
        add(name)
    for header, text in (extra or {}).items():
        parts[header] = text
    if not parts:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + final
