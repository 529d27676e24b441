"""Case files, manifests, prediction and review records, and the model file."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.functions.features import FEATURE_NAMES, LogisticModel
from ostiary.operators.ordering import rank_within
from ostiary.operators.quality import raise_on, violations
from ostiary.operators.reviews import KEY, SCOPE
from ostiary.sources.streams import digests

# Rows in one nested record. Every record names its ``part`` and the case's number of ``parts``, whatever the size.
RECORD_ROWS = 100_000
PREDICTION_SCHEMA = (
    "case_id string, part bigint, parts bigint, parent struct<instance_id:string>, daughters array<struct<instance_id:string,parent_instance_id:string,"
    "ostium_xyz_mm:array<double>,seed_xyz_mm:array<double>,radius_mm:double,direction_xyz:array<double>>>"
)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of all files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")


def scan_cases(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row per case folder; ``failed`` unless it holds exactly one scan and one mask.

    Only paths are read, so the content column is pruned from the scan.
    """
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"))
    if wanted is not None:
        named = named.filter(F.col("case_id").isin(wanted))
    image, mask = F.col("name").rlike(r"\Aorig.*\.nii"), F.col("name").rlike(r"\Amask.*\.nii")
    counted = named.groupBy("case_id").agg(F.count_if(image).alias("images"), F.count_if(mask).alias("masks"))
    good = (F.col("images") == 1) & (F.col("masks") == 1)
    return counted.select("case_id", "images", "masks", F.when(good, "ok").otherwise("failed").alias("status"),
                          F.when(~good, "a case folder needs exactly one scan and one mask").alias("error"))


def unknown_cases(scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("case_id").distinct().join(scanned, "case_id", "left_anti")


def file_availability(files: DataFrame, case: Column) -> DataFrame:
    """A file is available unless it is a storage pointer; a case needs all its files. Gzip goes by its magic.

    ``content`` may be the whole file or its head (:func:`ostiary.sources.streams.heads`)."""
    head = F.substring("content", 1, 40).cast("binary")
    pointer = F.startswith(head, F.lit(b"version https://git-lfs"))
    gzipped = F.substring("content", 1, 2).cast("binary") == F.lit(b"\x1f\x8b")
    marked = files.select(case.alias("case_id"), (~pointer).alias("available"), gzipped.alias("gzipped"))
    return marked.groupBy("case_id").agg(
        F.bool_and("available").alias("available"), F.count_if("gzipped").alias("gzipped"), F.count("*").alias("files"))


def checksums(files: DataFrame) -> DataFrame:
    """Digest of each file: of its ``content``, or without that column streamed from its ``path``, whatever its size."""
    return (files.withColumn("sha256", F.sha2("content", 256)) if "content" in files.columns else digests(files)).select("path", "sha256")


def read_checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``sha256  path``."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).alias("sha256"))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or differs."""
    actual = checksums(files).withColumnRenamed("sha256", "actual")
    return manifest.select("path", "sha256").join(actual, "path", "left").filter(
        F.col("actual").isNull() | (F.col("actual") != F.col("sha256"))).select(
        "path", F.when(F.col("actual").isNull(), "missing").otherwise("mismatch").alias("rule"))


def build_manifest(files: DataFrame, attributes: DataFrame, key: str = "case_id", rows_per_record: int = RECORD_ROWS) -> DataFrame:
    """Name-sorted maps of file → sha256 with the case's attributes, a map per ``part`` of a case's ``parts``.
    Digests are taken before the shuffle, so file contents never move; without ``content`` they are streamed from ``path``."""
    hashed = files.withColumn("sha256", F.sha2("content", 256)) if "content" in files.columns else digests(files)
    hashed = hashed.select(key, "name", "sha256")
    maps = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "sha256")))).alias("files")
    return nest(attributes, hashed, key, ["name"], maps, rows_per_record, files)


def nest(groups: DataFrame, rows: DataFrame, key: str, order: list[str], entries: Column, rows_per_record: int, sized: DataFrame | None = None) -> DataFrame:
    """One record per group and part, as :func:`with_parts`, with the rows' ``entries`` collected.

    Where no group fills a record, rows need neither ranks nor counts and are read once. ``sized`` is a table with at least as many
    rows of each group as ``rows``, whose sizes are looked at in place of theirs when it is cheaper to count.
    """
    if not scale.has_large_group(rows if sized is None else sized, [key], rows_per_record):
        whole = rows.groupBy(key).agg(entries)
        return groups.join(whole, key, "left").withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    parts = record_parts(rows, [key], order, rows_per_record)
    return with_parts(groups, rows, parts.groupBy(key, "part").agg(entries), key, rows_per_record)


def record_parts(rows: DataFrame, by: list[str], order: list[str], rows_per_record: int) -> DataFrame:
    """``part`` numbers stretches of ``rows_per_record`` rows of a group, from 0, in the given order."""
    ranked = rank_within(rows, by, [F.col(c) for c in order], "_n")
    return ranked.withColumn("part", F.floor((F.col("_n") - 1) / rows_per_record)).drop("_n")


def with_parts(groups: DataFrame, rows: DataFrame, nested: DataFrame, key: str, rows_per_record: int) -> DataFrame:
    """One record per group and part, with ``part`` and ``parts``; a group without rows has one empty part."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / rows_per_record).alias("parts"))
    return groups.join(counts, key, "left").join(nested, key, "left").withColumns({
        "part": F.coalesce("part", F.lit(0).cast("bigint")), "parts": F.coalesce("parts", F.lit(1).cast("bigint"))})


def prediction_records(cases: DataFrame, branches: DataFrame, rows_per_record: int = RECORD_ROWS) -> DataFrame:
    """Nested record per case with ids in order; cases without branches keep an empty list."""
    listed = {name: F.array(*g.xyz(name)) for name in ("ostium", "seed", "direction")}
    daughter = F.struct(
        "instance_id", F.lit("aorta").alias("parent_instance_id"), listed["ostium"].alias("ostium_xyz_mm"),
        listed["seed"].alias("seed_xyz_mm"), "radius_mm", listed["direction"].alias("direction_xyz"))
    listed = F.sort_array(F.collect_list(daughter)).alias("daughters")
    nested = nest(cases.select("case_id"), branches, "case_id", ["instance_id"], listed, rows_per_record)
    return nested.select(
        "case_id", "part", "parts", F.struct(F.lit("aorta").alias("instance_id")).alias("parent"),
        F.coalesce("daughters", F.array().cast(nested.schema["daughters"].dataType)).alias("daughters"))


def write_once(frame: DataFrame, path: str, fmt: str = "json") -> None:
    """Refuse an existing target."""
    frame.write.mode("errorifexists").format(fmt).save(path)


def write_predictions(cases: DataFrame, branches: DataFrame, path: str) -> None:
    write_once(prediction_records(cases, branches), path)


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(branches, cases); cases without daughters stay in the second table.

    Each file holds one JSON document, indented or not, or with ``lines`` one record per line (as written by
    :func:`write_predictions`). A malformed document is an error. Parts of a case merge by its id.
    """
    records = spark.read.schema(PREDICTION_SCHEMA).json(
        path, pathGlobFilter="*.json", recursiveFileLookup=True, multiLine=not lines, mode="FAILFAST")
    return flatten_predictions(records)


def flatten_predictions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    def vector(name: str) -> Column:
        value = F.col(f"d.{name}")
        return g.point(*[F.get(value, F.lit(i)) for i in range(3)])

    rows = records.select("case_id", F.explode("daughters").alias("d")).select(
        "case_id", "d.instance_id", "d.parent_instance_id", vector("ostium_xyz_mm").alias("ostium"),
        vector("seed_xyz_mm").alias("seed"), vector("direction_xyz").alias("direction"), "d.radius_mm")
    return rows, records.select("case_id").distinct()


def diagnostic_records(runs: DataFrame, log: DataFrame, rows_per_record: int = RECORD_ROWS, proposals: DataFrame | None = None) -> DataFrame:
    """Run record per case (:func:`ostiary.plans.batch.run_records`) with its decisions, candidates included, as ``workflow``.

    ``proposals`` are the rows that the log was made from: cases are counted there, which does not repeat the decisions."""
    candidate = F.struct(*[F.array(*g.xyz(c)).alias(n) for c, n in (("ostium", "ostium_xyz_mm"), ("seed", "seed_xyz_mm"), ("direction", "direction_xyz"))], "radius_mm")
    entry = F.struct("merge_rank", "profile", F.col("instance_id").alias("source_instance_id"), "score", candidate.alias("candidate"), "decision",
                     "output_instance_id", "suppressor_instance_id")
    decisions = F.sort_array(F.collect_list(entry)).alias("decisions")
    rest = [name for name in runs.columns if name != "case_id"]
    return nest(runs, log, "case_id", ["merge_rank"], decisions, rows_per_record, proposals).select("case_id", "part", "parts", *rest, F.struct(
        F.lit("score-before-merge").alias("name"), F.lit(1).alias("schema_version"), F.lit(3.0).alias("merge_distance_mm"),
        F.lit("strict_first").alias("priority"), "decisions").alias("workflow"))


def write_diagnostics(runs: DataFrame, log: DataFrame, path: str) -> None:
    write_once(diagnostic_records(runs, log), path)


REVIEW_SCHEMA = (
    "schema_version int, feature_names array<string>, scope string, records array<struct<case_id:string,instance_id:string,"
    "label:string,labeller:string,features:array<double>,fingerprint:string,reviewed_at:string>>"
)


def read_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, violations of the envelope and record rules)."""
    return flatten_reviews(spark.read.schema(REVIEW_SCHEMA).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path")))


def flatten_reviews(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = F.array(*map(F.lit, FEATURE_NAMES))
    bad_files = violations(envelopes, ["file"], {
        "schema_version": F.col("schema_version") != 1, "feature_names": F.col("feature_names") != names,
        "scope": F.coalesce(F.col("scope") != SCOPE, F.lit(True))})
    rows = envelopes.select("file", F.inline("records"))
    bad_rows = violations(rows, ["file"], {
        "label": ~F.col("label").isin("confirmed", "rejected"),
        "identifier": (F.length("case_id") == 0) | (F.length("instance_id") == 0),
        "features": (F.size("features") != len(FEATURE_NAMES)) | ~F.forall("features", g.is_finite),
    }, F.concat_ws("/", *KEY))
    return rows, bad_files.unionByName(bad_rows)


MODEL_SCHEMA = (
    "schema_version int, feature_names array<string>, mean array<double>, scale array<double>, weights array<double>, "
    "bias double, threshold double, split map<string,array<string>>"
)


def model_record(spark: SparkSession, model: LogisticModel) -> DataFrame:
    row = (1, FEATURE_NAMES, model.mean, model.scale, model.weights, model.bias, model.threshold, model.split)
    return spark.createDataFrame([row], MODEL_SCHEMA)


def model_violations(records: DataFrame) -> DataFrame:
    size = len(FEATURE_NAMES)
    vectors = F.lit(True)
    for name in ("mean", "scale", "weights"):
        vectors = vectors & (F.size(name) == size) & F.forall(name, g.is_finite)
    return violations(records.withColumn("model", F.lit("model")), ["model"], {
        "schema_version": F.col("schema_version") != 1, "feature_names": F.col("feature_names") != F.array(*map(F.lit, FEATURE_NAMES)),
        "vectors": ~vectors, "scale": F.exists("scale", lambda s: s <= 0), "bias": ~g.is_finite(F.col("bias")),
        "threshold": ~(F.col("threshold") >= 0) | ~(F.col("threshold") <= 1) | F.isnan("threshold"),
        "split": (F.size("split") != 3) | F.exists(F.map_values("split"), lambda cases: F.size(cases) == 0)
        | (F.size(F.array_distinct(F.flatten(F.map_values("split")))) != F.size(F.flatten(F.map_values("split"))))})


def save_model(spark: SparkSession, model: LogisticModel, path: str) -> None:
    """One JSON line; a model with numbers JSON cannot hold is refused."""
    numbers = [*model.mean, *model.scale, *model.weights, model.bias, model.threshold]
    if not all(math.isfinite(v) for v in numbers):
        raise ValueError("Model values must be finite.")
    model_record(spark, model).coalesce(1).write.mode("errorifexists").json(path)


def load_model(spark: SparkSession, path: str, sha256: str | None = None) -> LogisticModel:
    """Check and load; with ``sha256`` the file's digest must match."""
    if sha256 is not None:
        found = read_files(spark, path).filter(F.col("path").endswith(".json")).select(F.sha2("content", 256)).limit(2).collect()
        if [r[0] for r in found] != [sha256]:
            raise ValueError("Model file digest differs.")
    records = spark.read.schema(MODEL_SCHEMA).json(path)
    raise_on(model_violations(records))
    row = records.first()
    return LogisticModel(list(row["mean"]), list(row["scale"]), list(row["weights"]), row["bias"], row["threshold"],
                         {k: list(v) for k, v in row["split"].items()})
