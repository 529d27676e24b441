"""References of uncertain layout: read five JSON layouts, map aliases, report every change made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ostiary.functions import geometry as g, naming as n

# Fixed value: marker of files that must not be used as references.
REJECTED_SCOPE = "unreviewed_proposals_not_ground_truth"
MAP = "map<string,string>"
# A JSON list read as one field of an object, so that the parser tells when an element is no object.
ITEMS = "_ostiary_items array<map<string,string>>, _ostiary_bad string"


def read_landmark_sets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``record, raw`` with one row per case object; ``raw`` maps field names to JSON text.

    Layouts: one case; a list; ``{"cases": [...]}``; ``{case_id: {...}}``; a case without id takes the file
    stem. Each file is one JSON document and so one row, or with ``lines`` each line is one, so that large inputs
    are split; the cases inside are exploded at once. A record is known by its file's full path and its position.
    """
    files = spark.read.text(path, wholetext=not lines, pathGlobFilter="*.json", recursiveFileLookup=True)
    named = files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.regexp_replace(
        F.col("_metadata.file_name"), r"\.json\z", "").alias("stem"))
    if lines:  # many documents share a file: the text tells them apart
        named = named.filter(F.trim("text") != "").withColumn("path", F.concat_ws("#", "path", F.sha2("text", 256)))
    return split_documents(named)


def split_documents(documents: DataFrame) -> DataFrame:
    """``text, stem`` (and ``path``, by which records are known if it is there) → ``record, raw`` for any mix of the
    five layouts."""
    documents = documents.select("text", "stem", (F.col("path") if "path" in documents.columns else F.col("stem")).alias("path"))
    is_list = F.startswith(F.ltrim("text"), F.lit("["))
    # Each step stands on stored columns, so that no text is parsed twice.
    parsed = documents.select("stem", "path", F.when(is_list, F.col("text")).alias("items"), F.when(~is_list, F.from_json("text", MAP)).alias("top"))
    daughters = F.lit(False)
    for key in n.DAUGHTER_KEYS:
        daughters = daughters | F.map_contains_key("top", key)
    parsed = parsed.select(
        "stem", "path", "top", daughters.alias("single"), (F.try_element_at("top", F.lit("scope")) == REJECTED_SCOPE).alias("rejected"),
        F.map_contains_key("top", "cases").alias("_in_cases"),
        F.coalesce("items", F.when(~daughters, F.try_element_at("top", F.lit("cases")))).alias("items"))
    parsed = parsed.withColumn("_read", read_objects(F.col("items")))
    nested = F.filter(F.map_entries("top"), lambda e: F.startswith(F.ltrim(e["value"]), F.lit("{")))
    no_id = F.lit(None).cast("string")

    def item(fields: Column, case: Column) -> Column:
        return F.struct(fields.alias("fields"), case.alias("case"))

    # A single case keeps its own map, because writing a map of JSON texts again would quote them twice.
    cases = F.when(F.col("single"), F.array(item(F.col("top"), no_id))).when(
        F.col("top").isNull() | F.col("_in_cases"), F.transform(objects(F.col("items"), F.col("_read")), lambda m: item(m, no_id))).otherwise(
        F.transform(nested, lambda e: item(F.from_json(e["value"], MAP), e["key"])))
    # The generator parses the cases; parsed above it, they would be parsed once more in the filter.
    flagged = parsed.select("stem", "path", "rejected", "single", F.posexplode_outer(cases).alias("pos", "case"))
    fields = F.col("case.fields")
    own_id = F.lit(False)
    for key in n.CASE_KEYS:
        own_id = own_id | F.map_contains_key(fields, key)
    given = F.coalesce("case.case", F.when(F.coalesce("single", F.lit(False)) & ~own_id, F.col("stem")))
    with_id = flagged.filter(fields.isNotNull() | F.coalesce("rejected", F.lit(False))).withColumn("_given", given)
    merged = F.when(F.col("_given").isNull(), fields).otherwise(F.map_concat(
        F.map_filter(fields, lambda k, v: k != "case_id"), F.create_map(F.lit("case_id"), F.col("_given"))))
    return with_id.select(
        F.concat_ws("#", "path", F.col("pos").cast("string")).alias("record"), merged.alias("raw"),
        F.coalesce(F.col("rejected"), F.lit(False)).alias("rejected"))


def read_objects(text: Column) -> Column:
    """A JSON list of objects as one parse gives it, for :func:`objects`; store it as a column."""
    whole = F.concat(F.lit('{"_ostiary_items":'), text, F.lit("}"))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(whole, ITEMS, {"columnNameOfCorruptRecord": "_ostiary_bad"}))


def objects(text: Column, read: Column) -> Column:
    """The elements of a JSON list as maps of field names to JSON text, NULL for those that are no objects.

    A list that holds anything but objects is read again, element by element.
    """
    whole = read["_ostiary_bad"].isNull() & read["_ostiary_items"].isNotNull()
    return F.when(whole, read["_ostiary_items"]).otherwise(
        F.transform(F.from_json(text, "array<string>"), lambda t: F.from_json(t, MAP)))


def _note(condition: Column, *text) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))


def normalize_references(raw: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per daughter with canonical fields, ``radius_known``, ``notes`` and ``problem`` (NULL if usable).

    ``headers`` (case_id, origin, spacing, direction) converts voxel coordinates. Rows with a problem are
    kept so that the caller can report or raise.
    """
    case_value, case_key = n.pick_alias(F.col("raw"), n.CASE_KEYS)
    list_text, _ = n.pick_alias(F.col("raw"), n.DAUGHTER_KEYS)
    scope = F.try_element_at("raw", F.lit("scope")) == REJECTED_SCOPE
    space = F.coalesce(F.try_element_at("raw", F.lit("coordinate_space")), F.try_element_at("raw", F.lit("units")))
    found = raw.select("record", case_value.alias("case_value"), list_text.alias("list"), n.has_voxel_hint(space).alias("voxel_space"),
                       (F.col("rejected") | F.coalesce(scope, F.lit(False))).alias("rejected"))
    found = found.withColumns({"case_id": n.normalize_case_id(F.col("case_value")), "_read": read_objects(F.col("list"))})
    as_map = F.from_json("list", MAP)
    entries = F.when(F.startswith(F.ltrim("list"), F.lit("[")), objects(F.col("list"), F.col("_read"))).otherwise(F.transform(
        F.map_entries(as_map), lambda e: F.map_concat(
            F.map_filter(F.from_json(e["value"], MAP), lambda k, v: k != "instance_id"),
            F.create_map(F.lit("instance_id"), e["key"]))))
    found = found.withColumn("_entries", entries)
    entries = F.col("_entries")
    found = found.withColumn("_repeated", repeated_ids(entries))
    rows = found.select(
        "record", "_repeated", "case_id", "case_value", "voxel_space", "rejected",
        F.col("list").isNull().alias("no_list"), F.posexplode_outer(entries).alias("index", "entry"))

    picked = list(n.FIELD_ALIASES)
    rows = rows.select("*", *[n.present_alias(F.col("entry"), aliases).alias(f"k_{field}") for field, aliases in n.FIELD_ALIASES.items()])
    # Looked for only where no ostium field is present.
    lowered = F.transform(F.map_keys("entry"), lambda k: F.struct(k.alias("key"), F.lower(k).alias("low")))
    voxel_key = F.when(F.col("t_ostium_xyz_mm").isNull(), F.get(F.filter(
        lowered, lambda k: F.contains(k["low"], F.lit("ost")) & n.holds_voxel_hint(k["low"])), F.lit(0))["key"])
    rows = rows.select("*", *[F.try_element_at("entry", F.col(f"k_{field}")).alias(f"t_{field}") for field in picked])
    rows = rows.withColumn("voxel_key", voxel_key)
    use_voxel_key = F.col("t_ostium_xyz_mm").isNull()
    texts = {"ostium": F.coalesce("t_ostium_xyz_mm", F.try_element_at("entry", F.col("voxel_key"))),
             "seed": F.col("t_seed_xyz_mm"), "direction": F.col("t_direction_xyz")}
    rows = rows.select(
        "record", "_repeated", "case_id", "case_value", "rejected", "no_list", "index", "entry", *[f"k_{f}" for f in picked],
        "t_radius_mm", F.col("t_instance_id"), use_voxel_key.alias("from_voxel_key"),
        (F.when(use_voxel_key, F.lit(True)).otherwise(F.col("voxel_space"))).alias("voxel"),
        F.col("t_ostium_xyz_mm").isNull().alias("_no_ostium_key"), "voxel_key",
        *[column.alias(f"{form}_{name}") for name, text in texts.items()
          for form, column in zip(("listed", "named"), n.parsed_vector(text))],
        F.col("t_seed_xyz_mm").isNotNull().alias("seed_given"), F.col("t_direction_xyz").isNotNull().alias("direction_given"))
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith(("listed_", "named_"))],
        *[n.to_vector(F.col(f"listed_{name}"), F.col(f"named_{name}")).alias(name) for name in texts])
    # Plain numbers rather than arrays: what is generated for this step stays short enough to be compiled.
    frame = {f"_{part}{i}": F.get(part, F.lit(i)) for part, size in (("origin", 3), ("spacing", 3), ("direction", 9)) for i in range(size)}
    if headers is not None:
        rows = rows.join(headers.select("case_id", F.lit(True).alias("_h"), *[v.alias(c) for c, v in frame.items()]), "case_id", "left")
    else:
        rows = rows.withColumns({"_h": F.lit(None).cast("boolean"), **{c: F.lit(None).cast("double") for c in frame}})
    header = F.col("_h").isNotNull()
    parts = [[F.col(c) for c in frame if c.startswith(f"_{part}")] for part in ("origin", "spacing", "direction")]

    def physical(name: str) -> Column:
        moved = g.point(*g.index_to_physical(g.xyz(name), *parts))
        return F.when(F.col("voxel"), F.when(header & F.col(name).isNotNull(), moved)).otherwise(F.col(name))

    rows = rows.withColumns({"ostium": physical("ostium"), "seed": physical("seed")})
    derived = g.point(*g.subtract(g.xyz("seed"), g.xyz("ostium")))
    rows = rows.withColumn("direction", F.when(F.col("direction_given"), F.col("direction")).otherwise(derived))
    rows = rows.withColumn("norm", g.norm(g.xyz("direction")))
    rows = rows.withColumn("direction", F.when(F.col("norm") > 0, g.point(*[c / F.col("norm") for c in g.xyz("direction")])))
    rows = rows.withColumn("seed", F.when(F.col("seed_given"), F.col("seed")).otherwise(
        g.point(*g.add_scaled(g.xyz("ostium"), g.xyz("direction"), 5.0))))
    value = F.col("t_radius_mm").try_cast("double")
    known = F.coalesce(g.is_finite(value) & (value > 0), F.lit(False))
    halved = F.col("k_radius_mm") == "diameter_mm"
    rows = rows.withColumn("_label", F.concat(F.col("case_id"), F.lit("#"), F.col("index").cast("string")))
    label = F.col("_label")
    renamed = _note(F.col("case_id") != F.col("case_value"), F.col("case_id"), ": case identifier normalized")
    used = F.array(*[F.struct(F.col(f"k_{field}").alias("key"), F.lit(aliases[0]).alias("meant")) for field, aliases in n.FIELD_ALIASES.items()])
    aliased = F.transform(used, lambda u: _note(u["key"] != u["meant"], label, ": field '", u["key"], "' used for '", u["meant"], "'"))
    notes = [
        _note(F.col("voxel") & header, label, ": converted voxel indices to physical mm"),
        _note(~F.col("direction_given"), label, ": no direction given, taken from ostium to seed"),
        _note(F.abs(F.col("norm") - 1) > 0.01 + 1e-5, label, ": direction renormalized"),
        _note(~F.col("seed_given"), label, ": seed placed 5 mm along the direction"),
        _note(F.col("_repeated"), label, ": identifiers repeat, position appended"),
        _note(known & halved, label, ": diameter halved to a radius"), _note(~known, label, ": no radius"),
    ]
    problem = F.coalesce(
        F.when(F.col("rejected"), "unreviewed_proposals"), F.when(F.col("case_value").isNull(), "no_case_identifier"),
        F.when(F.col("no_list"), "no_daughter_list"),
        F.when(F.col("index").isNotNull() & F.col("_no_ostium_key") & F.col("voxel_key").isNull(), "no_ostium"),
        F.when(F.col("index").isNotNull() & F.col("voxel") & ~header, "voxel_without_header"),
        F.when(F.col("index").isNotNull() & F.col("ostium").isNull(), "bad_ostium"),
        F.when(F.col("seed_given") & F.col("seed").isNull(), "bad_seed"),
        F.when(F.col("index").isNotNull() & ~F.col("direction_given") & ~F.col("seed_given"), "no_direction_or_seed"),
        F.when(F.col("direction_given") & F.col("norm").isNull(), "bad_direction"),
        F.when(F.col("norm") == 0, "zero_direction"))
    name = F.coalesce("t_instance_id", default_id(F.col("index")))
    return rows.select(
        "record", "case_id", "index",
        F.when(F.col("_repeated"), F.concat(name, F.format_string("_%03d", F.col("index") + 1))).otherwise(name).alias("instance_id"),
        F.lit("aorta").alias("parent_instance_id"), "ostium", "seed", "direction",
        F.when(~known, 1.0).when(halved, value / 2).otherwise(value).alias("radius_mm"), known.alias("radius_known"),
        F.array_compact(F.concat(F.array(renamed), aliased, F.array(*notes))).alias("notes"), problem.alias("problem"))


def default_id(index: Column) -> Column:
    return F.format_string("reference_%03d", index + 1)


def repeated_ids(entries: Column) -> Column:
    """True if an id occurs twice in a record's list: then every id of it gets its position as ``_%03d``.

    Found in the list before it is exploded, so records need no window and no shuffle.
    """
    names = F.transform(entries, lambda e, i: F.coalesce(n.pick_alias(e, n.FIELD_ALIASES["instance_id"])[0], default_id(i)))
    return F.when(F.size(entries) > 1, F.size(names) > F.size(F.array_distinct(names))).otherwise(F.lit(False))


def reference_problems(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNotNull()).select(
        "record", F.col("problem").alias("rule"), F.concat_ws("#", "case_id", F.col("index").cast("string")).alias("detail"))
