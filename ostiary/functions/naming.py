"""Case identifiers and field aliases of loosely structured references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Accepted field names, first one canonical.
CASE_KEYS = ["case_id", "case", "subject", "subject_id", "id", "name"]
DAUGHTER_KEYS = ["daughters", "branches", "children", "instances", "daughter_instances"]
FIELD_ALIASES = {
    "instance_id": ["instance_id", "id", "name", "label", "branch_id"],
    "ostium_xyz_mm": ["ostium_xyz_mm", "ostium_mm", "ostium", "ostium_xyz", "origin_mm", "origin", "ostium_point"],
    "seed_xyz_mm": ["seed_xyz_mm", "seed_mm", "seed", "seed_xyz", "seed_point"],
    "direction_xyz": ["direction_xyz", "direction", "direction_mm", "dir", "tangent"],
    "radius_mm": ["radius_mm", "radius", "r_mm", "diameter_mm"],
}
VOXEL_HINTS = ["voxel", "ijk", "index", "vox"]
# Fixed value: a JSON list of three numbers without blanks, as values of a parsed map are written.
PLAIN_VECTOR = r"\A\[{0},{0},{0}\]\z".format(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
# Fixed value: names that denote a case by number.
CASE_PATTERN = r"(?i)\A(subject|subj|case|orig|mask|s|c)?[_-]?0*[0-9]+(\.nii(\.gz)?)?\z"


def normalize_case_id(value: Column) -> Column:
    """Known prefix + number becomes ``subject%03d`` (wider numbers keep all digits); else unchanged."""
    # Leading zeros go; a number of zeros alone becomes 000 by the padding.
    trimmed = F.ltrim(F.regexp_extract(value, "([0-9]+)", 1), F.lit("0"))
    padded = F.when(F.length(trimmed) >= 3, trimmed).otherwise(F.lpad(trimmed, 3, "0"))
    return F.when(value.rlike(CASE_PATTERN), F.concat(F.lit("subject"), padded)).otherwise(value)


def case_id_from_path(path: Column) -> Column:
    """Parent folder when it starts with ``subject``, else the file name without ``.nii`` or ``.nii.gz``."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*\z", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.nii(\.gz)?\z", "")
    return F.when(folder.startswith("subject"), folder).otherwise(stem)


def pick_alias(fields: Column, aliases: list[str]) -> tuple[Column, Column]:
    """(value, key) of the first alias that is present, even when its value is null."""
    key = present_alias(fields, aliases)
    return F.try_element_at(fields, key), key


def present_alias(fields: Column, aliases: list[str]) -> Column:
    """The first alias that is present; store it as a column to read the value and the key without a second search."""
    return F.coalesce(*[F.when(F.map_contains_key(fields, name), F.lit(name)) for name in aliases])


def parsed_vector(text: Column) -> tuple[Column, Column]:
    """(list form, object form) of a JSON vector, parsed at most once each; plain lists of three numbers without a JSON parser.

    Store both as columns before calling :func:`to_vector`, which reads them several times."""
    listed = F.startswith(F.ltrim(text), F.lit("["))
    plain = F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",").cast("array<double>")
    return (F.when(text.rlike(PLAIN_VECTOR), plain).when(listed, F.from_json(text, "array<double>")),
            F.when(~listed, F.from_json(text, "struct<x:double,y:double,z:double>")))


def to_vector(listed: Column, named: Column) -> Column:
    """A point from three list items or from x, y, z; NULL unless all three are finite numbers."""
    parts = [F.coalesce(F.get(listed, F.lit(i)), named[axis]) for i, axis in enumerate("xyz")]
    usable = reduce(lambda p, q: p & q, [
        v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) for v in parts], listed.isNull() | (F.size(listed) == 3))
    return F.when(usable, F.struct(*[v.alias(axis) for v, axis in zip(parts, "xyz")]))


def has_voxel_hint(text: Column) -> Column:
    return holds_voxel_hint(F.lower(text))


def holds_voxel_hint(lowered: Column) -> Column:
    found = F.lit(False)
    for hint in VOXEL_HINTS:
        found = found | F.coalesce(F.contains(lowered, F.lit(hint)), F.lit(False))
    return found
