"""Reference documents are parsed once, and lists that hold more than objects keep every element."""

import json

from ostiary.functions import naming
from ostiary.sources import references

GOOD = {"id": "a", "ostium": [1, 2, 3], "seed": [1, 2, 8]}


def split(spark, *texts):
    return references.split_documents(spark.createDataFrame([(t, f"s{i}") for i, t in enumerate(texts)], "text string, stem string"))


def test_no_filter_parses_again(spark):
    """A parse that stands in a plain column is pushed into the filter above it and done twice."""
    plan = split(spark, json.dumps([{"id": 1, "children": [GOOD]}]))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Filter" in line]
    assert lines and not any("from_json" in line for line in lines)


def test_lists_with_other_elements(spark):
    quoted = json.dumps(GOOD)
    rows = references.normalize_references(split(
        spark, json.dumps({"case": "1", "branches": [GOOD, None, 5, quoted, [1]]}), json.dumps([{"case": "2", "branches": [GOOD]}, "x", None]),
        json.dumps({"cases": [7, {"case": "3", "children": [GOOD, GOOD]}]}))).collect()
    found = sorted((r["case_id"], r["index"], r["problem"], r["instance_id"]) for r in rows)
    assert [f[:3] for f in found] == [
        ("subject001", 0, None), ("subject001", 1, "no_ostium"), ("subject001", 2, "no_ostium"), ("subject001", 3, None), ("subject001", 4, "no_ostium"),
        ("subject002", 0, None), ("subject003", 0, None), ("subject003", 1, None)]
    assert [f[3] for f in found[-2:]] == ["a_001", "a_002"] and {r["record"] for r in rows if r["case_id"] == "subject003"} == {"s2#1"}


def test_vectors_keep_their_rules(spark):
    texts = {"[1.5,2.0E-3,-3]": (1.5, 0.002, -3.0), "[1, 2, 3]": (1.0, 2.0, 3.0), '{"x":1,"y":2,"z":3}': (1.0, 2.0, 3.0), "[1d,2,3]": None, "[01,2,3]": None,
             "[1e400,2,3]": None, "[1,2]": None, "[1,2,3,4]": None, "[null,1,2]": None, "1,2,3": None, "": None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    listed, named = naming.parsed_vector(frame["t"])
    stored = frame.select("t", listed.alias("listed"), named.alias("named"))
    found = stored.select("t", naming.to_vector(stored["listed"], stored["named"]).alias("v")).collect()
    assert {r["t"]: r["v"] and tuple(r["v"]) for r in found} == texts
