"""Heads and digests of files that are never held whole."""

import gzip
import hashlib
import os

from pyspark.sql import functions as F

from ostiary.sources import files, streams


def _folder(tmp_path):
    pointer = b"version https://git-lfs.github.com/spec/v1\noid sha256:0\n"
    bodies = {"a/orig1.nii.gz": gzip.compress(os.urandom(100_000)), "a/mask1.nii": os.urandom(70_000), "b/orig1.nii": pointer, "b/mask1.nii": b"m", "c d/ä.nii": b"x" * 41}
    for name, body in bodies.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    return bodies


def test_heads_and_availability(spark, tmp_path):
    bodies = _folder(tmp_path)
    found = streams.heads(streams.list_files(spark, str(tmp_path)))
    rows = {r["path"].split(str(tmp_path) + "/")[1]: bytes(r["content"]) for r in found.collect()}
    assert rows == {name: body[:40] for name, body in bodies.items()}
    case = F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)
    cases = {r["case_id"]: (r["available"], r["gzipped"], r["files"]) for r in files.file_availability(found, case).collect()}
    assert cases == {"a": (True, 1, 2), "b": (False, 0, 2), "c d": (True, 0, 1)}


def test_digests_in_blocks(spark, tmp_path, monkeypatch):
    bodies = _folder(tmp_path)
    listed = streams.list_files(spark, str(tmp_path))
    assert "content" not in listed.columns
    want = {name: hashlib.sha256(body).hexdigest() for name, body in bodies.items()}
    rows = {r["path"].split(str(tmp_path) + "/")[1]: r["sha256"] for r in files.checksums(listed).collect()}
    assert rows == want
    manifest = files.checksums(listed).withColumn("sha256", F.when(F.col("path").endswith("mask1.nii"), F.lit("0")).otherwise(F.col("sha256")))
    assert sorted(r["rule"] for r in files.verify_checksums(listed, manifest).collect()) == ["mismatch", "mismatch"]
    named = listed.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"))
    records = files.build_manifest(named, named.select("case_id").distinct()).collect()
    assert {(r["case_id"], n): d for r in records for n, d in r["files"].items()} == {tuple(k.split("/")): d for k, d in want.items()}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: larger than any row, with no disk used."""
    path = tmp_path / "large.bin"
    with open(path, "wb") as file:
        file.write(b"begin")
        file.truncate((2 << 30) + 5)
    row = streams.digests(streams.heads(streams.list_files(spark, str(tmp_path)))).first()
    digest = hashlib.sha256(b"begin")
    for _ in range(512):
        digest.update(bytes(1 << 22))
    assert row["length"] == (2 << 30) + 5 and bytes(row["content"])[:5] == b"begin" and row["sha256"] == digest.hexdigest()
