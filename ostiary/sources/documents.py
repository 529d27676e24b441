"""One document per case: a writer that shows all files of a batch at once or none.

Tasks write into a hidden folder beside the target; the driver's commit gives it the target's name in one rename, and an
aborted job removes it. An existing target is refused before anything is written and again at the commit. The rename is
atomic on local and HDFS folders; on an object store it is as good as the store's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ostiary.operators.quality import raise_on
from ostiary.sources.files import diagnostic_records, prediction_records

FORMAT = "case_documents"
# Names must be plain file names: they come from case ids.
NAME = r"\A[A-Za-z0-9_.-]+\z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        parent, _, name = self.path.rpartition("/")
        self.hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"
        self._refuse()

    def _refuse(self) -> None:
        system, path = _open(self.path)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists already; nothing was written")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each attempt of a task writes a folder of its own, so an attempt that dies leaves nothing that counts."""
        system, hidden = _open(self.hidden)
        attempt = f"{hidden}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        names = []
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                with system.open_output_stream(f"{attempt}/{name}") as file:
                    file.write(body.encode())
                names.append(f"{attempt}/{name}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, hidden = _open(self.hidden)
        shown = f"{hidden}/committed"
        system.create_dir(shown, recursive=True)
        for message in messages:
            for file in message.files if message is not None else ():
                system.move(file, f"{shown}/{file.rsplit('/', 1)[1]}")
        self._refuse()
        system.move(shown, _open(self.path)[1])
        system.delete_dir(hidden)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, hidden = _open(self.hidden)
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class CaseDocuments(DataSource):
    """``df.write.format("case_documents").save(path)`` for rows ``name string, body string``, one file each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("documents are written once; choose a new folder")
        return _Writer(self.options["path"])


def write_documents(documents: DataFrame, path: str) -> None:
    """Write ``name, body``; names must be different plain file names."""
    wrong = documents.filter(F.col("name").isNull() | ~F.col("name").rlike(NAME)).select(F.lit("file name").alias("rule"), F.col("name").alias("detail"))
    twice = documents.groupBy("name").count().filter("count > 1").select(F.lit("two documents of one name").alias("rule"), F.col("name").alias("detail"))
    raise_on(wrong.unionByName(twice))
    documents.sparkSession.dataSource.register(CaseDocuments)
    documents.select("name", "body").write.format(FORMAT).mode("append").save(path)


def _named(records: DataFrame) -> DataFrame:
    """``<case_id>.json``, and ``<case_id>.part-<n>.json`` of a case in several parts."""
    several = F.col("parts") > 1
    body = F.to_json(F.struct(*[c for c in records.columns if c not in ("part", "parts")], *[F.when(several, F.col(c)).alias(c) for c in ("part", "parts")]))
    case = F.col("case_id").cast("string")
    return records.select(F.when(several, F.concat(case, F.lit(".part-"), F.col("part").cast("string"))).otherwise(case).alias("stem"), body.alias("body")).select(
        F.concat("stem", F.lit(".json")).alias("name"), "body")


def _finite(records: DataFrame) -> DataFrame:
    """JSON has no NaN: a document that would need it is an error."""
    raise_on(records.filter(F.col("body").rlike(r'"(NaN|-?Infinity)"')).select(F.lit("number without a JSON form").alias("rule"), F.col("name").alias("detail")))
    return records


def write_case_predictions(cases: DataFrame, branches: DataFrame, path: str) -> None:
    """A prediction document per case, also of cases without branches."""
    write_documents(_finite(_named(prediction_records(cases, branches))), path)


def write_case_diagnostics(runs: DataFrame, log: DataFrame, path: str) -> None:
    """A document per case with its run record and its decisions."""
    write_documents(_finite(_named(diagnostic_records(runs, log))), path)
