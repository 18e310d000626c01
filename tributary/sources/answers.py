"""Write-ahead logs: tasks add answers, or soft labels, as they land, so that what a job paid for outlives it.

``<log>/run-<id>/<partition>/`` has what a partition of one run got, in small files of JSON lines or Parquet. A file is
written under a name that readers pass over (``_``) and then renamed: its final name is its commit mark. A file is never
changed, and the same id in several files means the same work done once more, of which the later counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.records import append_generations, read_generation_log


def uri(path: str) -> str:
    """An absolute path as a URI."""
    return f"file://{path}" if path.startswith("/") else path


class PartFiles:
    """The files of one partition of one run; used inside a task."""

    def __init__(self, log: str, run: str, part: int):
        self.fs, root = pafs.FileSystem.from_uri(uri(log))
        self.folder = f"{root}/run-{run}/{part:06d}"
        self.fs.create_dir(self.folder, recursive=True)

    def files(self) -> Iterator[bytes]:
        """What earlier attempts have committed, from old to new."""
        for info in sorted(self.fs.get_file_info(pafs.FileSelector(self.folder)), key=lambda x: (x.mtime_ns or 0, x.path)):
            if info.type == pafs.FileType.File and not info.base_name.startswith(("_", ".")):
                with self.fs.open_input_stream(info.path) as f:
                    yield f.read()

    def commit(self, content: bytes, kind: str) -> None:
        name = f"{uuid.uuid4().hex}.{kind}"
        with self.fs.open_output_stream(f"{self.folder}/_{name}") as f:
            f.write(content)
        self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


class LabelLog(PartFiles):
    """Soft labels: a Parquet file for each scored group of examples."""

    def landed(self) -> set[str]:
        return {x for raw in self.files() for x in pq.read_table(pa.BufferReader(raw), columns=["example_id"]).column(0).to_pylist()}

    def add(self, rows: pa.Table) -> None:
        out = pa.BufferOutputStream()
        pq.write_table(rows, out)
        self.commit(out.getvalue().to_pybytes(), "parquet")


class PartLog(PartFiles):
    """Answers: JSON lines, ``every`` of them in a file."""

    def __init__(self, log: str, run: str, part: int, every: int = 1):
        super().__init__(log, run, part)
        self.every, self.waiting = every, []

    def landed(self) -> dict[int, str]:
        return {x["index"]: x["output"] for raw in self.files() for x in map(json.loads, raw.decode().splitlines())}

    def add(self, rec_id: int, output: str) -> None:
        self.waiting.append(json.dumps({"index": rec_id, "output": output}))
        if len(self.waiting) >= self.every:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        self.commit(("\n".join(self.waiting) + "\n").encode(), "json")
        self.waiting = []


def compact_log(spark: SparkSession, log: str) -> int:
    """Writes the log's answers anew in few files and removes the ones that were there; not while a job runs on it.
    Returns the number of files removed. If it breaks off, answers stand in two files, which changes nothing."""
    fs, root = pafs.FileSystem.from_uri(uri(log))
    before = [x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == pafs.FileType.File]
    if not before:
        return 0
    append_generations(read_generation_log(spark, log), log)
    for path in before:
        fs.delete_file(path)
    return len(before)


SOFT_LABELS = "batch int, example_id string, pos int, label int, rag array<float>, bare array<float>, neg array<float>"


def read_soft_labels(spark: SparkSession, log: str) -> DataFrame:
    """The soft labels of a log, each example's once: those of the file that was committed first. Empty if it is not there."""
    try:
        rows = spark.read.schema(SOFT_LABELS).option("recursiveFileLookup", "true").parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SOFT_LABELS)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    files = rows.groupBy("example_id").agg(F.count_distinct("_file").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = files.select("example_id", F.col("first.file_path").alias("_first"))  # scored by two runs at once
    return rows.join(again, "example_id", "left").where("_first is null or _first = _file").select(*rows.columns[:-1])
