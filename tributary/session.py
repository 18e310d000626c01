"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tributary")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where everything runs in one process, in a
    local session, may it be unset; a temporary folder is used then, which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_dir()
    return folder.rstrip("/")


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="tributary-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


#: Tables written by ``save``, in order.
_written: list[str] = []


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and returns it as read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_last(df: DataFrame, name: str, codec: str = "snappy", since: int = 0) -> DataFrame:
    """``save``, after which the tables that ``save`` wrote from number ``since`` on go: nothing but ``df`` reads them."""
    last = len(_written)
    out = save(df, name, codec)
    drop_saved(df.sparkSession, since, last)
    return out


def drop_saved(spark: SparkSession, since: int, to: int | None = None) -> None:
    """Removes the tables that ``save`` wrote from number ``since`` on, or up to ``to``: nothing reads them any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _written[since:to]:
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def n_saved() -> int:
    return len(_written)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
