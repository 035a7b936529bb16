"""Table access and shared intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the cluster's spark.checkpoint.dir; a local one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage once and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no further result reads, so that a long session doesn't pile them up."""
    for df in tables:
        if (path := getattr(df, "table_path", None)) in _written:
            _delete(_written.pop(path), path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s result as a table, without the tables that were materialised on the way to it."""
    before = set(_written)
    out = materialize(build())
    for path in set(_written) - before - {out.table_path}:
        _delete(_written.pop(path), path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this process materialised; call once no result depends on them."""
    for path in [p for p, s in _written.items() if s is spark]:
        _delete(spark, path)
        del _written[path]


@atexit.register
def _release_all() -> None:
    for spark in set(_written.values()):
        try:
            release(spark)
        except Exception:  # the session is already gone
            pass
