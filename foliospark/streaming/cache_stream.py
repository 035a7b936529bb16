"""The page-text cache fed by a stream: each batch is an upsert, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.caching import upsert
from ..operators.ordering import last_wins
from ..session import shared_dir


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_stream(stream: DataFrame, root: str, key: str, seq: str) -> DataFrame:
    """The last row per key after all that the stream has so far was taken up; `root` keeps state and progress between calls.

    Every batch merges its own last rows with the state of the batch before into a table of its own number, so a batch that
    runs again writes the same table again; tables older than the previous one are no longer read.
    """
    spark, schema = stream.sparkSession, stream.schema

    def state(number: int) -> DataFrame:
        path = f"{root}/state/{number:09d}"
        return spark.read.schema(schema).parquet(path) if number >= 0 and _exists(spark, path) else spark.createDataFrame([], schema)

    def merge(batch: DataFrame, number: int) -> None:
        new = last_wins(batch.where(F.col(key).isNotNull()), [key], F.col(seq))
        upsert(state(number - 1), new, key, seq).write.mode("overwrite").parquet(f"{root}/state/{number:09d}")

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    number = -1
    while _exists(spark, f"{root}/state/{number + 1:09d}"):
        number += 1
    return state(number)


def stream_latest(spark: SparkSession, sf_dir: str, name: str = "ocr_cache", key: str = "page_id", seq: str = "cache_seq") -> DataFrame:
    """page_id, cache_seq, ocr_ok of the last row per page. The state of a table lies under the shared folder: a later call takes up only new files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    root = f"{shared_dir(spark)}/stream/{spark.sparkContext.applicationId}/{abs(hash(path)):x}"
    return upsert_stream(stream.select(key, seq, "ocr_ok"), root, key, seq)
