"""Line-delimited JSON and image sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.ordering import positions
from ..session import materialize


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of a JSONL file. strict: a line that isn't a JSON object of the schema fails the read; else it comes as nulls with its text in `_corrupt`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    return spark.read.schema(full.add("_corrupt", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of the lines that are no JSON object; blank lines are none."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    numbered = positions(materialize(raw), ["file"], F.col("block"), [F.col("block"), F.col("id")], "line_no")  # ids grow in the order of a block's lines
    bad = (F.trim("line") != "") & ~F.coalesce(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull(), F.lit(False))
    return numbered.where(bad).select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")


def read_jsonl_if_present(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return read_jsonl(spark, path, schema)
    return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Many part files; with an order, ranges of it in file order. Columns are written by name, nulls kept."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, is_png, width, height from the files' own heads."""
    head = F.substring("content", 1, 24)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring(head, 1, 8)) == "89504E470D0A1A0A"
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", png.alias("is_png"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))


def image_violations(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem of listed images that are missing, no PNG or of another size. images: read_images(); manifest: path, width, height."""
    j = manifest.where("path is not null").join(images.select("path", "is_png", F.col("width").alias("w"), F.col("height").alias("h")), "path", "left")
    problem = F.when(F.col("is_png").isNull(), "missing").when(~F.col("is_png"), "no PNG").when(~F.coalesce((F.col("w") == F.col("width")) & (F.col("h") == F.col("height")), F.lit(False)), "other size")
    return j.select("path", problem.alias("problem")).where("problem is not null")
