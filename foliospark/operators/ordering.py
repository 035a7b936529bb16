"""Positions, running totals and frames over ordered rows of groups that may be of any size.

A window over one group is one task. Here a group is cut into buckets by a coarse order key (a day, a step range):
windows run within a bucket, and what came before it is added from one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranges(df: DataFrame, column: str, rows: int = 500_000) -> Column:
    """A bucket for running(): the range of all rows' values of the column, in which about `rows` rows lie.

    The ranges follow from counts (approximate percentiles), so a busy day is cut like a busy year.
    """
    n = df.count() // rows
    if not n:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(F.col(column).cast("timestamp").cast("double"), [i / (n + 1) for i in range(1, n + 1)], 10_000)).first()[0]
    return F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda k, c: k + (F.col(column).cast("double") >= c).cast("int"))


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """df with, per name in totals, the sum of its expression over the group's rows up to and with this one.

    Rows of a smaller bucket must come before those of a larger one in `order`, which must be unique.
    """
    b = df.withColumns({"__bucket": bucket} | {f"__x{i}": x for i, x in enumerate(totals.values())})
    sums = b.groupBy(*keys, "__bucket").agg(*[F.sum(f"__x{i}").alias(f"__s{i}") for i in range(len(totals))])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__s{i}") for i in range(len(totals))])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({name: F.sum(f"__x{i}").over(inside) for i, name in enumerate(totals)})
    joined = local.join(sums, [*keys, "__bucket"])
    return joined.withColumns({name: F.col(name) + F.col(f"__s{i}") for i, name in enumerate(totals)}).select(*df.columns, *totals)


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    return running(df, keys, bucket, order, {name: F.lit(1)})


def trailing(df: DataFrame, keys: list[str], position: str, rows: int, name: str, value: Column, segment: int = 1000) -> DataFrame:
    """df with `name`: the values of the last `rows` rows up to this one, oldest first. position counts from 1 per group.

    Groups are cut into segments; each takes along the rows before it that its first frames need.
    """
    at = F.floor((F.col(position) - 1) / segment)
    copies = df.withColumns({"__v": value, "__own": at}).withColumn("__segment", F.explode(F.array_distinct(F.array(at, F.floor((F.col(position) + rows - 2) / segment)))))
    w = Window.partitionBy(*keys, "__segment").orderBy(position).rowsBetween(-(rows - 1), 0)
    return copies.withColumn(name, F.collect_list("__v").over(w)).where("__segment = __own").select(*df.columns, name)


def global_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with the row's place from 1 in the order of all rows: range partitions, numbered, plus the rows before them."""
    from ..session import materialize

    parted = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()))
    before = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = before.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = parted.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__rn")).cast("bigint")).select(*df.columns, name)


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: that of the greatest order value. Partial maxima are made before the shuffle."""
    whole = F.struct(order.alias("__o"), F.struct(*df.columns).alias("__row"))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(whole["__row"], whole["__o"]).alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")
