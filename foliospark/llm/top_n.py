"""Problem 3: the N best items of every group by simultaneous bisection.

An item's code is an array of whole numbers whose order is the order wanted: first the score's bits, made
monotone, then the identifier's bytes, seven at a time and inverted, so that equal scores rank by identifier
ascending. Every group keeps a cutoff that is refined for all groups at once: the range of one code position is
cut at 2^BITS - 1 midpoints, the rows between them are counted (pre-aggregated before the shuffle), and the cut that holds the
N-th row is the next range. When a range is one value and still holds too many rows, the next position of the
code decides. No group is ever collected or sorted: a task sees only partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BITS = 6
#: A group is hot if it holds more than a HOT_PARTS-th of all rows; so there are fewer than HOT_PARTS of them. Its cutoff
#: has SALTS copies, so that its rows are joined by that many tasks.
HOT_PARTS, SALTS = 200, 16
#: Cutoffs up to this number are broadcast (under 200 bytes each); beyond it they are joined by shuffle.
BROADCAST_CUTOFFS = 20_000
CHUNK = 7
TOP = 1 << (8 * CHUNK)


def score_code(score: Column) -> Column:
    """A bigint that orders as the finite double does; -0.0 equals 0.0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(F.lit(-(2**63)).cast("bigint") - bits)


def identifier_code(name: Column) -> Column:
    """Bigints of which an earlier string has the larger; the end of a string ranks before any further byte."""
    raw = F.encode(name, "UTF-8")
    n = F.octet_length(raw)
    part = lambda i: F.conv(F.rpad(F.hex(F.substring(raw, i * CHUNK + 1, F.lit(CHUNK))), 2 * CHUNK, "0"), 16, 10).cast("bigint")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1).cast("int") / F.lit(CHUNK), F.lit(0)).cast("int")), lambda i: F.lit(TOP - 1).cast("bigint") - part(i))
    return F.concat(chunks, F.array(F.lit(2 * TOP).cast("bigint") - n.cast("bigint")))


def top_n(items: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """group, item, score of the n best distinct items of each group; an item's score is its highest.

    Rows with a null group or item or a score that is null or not finite don't count. Groups with n items or fewer
    keep them all. Equal scores rank by item ascending (bytes). Further columns are ignored, whatever their names.
    """
    s = F.col(score).cast("double")
    best = (items.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
            .groupBy(F.col(group).alias("__group"), F.col(item).alias("__item")).agg((F.max(s) + F.lit(0.0)).alias("__score")))
    best = materialize(best.select("*", F.concat(F.array(score_code(F.col("__score"))), identifier_code(F.col("__item"))).alias("__code")))
    groups = best.groupBy("__group").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("__code")[0]).alias("lo"), F.max(F.col("__code")[0]).alias("hi"))
    groups = materialize(groups)
    total = groups.agg(F.sum("rows")).first()[0] or 0
    hot = [r[0] for r in groups.where(F.col("rows") > max(n, total // HOT_PARTS)).select("__group").collect()]  # fewer than HOT_PARTS
    open_ = materialize(groups.where(F.col("rows") > n).select("__group", F.array().cast("array<bigint>").alias("head"), "lo", "hi", F.lit(n).cast("bigint").alias("need")))
    cutoffs = []
    rows = best.select("__group", "__code")
    while not open_.isEmpty():
        rows = materialize(_inside(rows, open_, hot))
        chosen = materialize(_refine(rows))
        cutoffs.append(chosen.where("exact").select("__group", "cutoff"))
        open_ = chosen.where("not exact").select("__group", "head", "lo", "hi", "need")
        rows = rows.select("__group", "__code")
    if not cutoffs:
        return best.select(F.col("__group").alias(group), F.col("__item").alias(item), F.col("__score").alias(score))
    bound = cutoffs[0]
    for c in cutoffs[1:]:
        bound = bound.unionByName(c)
    kept = _salted(best, materialize(bound), "left", hot).where(F.col("cutoff").isNull() | (F.col("__code") >= F.col("cutoff")))
    return kept.select(F.col("__group").alias(group), F.col("__item").alias(item), F.col("__score").alias(score))


def _salted(rows: DataFrame, per_group: DataFrame, how: str, hot: list) -> DataFrame:
    """rows joined with their group's row of per_group; that of a hot group is found under SALTS salts."""
    if per_group.count() <= BROADCAST_CUTOFFS:
        return rows.join(F.broadcast(per_group), "__group", how)
    is_hot = F.col("__group").isin(hot) if hot else F.lit(False)
    salted = per_group.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    own = F.when(is_hot, F.pmod(F.xxhash64("__code"), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.withColumn("__salt", own).join(salted.hint("merge"), ["__group", "__salt"], how).drop("__salt")


def _inside(rows: DataFrame, open_: DataFrame, hot: list) -> DataFrame:
    """Rows of undecided groups within the group's range, with the value at the code's position in question."""
    at = F.get("__code", F.size("head"))
    joined = _salted(rows, open_, "inner", hot)
    return joined.where((F.slice("__code", F.lit(1), F.size("head")) == F.col("head")) & (at >= F.col("lo")) & (at <= F.col("hi"))).withColumn("at", at)


def _refine(rows: DataFrame) -> DataFrame:
    """One row per group: an exact cutoff, or the narrower range in which the n-th row lies."""
    # ranges wider than a bigint are measured in steps of two
    span = F.try_subtract("hi", "lo")
    fine = F.expr(f"(at - lo) div ((hi - lo) div {1 << BITS} + 1)")
    coarse = F.expr(f"(shiftright(at, 1) - shiftright(lo, 1)) div ((shiftright(hi, 1) - shiftright(lo, 1)) div {1 << BITS} + 1)")
    cut = F.when(F.col("lo") == F.col("hi"), F.lit(0)).when(span.isNotNull(), fine).otherwise(coarse).cast("int")
    counted = (rows.withColumn("cut", cut).groupBy("__group", "cut")
               .agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("least"), F.max("at").alias("most"), F.first("head").alias("head"), F.first("need").alias("need")))
    above = Window.partitionBy("__group").orderBy(F.desc("cut"))  # at most 2^BITS rows a group
    upto = counted.withColumn("upto", F.sum("rows").over(above)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need")))
    left = F.col("need") - (F.col("upto") - F.col("rows"))
    exact = F.col("rows") == left
    single = F.col("least") == F.col("most")
    return upto.select(
        "__group", exact.alias("exact"), F.concat("head", F.array("least")).alias("cutoff"),
        F.when(single, F.concat("head", F.array("least"))).otherwise(F.col("head")).alias("head"),
        F.when(single, F.lit(-(2**63)).cast("bigint")).otherwise(F.col("least")).alias("lo"),
        F.when(single, F.lit(2**63 - 1).cast("bigint")).otherwise(F.col("most")).alias("hi"), left.alias("need"),
    )


def ranked_handles(predictions: DataFrame, n: int = 10) -> DataFrame:
    """query_id, page_handle, score: the n best handles of each query over all its submissions, whatever their status."""
    answers = predictions.where("query_id is not null").select("query_id", F.explode("ranked_answers").alias("a")).select("query_id", F.col("a.page_handle").alias("page_handle"), F.col("a.relevance_score").alias("score"))
    return top_n(answers, "query_id", "page_handle", "score", n)
