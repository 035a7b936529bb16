"""Rules over tables: every violation is a row (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, rule: str, key: Column, bad: Column, detail: Column | None = None) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def duplicates(df: DataFrame, rule: str, key: str) -> DataFrame:
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return violations(n, rule, F.col(key), F.col("n") > 1, F.col("n"))


def missing(df: DataFrame, known: DataFrame, rule: str, key: str) -> DataFrame:
    """Keys of df that `known` lacks; null keys are no keys."""
    lost = df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti")
    return violations(lost, rule, F.col(key), F.lit(True))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def preview(found: DataFrame, n: int = 10) -> DataFrame:
    """rule, n_violations and the n smallest keys, in order: partial lists are cut to n before the shuffle's end."""
    from pyspark.sql import Window

    firsts = found.select("rule", "key").distinct()
    w = Window.partitionBy("rule").orderBy("key")
    top = firsts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("first_keys"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations")).join(top, "rule")


def dataset_rules(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Invariants of an annotated corpus: supports number level - 1, are distinct, known and without the answer; answers are known."""
    a = annotations.distinct()
    s = F.coalesce("support_page_ids", F.array().cast("array<string>"))
    key = F.coalesce(F.col("query_id"), F.lit(""))
    hops = a.select("query_id", F.explode("support_page_ids").alias("page_id")).distinct()
    return all_of(
        violations(a, "level_out_of_range", key, F.coalesce(~F.col("level").isin(1, 2, 3), F.lit(True))),
        violations(a, "support_length", key, F.size(s) != F.col("level") - 1, F.size(s)),
        violations(a, "support_repeats", key, F.size(s) != F.size(F.array_distinct(s))),
        violations(a, "answer_in_support", key, F.coalesce(F.array_contains(s, F.col("answer_page_id")), F.lit(False))),
        missing(a.select(F.col("answer_page_id").alias("page_id")), pages, "answer_not_in_corpus", "page_id"),
        missing(hops, pages, "support_not_in_corpus", "page_id"),
        duplicates(a, "repeated_query", "query_id"),
    )
