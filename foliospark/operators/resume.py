"""Whether earlier results can be kept when a run goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .evaluation import DEPTHS

VIOLATIONS = ("duplicate", "outside", "query_mismatch", "gold_mismatch", "fingerprint_mismatch")


def scope_violations(rows: DataFrame, contract: DataFrame, order: Column, fingerprint: str | None = None) -> DataFrame:
    """run_name, query_id, violation: one row per earlier result and reason why it doesn't belong to the contract.

    rows: run_name, query_id, query, gold_page_id and the fingerprint column; contract: query_id, query, gold_page_id
    and `expected` (text), one row a query. Of a query's rows the first in `order` counts; the others, and rows without an id, are duplicates.
    The first row is found by a minimum, so a query of any size is no task's whole work.
    """
    base = rows.withColumns({"query_id": F.trim(F.coalesce("query_id", F.lit(""))), "__order": order})
    first = base.where("query_id <> ''").groupBy("run_name", "query_id").agg(F.min("__order").alias("__order")).withColumn("__first", F.lit(True))
    c = contract.select("query_id", F.col("query").alias("__query"), F.col("gold_page_id").alias("__gold"), F.col("expected").alias("__expected"), F.lit(True).alias("__in"))
    joined = base.join(first, ["run_name", "query_id", "__order"], "left").join(c, "query_id", "left")
    one, inside = F.col("__first").isNotNull(), F.col("__in").isNotNull()
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    tests = {"duplicate": ~one, "outside": one & ~inside, "query_mismatch": one & inside & (text("query") != text("__query")), "gold_mismatch": one & inside & (text("gold_page_id") != text("__gold")),
             "fingerprint_mismatch": one & inside & (text(fingerprint) != text("__expected")) if fingerprint else F.lit(False)}
    found = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return joined.select("run_name", "query_id", F.explode(found).alias("violation"))


def scope_report(rows: DataFrame, violations: DataFrame, n: int = 5) -> DataFrame:
    """run_name, prediction_rows, a count and the n first ids per violation, compatible."""
    ids = violations.select("run_name", "violation", "query_id").distinct()
    w = Window.partitionBy("run_name", "violation").orderBy("query_id")
    firsts = ids.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy("run_name", "violation").agg(F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("ids"))
    counts = violations.groupBy("run_name", "violation").agg(F.count(F.lit(1)).alias("n")).join(firsts, ["run_name", "violation"])
    wide = counts.groupBy("run_name").agg(*[F.coalesce(F.sum(F.when(F.col("violation") == v, F.col("n"))), F.lit(0)).alias(f"n_{v}") for v in VIOLATIONS],
                                          *[F.coalesce(F.max(F.when(F.col("violation") == v, F.col("ids"))), F.lit("")).alias(f"{v}_ids") for v in VIOLATIONS])
    out = rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("prediction_rows")).join(wide, "run_name", "left")
    out = out.withColumns({f"n_{v}": F.coalesce(f"n_{v}", F.lit(0)) for v in VIOLATIONS} | {f"{v}_ids": F.coalesce(f"{v}_ids", F.lit("")) for v in VIOLATIONS})
    bad = F.lit(0)
    for v in VIOLATIONS:
        bad = bad + F.col(f"n_{v}")
    return out.withColumn("compatible", bad == 0)


def require_compatible(report: DataFrame) -> None:
    """Fails where a run's earlier results belong to other queries or another configuration; report: scope_report()."""
    bad = report.where("not compatible").select("run_name").orderBy("run_name").limit(10).collect()
    if bad:
        raise ValueError(f"earlier results of another scope: {', '.join(str(r[0]) for r in bad)}")


def reusable_rows(submissions: DataFrame, contract: DataFrame, mapping: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """run_name, query_id, level, topic_id, gold_rank, recall_at_k, mrr_at_10 of the submissions to keep.

    Kept are those of a finished status with ten known, distinct handles whose query the contract (query_id, level,
    topic_id, answer_page_id) has. Level, topic and metrics are those of the contract, not of the stored row.
    """
    done = submissions.where(F.col("status").isin(*statuses) & (F.size("ranked_answers") == 10))
    long = done.select("run_name", "query_id", F.posexplode("ranked_answers").alias("pos", "a")).select("run_name", "query_id", "pos", F.col("a.page_handle").alias("page_handle"))
    known = long.join(mapping.select("page_handle", "page_id"), "page_handle").join(contract.select("query_id", "level", "topic_id", "answer_page_id"), "query_id")
    per = known.groupBy("run_name", "query_id").agg(F.countDistinct("page_handle").alias("n"), F.first("level").alias("level"), F.first("topic_id").alias("topic_id"),
                                                     F.min(F.when(F.col("page_id") == F.col("answer_page_id"), F.col("pos") + 1)).cast("int").alias("gold_rank")).where("n = 10")
    hit = F.col("gold_rank")
    return per.select("run_name", "query_id", "level", "topic_id", "gold_rank", *[F.coalesce((hit <= d).cast("double"), F.lit(0.0)).alias(f"recall_at_{d}") for d in DEPTHS], F.round(F.coalesce(1.0 / hit, F.lit(0.0)), 9).alias("mrr_at_10"))


def checkpoint_error(next_step: Column, most_steps: int, stored: Column, expected: Column, has_state: Column) -> Column:
    """'' for a checkpoint that can be resumed: its fingerprint is the expected one, its step is in bounds, its state is there."""
    return (F.when(~F.coalesce(stored == expected, F.lit(False)), "fingerprint differs").when(F.coalesce(next_step, F.lit(1)) > most_steps + 1, "too many steps")
            .when(~F.coalesce(has_state, F.lit(False)), "no state").otherwise(""))
