"""The strict top-ten evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import finite

DEPTHS = (1, 3, 5, 10)
METRICS = [f"recall_at_{d}" for d in DEPTHS] + ["mrr_at_10"]


def one_annotation(annotations: DataFrame) -> DataFrame:
    """One row per query; repeated rows are one, of differing ones the smallest answer wins."""
    row = F.min(F.struct("answer_page_id", "level", F.coalesce("topic_id", F.lit("")).alias("topic_id")))
    return annotations.where("query_id is not null").groupBy("query_id").agg(row.alias("r")).select("query_id", "r.*")


def latest_submissions(predictions: DataFrame) -> DataFrame:
    """Per run and query the submission generated last (then the larger id)."""
    known = predictions.where("query_id is not null and generated_at is not null")
    row = F.struct("prediction_id", "status", "ranked_answers")
    return (known.groupBy("run_name", "query_id").agg(F.max_by(row, F.struct("generated_at", "prediction_id")).alias("r")).select("run_name", "query_id", "r.*"))


def ranked_pages(submissions: DataFrame, mapping: DataFrame) -> DataFrame:
    """run_name, query_id, place, page_id: answers by score (missing and non-finite last), then list position; unknown handles are dropped."""
    long = submissions.select("run_name", "query_id", "status", F.posexplode("ranked_answers").alias("pos", "a")).select(
        "run_name", "query_id", "status", "pos", F.col("a.page_handle").alias("page_handle"), finite(F.col("a.relevance_score")).alias("score"))
    known = long.join(mapping.select("page_handle", "page_id"), "page_handle")
    w = Window.partitionBy("run_name", "query_id").orderBy(F.desc_nulls_last("score"), "pos")  # one submission's list
    return known.withColumn("place", F.row_number().over(w)).select("run_name", "query_id", "status", "place", "page_id")


def scored_queries(annotations: DataFrame, submissions: DataFrame, mapping: DataFrame, pages: DataFrame, need_status: bool = False) -> DataFrame:
    """One row per run and annotated query: valid, gold_rank and the metrics; a missing or invalid list scores 0.

    Valid is a list whose first ten are ten distinct pages of the corpus, with need_status also submitted.
    """
    runs = [r[0] for r in submissions.select("run_name").distinct().collect()]  # the handful of configurations
    base = one_annotation(annotations).withColumn("run_name", F.explode(F.array(*[F.lit(r) for r in runs]).cast("array<string>")))
    top = ranked_pages(submissions, mapping).where("place <= 10")
    corpus = pages.select("page_id").where("page_id is not null").distinct().withColumn("known", F.lit(1))
    top = top.join(corpus, "page_id", "left").join(one_annotation(annotations).select("query_id", "answer_page_id"), "query_id")
    lists = top.groupBy("run_name", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("distinct_pages"), F.count("known").alias("known_pages"),
        F.min(F.when(F.col("page_id") == F.col("answer_page_id"), F.col("place"))).alias("hit"), F.max("status").alias("status"))
    ok = (F.col("n") == 10) & (F.col("distinct_pages") == 10) & (F.col("known_pages") == 10)
    if need_status:
        ok = ok & (F.coalesce("status", F.lit("submitted")) == "submitted")
    joined = base.join(lists, ["run_name", "query_id"], "left").withColumn("valid", F.coalesce(ok, F.lit(False)))
    rank = F.when(F.col("valid"), F.col("hit")).cast("int")
    metrics = {f"recall_at_{d}": F.coalesce((rank <= d).cast("double"), F.lit(0.0)) for d in DEPTHS} | {"mrr_at_10": F.coalesce(1.0 / rank, F.lit(0.0))}
    return joined.withColumn("gold_rank", rank).withColumns(metrics).select("run_name", "query_id", "level", "topic_id", "valid", "gold_rank", *METRICS)


def report(scored: DataFrame, sets: tuple = (("run_name",), ("run_name", "level"), ("run_name", "topic_id")), scale: float = 100.0) -> DataFrame:
    """run_name, part, key, count, valid_rankings and metrics; part is overall, level or topic."""
    level, topic = F.grouping("level") == 0, F.grouping("topic_id") == 0
    part = F.when(level, "level").when(topic, "topic").otherwise("overall")
    key = F.when(level, F.coalesce(F.col("level").cast("string"), F.lit(""))).when(topic, F.col("topic_id")).otherwise("")
    cols = ["run_name", "level", "topic_id"]
    grouped = scored.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    return grouped.agg(part.alias("part"), key.alias("key"), F.count(F.lit(1)).alias("count"), F.count_if("valid").alias("valid_rankings"), *[F.round(scale * F.avg(m), 6).alias(m) for m in METRICS]).select("run_name", "part", "key", "count", "valid_rankings", *METRICS)
