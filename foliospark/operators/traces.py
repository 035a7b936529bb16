"""Relational analytics over model turns: audits, state as of a step, submission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import first_wins, positions, ranges, running

HANDLE = r"(page_[0-9]+)"
ORDER = ["logged_at", "output_id"]


def turns(outputs: DataFrame) -> DataFrame:
    """One row per output_id; rows without a query or a time are left out."""
    known = outputs.where("query_id is not null and logged_at is not null and output_id is not null")
    return first_wins(known, ["output_id"], F.col("logged_at"))


def request_audit(rows: DataFrame, *by: str) -> DataFrame:
    """Logical turns (distinct query, phase and step), events, physical attempts, retries, accepted and rejected replies."""
    a = F.col("request_attempts")
    return rows.groupBy(*by).agg(
        F.countDistinct("query_id", F.coalesce("phase", F.lit("")), "step").alias("logical_turns"), F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts"),
        F.sum(F.coalesce(F.size(F.filter(a, lambda x: F.coalesce(x["retry_scheduled"], F.lit(False)))), F.lit(0))).alias("retries"),
        F.count_if(F.col("event_type") == "format_error").alias("format_errors"), F.count_if(F.col("event_type") == "provider_error").alias("provider_errors"),
        F.count_if(F.col("response_accepted")).alias("accepted"), F.count_if(~F.coalesce("response_accepted", F.lit(False))).alias("rejected"))


def handles_seen(rows: DataFrame) -> DataFrame:
    """query_id, logged_at, output_id, handle for every handle a turn names."""
    return rows.select("query_id", *ORDER, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("raw_response", F.lit("")), F.lit(HANDLE), 1))).alias("handle"))


def seen_as_of(rows: DataFrame) -> DataFrame:
    """query_id, output_id, n_seen: distinct handles named up to and with the turn."""
    first = handles_seen(rows).groupBy("query_id", "handle").agg(F.min(F.struct(*ORDER)).alias("f")).groupBy("query_id", "f.output_id").agg(F.count(F.lit(1)).alias("new"))
    with_new = rows.select("query_id", *ORDER).join(first, ["query_id", "output_id"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return running(with_new, ["query_id"], ranges(rows, "logged_at"), [F.col(c) for c in ORDER], {"n_seen": F.col("new")}).select("query_id", "output_id", "n_seen")


def usage_so_far(rows: DataFrame) -> DataFrame:
    """query_id, output_id, step_no, tokens_so_far, accepted_so_far."""
    totals = {"step_no": F.lit(1), "tokens_so_far": F.coalesce("output_tokens", F.lit(0)), "accepted_so_far": F.coalesce(F.col("response_accepted").cast("int"), F.lit(0))}
    narrow = rows.select("query_id", *ORDER, "output_tokens", "response_accepted")
    return running(narrow, ["query_id"], ranges(rows, "logged_at"), [F.col(c) for c in ORDER], totals).select("query_id", "output_id", *totals)


def numbered(rows: DataFrame) -> DataFrame:
    return positions(rows, ["query_id"], ranges(rows, "logged_at"), [F.col(c) for c in ORDER])


def submission_checks(predictions: DataFrame, mapping: DataFrame) -> DataFrame:
    """prediction_id, n_answers, n_null, n_repeated, n_unknown, ok of each distinct submission; ok is ten known handles without repeats."""
    one = first_wins(predictions, ["prediction_id"], F.col("received_at"))
    answers = one.select("prediction_id", F.explode_outer("ranked_answers").alias("a")).select("prediction_id", F.col("a").isNotNull().alias("there"), F.col("a.page_handle").alias("page_handle"))
    known = answers.join(mapping.select("page_handle").distinct().withColumn("known", F.lit(1)), "page_handle", "left")
    n = known.groupBy("prediction_id").agg(
        F.count_if("there").alias("n_answers"), F.count_if(F.col("there") & F.col("page_handle").isNull()).alias("n_null"),
        (F.count("page_handle") - F.countDistinct("page_handle")).alias("n_repeated"), F.count_if(F.col("page_handle").isNotNull() & F.col("known").isNull()).alias("n_unknown"))
    return n.withColumn("ok", (F.col("n_answers") == 10) & (F.col("n_null") + F.col("n_repeated") + F.col("n_unknown") == 0))
