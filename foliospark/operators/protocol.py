"""Checks of what a model asked for and answered: call requests, assessments, aggregate answers and submissions.

Every check gives the error as text, '' for a valid row, so that rows are marked and never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .traces import ORDER, handles_seen

MOST_SEARCH_RESULTS, MOST_IMAGES, LEAST_SIDE = 50, 10, 0.01
DEFAULT_SEARCH_RESULTS, ANSWERS = 10, 10
ASSESSMENTS = "array<struct<page_handle: string, relevance_score: double>>"


def reply_object(reply: Column) -> Column:
    """The reply's text from its first to its last brace if that is one JSON object (bare, fenced or with words around it), else null."""
    found = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def first_error(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that is broken; a rule that is null isn't."""
    out = F.lit("")
    for broken, text in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), text).otherwise(out)
    return out


def search_error(query: Column, top_k: Column) -> Column:
    """top_k: text, null for the default."""
    n = top_k.try_cast("bigint")
    return first_error((F.trim(F.coalesce(query, F.lit(""))) == "", "empty query"), (top_k.isNotNull() & n.isNull(), "top_k is no integer"), ((n < 1) | (n > MOST_SEARCH_RESULTS), "top_k out of range"))


def clamped(k: Column | int, n: Column | int) -> Column:
    """Wanted results, at least one and at most as many as there are."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.lit(1), F.least(lit(k), lit(n)))


def crop_error(region: Column, inspected: Column) -> Column:
    """region: [x1, y1, x2, y2] as fractions of the page."""
    r = lambda i: F.get(region, F.lit(i))
    return first_error(
        (~inspected, "page not inspected"), (F.coalesce(F.size(region), F.lit(-1)) != 4, "no four numbers"), (F.exists(region, lambda x: x.isNull() | F.isnan(x)), "not numeric"),
        (F.exists(region, lambda x: (x < 0) | (x > 1)), "outside the page"), ((r(2) - r(0) < LEAST_SIDE) | (r(3) - r(1) < LEAST_SIDE), "empty, reversed or too small"))


def first_seen(turns: DataFrame) -> DataFrame:
    """query_id, handle, first: the turn (time and id) that named the handle first."""
    return handles_seen(turns).groupBy("query_id", "handle").agg(F.min(F.struct(*ORDER)).alias("first"))


def inspect_checks(requests: DataFrame, seen: DataFrame, mapping: DataFrame) -> DataFrame:
    """query_id, output_id, n_handles, error of inspection requests (query_id, logged_at, output_id, handles). A request is valid as a whole or not at all.

    A handle must be known and named in an earlier turn of its query. Null handles are unknown.
    """
    long = requests.select("query_id", *ORDER, F.explode("handles").alias("handle"))
    known = mapping.select(F.col("page_handle").alias("handle")).distinct().withColumn("known", F.lit(True))
    joined = long.join(known, "handle", "left").join(seen, ["query_id", "handle"], "left")
    per = joined.groupBy("query_id", *ORDER).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("handle").alias("distinct"), F.count_if(F.col("known").isNull()).alias("unknown"),
                                                F.count_if(~F.coalesce(F.col("first") < F.struct(*ORDER), F.lit(False))).alias("unseen"))
    n = F.coalesce("n", F.lit(0))
    error = first_error((n == 0, "no handles"), (n > MOST_IMAGES, "too many handles"), (F.col("distinct") < n, "repeated handle"), (F.col("unknown") > 0, "unknown handle"), (F.col("unseen") > 0, "handle not seen before"))
    return requests.select("query_id", *ORDER).join(per, ["query_id", *ORDER], "left").select("query_id", "output_id", n.cast("bigint").alias("n_handles"), error.alias("error"))


def assessment_error(assessments: Column, expected: Column) -> Column:
    """expected: the handles that were to be assessed, each once, with a score of 0 to 100."""
    handles, scores = F.transform(assessments, lambda a: F.coalesce(a["page_handle"], F.lit(""))), F.transform(assessments, lambda a: a["relevance_score"])
    return first_error(
        (assessments.isNull(), "no assessments"), (F.size(handles) != F.size(expected), "wrong number of assessments"), (F.size(F.array_except(handles, expected)) > 0, "unexpected handle"),
        (F.size(F.array_distinct(handles)) != F.size(handles), "repeated handle"), (F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 100)), "invalid score"))


def in_expected_order(assessments: Column, expected: Column) -> Column:
    """The assessments in the order of the expected handles."""
    return F.filter(F.transform(expected, lambda h: F.get(F.filter(assessments, lambda a: a["page_handle"] == h), F.lit(0))), lambda a: a.isNotNull())


def answer_handles(items: Column) -> Column:
    """Handles of ranked answers that are strings or objects (as JSON text)."""
    return F.transform(items, lambda x: F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.page_handle")).otherwise(x), F.lit("")))


def submission_checks(answers: DataFrame, eligible: DataFrame, mapping: DataFrame, need_ten: bool = True) -> DataFrame:
    """One row per submission: prediction_id, n_answers, n_eligible, target, n_unknown, n_unseen, n_repeated, n_evidence_dropped, error.

    answers: prediction_id, query_id, ranked_answers, one row a submission; eligible: (query_id, page_handle) pairs that the
    query's turns discovered or saw. A submission holds min(10, eligible) known, eligible, distinct handles; with
    need_ten there must be ten eligible ones. Evidence that isn't eligible is dropped, not an error.
    """
    pairs = eligible.select("query_id", "page_handle").distinct()
    number = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_eligible"))
    known = mapping.select("page_handle").distinct().withColumn("known", F.lit(True))
    long = answers.select("prediction_id", "query_id", F.posexplode("ranked_answers").alias("pos", "a")).select("prediction_id", "query_id", "pos", F.col("a.page_handle").alias("page_handle"), F.coalesce("a.evidence_page_handles", F.array()).alias("evidence"))
    seen = pairs.withColumn("seen", F.lit(True))
    checked = long.join(known, "page_handle", "left").join(seen, ["query_id", "page_handle"], "left")
    per = checked.groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("n_answers"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.count_if(F.col("known").isNotNull() & F.col("seen").isNull()).alias("n_unseen"),
        (F.count("page_handle") - F.countDistinct("page_handle")).alias("n_repeated"))
    evidence = long.select("prediction_id", "query_id", F.explode(F.array_distinct("evidence")).alias("page_handle")).join(seen, ["query_id", "page_handle"], "left")
    dropped = evidence.groupBy("prediction_id").agg(F.count_if(F.col("seen").isNull()).alias("n_evidence_dropped"))
    zero = ["n_answers", "n_unknown", "n_unseen", "n_repeated", "n_eligible", "n_evidence_dropped"]
    joined = answers.select("prediction_id", "query_id").join(per, "prediction_id", "left").join(dropped, "prediction_id", "left").join(number, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    target = F.least(F.lit(ANSWERS), F.col("n_eligible"))
    error = first_error(
        (F.lit(need_ten) & (F.col("n_eligible") < ANSWERS), "too few candidates"), (F.col("n_answers") > ANSWERS, "too many answers"), ((target > 0) & (F.col("n_answers") != target), "wrong number of answers"),
        (F.col("n_unknown") > 0, "unknown handle"), (F.col("n_unseen") > 0, "handle not seen"), (F.col("n_repeated") > 0, "repeated handle"), (F.col("n_answers") == 0, "no answers"))
    return joined.select("prediction_id", "n_answers", "n_eligible", target.alias("target"), "n_unknown", "n_unseen", "n_repeated", "n_evidence_dropped", error.alias("error"))


def with_schema_rejections(turns: DataFrame, error: Column) -> DataFrame:
    """Accepted replies that break their schema become rejected ones of event type schema_error."""
    bad = F.coalesce("response_accepted", F.lit(False)) & (error != "")
    return turns.withColumns({"event_type": F.when(bad, "schema_error").otherwise(F.col("event_type")), "response_accepted": F.when(bad, False).otherwise(F.col("response_accepted"))})


def reply_text(reply: Column) -> Column:
    """Text of a provider's reply in one of three shapes: output_text or output blocks, content blocks, or a chat choice."""
    texts = lambda path, schema, get: F.nullif(F.array_join(F.filter(F.transform(F.from_json(F.get_json_object(reply, path), schema), get), lambda x: x.isNotNull()), "\n"), F.lit(""))
    blocks = texts("$.output[*].content[*].text", "array<string>", lambda x: x)
    content = texts("$.content", "array<struct<type: string, text: string>>", lambda b: F.when(b["type"].isin("text", "output_text"), b["text"]))
    plain = F.get_json_object(reply, "$.content")
    return F.coalesce(F.get_json_object(reply, "$.output_text"), blocks, F.get_json_object(reply, "$.choices[0].message.content"), content, F.when(~plain.startswith("["), plain))


# What marks a filtered reply, and the states of a request that is sent again.
FILTER_VALUES = r'"(?:finish_reason|stop_reason|code|type)"\s*:\s*"\s*(?:blocked|content_filter|content_filtered|refusal|safety)\s*"'
FILTER_TEXTS = r"content_filter|content filtering policy"
RETRYABLE = (408, 429, 500, 502, 503, 504)


def content_filtered(reply: Column) -> Column:
    """Whether a reply, as JSON text of any depth, or its words report a content filter."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    return low.rlike(FILTER_VALUES) | low.rlike(FILTER_TEXTS)


def retryable(status: Column, more: tuple[int, ...] = ()) -> Column:
    return F.coalesce(status.isin(*RETRYABLE, *more), F.lit(False))


def body_preview(body: Column, limit: int = 1000) -> Column:
    return F.replace(F.substring(F.coalesce(body, F.lit("")), 1, limit), F.lit("\n"), F.lit("\\n"))


def normalised_url(url: Column, path: str = "") -> Column:
    """Without trailing slashes, with the path appended unless it is there."""
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    return bare if not path else F.when(bare.endswith(path), bare).otherwise(F.concat(bare, F.lit(path)))
