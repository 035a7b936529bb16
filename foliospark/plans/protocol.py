"""Registered queries on replies, requests, submissions, resumption and corpora; each with its SQL where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X
from ..operators import blocks as B, caching, evaluation as E, ordering as O, protocol as P, resume, retrieval as R, traces as T, validation as C
from ..session import materialize, table as t
from .catalogue import COS, SEARCH, SEEN, STATE, SUBS, TOKENS, TURNS, _pages_text, _searches, _state, _turns
from .registry import query

# Replies: the text from the first to the last brace, if it is one JSON object.

REPLIES = r", replies as (select *, case when json_valid(o) then o end as obj from (select *, nullif(regexp_extract(coalesce(raw_response, ''), '(\{.*\})', 1, 's'), '') as o from turns))"
FIRSTS = ", firsts as (select query_id, handle, min(struct_pack(logged_at := logged_at, output_id := output_id)) as f from named group by query_id, handle)"
KNOWN = ", known as (select distinct page_handle from handle_mapping)"


def _replies(spark, d, action: str | None = None) -> DataFrame:
    r = _turns(spark, d).withColumn("obj", P.reply_object(F.col("raw_response")))
    return r if action is None else r.where(F.get_json_object("obj", "$.action") == action)


@query(TURNS + REPLIES + " select output_id, json_extract_string(obj, '$.action') as action, json_extract_string(obj, '$.arguments.query') as query, obj is not null as ok from replies")
def json_plain_objects(spark, d):
    return _replies(spark, d).select("output_id", F.get_json_object("obj", "$.action").alias("action"), F.get_json_object("obj", "$.arguments.query").alias("query"), F.col("obj").isNotNull().alias("ok"))


@query(TURNS + REPLIES + """, q as (select output_id, json_extract_string(obj, '$.arguments.query') as query, json_extract_string(obj, '$.arguments.top_k') as top_k from replies where json_extract_string(obj, '$.action') = 'search')
select output_id, query, cast(greatest(1, least(coalesce(try_cast(top_k as bigint), 10), (select count(*) from handle_mapping))) as bigint) as k,
case when trim(coalesce(query, '')) = '' then 'empty query' when top_k is not null and try_cast(top_k as bigint) is null then 'top_k is no integer' when try_cast(top_k as bigint) not between 1 and 50 then 'top_k out of range' else '' end as error from q""")
def search_requests(spark, d):
    q = _replies(spark, d, "search").select("output_id", F.get_json_object("obj", "$.arguments.query").alias("query"), F.get_json_object("obj", "$.arguments.top_k").alias("top_k"))
    k = P.clamped(F.coalesce(F.col("top_k").try_cast("bigint"), F.lit(P.DEFAULT_SEARCH_RESULTS)), t(spark, d, "handle_mapping").count())
    return q.select("output_id", "query", k.cast("bigint").alias("k"), P.search_error(F.col("query"), F.col("top_k")).alias("error"))


@query(SEEN + FIRSTS + REPLIES + KNOWN + """, req as (select query_id, logged_at, output_id, json_extract(obj, '$.arguments.page_handles')::varchar[] as handles from replies where json_extract_string(obj, '$.action') = 'inspect_pages'),
per as (select l.output_id, count(*) as n, count(distinct handle) as nd, count(*) filter (m.page_handle is null) as unknown, count(*) filter (not coalesce(f.f < struct_pack(logged_at := l.logged_at, output_id := l.output_id), false)) as unseen
        from (select query_id, logged_at, output_id, unnest(handles) as handle from req) l left join known m on m.page_handle = l.handle left join firsts f using (query_id, handle) group by l.output_id)
select query_id, output_id, coalesce(n, 0) as n_handles, case when coalesce(n, 0) = 0 then 'no handles' when n > 10 then 'too many handles' when nd < n then 'repeated handle' when unknown > 0 then 'unknown handle' when unseen > 0 then 'handle not seen before' else '' end as error
from req left join per using (output_id)""")
def inspect_requests(spark, d):
    """Requests to look at pages: a handle must be named in an earlier turn of its query."""
    turns = _turns(spark, d)
    handles = F.from_json(F.get_json_object(P.reply_object(F.col("raw_response")), "$.arguments.page_handles"), "array<string>")
    req = turns.where(F.get_json_object(P.reply_object(F.col("raw_response")), "$.action") == "inspect_pages").select("query_id", *T.ORDER, handles.alias("handles"))
    return P.inspect_checks(materialize(req), P.first_seen(turns), t(spark, d, "handle_mapping"))


ASSESSED = TURNS + REPLIES + KNOWN + """, a as (select output_id, json_extract(obj, '$.assessments') as list from replies where obj is not null and json_extract(obj, '$.assessments') is not null),
items as (select output_id, unnest(json_extract(list, '$[*]')) as x from a),
per as (select output_id, count(*) as n, count(distinct m.page_handle) as n_expected, count(*) filter (not coalesce(json_extract_string(x, '$.relevance_score')::double between 0 and 100, false)) as bad,
        string_agg(m.page_handle, ',' order by m.page_handle) as handles from items left join known m on m.page_handle = json_extract_string(x, '$.page_handle') group by output_id),
checked as (select a.output_id, coalesce(n, 0) as n_assessments, case when coalesce(n, 0) != coalesce(n_expected, 0) then 'wrong number of assessments' when bad > 0 then 'invalid score' else '' end as error, coalesce(handles, '') as handles from a left join per using (output_id))
"""


def _assessed(spark, d) -> DataFrame:
    """output_id, assessments, expected: the known handles of the reply, each once, in handle order."""
    a = _replies(spark, d).select("output_id", F.from_json(F.get_json_object("obj", "$.assessments"), P.ASSESSMENTS).alias("assessments")).where("assessments is not null")
    known = t(spark, d, "handle_mapping").select("page_handle").distinct()
    expected = a.select("output_id", F.explode("assessments.page_handle").alias("page_handle")).join(known, "page_handle").groupBy("output_id").agg(F.array_sort(F.collect_set("page_handle")).alias("expected"))  # of one reply
    return a.join(expected, "output_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))


@query(ASSESSED + "select output_id, n_assessments, error, case when error = '' then handles else '' end as handles from checked")
def assessment_checks(spark, d):
    a = _assessed(spark, d)
    error = P.assessment_error(F.col("assessments"), F.col("expected"))
    ordered = F.transform(P.in_expected_order(F.col("assessments"), F.col("expected")), lambda x: x["page_handle"])
    return a.select("output_id", F.size("assessments").cast("bigint").alias("n_assessments"), error.alias("error"), F.when(error == "", F.array_join(ordered, ",")).otherwise("").alias("handles"))


@query(TURNS + REPLIES + KNOWN + """, s as (select output_id, json_extract(obj, '$.ranked_answers') as list from replies where json_extract_string(obj, '$.action') = 'submit'),
items as (select output_id, case when json_type(x) = 'OBJECT' then coalesce(json_extract_string(x, '$.page_handle'), '') else json_extract_string(x, '$') end as handle from (select output_id, unnest(json_extract(list, '$[*]')) as x from s)),
per as (select output_id, count(*) as n, count(distinct handle) as nd, count(*) filter (m.page_handle is null) as unknown from items left join known m on m.page_handle = handle group by output_id)
select output_id, coalesce(n, 0) as n_answers, case when coalesce(n, 0) != 10 then 'not ten answers' when unknown > 0 then 'unknown handle' when nd < n then 'repeated handle' else '' end as error from s left join per using (output_id)""")
def aggregate_answers(spark, d):
    s = _replies(spark, d, "submit").select("output_id", P.answer_handles(F.from_json(F.get_json_object("obj", "$.ranked_answers"), "array<string>")).alias("handles"))
    known = t(spark, d, "handle_mapping").select(F.col("page_handle").alias("handle")).distinct().withColumn("known", F.lit(True))
    unknown = s.select("output_id", F.explode("handles").alias("handle")).join(known, "handle", "left").groupBy("output_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"))
    n = F.coalesce(F.size("handles"), F.lit(0)).cast("bigint")
    error = P.first_error((n != 10, "not ten answers"), (F.col("unknown") > 0, "unknown handle"), (F.size(F.array_distinct("handles")) < n, "repeated handle"))
    return s.join(unknown, "output_id", "left").select("output_id", n.alias("n_answers"), error.alias("error"))


@query(SEEN + KNOWN + """, one as (select prediction_id, any_value(query_id) as query_id, min_by(ranked_answers, received_at) as l from predictions where prediction_id is not null and query_id is not null group by prediction_id),
pairs as (select distinct query_id, handle as page_handle from named), number as (select query_id, count(*) as n_eligible from pairs group by query_id),
long as (select prediction_id, query_id, unnest(l) as a from one),
per as (select prediction_id, count(*) as n_answers, count(*) filter (m.page_handle is null) as n_unknown, count(*) filter (m.page_handle is not null and p.page_handle is null) as n_unseen, count(a.page_handle) - count(distinct a.page_handle) as n_repeated
        from long left join known m on m.page_handle = a.page_handle left join pairs p on p.query_id = long.query_id and p.page_handle = a.page_handle group by prediction_id),
ev as (select e.prediction_id, count(*) filter (p.page_handle is null) as n_evidence_dropped from (select prediction_id, query_id, unnest(list_distinct(a.evidence_page_handles)) as h from long) e left join pairs p on p.query_id = e.query_id and p.page_handle = e.h group by e.prediction_id),
r as (select o.prediction_id, coalesce(n_answers, 0) as n_answers, coalesce(n_eligible, 0) as n_eligible, least(10, coalesce(n_eligible, 0)) as target, coalesce(n_unknown, 0) as n_unknown, coalesce(n_unseen, 0) as n_unseen, coalesce(n_repeated, 0) as n_repeated, coalesce(n_evidence_dropped, 0) as n_evidence_dropped
      from one o left join per using (prediction_id) left join ev using (prediction_id) left join number n on n.query_id = o.query_id)
select *, case when n_answers > 10 then 'too many answers' when target > 0 and n_answers != target then 'wrong number of answers' when n_unknown > 0 then 'unknown handle' when n_unseen > 0 then 'handle not seen' when n_repeated > 0 then 'repeated handle' when n_answers = 0 then 'no answers' else '' end as error from r""")
def submission_eligibility(spark, d):
    """Submissions against what their query's turns named; in the finalisation fewer than ten may do."""
    p = O.first_wins(t(spark, d, "predictions").where("prediction_id is not null and query_id is not null").select("prediction_id", "query_id", "ranked_answers", "received_at"), ["prediction_id"], F.col("received_at"))
    eligible = T.handles_seen(_turns(spark, d)).select("query_id", F.col("handle").alias("page_handle"))
    return P.submission_checks(materialize(p), materialize(eligible.distinct()), t(spark, d, "handle_mapping"), need_ten=False)


@query(TURNS + REPLIES + """, marked as (select *, coalesce(response_accepted, false) and phase = 'assess' and (obj is null or json_extract(obj, '$.assessments') is null or
  len(list_distinct(json_extract(obj, '$.assessments[*].page_handle'))) != len(json_extract(obj, '$.assessments[*].page_handle'))) as bad from replies)
select coalesce(provider, '') as provider, count(*) as calls, sum(coalesce(attempts, 0))::bigint as attempts, count(*) filter (coalesce(bad, false) or event_type in ('format_error', 'schema_error')) as format_failures, count(*) filter (coalesce(bad, false)) as schema_failures,
count(*) filter (event_type = 'provider_error') as provider_failures, count(*) filter (response_accepted and not coalesce(bad, false)) as accepted, count(*) filter (response_accepted = false or coalesce(bad, false)) as rejected from marked group by all""")
def reranker_audit(spark, d):
    """Requests by provider, after replies of the assessing phase that break their schema were marked as rejected."""
    a = F.from_json(F.get_json_object("obj", "$.assessments"), P.ASSESSMENTS)
    handles = F.transform(a, lambda x: x["page_handle"])
    error = P.first_error((F.coalesce("phase", F.lit("")) != "assess", ""), (a.isNull(), "no assessments"), (F.size(F.array_distinct(handles)) != F.size(handles), "repeated handle"))
    m = P.with_schema_rejections(_replies(spark, d), error)
    return m.groupBy(F.coalesce("provider", F.lit("")).alias("provider")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts"), F.count_if(F.col("event_type").isin("format_error", "schema_error")).alias("format_failures"), F.count_if(F.col("event_type") == "schema_error").alias("schema_failures"),
        F.count_if(F.col("event_type") == "provider_error").alias("provider_failures"), F.count_if("response_accepted").alias("accepted"), F.count_if(~F.col("response_accepted")).alias("rejected"))


@query(SUBS.rstrip() + ", " + SEEN.removeprefix("with ") + """, calls as (select query_id, count(*) as calls, sum(coalesce(output_tokens, 0)) as tokens, sum(coalesce(attempts, 0)) as attempts from turns group by query_id),
looked as (select query_id, count(distinct handle) as pages from named group by query_id),
r as (select l.run_name, g.level, coalesce(calls, 0) as calls, coalesce(tokens, 0) as tokens, coalesce(attempts, 0) as attempts, coalesce(pages, 0) as pages from latest l join gold g using (query_id) left join calls using (query_id) left join looked using (query_id) where l.status = 'submitted')
select run_name, case when grouping(level) = 1 then '' else coalesce(cast(level as varchar), '') end as level, count(*) as n_accepted, round(avg(calls), 6) as mean_calls, round(avg(pages), 6) as mean_pages, round(avg(tokens), 6) as mean_output_tokens, round(avg(attempts), 6) as mean_attempts
from r group by grouping sets ((run_name), (run_name, level))""")
def mean_usage(spark, d):
    """Calls, pages, tokens and attempts per accepted submission, by run and by level."""
    turns = _turns(spark, d)
    calls = turns.groupBy("query_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts"))
    looked = T.handles_seen(turns).groupBy("query_id").agg(F.countDistinct("handle").alias("pages"))
    subs = E.latest_submissions(t(spark, d, "predictions")).where("status = 'submitted'").select("run_name", "query_id")
    r = subs.join(E.one_annotation(t(spark, d, "annotations")).select("query_id", "level"), "query_id").join(calls, "query_id", "left").join(looked, "query_id", "left")
    g = r.groupingSets([[F.col("run_name")], [F.col("run_name"), F.col("level")]], "run_name", "level")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    return g.agg(F.when(F.grouping("level") == 1, "").otherwise(F.coalesce(F.col("level").cast("string"), F.lit(""))).alias("l"), F.count(F.lit(1)).alias("n_accepted"), mean("calls").alias("mean_calls"), mean("pages").alias("mean_pages"),
                 mean("tokens").alias("mean_output_tokens"), mean("attempts").alias("mean_attempts")).drop("level").withColumnRenamed("l", "level")


# Resumption.

@query("""with rows as (select distinct prediction_id, run_name, trim(coalesce(query_id, '')) as query_id, coalesce(action, '') as act, generated_at from predictions where prediction_id is not null),
conf as (select action as expected from predictions where action is not null group by 1 order by count(*) desc, 1 limit 1),
marked as (select *, query_id != '' and row_number() over (partition by run_name, query_id order by prediction_id) = 1 as one, query_id in (select query_id from annotations where query_id is not null) as inside, (select expected from conf) as expected from rows),
found as (select run_name, query_id, 'duplicate' as v from marked where not one union all select run_name, query_id, 'outside' from marked where one and not inside union all select run_name, query_id, 'fingerprint_mismatch' from marked where one and inside and act != expected),
firsts as (select run_name, v, string_agg(query_id, ',' order by query_id) as ids from (select *, row_number() over (partition by run_name, v order by query_id) as rn from (select distinct * from found)) where rn <= 5 group by all)
select m.run_name, count(*) as prediction_rows, """ + ", ".join(
    f"(select count(*) from found f where f.v = '{v}' and f.run_name is not distinct from m.run_name) as n_{v}, coalesce((select ids from firsts f where f.v = '{v}' and f.run_name is not distinct from m.run_name), '') as {v}_ids" for v in resume.VIOLATIONS)
    + ", not exists (select 1 from found f where f.run_name is not distinct from m.run_name) as compatible from marked m group by m.run_name")
def resume_contract(spark, d):
    """Which of a run's submissions don't belong to the annotated queries, in five lists. The tables hold no query texts: the fingerprint is the action's name."""
    p = t(spark, d, "predictions").where("prediction_id is not null").select("prediction_id", "run_name", "query_id", "action").distinct()
    rows = materialize(p.withColumns({"query": F.lit(""), "gold_page_id": F.lit("")}))
    contract = E.one_annotation(t(spark, d, "annotations")).select("query_id", F.lit("").alias("query"), F.lit("").alias("gold_page_id"), F.lit(caching.commonest(t(spark, d, "predictions"), "action")).alias("expected"))
    return resume.scope_report(rows, materialize(resume.scope_violations(rows, contract, F.col("prediction_id"), "action")))


@query(SUBS + """, done as (select * from latest where status in ('submitted', 'submitted_after_finalization') and len(ranked_answers) = 10),
long as (select run_name, query_id, unnest(ranked_answers) as a, generate_subscripts(ranked_answers, 1) as pos from done),
per as (select run_name, l.query_id, count(distinct a.page_handle) as n, any_value(level) as level, any_value(topic_id) as topic_id, min(case when m.page_id = g.answer_page_id then pos end) as hit
        from long l join handle_mapping m on m.page_handle = a.page_handle join gold g on g.query_id = l.query_id group by run_name, l.query_id)
select run_name, query_id, level, topic_id, cast(hit as int) as gold_rank, """ + ", ".join(f"cast(case when hit <= {k} then 1 else 0 end as double) as recall_at_{k}" for k in E.DEPTHS) + ", round(case when hit is null then 0.0 else 1.0 / hit end, 9) as mrr_at_10 from per where n = 10")
def resume_reuse(spark, d):
    """Finished submissions that a resumed run keeps, with level, topic and metrics from the current annotations."""
    return resume.reusable_rows(E.latest_submissions(t(spark, d, "predictions")), E.one_annotation(t(spark, d, "annotations")), t(spark, d, "handle_mapping"), ("submitted", "submitted_after_finalization"))


@query(TURNS + """, per as (select query_id, max(step) as next_step, min(provider) as first_provider, max(provider) as last_provider, count(reasoning_content) > 0 as has_state from (select t.*, m.reasoning_content from turns t join (select output_id, min(reasoning_content) as reasoning_content from model_outputs group by output_id) m using (output_id)) group by query_id)
select query_id, next_step, case when not coalesce(first_provider = last_provider, false) then 'fingerprint differs' when coalesce(next_step, 1) > 13 then 'too many steps' when not has_state then 'no state' else '' end as error from per""")
def checkpoint_guard(spark, d):
    """Whether a query's turns so far can be gone on from: one provider throughout, at most twelve steps, some state."""
    turns = T.turns(t(spark, d, "model_outputs"))
    state = t(spark, d, "model_outputs").groupBy("output_id").agg(F.min("reasoning_content").alias("state"))
    per = turns.select("query_id", "output_id", "step", "provider").join(state, "output_id").groupBy("query_id").agg(F.max("step").alias("next_step"), F.min("provider").alias("first"), F.max("provider").alias("last"), (F.count("state") > 0).alias("has_state"))
    return per.select("query_id", "next_step", resume.checkpoint_error(F.col("next_step"), 12, F.col("first"), F.col("last"), F.col("has_state")).alias("error"))


# Hybrid retrieval of all search turns: page n of the handles has vector n; a search turn has the vector of its id, if there is one.

HYBRID = TOKENS + SEARCH.replace("output_id % 20 = 0", "output_id is not null") + r""", wt as (select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from wanted) group by query_id, term),
tf as (select page_id, term, count(*) as tf from tokens group by page_id, term), df as (select term, count(*) as df from tf group by term),
bhits as (select query_id, tf.page_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) as score from wt join tf using (term) join df using (term) join lengths l on l.page_id = tf.page_id, stats group by query_id, tf.page_id),
sparse as (select query_id, page_id, rank from (select w.query_id, p.page_id, row_number() over (partition by w.query_id order by coalesce(score, 0.0) desc, p.page_id) as rank from wanted w cross join pages_text p left join bhits h on h.query_id = w.query_id and h.page_id = p.page_id) where rank <= 1000),
""" + COS.strip().removeprefix("with ").replace(" where q.vec_id % 20 = 0", "") + """, located as (select page_id, cast(substr(page_handle, 6) as bigint) as vec_id from handle_mapping),
dense as (select * from (select qid as query_id, l.page_id, row_number() over (partition by qid order by score desc, id) as rank from scores join wanted on wanted.query_id = qid join located l on l.vec_id = id) where rank <= 1000)
"""
HYBRID += """, fused as (select query_id, page_id, round(sum(1.0 / (60 + rank)), 12) as score, min(rank) as best_rank from (select * from sparse union all select * from dense) group by query_id, page_id),
final as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, best_rank, page_id) as int) as rank from fused) where rank <= 10)
"""


def _hybrid(spark, d, depth: int = 1000, k: int = 10) -> DataFrame:
    """The k best pages of every search turn. A turn without a vector has its BM25 ranking alone, which fusion keeps in order: its first k are enough."""
    searches = materialize(_searches(spark, d, 1))
    pages = materialize(R.term_counts(_pages_text(spark, d)))
    located = t(spark, d, "handle_mapping").select("page_id", F.substring("page_handle", 6, 20).cast("bigint").alias("id"))
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    corpus = materialize(e.join(located.select("id"), "id", "left_semi"))
    q = materialize(e.withColumnRenamed("id", "qid").join(searches.select(F.col("query_id").alias("qid")), "qid", "left_semi"))
    seen = q.select(F.col("qid").alias("query_id"))
    dense = R.dense_topk(q, corpus, depth).join(located, "id").select(F.col("qid").alias("query_id"), "page_id", "rank")
    sparse = R.bm25_topk(searches.join(seen, "query_id", "left_semi"), pages, depth)
    alone = R.bm25_topk(searches.join(seen, "query_id", "left_anti"), pages, k)
    return R.rrf(_lists(sparse).unionByName(dense), k).unionByName(R.rrf(_lists(alone), k))


def _lists(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", "page_id", "rank")


@query(HYBRID + "select query_id, page_id, round(score, 9) as score, cast(best_rank as bigint) as best_rank, rank from final")
def hybrid_topk(spark, d):
    """BM25 and dense rankings of depth 1,000 fused to ten pages."""
    return _hybrid(spark, d).select("query_id", "page_id", F.round("score", 9).alias("score"), F.col("best_rank").cast("bigint").alias("best_rank"), "rank")


@query(HYBRID + """, gold as (select query_id, r.answer_page_id from (select query_id, min(struct_pack(answer_page_id := answer_page_id, level := level, topic_id := coalesce(topic_id, ''))) as r from annotations where query_id is not null group by query_id)),
asked as (select w.query_id, min(g.answer_page_id) as answer_page_id from wanted w join model_outputs m on m.output_id = w.query_id join gold g on g.query_id = m.query_id group by w.query_id),
hits as (select a.query_id, min(f.rank) as hit from asked a left join final f on f.query_id = a.query_id and f.page_id = a.answer_page_id group by a.query_id)
select count(*) as n_queries, """ + ", ".join(f"round(avg(case when hit <= {k} then 1.0 else 0.0 end), 6) as recall_at_{k}" for k in E.DEPTHS) + ", round(avg(case when hit is null then 0.0 else 1.0 / hit end), 6) as mrr_at_10 from hits")
def hybrid_eval(spark, d):
    """The fused ranking of each search turn against the answer of its query."""
    turn = t(spark, d, "model_outputs").where("query_id is not null").select(F.col("output_id").alias("turn"), "query_id").distinct()
    gold = E.one_annotation(t(spark, d, "annotations")).select("query_id", "answer_page_id")
    asked = _searches(spark, d, 1).select(F.col("query_id").alias("turn")).join(turn, "turn").join(gold, "query_id").groupBy("turn").agg(F.min("answer_page_id").alias("page_id"))
    hits = asked.join(_hybrid(spark, d).select(F.col("query_id").alias("turn"), "page_id", "rank"), ["turn", "page_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in E.DEPTHS], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr_at_10"))


@query(COS + ", placed as (select m.page_id, s.qid, s.score, row_number() over (partition by s.qid order by s.score desc, sha256('17' || chr(10) || m.page_id), m.page_id) as rank from scores s join handle_mapping m on cast(substr(m.page_handle, 6) as bigint) = s.id) select qid, page_id, round(score, 6) as score, cast(rank as int) as rank from placed where rank <= 10")
def visual_search(spark, d):
    """Ten pages per query vector; equal scores by the place in the shuffled handle space."""
    e = t(spark, d, "embeddings")
    located = t(spark, d, "handle_mapping").select("page_id", F.substring("page_handle", 6, 20).cast("bigint").alias("vec_id"))
    pages = e.join(located, "vec_id").withColumn("h", X.fingerprint(F.lit("17"), F.col("page_id")))
    placed = materialize(O.global_positions(pages.select("page_id", "embedding", "h"), ["h", "page_id"], "id"))
    top = R.dense_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), placed.select("id", F.col("embedding").alias("vec")), 10)
    return top.join(placed.select("id", "page_id"), "id").select("qid", "page_id", F.round("score", 6).alias("score"), "rank")


# Joins, projections and checks.


@query("""with q as (select distinct query_id from predictions where query_id is not null), page as (select page_id, min(document_id) as document_id from pages where page_id is not null group by page_id), topics as (select document_id, min(topic_id) as topic_id from documents where document_id is not null and topic_id is not null group by document_id),
g as (select query_id, r.answer_page_id as answer_page_id, r.level as level, nullif(r.topic_id, '') as topic_id from (select query_id, min(struct_pack(answer_page_id := answer_page_id, level := level, topic_id := coalesce(topic_id, ''))) as r from annotations where query_id is not null group by query_id))
select coalesce(q.query_id, g.query_id) as query_id, g.answer_page_id as gold_page_id, g.level as level, coalesce(g.topic_id, t.topic_id) as topic_id, case when g.query_id is null then 'no annotation' when q.query_id is null then 'unknown query' when coalesce(trim(g.answer_page_id), '') = '' then 'no answer' when g.topic_id != t.topic_id then 'topic mismatch' else '' end as error
from q full join g on q.query_id = g.query_id left join page p on p.page_id = g.answer_page_id left join topics t on t.document_id = p.document_id""")
def strict_topic_join(spark, d):
    """Queries and annotations one to one, the topic checked against and filled up from the answer page's document."""
    q = t(spark, d, "predictions").where("query_id is not null").select("query_id").distinct().withColumn("asked", F.lit(True))
    g = E.one_annotation(t(spark, d, "annotations")).select("query_id", "answer_page_id", "level", F.nullif("topic_id", F.lit("")).alias("own"), F.lit(True).alias("annotated"))
    page = t(spark, d, "pages").where("page_id is not null").groupBy(F.col("page_id").alias("answer_page_id")).agg(F.min("document_id").alias("document_id"))
    topics = t(spark, d, "documents").where("document_id is not null and topic_id is not null").groupBy("document_id").agg(F.min("topic_id").alias("other"))
    j = q.join(g, "query_id", "full_outer").join(page, "answer_page_id", "left").join(topics, "document_id", "left")
    error = P.first_error((F.col("annotated").isNull(), "no annotation"), (F.col("asked").isNull(), "unknown query"), (F.coalesce(F.trim("answer_page_id"), F.lit("")) == "", "no answer"), (F.col("own") != F.col("other"), "topic mismatch"))
    return j.select("query_id", F.col("answer_page_id").alias("gold_page_id"), "level", F.coalesce("own", "other").alias("topic_id"), error.alias("error"))


@query("select document_id, page_id, page_index, row_number() over (partition by document_id order by page_index, page_id) as position from (select distinct document_id, page_id, page_index from pages where document_id is not null and page_id is not null and page_index is not null)")
def document_pages(spark, d):
    """Each document's pages in order, numbered; documents of any size are cut by page number."""
    p = t(spark, d, "pages").where("document_id is not null and page_id is not null and page_index is not null").select("document_id", "page_id", "page_index").distinct()
    return O.positions(p, ["document_id"], F.floor(F.col("page_index") / 1000), [F.col("page_index"), F.col("page_id")]).withColumn("position", F.col("position").cast("bigint"))


@query("select cache_seq, coalesce(nullif(trim(page_id), ''), printf('row_%08d', cache_seq)) as row_id, printf('page_%09d', page_index) as padded, coalesce(nullif(document_id, ''), nullif(ocr_engine, ''), '') as first_name, case when contains(coalesce(page_id, ''), '_p') then page_id else coalesce(image_sha256, '') end as gold_id from ocr_cache")
def id_fallbacks(spark, d):
    """Ids as they are, or made from the row's number; the first truthy of several names."""
    c = t(spark, d, "ocr_cache")
    return c.select("cache_seq", X.truthy(F.trim("page_id"), F.format_string("row_%08d", "cache_seq")).alias("row_id"), F.when(F.col("page_index").isNotNull(), F.format_string("page_%09d", "page_index")).alias("padded"),
                    F.coalesce(X.truthy(F.col("document_id"), F.col("ocr_engine")), F.lit("")).alias("first_name"), F.when(F.coalesce("page_id", F.lit("")).contains("_p"), F.col("page_id")).otherwise(F.coalesce("image_sha256", F.lit(""))).alias("gold_id"))


@query(r"""select distinct page_id, regexp_replace(trim(image_path), '/+$', '') as bare, case when regexp_replace(trim(image_path), '/+$', '') like '%.png' then regexp_replace(trim(image_path), '/+$', '') else regexp_replace(trim(image_path), '/+$', '') || '.png' end as url from pages where image_path is not null""")
def normalised_urls(spark, d):
    p = t(spark, d, "pages").where("image_path is not null")
    return p.select("page_id", P.normalised_url(F.col("image_path")).alias("bare"), P.normalised_url(F.col("image_path"), ".png").alias("url")).distinct()


@query(r"""select output_id, coalesce(regexp_matches(lower(coalesce(raw_response, '')), '"(finish_reason|stop_reason|code|type)"\s*:\s*"\s*(blocked|content_filter|content_filtered|refusal|safety)\s*"') or regexp_matches(lower(coalesce(raw_response, '')), 'content_filter|content filtering policy'), false) as filtered,
event_type in ('provider_error', 'transport_failure') as retryable, replace(substr(coalesce(raw_response, ''), 1, 1000), chr(10), '\n') as preview from (select distinct output_id, event_type, raw_response from model_outputs where output_id is not null)""")
def reply_signals(spark, d):
    m = t(spark, d, "model_outputs").where("output_id is not null").select("output_id", "event_type", "raw_response").distinct()
    return m.select("output_id", P.content_filtered(F.col("raw_response")).alias("filtered"), F.col("event_type").isin("provider_error", "transport_failure").alias("retryable"), P.body_preview(F.col("raw_response")).alias("preview"))


@query("""with s as (select query_id, min(level) as level, min(support_page_ids) as ids from (select distinct query_id, level, support_page_ids from annotations where query_id is not null and len(support_page_ids) > 0) group by query_id),
long as (select query_id, unnest(ids) as page_id from s), per as (select query_id, count(*) as n, count(m.page_handle) as n_known from long left join (select page_id, min(page_handle) as page_handle from handle_mapping group by page_id) m using (page_id) group by query_id)
select s.query_id, s.level, n as n_support, n = level - 1 as complete, n_known = n as loadable from s join per using (query_id)""")
def support_events(spark, d):
    """The pages shown before a query's first turn: whether they are all its level asks for and all known. They cost no calls."""
    s = t(spark, d, "annotations").where("query_id is not null and size(support_page_ids) > 0").groupBy("query_id").agg(F.min("level").alias("level"), F.min("support_page_ids").alias("ids"))
    handles = t(spark, d, "handle_mapping").groupBy("page_id").agg(F.min("page_handle").alias("page_handle"))
    per = s.select("query_id", F.explode("ids").alias("page_id")).join(handles, "page_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("page_handle").alias("n_known"))
    return s.join(per, "query_id").select("query_id", "level", F.col("n").alias("n_support"), (F.col("n") == F.col("level") - 1).alias("complete"), (F.col("n_known") == F.col("n")).alias("loadable"))


def shuffled(query_id: str, ids: list[str], seed: int) -> list[str]:
    """The ids in the order that a generator seeded by the query's hash gives."""
    import hashlib
    import random

    out = list(ids)
    random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{query_id}".encode()).digest()[:8], "big")).shuffle(out)
    return out


@query()
def support_order(spark, d):
    """query_id, visible: the support pages in their seeded order (a list has at most a few ids)."""
    s = t(spark, d, "annotations").where("query_id is not null and size(support_page_ids) > 0").groupBy("query_id").agg(F.min("support_page_ids").alias("ids"))

    @F.pandas_udf("array<string>")
    def order(q: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([shuffled(a, b, 17) for a, b in zip(q, ids)])

    return s.select("query_id", order("query_id", "ids").alias("visible"))


@query("select output_id, array_to_string(list_filter(['gold', 'support', 'first hop', 'second hop', 'path order'], lambda w: contains(lower(coalesce(r, '')), w)), ',') as leaked from (select output_id, min_by(raw_response, logged_at) as r from model_outputs where output_id is not null group by output_id)")
def leak_check(spark, d):
    """Words that must not be in what a model sees."""
    m = O.first_wins(t(spark, d, "model_outputs").where("output_id is not null").select("output_id", "raw_response", "logged_at"), ["output_id"], F.col("logged_at"))
    low = F.lower(F.coalesce("raw_response", F.lit("")))
    return m.select("output_id", F.array_join(F.filter(F.array(*[F.lit(w) for w in ("gold", "support", "first hop", "second hop", "path order")]), lambda w: F.contains(low, w)), ",").alias("leaked"))


@query("with n as (select level, count(distinct query_id) as n from annotations where level in (1, 2, 3) group by level), e as (select unnest([1, 2, 3]) as level, (select count(distinct query_id) // 3 from annotations where level in (1, 2, 3)) as expected) select cast(e.level as int) as level, coalesce(n, 0) as n, expected, coalesce(n, 0) = expected as equal from e left join n on n.level = e.level")
def level_distribution_check(spark, d):
    """Queries per level against an even distribution."""
    a = t(spark, d, "annotations").where("level in (1, 2, 3)")
    n = a.groupBy("level").agg(F.countDistinct("query_id").alias("n"))
    e = a.agg(F.floor(F.countDistinct("query_id") / 3).alias("expected")).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level"), "expected")
    return e.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("equal"))


@query(TURNS + REPLIES + " select query_id, row_number() over (partition by query_id order by logged_at, output_id) as position, output_id, coalesce(json_extract_string(obj, '$.action'), '') as tool, coalesce(json_extract(obj, '$.arguments') is not null, false) as has_arguments, json_extract_string(obj, '$.action') is null as unnamed from replies")
def trace_observations(spark, d):
    """The turns of a query as tool calls in order."""
    r = T.numbered(materialize(_replies(spark, d).select("query_id", *T.ORDER, F.get_json_object("obj", "$.action").alias("tool"), F.get_json_object("obj", "$.arguments").isNotNull().alias("has_arguments"))))
    return r.select("query_id", F.col("position").cast("bigint").alias("position"), "output_id", F.coalesce("tool", F.lit("")).alias("tool"), "has_arguments", F.col("tool").isNull().alias("unnamed"))


@query("with p as (select page_id, row_number() over (order by page_id) as position from (select distinct page_id from pages where page_id is not null)), c as (select page_id, max_by(coalesce(text_words, -1), cache_seq) as words from ocr_cache where page_id is not null group by page_id) select position, page_id, words from p join c using (page_id)")
def input_order(spark, d):
    """Cached rows in the manifest's order; pages without a row are skipped."""
    p = O.global_positions(t(spark, d, "pages").where("page_id is not null").select("page_id").distinct(), ["page_id"])
    c = t(spark, d, "ocr_cache").where("page_id is not null").groupBy("page_id").agg(F.max_by(F.coalesce("text_words", F.lit(-1)), "cache_seq").alias("words"))
    return p.join(c, "page_id").select("position", "page_id", "words")


LIMIT = 100


@query(STATE + f", p as (select page_id, row_number() over (order by page_id) as position from state where state in ('pending', 'failed', 'stale')) select position, page_id from p where position <= {LIMIT}")
def pending_batch(spark, d):
    """The pages that a run limited to LIMIT pages works on (the limit is the feature)."""
    lost = _state(spark, d).where("state in ('pending', 'failed', 'stale')").select("page_id")
    top = lost.orderBy("page_id").limit(LIMIT)
    return top.withColumn("position", F.row_number().over(Window.orderBy("page_id")).cast("bigint"))  # LIMIT rows


@query(STATE + f"""select count(*) filter (state != 'orphan') as manifest_pages, count(*) filter (state = 'reused') as reused, count(*) filter (state in ('failed', 'stale')) as invalidated, count(*) filter (state in ('pending', 'failed', 'stale')) as to_do,
least({LIMIT}, count(*) filter (state in ('pending', 'failed', 'stale'))) as processing, greatest(0, count(*) filter (state in ('pending', 'failed', 'stale')) - {LIMIT}) as deferred, count(*) filter (state in ('pending', 'failed', 'stale')) = 0 as complete from state""")
def cache_counters(spark, d):
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    todo = n("pending", "failed", "stale")
    return _state(spark, d).agg(F.count_if(F.col("state") != "orphan").alias("manifest_pages"), n("reused").alias("reused"), n("failed", "stale").alias("invalidated"), todo.alias("to_do"),
                                F.least(F.lit(LIMIT), todo).alias("processing"), F.greatest(F.lit(0), todo - LIMIT).alias("deferred"), (todo == 0).alias("complete"))


@query("""with e as (select *, len(embedding) as width from embeddings), w as (select width from e group by width order by count(*) desc, width desc limit 1)
select 'null id' as rule, '' as key from e where vec_id is null union all select 'repeated id', cast(vec_id as varchar) from e where vec_id is not null group by vec_id having count(*) > 1 union all select 'no vector', coalesce(cast(vec_id as varchar), '') from e where embedding is null
union all select 'other width', coalesce(cast(vec_id as varchar), '') from e where width != (select width from w) union all select 'in no page', cast(vec_id as varchar) from e where vec_id not in (select cast(substr(page_handle, 6) as bigint) from handle_mapping where page_handle is not null)""")
def embedding_checks(spark, d):
    e = t(spark, d, "embeddings").withColumn("width", F.size("embedding"))
    top = e.where("embedding is not null").groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    key = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    numbers = t(spark, d, "handle_mapping").select(F.substring("page_handle", 6, 20).cast("bigint").alias("vec_id"))
    return C.all_of(C.violations(e, "null id", key, F.col("vec_id").isNull()), C.duplicates(e, "repeated id", "vec_id"), C.violations(e, "no vector", key, F.col("embedding").isNull()),
                    C.violations(e, "other width", key, F.col("embedding").isNotNull() & (F.col("width") != F.lit(top[0][0] if top else 0))), C.missing(e, numbers, "in no page", "vec_id")).select("rule", "key")


@query("select 'pages' as a, 'handle_mapping' as b, (select count(*) from (select page_id from pages where page_id is not null except select page_id from handle_mapping)) as only_a, (select count(*) from (select page_id from handle_mapping where page_id is not null except select page_id from pages)) as only_b"
       " union all select 'pages', 'ocr_cache', (select count(*) from (select page_id from pages where page_id is not null except select page_id from ocr_cache)), (select count(*) from (select page_id from ocr_cache where page_id is not null except select page_id from pages))")
def key_sets(spark, d):
    """Whether two tables have the same pages: the number of keys that only one has."""
    ids = lambda n: t(spark, d, n).where("page_id is not null").select("page_id").distinct()

    def compared(b):
        both = ids("pages").withColumn("a", F.lit(1)).join(ids(b).withColumn("b", F.lit(1)), "page_id", "full_outer")
        return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")).select(F.lit("pages").alias("a"), F.lit(b).alias("b"), "only_a", "only_b")

    return compared("handle_mapping").unionByName(compared("ocr_cache"))


@query(SEEN + """, shown as (select distinct query_id, unnest(a.evidence_page_handles) as handle from (select query_id, unnest(ranked_answers) as a from predictions where query_id is not null)), u as (select query_id, handle, 1 as d, 0 as s from named union all select query_id, handle, 0, 1 from shown where handle is not null),
per as (select query_id, handle, max(d) as d, max(s) as s from u group by query_id, handle) select query_id, count(*) as n_union, count(*) filter (d = 1) as n_discovered, count(*) filter (s = 1) as n_seen, count(*) filter (d = 1 and s = 1) as n_both from per group by query_id""")
def handle_union(spark, d):
    """Handles discovered in turns or used as evidence, per query."""
    named = T.handles_seen(_turns(spark, d)).select("query_id", "handle", F.lit(1).alias("d"), F.lit(0).alias("s"))
    shown = t(spark, d, "predictions").where("query_id is not null").select("query_id", F.explode("ranked_answers").alias("a")).select("query_id", F.explode("a.evidence_page_handles").alias("handle")).where("handle is not null")
    per = named.unionByName(shown.withColumns({"d": F.lit(0), "s": F.lit(1)})).groupBy("query_id", "handle").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    return per.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("d") == 1).alias("n_discovered"), F.count_if(F.col("s") == 1).alias("n_seen"), F.count_if((F.col("d") == 1) & (F.col("s") == 1)).alias("n_both"))


@query("with complete as (select document_id, bool_and(coalesce(image_included, false)) as complete from pages where document_id is not null group by document_id) select distinct page_id, coalesce(c.complete, false) as complete, image_path is null as no_path from pages p left join complete c using (document_id) where page_id is not null and (coalesce(c.complete, false) or coalesce(image_included, false))")
def required_files(spark, d):
    """Pages whose image must be there: those included, and all of complete documents."""
    p = t(spark, d, "pages")
    complete = p.where("document_id is not null").groupBy("document_id").agg(F.bool_and(F.coalesce("image_included", F.lit(False))).alias("complete"))
    j = p.where("page_id is not null").join(complete, "document_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return j.where(F.col("complete") | F.coalesce("image_included", F.lit(False))).select("page_id", "complete", F.col("image_path").isNull().alias("no_path")).distinct()


@query(SEEN + ", per as (select query_id, logged_at, output_id, regexp_extract_all(coalesce(raw_response, ''), 'page_[0-9]+') as h from turns), last as (select query_id, max_by(h, struct_pack(logged_at := logged_at, output_id := output_id)) as h from per where len(h) > 0 group by query_id) select query_id, len(h) as n_named, array_to_string(h[greatest(1, len(h) - 9):], ',') as tail from last")
def visible_tail(spark, d):
    """The last ten handles of the last turn of a query that named any."""
    h = F.regexp_extract_all(F.coalesce("raw_response", F.lit("")), F.lit(T.HANDLE), 1)
    last = _turns(spark, d).select("query_id", *T.ORDER, h.alias("h")).where(F.size("h") > 0).groupBy("query_id").agg(F.max_by("h", F.struct(*T.ORDER)).alias("h"))
    return last.select("query_id", F.size("h").cast("bigint").alias("n_named"), F.array_join(F.slice("h", F.greatest(F.lit(1), F.size("h") - 9), F.lit(10)), ",").alias("tail"))


@query("""with g as (select query_id, r.* from (select query_id, min(struct_pack(answer_page_id := answer_page_id, level := level, topic_id := coalesce(topic_id, ''))) as r from annotations where query_id is not null group by query_id)), r as (select distinct run_name, action from predictions where run_name is not null and action is not null)
select run_name, query_id, action, sha256(concat_ws(chr(10), 'v1', run_name, action, query_id, coalesce(answer_page_id, ''), coalesce(cast(level as varchar), ''), topic_id, '12', '17')) as fingerprint from g cross join r""")
def episode_fingerprints(spark, d):
    """One fingerprint per query and configuration (the handful of run names and actions)."""
    g = E.one_annotation(t(spark, d, "annotations"))
    configurations = t(spark, d, "predictions").where("run_name is not null and action is not null").select("run_name", "action").distinct().collect()  # one row per configuration of the harness
    rows = g.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("run_name"), F.lit(r[1]).alias("action")) for r in configurations]).cast("array<struct<run_name: string, action: string>>"))).select("c.*", *g.columns)
    return rows.select("run_name", "query_id", "action", X.fingerprint(F.lit("v1"), F.col("run_name"), F.col("action"), F.col("query_id"), F.col("answer_page_id"), F.col("level"), F.col("topic_id"), F.lit("12"), F.lit("17")).alias("fingerprint"))


@query("with p as (select page_id, min(document_id) as document_id, min(page_index) as page_index, min(image_path) as image_path from pages where page_id is not null group by page_id), x as (select page_id, max_by(coalesce(ocr_text, ''), cache_seq) as text from ocr_cache where ocr_ok and page_id is not null group by page_id) "
       "select h.page_handle, p.page_id, p.document_id, p.page_index, length(x.text) as chars, sha256(x.text) as text_sha256, list_sum(e.embedding::double[]) is not null as embedded from p join handle_mapping h using (page_id) join x using (page_id) left join embeddings e on e.vec_id = cast(substr(h.page_handle, 6) as bigint)")
def prepared_corpus(spark, d):
    """The pages with text as a corpus in handle order: ids, text identity and whether there is a vector."""
    p = t(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("document_id").alias("document_id"), F.min("page_index").alias("page_index"))
    x = t(spark, d, "ocr_cache").where("ocr_ok and page_id is not null").groupBy("page_id").agg(F.max_by(F.coalesce("ocr_text", F.lit("")), "cache_seq").alias("text"))
    h = t(spark, d, "handle_mapping").select("page_handle", "page_id", F.substring("page_handle", 6, 20).cast("bigint").alias("vec_id"))
    e = t(spark, d, "embeddings").select("vec_id", F.lit(True).alias("e"))
    return p.join(h, "page_id").join(x, "page_id").join(e, "vec_id", "left").select("page_handle", "page_id", "document_id", "page_index", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_sha256"), F.col("e").isNotNull().alias("embedded"))


@query("select distinct query_id from annotations where query_id is not null and query_id not in (select query_id from predictions where query_id is not null and generated_at is not null)")
def first_stage_coverage(spark, d):
    """Annotated queries without any ranking."""
    have = t(spark, d, "predictions").where("query_id is not null and generated_at is not null").select("query_id")
    return t(spark, d, "annotations").where("query_id is not null").select("query_id").distinct().join(have, "query_id", "left_anti")


@query(r"with files as (select distinct regexp_extract(image_path, '([^/\\]+)$', 1) as name from pages where coalesce(image_included, false) and image_path is not null), p as (select page_id, min(image_path) as image_path from pages where page_id is not null group by page_id), c as (select page_id, unnest([regexp_extract(image_path, '([^/\\]+)$', 1), page_id || '.png', page_id || '.jpg', page_id || '.webp']) as name, unnest([1, 2, 3, 4]) as priority from p) "
       "select p.page_id, min_by(f.name, priority) as file, regexp_replace(p.page_id, '_p[^_]*$', '') as document from p left join (select c.* from c join files using (name)) f using (page_id) group by p.page_id")
def image_files(spark, d):
    """The first of four candidate names of a page's image that is among the files; the document from the page's id."""
    name = F.regexp_extract("image_path", r"([^/\\]+)$", 1)
    files = t(spark, d, "pages").where("coalesce(image_included, false) and image_path is not null").select(name.alias("name")).distinct()
    p = t(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("image_path").alias("image_path"))
    c = p.select("page_id", F.posexplode(F.array(name, *[F.concat("page_id", F.lit(x)) for x in (".png", ".jpg", ".webp")])).alias("priority", "name"))
    found = c.join(files, "name").groupBy("page_id").agg(F.min_by("name", "priority").alias("file"))
    return p.select("page_id").join(found, "page_id", "left").select("page_id", "file", F.regexp_replace("page_id", r"_p[^_]*$", "").alias("document"))


@query(TURNS + " select provider, sum(coalesce(nullif(output_tokens, 0), len(regexp_split_to_array(trim(coalesce(raw_response, '')), '\\s+'))))::bigint as tokens from turns group by provider".replace("\\\\", "\\"))
def tokens_with_fallback(spark, d):
    """Output tokens, or the reply's words where the provider reports none."""
    words = F.size(F.split(F.trim(F.coalesce("raw_response", F.lit(""))), r"\s+"))
    return _turns(spark, d).groupBy("provider").agg(F.sum(F.coalesce(F.nullif("output_tokens", F.lit(0)), words)).alias("tokens"))


@query("""with conf as (select ocr_config_sha256 as c from ocr_cache where ocr_config_sha256 is not null group by 1 order by count(*) desc, 1 limit 1),
e as (select page_id, max_by(struct_pack(seq := cache_seq, f := sha256(concat_ws(chr(10), coalesce(image_sha256, ''), coalesce(ocr_config_sha256, '')))), cache_seq) as r from ocr_cache where page_id is not null group by page_id),
n as (select page_id, sha256(concat_ws(chr(10), coalesce(max_by(image_sha256, cached_at) filter (image_sha256 is not null), ''), coalesce((select c from conf), ''))) as f from ocr_cache where page_id is not null group by page_id)
select e.page_id, r.seq as cache_seq from e join n on n.page_id = e.page_id and n.f = r.f""")
def fingerprint_reuse(spark, d):
    """Cached rows whose input and configuration are still the current ones."""
    c = t(spark, d, "ocr_cache").where("page_id is not null")
    e = O.last_wins(c.select("page_id", "cache_seq", X.fingerprint(F.col("image_sha256"), F.col("ocr_config_sha256")).alias("fingerprint")), ["page_id"], F.col("cache_seq"))
    now = c.groupBy("page_id").agg(F.max_by("image_sha256", F.when(F.col("image_sha256").isNotNull(), F.col("cached_at"))).alias("image"))
    now = now.select("page_id", X.fingerprint(F.col("image"), F.lit(caching.commonest(c, "ocr_config_sha256"))).alias("fingerprint"))
    return caching.matching(e, now, "page_id", "fingerprint").select("page_id", "cache_seq")


@query(f"""with i as (select page_id as id, row_number() over (order by page_id) as position, h from (select page_id, sha256(coalesce(max_by(coalesce(ocr_text, ''), cache_seq), '')) as h from ocr_cache where page_id is not null group by page_id)),
v as (select o.page_id as id, sha256(coalesce(min_by(coalesce(ocr_text, ''), cache_seq), '')) as h from ocr_cache o join handle_mapping m on m.page_id = o.page_id join embeddings e on e.vec_id = cast(substr(m.page_handle, 6) as bigint) group by o.page_id),
j as (select i.*, v.id is not null as cached, coalesce(i.h = v.h, false) as kept from i left join v using (id)), last as (select max(position) as last from (select position from j where not kept order by position limit {LIMIT}))
select position, id, case when kept then 'reuse' when position > (select last from last) then 'deferred' when cached then 'invalidate' else 'embed' end as state from j""")
def embedding_cache_plan(spark, d):
    """What a run limited to LIMIT texts does with the cached vectors: pages have a vector of their first text, the input is their last."""
    c = t(spark, d, "ocr_cache").where("page_id is not null").select("page_id", "cache_seq", F.coalesce("ocr_text", F.lit("")).alias("text"))
    sides = c.groupBy(F.col("page_id").alias("id")).agg(F.sha2(F.min_by("text", "cache_seq"), 256).alias("first"), F.sha2(F.max_by("text", "cache_seq"), 256).alias("input_hash"))
    sides = materialize(O.global_positions(materialize(sides), ["id"], "position"))
    have = t(spark, d, "embeddings").select("vec_id").join(t(spark, d, "handle_mapping").select("page_id", F.substring("page_handle", 6, 20).cast("bigint").alias("vec_id")), "vec_id")
    vectors = sides.join(have.select(F.col("page_id").alias("id")).distinct(), "id", "left_semi").select("id", F.col("first").alias("input_hash"))
    return caching.vector_states(sides.select("position", "id", "input_hash"), vectors, LIMIT)


@query(SUBS + """, conf as (select action as expected from predictions where action is not null group by 1 order by count(*) desc, 1 limit 1), p as (select prediction_id, any_value(action) as action from predictions group by prediction_id),
stored as (select run_name, query_id, status, sha256(concat_ws(chr(10), coalesce(run_name, ''), query_id, coalesce(action, ''))) as f from (select run_name, query_id, status, pid from (select run_name, query_id, r.status as status, r.pid as pid from (select run_name, query_id, max_by(struct_pack(status := status, pid := prediction_id), struct_pack(g := generated_at, p := prediction_id)) as r from known group by run_name, query_id))) s join p on p.prediction_id = s.pid)
select run_name, query_id from stored join gold using (query_id) where status = 'submitted' and f = sha256(concat_ws(chr(10), coalesce(run_name, ''), query_id, (select expected from conf)))""")
def resume_results(spark, d):
    """Stored results per run and query that a further run needn't compute: submitted, with the fingerprint it would have."""
    p = t(spark, d, "predictions")
    known = p.where("query_id is not null and generated_at is not null")
    last = known.groupBy("run_name", "query_id").agg(F.max_by(F.struct("status", "action"), F.struct("generated_at", "prediction_id")).alias("r")).where("r.status = 'submitted'")
    stored = last.select("run_name", "query_id", X.fingerprint(F.col("run_name"), F.col("query_id"), F.col("r.action")).alias("fingerprint"))
    asked = stored.select("run_name", "query_id").join(E.one_annotation(t(spark, d, "annotations")).select("query_id"), "query_id", "left_semi")
    current = asked.withColumn("fingerprint", X.fingerprint(F.col("run_name"), F.col("query_id"), F.lit(caching.commonest(p, "action"))))
    return caching.matching(stored, current, "run_name", "query_id", "fingerprint").select("run_name", "query_id")


@query(TURNS + """ select output_id, step, case when response_accepted then 'accepted' when event_type = 'format_error' then 'rejected: format' when event_type = 'provider_error' then 'rejected: provider' when event_type = 'transport_failure' then 'not delivered' else 'rejected' end as outcome,
case when response_accepted then length(raw_response) else 0 end as shown_chars, coalesce(len(request_attempts), 0) as n_attempts from turns""")
def public_replies(spark, d):
    """What a turn shows to others: its outcome, and its text only if it was accepted."""
    e = F.col("event_type")
    outcome = F.when(F.col("response_accepted"), "accepted").when(e == "format_error", "rejected: format").when(e == "provider_error", "rejected: provider").when(e == "transport_failure", "not delivered").otherwise("rejected")
    return _turns(spark, d).select("output_id", "step", outcome.alias("outcome"), F.when(F.col("response_accepted"), F.length("raw_response")).otherwise(0).cast("bigint").alias("shown_chars"), F.coalesce(F.size("request_attempts"), F.lit(0)).cast("bigint").alias("n_attempts"))


@query(TURNS + REPLIES + """, b as (select output_id, trim(coalesce(nullif(json_extract_string(obj, '$.rationale'), ''), nullif(json_extract_string(obj, '$.note'), ''), nullif(json_extract_string(obj, '$.overall_rationale'), ''))) as text from replies where obj is not null)
select output_id, case when coalesce(text, '') = '' then 0 else 1 end as n_blocks, coalesce(text, '') as text from b""")
def reply_blocks(spark, d):
    """The reasons given anywhere inside a reply's object, as blocks put together."""
    b = _replies(spark, d).where("obj is not null").select("output_id", B.text_blocks(F.col("obj"), ("rationale", "note", "overall_rationale")).alias("b"))
    return b.select("output_id", F.size("b").alias("n_blocks"), B.assembled(F.col("b")).alias("text"))
