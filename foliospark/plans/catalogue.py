"""Registered queries over the project's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X, vectors as V
from ..operators import caching, evaluation as E, ordering as O, retrieval as R, traces as T, validation as C
from ..session import materialize, table as t
from ..streaming.cache_stream import stream_latest
from .registry import QUERIES as _QUERIES, SQL as _SQL, query

def queries() -> dict:
    from . import protocol  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import protocol  # noqa: F401

    return dict(_SQL)


# Vectors: the query set is every row whose id is divisible by 20, against all rows.

COS = """
with unit as (select vec_id, label, list_transform(embedding::double[], lambda x: x / case when n = 0 then 1.0 else n end) as v
              from (select *, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)),
scores as (select q.vec_id as qid, d.vec_id as id, round(list_inner_product(q.v, d.v), 9) as score from unit q, unit d where q.vec_id % 20 = 0)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(COS + "select qid, id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by qid order by score desc, id) as int) as rank from scores) where rank <= 10")
def dense_topk(spark, d):
    q, c = _vectors(spark, d)
    return R.dense_topk(q, c, 10).withColumn("score", F.round("score", 6))


@query(COS + """, gold as (select s.* from scores s where s.id = s.qid + 1)
select g.qid, g.id as gold_id, (select count(*) + 1 from scores s where s.qid = g.qid and (s.score > g.score or (s.score = g.score and s.id < g.id))) as gold_rank from gold g
union all select vec_id as qid, vec_id + 1 as gold_id, null as gold_rank from embeddings where vec_id % 20 = 0 and vec_id + 1 not in (select vec_id from embeddings)""")
def dense_gold_rank(spark, d):
    q, c = _vectors(spark, d)
    return R.gold_ranks(q.withColumn("gold_id", F.col("qid") + 1), c)


@query("select vec_id, round(n, 6) as norm, round(sqrt(list_inner_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))), 6) as unit_norm from (select vec_id, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)")
def l2_normalize(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(V.l2_normalize(F.col("embedding"))), 6).alias("unit_norm"))


MANY = "with vecs as (select vec_id // 4 as page, vec_id, embedding::double[] as v from embeddings)"


@query(MANY + """, best as (select q.page as qid, q.vec_id, p.page as id, max(list_inner_product(q.v, p.v)) as s from vecs q, vecs p where q.page % 20 = 0 group by q.page, q.vec_id, p.page),
total as (select qid, id, round(sum(s), 9) as score from best group by qid, id)
select qid, id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by qid order by score desc, id) as int) as rank from total) where rank <= 10""")
def maxsim_topk(spark, d):
    e = t(spark, d, "embeddings").withColumn("page", F.floor(F.col("vec_id") / 4))
    pages = e.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).select(F.col("page").alias("id"), F.col("v.embedding").alias("vecs"))  # four vectors a page
    pages = materialize(pages)
    return R.maxsim_topk(pages.where("id % 20 = 0").withColumnRenamed("id", "qid"), pages, 10).withColumn("score", F.round("score", 6))


# Sparse retrieval: pages are the last cached row per page, queries the search turns whose id is divisible by 20.

LATEST = "with pages_text as (select page_id, coalesce(max_by(coalesce(ocr_text, ''), cache_seq), '') as text from ocr_cache where page_id is not null group by page_id)"
TOKENS = LATEST + r", tokens as (select page_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from pages_text), lengths as (select p.page_id, count(k.term) as dl from pages_text p left join tokens k on p.page_id = k.page_id group by p.page_id), stats as (select count(*) as n, avg(dl)::float::double as mean, sum(dl)::bigint as total from lengths)"
SEARCH = """, wanted as (select output_id as query_id, max(regexp_extract(raw_response, '"query": "([^"]*)"', 1)) as text from model_outputs where output_id % 20 = 0 and raw_response like '%"query": "%' group by output_id)"""


def _pages_text(spark, d) -> DataFrame:
    rows = t(spark, d, "ocr_cache").where("page_id is not null").select("page_id", "cache_seq", F.coalesce("ocr_text", F.lit("")).alias("text"))
    return materialize(O.last_wins(rows, ["page_id"], F.col("cache_seq")).select("page_id", "text"))


def _searches(spark, d, of: int = 20) -> DataFrame:
    m = t(spark, d, "model_outputs").where(F.col("raw_response").contains('"query": "') & (F.col("output_id") % of == 0))
    return m.groupBy(F.col("output_id").alias("query_id")).agg(F.max(F.regexp_extract("raw_response", r'"query": "([^"]*)"', 1)).alias("text"))


@query(TOKENS + " select p.page_id, dl as n_tokens, (select count(distinct term) from tokens k where k.page_id = p.page_id) as n_terms from lengths p")
def tokenize_counts(spark, d):
    tokens = X.tokenize(F.col("text"))
    return _pages_text(spark, d).select("page_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("n_terms"))


@query(TOKENS + " select n as n_pages, round(mean, 6) as mean_length, total as total_tokens from stats")
def bm25_corpus_stats(spark, d):
    return R.corpus_stats(_pages_text(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


@query(TOKENS + " select term, count(distinct page_id) as df, round(ln(1 + (n - count(distinct page_id) + 0.5) / (count(distinct page_id) + 0.5)), 6) as idf from tokens, stats group by term, n")
def bm25_idf(spark, d):
    pages = _pages_text(spark, d)
    return R.document_frequencies(pages).withColumn("idf", F.round(R.idf(F.col("df"), F.lit(pages.count())), 6))


@query(TOKENS + SEARCH + r""", wt as (select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from wanted) group by query_id, term),
tf as (select page_id, term, count(*) as tf from tokens group by page_id, term), df as (select term, count(*) as df from tf group by term),
hits as (select query_id, tf.page_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) as score
         from wt join tf using (term) join df using (term) join lengths l on l.page_id = tf.page_id, stats group by query_id, tf.page_id),
every as (select w.query_id, p.page_id, coalesce(score, 0.0) as score from wanted w cross join pages_text p left join hits h on h.query_id = w.query_id and h.page_id = p.page_id)
select query_id, page_id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, page_id) as int) as rank from every) where rank <= 10""")
def bm25_topk(spark, d):
    return R.bm25_topk(materialize(_searches(spark, d)), _pages_text(spark, d), 10).select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")


# Submissions and their evaluation.

SUBS = """
with known as (select distinct prediction_id, run_name, query_id, status, generated_at, ranked_answers from predictions where query_id is not null and generated_at is not null),
latest as (select * exclude (rn) from (select *, row_number() over (partition by run_name, query_id order by generated_at desc, prediction_id desc) as rn from known) where rn = 1),
answers as (select run_name, query_id, status, unnest(ranked_answers) as a, generate_subscripts(ranked_answers, 1) as pos from latest),
ranks as (select run_name, query_id, status, m.page_id, row_number() over (partition by run_name, query_id order by case when isfinite(a.relevance_score) then a.relevance_score end desc nulls last, pos) as place
          from answers join handle_mapping m on m.page_handle = a.page_handle),
gold as (select query_id, r.answer_page_id, r.level, r.topic_id from (select query_id, min(struct_pack(answer_page_id := answer_page_id, level := level, topic_id := coalesce(topic_id, ''))) as r from annotations where query_id is not null group by query_id)),
lists as (select run_name, k.query_id, count(*) as n, count(distinct k.page_id) as nd, count(c.page_id) as nk, max(status) as status, min(case when k.page_id = g.answer_page_id then place end) as hit
          from ranks k join gold g using (query_id) left join (select distinct page_id from pages) c on c.page_id = k.page_id where place <= 10 group by run_name, k.query_id),
scored as (select u.run_name, g.query_id, g.level, g.topic_id, coalesce(n = 10 and nd = 10 and nk = 10, false) as valid, coalesce(status, 'submitted') as status, case when n = 10 and nd = 10 and nk = 10 then hit end as hit
           from gold g cross join (select distinct run_name from latest) u left join lists l on l.run_name = u.run_name and l.query_id = g.query_id)
"""
MEANS = ", ".join([f"round(SCALE * avg(case when hit <= {k} then 1.0 else 0.0 end), 6) as recall_at_{k}" for k in E.DEPTHS] + ["round(SCALE * avg(case when hit is not null then 1.0 / hit else 0.0 end), 6) as mrr_at_10"])
REPORT = SUBS + """select run_name, case when grouping(level) = 0 then 'level' when grouping(topic_id) = 0 then 'topic' else 'overall' end as part,
case when grouping(level) = 0 then coalesce(cast(level as varchar), '') when grouping(topic_id) = 0 then topic_id else '' end as key, count(*) as count, count(*) filter (valid) as valid_rankings, """ + MEANS.replace("SCALE", "100.0")


def _scored(spark, d, **more) -> DataFrame:
    return E.scored_queries(t(spark, d, "annotations"), materialize(E.latest_submissions(t(spark, d, "predictions"))), t(spark, d, "handle_mapping"), t(spark, d, "pages"), **more)


@query(REPORT + " from scored group by grouping sets ((run_name), (run_name, level), (run_name, topic_id))")
def eval_report(spark, d):
    return E.report(_scored(spark, d))


@query(REPORT + " from scored group by grouping sets ((run_name), (run_name, level), (run_name, topic_id)) having grouping(level) = 1 and grouping(topic_id) = 1")
def eval_overall(spark, d):
    return E.report(_scored(spark, d), (("run_name",),))


@query(REPORT + " from scored group by grouping sets ((run_name, level), (run_name, topic_id)) having grouping(level) = 0")
def eval_by_level(spark, d):
    return E.report(_scored(spark, d), (("run_name", "level"),))


@query(REPORT + " from scored group by grouping sets ((run_name, level), (run_name, topic_id)) having grouping(topic_id) = 0")
def eval_by_topic(spark, d):
    return E.report(_scored(spark, d), (("run_name", "topic_id"),))


@query(SUBS + "select run_name, count(*) as num_queries, count(*) filter (valid and status = 'submitted') as num_valid, " + MEANS.replace("SCALE", "1.0").replace("case when hit", "case when valid and status = 'submitted' and hit") + " from scored group by run_name")
def eval_static_fractions(spark, d):
    """Fractions instead of percent; a list also needs the status submitted."""
    r = E.report(_scored(spark, d, need_status=True), (("run_name",),), scale=1.0)
    return r.select("run_name", F.col("count").alias("num_queries"), F.col("valid_rankings").alias("num_valid"), *E.METRICS)


@query(SUBS + "select run_name, query_id, n < 10 as too_short, nd < n as repeated, nk < n as outside from lists where not (n = 10 and nd = 10 and nk = 10)")
def eval_invalid_lists(spark, d):
    ranks = E.ranked_pages(E.latest_submissions(t(spark, d, "predictions")), t(spark, d, "handle_mapping")).where("place <= 10")
    ranks = ranks.join(E.one_annotation(t(spark, d, "annotations")).select("query_id"), "query_id", "left_semi")
    corpus = t(spark, d, "pages").select("page_id").distinct().withColumn("known", F.lit(1))
    lists = ranks.join(corpus, "page_id", "left").groupBy("run_name", "query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("nd"), F.count("known").alias("nk"))
    return lists.where("not (n = 10 and nd = 10 and nk = 10)").select("run_name", "query_id", (F.col("n") < 10).alias("too_short"), (F.col("nd") < F.col("n")).alias("repeated"), (F.col("nk") < F.col("n")).alias("outside"))


@query(SUBS + "select run_name, query_id, place, page_id from ranks")
def eval_handle_mapping(spark, d):
    return E.ranked_pages(E.latest_submissions(t(spark, d, "predictions")), t(spark, d, "handle_mapping")).drop("status").withColumn("place", F.col("place").cast("bigint"))


FUSED = SUBS + """, fused as (select query_id, page_id, round(sum(1.0 / (60 + place)), 12) as score, min(place) as best_rank from ranks group by query_id, page_id),
first_stage as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, best_rank, page_id) as int) as rank from fused) where rank <= 30)
"""


def _fused(spark, d, k: int = 30) -> DataFrame:
    ranks = E.ranked_pages(E.latest_submissions(t(spark, d, "predictions")), t(spark, d, "handle_mapping"))
    return R.rrf(ranks.select("query_id", "page_id", F.col("place").alias("rank")), k)


@query(FUSED + "select query_id, page_id, round(score, 9) as score, cast(best_rank as bigint) as best_rank, rank from first_stage")
def rrf_fusion(spark, d):
    """The runs' rankings of a query fused."""
    return _fused(spark, d).select("query_id", "page_id", F.round("score", 9).alias("score"), F.col("best_rank").cast("bigint").alias("best_rank"), "rank")


@query(FUSED + """, hits as (select g.query_id, g.level, min(f.rank) as rank from gold g left join first_stage f on f.query_id = g.query_id and f.page_id = g.answer_page_id group by g.query_id, g.level)
select case when grouping(level) = 1 then '' else coalesce(cast(level as varchar), '') end as level, count(*) as n_queries, round(avg(case when rank <= 30 then 1.0 else 0.0 end), 6) as first_stage_recall_at_30,
round(avg(case when rank is not null then case when rank = 1 then 1.0 else 0.0 end end), 6) as recall_at_1_given_hit from hits group by grouping sets ((), (level))""")
def first_stage_extended(spark, d):
    gold = E.one_annotation(t(spark, d, "annotations"))
    hit = _fused(spark, d).select("query_id", F.col("page_id").alias("answer_page_id"), "rank")
    hits = gold.join(hit, ["query_id", "answer_page_id"], "left").select("level", "rank")
    grouped = hits.groupingSets([[], [F.col("level")]], "level")
    return grouped.agg(F.when(F.grouping("level") == 1, "").otherwise(F.coalesce(F.col("level").cast("string"), F.lit(""))).alias("level_key"), F.count(F.lit(1)).alias("n_queries"),
                       F.round(F.avg(F.coalesce((F.col("rank") <= 30).cast("double"), F.lit(0.0))), 6).alias("first_stage_recall_at_30"),
                       F.round(F.avg(F.when(F.col("rank").isNotNull(), (F.col("rank") == 1).cast("double"))), 6).alias("recall_at_1_given_hit")).drop("level").withColumnRenamed("level_key", "level")


@query(FUSED + ", text as (select page_id, max_by(coalesce(text_words, -1), cache_seq) as words from ocr_cache where ocr_ok and page_id is not null group by page_id), page as (select page_id, min(document_id) as document_id, min(page_index) as page_index from pages group by page_id) "
       "select f.query_id, f.rank, f.page_id, p.document_id, p.page_index, coalesce(x.words, -1) as words, cast((f.rank - 1) // 3 as bigint) as batch from first_stage f left join page p using (page_id) left join text x using (page_id)")
def candidate_enrichment(spark, d):
    """Thirty candidates a query with their page, text size and batch of three."""
    page = t(spark, d, "pages").groupBy("page_id").agg(F.min("document_id").alias("document_id"), F.min("page_index").alias("page_index"))
    words = t(spark, d, "ocr_cache").where("ocr_ok and page_id is not null").groupBy("page_id").agg(F.max_by(F.coalesce("text_words", F.lit(-1)), "cache_seq").alias("words"))
    return _fused(spark, d).join(page, "page_id", "left").join(words, "page_id", "left").select("query_id", "rank", "page_id", "document_id", "page_index", F.coalesce("words", F.lit(-1)).alias("words"), F.floor((F.col("rank") - 1) / 3).alias("batch"))


@query(FUSED + "select query_id, cast((rank - 1) // 3 as bigint) as batch, count(*) as n, string_agg(page_id, ',' order by rank) as page_ids from first_stage group by query_id, (rank - 1) // 3")
def fixed_batches(spark, d):
    b = _fused(spark, d).withColumn("batch", F.floor((F.col("rank") - 1) / 3))
    return b.groupBy("query_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"]), ",").alias("page_ids"))


# Joins and checks.


@query("""with a as (select distinct query_id from annotations where query_id is not null), p as (select distinct query_id from predictions where query_id is not null)
select coalesce(a.query_id, p.query_id) as query_id, case when a.query_id is null then 'not annotated' when p.query_id is null then 'not predicted' else 'both' end as side from a full join p on a.query_id = p.query_id""")
def strict_query_join(spark, d):
    a = t(spark, d, "annotations").where("query_id is not null").select("query_id").distinct().withColumn("a", F.lit(1))
    p = t(spark, d, "predictions").where("query_id is not null").select("query_id").distinct().withColumn("p", F.lit(1))
    return a.join(p, "query_id", "full_outer").select("query_id", F.when(F.col("a").isNull(), "not annotated").when(F.col("p").isNull(), "not predicted").otherwise("both").alias("side"))


@query("select distinct page_id from pages where page_id is not null except select page_id from ocr_cache")
def coverage_missing(spark, d):
    return t(spark, d, "pages").where("page_id is not null").select("page_id").distinct().join(t(spark, d, "ocr_cache").select("page_id"), "page_id", "left_anti")


@query("select distinct page_id from ocr_cache where page_id is not null except select page_id from pages")
def coverage_unexpected(spark, d):
    return t(spark, d, "ocr_cache").where("page_id is not null").select("page_id").distinct().join(t(spark, d, "pages").select("page_id"), "page_id", "left_anti")


@query("select page_id from (select page_id from pages where page_id is not null intersect select page_id from ocr_cache intersect select page_id from handle_mapping)")
def coverage_common(spark, d):
    ids = lambda n: t(spark, d, n).where("page_id is not null").select("page_id")
    return ids("pages").intersect(ids("ocr_cache")).intersect(ids("handle_mapping"))


@query("select distinct query_id, answer_page_id from annotations a where answer_page_id is not null and not exists (select 1 from pages p where p.page_id = a.answer_page_id)")
def gold_not_in_corpus(spark, d):
    pages = t(spark, d, "pages").select(F.col("page_id").alias("answer_page_id"))
    return t(spark, d, "annotations").where("answer_page_id is not null").select("query_id", "answer_page_id").distinct().join(pages, "answer_page_id", "left_anti").select("query_id", "answer_page_id")


@query("select 'pages' as tab, page_id as key, count(*) as n from pages where page_id is not null group by page_id having count(*) > 1 union all select 'predictions', cast(prediction_id as varchar), count(*) from predictions where prediction_id is not null group by prediction_id having count(*) > 1 union all select 'model_outputs', cast(output_id as varchar), count(*) from model_outputs where output_id is not null group by output_id having count(*) > 1")
def duplicate_keys(spark, d):
    found = [C.duplicates(t(spark, d, n), n, k) for n, k in (("pages", "page_id"), ("predictions", "prediction_id"), ("model_outputs", "output_id"))]
    return C.all_of(*found).select(F.col("rule").alias("tab"), "key", F.col("detail").cast("bigint").alias("n"))


RULES = """
with a as (select distinct * from annotations), s as (select *, coalesce(support_page_ids, []) as sup from a),
found as (
 select 'level_out_of_range' as rule, coalesce(query_id, '') as key from a where coalesce(level not in (1, 2, 3), true)
 union all select 'support_length', coalesce(query_id, '') from s where len(sup) != level - 1
 union all select 'support_repeats', coalesce(query_id, '') from s where len(sup) != len(list_distinct(sup))
 union all select 'answer_in_support', coalesce(query_id, '') from s where coalesce(list_contains(sup, answer_page_id), false)
 union all select distinct 'answer_not_in_corpus', answer_page_id from a where answer_page_id is not null and answer_page_id not in (select page_id from pages where page_id is not null)
 union all select distinct 'support_not_in_corpus', page_id from (select unnest(support_page_ids) as page_id from a) where page_id is not null and page_id not in (select page_id from pages where page_id is not null)
 union all select 'repeated_query', query_id from a where query_id is not null group by query_id having count(*) > 1)
"""


@query(RULES + "select rule, key from found")
def dataset_invariants(spark, d):
    return C.dataset_rules(t(spark, d, "annotations"), t(spark, d, "pages")).select("rule", "key")


@query(RULES + ", firsts as (select rule, key, row_number() over (partition by rule order by key) as rn from (select distinct rule, key from found)) select f.rule, n_violations, first_keys from (select rule, count(*) as n_violations from found group by rule) f join (select rule, string_agg(key, ',' order by key) as first_keys from firsts where rn <= 10 group by rule) using (rule)")
def violation_preview(spark, d):
    return C.preview(C.dataset_rules(t(spark, d, "annotations"), t(spark, d, "pages")))


@query("select level, count(*) as n_queries, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from (select distinct query_id, level from annotations) group by level")
def level_distribution(spark, d):
    n = t(spark, d, "annotations").select("query_id", "level").distinct().groupBy("level").agg(F.count(F.lit(1)).alias("n_queries"))
    return n.withColumn("percent", F.round(100.0 * F.col("n_queries") / F.sum("n_queries").over(Window.partitionBy()), 6))  # a row per level


@query("select query_id, cast(hop as int) as hop, support_page_id, support_page_id in (select page_id from pages where page_id is not null) as known from (select distinct query_id, unnest(support_page_ids) as support_page_id, generate_subscripts(support_page_ids, 1) as hop from annotations where level in (2, 3)) where support_page_id is not null")
def support_path_hops(spark, d):
    hops = t(spark, d, "annotations").where("level in (2, 3)").select("query_id", F.posexplode("support_page_ids").alias("pos", "support_page_id")).where("support_page_id is not null").distinct()
    known = t(spark, d, "pages").select(F.col("page_id").alias("support_page_id")).distinct().withColumn("k", F.lit(True))
    return hops.join(known, "support_page_id", "left").select("query_id", (F.col("pos") + 1).cast("int").alias("hop"), "support_page_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("""select rule, count(*) as n from (
 select 'missing text' as rule from ocr_cache where ocr_ok and ocr_text is null union all select 'failed' from ocr_cache where not coalesce(ocr_ok, false)
 union all select 'failed with text' from ocr_cache where not coalesce(ocr_ok, false) and length(ocr_text) > 0 union all select 'stale text_chars' from ocr_cache where text_chars != length(ocr_text)
 union all select 'no document' from ocr_cache where coalesce(document_id, '') = '' union all select 'no image hash' from ocr_cache where image_sha256 is null) group by rule""")
def ocr_cache_validation(spark, d):
    c, k = t(spark, d, "ocr_cache"), F.col("cache_seq")
    failed = ~F.coalesce("ocr_ok", F.lit(False))
    return C.all_of(
        C.violations(c, "missing text", k, F.col("ocr_ok") & F.col("ocr_text").isNull()), C.violations(c, "failed", k, failed),
        C.violations(c, "failed with text", k, failed & (F.length("ocr_text") > 0)), C.violations(c, "stale text_chars", k, F.col("text_chars") != F.length("ocr_text")),
        C.violations(c, "no document", k, F.coalesce("document_id", F.lit("")) == ""), C.violations(c, "no image hash", k, F.col("image_sha256").isNull()),
    ).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Caches.

STATE = """
with conf as (select ocr_config_sha256 as c from ocr_cache where ocr_config_sha256 is not null group by 1 order by count(*) desc, 1 limit 1),
cached as (select page_id, r.ok as ok, r.config as config, r.image as image, newest from (select page_id, max_by(image_sha256, cached_at) filter (image_sha256 is not null) as newest, max_by(struct_pack(ok := coalesce(ocr_ok, false), config := ocr_config_sha256, image := image_sha256), cache_seq) as r from ocr_cache where page_id is not null group by page_id)),
listed as (select distinct page_id from pages where page_id is not null),
state as (select coalesce(l.page_id, k.page_id) as page_id, case when l.page_id is null then 'orphan' when k.page_id is null then 'pending' when coalesce(k.config != (select c from conf), true) or coalesce(k.image != newest, newest is not null) then 'stale' when not k.ok then 'failed' else 'reused' end as state
          from listed l full join cached k on l.page_id = k.page_id)
"""


def _state(spark, d) -> DataFrame:
    cache = t(spark, d, "ocr_cache")
    images = cache.where("page_id is not null and image_sha256 is not null").groupBy("page_id").agg(F.max_by("image_sha256", "cached_at").alias("image_sha256"))  # the image seen last
    return caching.cache_state(cache, t(spark, d, "pages"), caching.commonest(cache, "ocr_config_sha256"), images)


def _in_state(*names: str):
    return lambda spark, d: _state(spark, d).where(F.col("state").isin(*names))


for _name, _states in (("cache_reuse", ("reused",)), ("cache_stale", ("stale", "orphan")), ("cache_pending", ("pending", "failed"))):
    _QUERIES[_name] = _in_state(*_states)
    _SQL[_name] = STATE + f"select page_id, state from state where state in ({', '.join(repr(s) for s in _states)})"


@query(STATE + "select state, count(*) as n_pages from state group by state")
def cache_report(spark, d):
    return _state(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n_pages"))


@query(STATE + "select document_id, count(*) as n_missing, min(page_index) as first_missing from (select distinct s.page_id, p.document_id, p.page_index from state s join pages p on p.page_id = s.page_id where state in ('pending', 'failed', 'stale')) group by document_id")
def pending_documents(spark, d):
    pages = t(spark, d, "pages").select("page_id", "document_id", "page_index").distinct()
    lost = _state(spark, d).where("state in ('pending', 'failed', 'stale')")
    return pages.join(lost.select("page_id"), "page_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("page_index").alias("first_missing"))


@query("select document_id, count(*) as n_files, sum(text_chars)::bigint as total_chars, concat_ws('-', count(*), sum(('0x' || substr(h, 1, 15))::bigint), sum(('0x' || substr(h, 16, 15))::bigint)) as identity from (select *, sha256(concat_ws(chr(10), page_id, coalesce(image_sha256, ''), coalesce(ocr_config_sha256, ''))) as h from ocr_cache where page_id is not null) group by document_id")
def collection_identity(spark, d):
    """Files, size and an identity: two independent sums of hashes, in which repeated records count each time. No list of a document's pages is built."""
    c = t(spark, d, "ocr_cache").where("page_id is not null")
    c = c.withColumn("h", X.fingerprint(F.col("page_id"), F.col("image_sha256"), F.col("ocr_config_sha256")))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("text_chars").alias("total_chars"), F.concat_ws("-", F.count(F.lit(1)), part(1), part(16)).alias("identity"))


@query("select page_id, max(cache_seq) as cache_seq, max_by(coalesce(text_words, -1), cache_seq) as words from ocr_cache where page_id is not null group by page_id")
def dedupe_last_wins(spark, d):
    c = t(spark, d, "ocr_cache").where("page_id is not null").select("page_id", "cache_seq", F.coalesce("text_words", F.lit(-1)).alias("words"))
    return O.last_wins(c, ["page_id"], F.col("cache_seq"))


@query("select page_id, min(cache_seq) as cache_seq, min_by(coalesce(text_words, -1), cache_seq) as words from ocr_cache where page_id is not null group by page_id")
def dedupe_first_wins(spark, d):
    c = t(spark, d, "ocr_cache").where("page_id is not null").select("page_id", "cache_seq", F.coalesce("text_words", F.lit(-1)).alias("words"))
    return O.first_wins(c, ["page_id"], F.col("cache_seq"))


@query("""with q as (select output_id, regexp_extract(raw_response, '"query": "([^"]*)"', 1) as query from model_outputs where raw_response like '%"query": "%')
select sha256(concat_ws(chr(10), 'v1', 'embedder', query)) as cache_key, query, min(output_id) as first_output from q group by query""")
def query_cache_insert_if_absent(spark, d):
    q = _searches(spark, d, 1).select(F.col("query_id").alias("output_id"), F.col("text").alias("query"))
    q = q.withColumn("cache_key", X.fingerprint(F.lit("v1"), F.lit("embedder"), F.col("query")))
    return caching.insert_if_absent(q, "cache_key", F.col("output_id")).select("cache_key", "query", F.col("output_id").alias("first_output"))


@query("select page_id, max(cache_seq) as cache_seq, max_by(coalesce(ocr_ok, false), cache_seq) as ocr_ok from ocr_cache where page_id is not null group by page_id")
def incremental_stream_cache(spark, d):
    return stream_latest(spark, d).withColumn("ocr_ok", F.coalesce("ocr_ok", F.lit(False)))


# Traces.

TURNS = "with turns as (select output_id, r.* from (select output_id, min_by(struct_pack(query_id := query_id, provider := provider, step := step, phase := phase, attempts := attempts, event_type := event_type, response_accepted := response_accepted, raw_response := raw_response, request_attempts := request_attempts, output_tokens := output_tokens, logged_at := logged_at), logged_at) as r from model_outputs where query_id is not null and logged_at is not null and output_id is not null group by output_id))"
AUDIT = """count(distinct (query_id, coalesce(phase, ''), step)) as logical_turns, count(*) as events, sum(coalesce(attempts, 0))::bigint as attempts,
sum(coalesce(len(list_filter(request_attempts, lambda x: coalesce(x.retry_scheduled, false))), 0))::bigint as retries, count(*) filter (event_type = 'format_error') as format_errors, count(*) filter (event_type = 'provider_error') as provider_errors,
count(*) filter (response_accepted) as accepted, count(*) filter (not coalesce(response_accepted, false)) as rejected"""


def _turns(spark, d) -> DataFrame:
    return materialize(T.turns(t(spark, d, "model_outputs")))


@query(TURNS + f" select coalesce(provider, '') as provider, {AUDIT} from turns group by coalesce(provider, '')")
def request_audit(spark, d):
    return T.request_audit(_turns(spark, d).withColumn("provider", F.coalesce("provider", F.lit(""))), "provider")


@query(TURNS + f", a as (select query_id, {AUDIT} from turns group by query_id) unpivot (select sum(logical_turns)::bigint as logical_turns, sum(events)::bigint as events, sum(attempts)::bigint as attempts, sum(retries)::bigint as retries, sum(accepted)::bigint as accepted, sum(rejected)::bigint as rejected from a) on logical_turns, events, attempts, retries, accepted, rejected into name counter value total")
def audit_rollup(spark, d):
    names = ["logical_turns", "events", "attempts", "retries", "accepted", "rejected"]
    a = T.request_audit(_turns(spark, d), "query_id").agg(*[F.sum(n).alias(n) for n in names])
    return a.unpivot([], names, "counter", "total")


@query(TURNS + " select query_id, sum(coalesce(output_tokens, 0))::bigint as output_tokens, count(output_tokens) as turns_with_tokens from turns group by query_id")
def token_totals(spark, d):
    return _turns(spark, d).groupBy("query_id").agg(F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.count("output_tokens").alias("turns_with_tokens"))


@query(TURNS + " select output_id, a.attempt as attempt, coalesce(a.retry_scheduled, false) as retry, case when coalesce(a.retry_scheduled, false) then 2.0 * pow(2, a.attempt - 1) else 0.0 end as wait_seconds from (select output_id, unnest(request_attempts) as a from turns)")
def backoff_schedule(spark, d):
    a = _turns(spark, d).select("output_id", F.explode("request_attempts").alias("a")).select("output_id", "a.attempt", F.coalesce("a.retry_scheduled", F.lit(False)).alias("retry"))
    return a.withColumn("wait_seconds", F.when(F.col("retry"), X.backoff(F.col("attempt"), 2.0)).otherwise(0.0))


RUNNING = " over (partition by query_id order by logged_at, output_id rows unbounded preceding)"


@query(TURNS + f" select query_id, output_id, count(*){RUNNING} as step_no, (sum(coalesce(output_tokens, 0)){RUNNING})::bigint as tokens_so_far, (sum(case when response_accepted then 1 else 0 end){RUNNING})::bigint as accepted_so_far from turns")
def running_usage(spark, d):
    return T.usage_so_far(_turns(spark, d))


@query(TURNS + " select query_id, output_id, list_reduce(list_transform(list(output_id) over w, lambda x: cast(x as varchar)), lambda a, b: a || ',' || b) as last_outputs from turns window w as (partition by query_id order by logged_at, output_id rows between 11 preceding and current row)")
def trace_last12(spark, d):
    rows = O.trailing(materialize(T.numbered(_turns(spark, d).select("query_id", *T.ORDER))), ["query_id"], "position", 12, "last", F.col("output_id").cast("string"))
    return rows.select("query_id", "output_id", F.array_join("last", ",").alias("last_outputs"))


SEEN = TURNS + ", named as (select query_id, logged_at, output_id, unnest(list_distinct(regexp_extract_all(coalesce(raw_response, ''), 'page_[0-9]+'))) as handle from turns)"


@query(SEEN + f", firsts as (select query_id, handle, min(struct_pack(logged_at := logged_at, output_id := output_id)) as f from named group by query_id, handle), fresh as (select query_id, f.output_id as output_id, count(*) as n from firsts group by query_id, f.output_id) select t.query_id, t.output_id, (sum(coalesce(n, 0)) over (partition by t.query_id order by logged_at, t.output_id rows unbounded preceding))::bigint as n_seen from turns t left join fresh r on r.query_id = t.query_id and r.output_id = t.output_id")
def seen_as_of_step(spark, d):
    return T.seen_as_of(_turns(spark, d))


@query(SEEN + ", lasts as (select query_id, handle, max(struct_pack(logged_at := logged_at, output_id := output_id)) as l from named group by query_id, handle) select query_id, handle, cast(rn as int) as recency from (select query_id, handle, row_number() over (partition by query_id order by l desc, handle) as rn from lasts) where rn <= 10")
def recency_order(spark, d):
    last = T.handles_seen(_turns(spark, d)).groupBy("query_id", "handle").agg(F.max(F.struct(*T.ORDER)).alias("l"))
    w = Window.partitionBy("query_id").orderBy(F.desc("l"), "handle")  # each task keeps ten a query before the shuffle
    return last.withColumn("recency", F.row_number().over(w)).where("recency <= 10").select("query_id", "handle", "recency")


@query(SEEN + ", per as (select query_id, logged_at, output_id, max_by(list_n, 1) as n from (select query_id, logged_at, output_id, count(*) as list_n from named group by all) group by all) select query_id, max_by(output_id, struct_pack(logged_at := logged_at, output_id := output_id)) as output_id, max_by(n, struct_pack(logged_at := logged_at, output_id := output_id)) as n_handles from per group by query_id")
def visible_batch(spark, d):
    """The last turn of a query that named any handle, and how many."""
    per = T.handles_seen(_turns(spark, d)).groupBy("query_id", *T.ORDER).agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(*T.ORDER)
    return per.groupBy("query_id").agg(F.max_by("output_id", row).alias("output_id"), F.max_by("n", row).alias("n_handles"))


@query(TURNS + r""" select query_id, regexp_extract(raw_response, '"action": "(\w+)"', 1) as action, count(*) as n_calls from turns where response_accepted and regexp_extract(raw_response, '"action": "(\w+)"', 1) != '' group by all""")
def tool_usage(spark, d):
    action = F.regexp_extract("raw_response", r'"action": "(\w+)"', 1)
    return _turns(spark, d).where("response_accepted").withColumn("action", action).where("action != ''").groupBy("query_id", "action").agg(F.count(F.lit(1)).alias("n_calls"))


@query("""with one as (select prediction_id, min_by(ranked_answers, received_at) as l from predictions where prediction_id is not null group by prediction_id),
long as (select prediction_id, unnest(l) as a from one), m as (select distinct page_handle from handle_mapping),
n as (select prediction_id, count(*) as n_answers, count(*) filter (a.page_handle is null) as n_null, count(a.page_handle) - count(distinct a.page_handle) as n_repeated, count(*) filter (a.page_handle is not null and m.page_handle is null) as n_unknown
      from long left join m on m.page_handle = a.page_handle group by prediction_id)
select o.prediction_id, coalesce(n_answers, 0) as n_answers, coalesce(n_null, 0) as n_null, coalesce(n_repeated, 0) as n_repeated, coalesce(n_unknown, 0) as n_unknown, coalesce(n_answers = 10 and n_null + n_repeated + n_unknown = 0, false) as ok from one o left join n using (prediction_id)""")
def submission_normalize(spark, d):
    return T.submission_checks(t(spark, d, "predictions").where("prediction_id is not null"), t(spark, d, "handle_mapping"))


@query(SUBS + """select run_name, count(*) filter (g.query_id is null) as not_annotated, count(*) filter (g.query_id is not null and status != 'submitted') as not_submitted,
count(*) filter (g.query_id is not null and status = 'submitted' and coalesce(len(ranked_answers), 0) < 10) as too_short, count(*) filter (g.query_id is not null and status = 'submitted' and coalesce(len(ranked_answers), 0) >= 10) as reusable
from latest l left join gold g using (query_id) group by run_name""")
def resume_scope(spark, d):
    """Which of a run's submissions a resumed run could keep."""
    s = E.latest_submissions(t(spark, d, "predictions")).join(E.one_annotation(t(spark, d, "annotations")).select("query_id", F.lit(True).alias("known")), "query_id", "left")
    n = F.coalesce(F.size("ranked_answers"), F.lit(0))
    known, done = F.col("known").isNotNull(), F.col("status") == "submitted"
    return s.groupBy("run_name").agg(F.count_if(~known).alias("not_annotated"), F.count_if(known & ~done).alias("not_submitted"), F.count_if(known & done & (n < 10)).alias("too_short"), F.count_if(known & done & (n >= 10)).alias("reusable"))


@query("select run_name, coalesce(status, '') as status, count(*) as n from (select distinct prediction_id, run_name, status from predictions) group by all")
def status_histogram(spark, d):
    return t(spark, d, "predictions").select("prediction_id", "run_name", "status").distinct().groupBy("run_name", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Scalar functions on whole tables.


@query("select page_handle, round_even(page_width * 0.1, 0)::bigint as x0, round_even(page_height * 0.25, 0)::bigint as y0, round_even(page_width * 0.65, 0)::bigint as x1, round_even(page_height * 0.75, 0)::bigint as y1, round((round_even(page_width * 0.65, 0) - round_even(page_width * 0.1, 0)) * (round_even(page_height * 0.75, 0) - round_even(page_height * 0.25, 0)) / (page_width::double * page_height), 6) as area, least(1.0, round(sqrt(200000.0 / (page_width::double * page_height)), 6)) as resize from handle_mapping")
def crop_boxes(spark, d):
    edge = lambda c, f: F.bround(F.col(c) * F.lit(f), 0).cast("bigint")
    w, h = F.col("page_width").cast("double"), F.col("page_height").cast("double")
    b = t(spark, d, "handle_mapping").select("page_handle", "page_width", "page_height", edge("page_width", 0.1).alias("x0"), edge("page_height", 0.25).alias("y0"), edge("page_width", 0.65).alias("x1"), edge("page_height", 0.75).alias("y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (w * h)
    return b.select("page_handle", "x0", "y0", "x1", "y1", F.round(area, 6).alias("area"), F.least(F.lit(1.0), F.round(F.sqrt(F.lit(200000.0) / (w * h)), 6)).alias("resize"))


@query(r"select page_id, image_path, regexp_extract(image_path, '([^/]+?)(\.[^./]*)?$', 1) as stem, case lower(regexp_extract(image_path, '\.([^./]*)$', 1)) when 'png' then 'image/png' when 'webp' then 'image/webp' when 'gif' then 'image/gif' else 'image/jpeg' end as mime, regexp_replace(image_path, '[^A-Za-z0-9_.-]+', '_', 'g') as safe_name, image_path like '/%' as absolute from (select distinct page_id, image_path from pages where image_path is not null)")
def url_and_path_parts(spark, d):
    p = F.col("image_path")
    return t(spark, d, "pages").where("image_path is not null").select("page_id", "image_path").distinct().select("page_id", "image_path", X.path_stem(p).alias("stem"), X.image_mime(p).alias("mime"), X.safe_filename(p).alias("safe_name"), p.startswith("/").alias("absolute"))


@query("select cache_seq, length(coalesce(ocr_text, ''))::bigint as chars, len(list_filter(regexp_split_to_array(coalesce(ocr_text, ''), '\\s+'), lambda x: x != ''))::bigint as words, coalesce(text_chars = length(coalesce(ocr_text, '')), false) as current, length(case when length(ocr_text) > 2400 then substr(ocr_text, 1, 2400) || '...[truncated]' else coalesce(ocr_text, '') end)::bigint as shown from ocr_cache".replace("\\\\", "\\"))
def word_and_char_counts(spark, d):
    x = F.coalesce("ocr_text", F.lit(""))
    return t(spark, d, "ocr_cache").select("cache_seq", F.length(x).cast("bigint").alias("chars"), X.word_count(x).cast("bigint").alias("words"), F.coalesce(F.col("text_chars") == F.length(x), F.lit(False)).alias("current"), F.length(X.truncated(x)).cast("bigint").alias("shown"))


@query("with p as (select page_id, min(document_id) as document_id from pages where page_id is not null group by page_id) select cache_seq, coalesce(nullif(o.document_id, ''), nullif(p.document_id, ''), regexp_replace(o.page_id, '_p[0-9]+$', '')) as document_id from ocr_cache o left join p using (page_id)")
def coalesced_fields(spark, d):
    p = t(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("document_id").alias("from_pages"))
    o = t(spark, d, "ocr_cache").select("cache_seq", "page_id", "document_id").join(p, "page_id", "left")
    return o.select("cache_seq", F.coalesce(X.truthy(F.col("document_id"), F.col("from_pages")), F.regexp_replace("page_id", "_p[0-9]+$", "")).alias("document_id"))


@query("select run_name, count(*) as n_scores, count(*) filter (s is null) as n_null, count(*) filter (s is not null and not isfinite(s)) as n_not_finite, round(avg(case when isfinite(s) then s end), 6) as mean from (select run_name, (unnest(ranked_answers)).relevance_score as s from predictions) group by run_name")
def score_quality(spark, d):
    s = t(spark, d, "predictions").select("run_name", F.explode("ranked_answers").alias("a")).select("run_name", F.col("a.relevance_score").alias("s"))
    fin = X.finite(F.col("s"))
    return s.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_scores"), F.count_if(F.col("s").isNull()).alias("n_null"), F.count_if(F.col("s").isNotNull() & fin.isNull()).alias("n_not_finite"), F.round(F.avg(fin), 6).alias("mean"))


@query("select b.label as label, count(*) as n_blocks, count(distinct cache_seq) as n_rows, round(avg(b.score), 6) as mean_score from (select cache_seq, unnest(blocks) as b from ocr_cache) group by b.label")
def block_labels(spark, d):
    b = t(spark, d, "ocr_cache").select("cache_seq", F.explode("blocks").alias("b"))
    per = b.groupBy(F.col("b.label").alias("label"), "cache_seq").agg(F.count(F.lit(1)).alias("n"), F.sum("b.score").alias("s"), F.count("b.score").alias("k"))
    return per.groupBy("label").agg(F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_score"))


@query("select distinct output_id, sha256(concat_ws(chr(10), coalesce(query_id, ''), coalesce(provider, ''), coalesce(raw_response, ''))) as fingerprint from model_outputs where output_id is not null")
def input_fingerprints(spark, d):
    m = t(spark, d, "model_outputs").where("output_id is not null")
    return m.select("output_id", X.fingerprint(F.col("query_id"), F.col("provider"), F.col("raw_response")).alias("fingerprint")).distinct()


@query("select page_id, row_number() over (order by sha256('17' || chr(10) || page_id), page_id) as place from (select distinct page_id from pages where page_id is not null)")
def handle_permutation(spark, d):
    """A seeded order of all pages: ids by their keyed hash, numbered over all partitions."""
    ids = t(spark, d, "pages").where("page_id is not null").select("page_id").distinct().withColumn("h", X.fingerprint(F.lit("17"), F.col("page_id")))
    return O.global_positions(ids, ["h", "page_id"], "place").select("page_id", "place")


@query()
def json_first_object(spark, d):
    """output_id, action, trailing, ok: the first JSON object of every reply, read tolerantly.

    Replies that are one plain object, with or without words before it, are read by Spark; only the others (more after
    the object, or a broken one) go through Python, in Arrow batches.
    """
    m = t(spark, d, "model_outputs").where("output_id is not null").select("output_id", "raw_response").distinct()
    m = m.withColumn("o", F.regexp_extract(F.coalesce("raw_response", F.lit("")), r"(?s)(\{.*)", 1)).withColumn("plain", (F.col("o") != "") & F.try_parse_json("o").isNotNull())
    plain = m.where("plain").select("output_id", F.get_json_object("o", "$.action").alias("action"), F.lit("").alias("trailing"), F.lit(True).alias("ok"))

    @F.pandas_udf("action string, trailing string, ok boolean")
    def first(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([X.first_json_object(x) for x in text], columns=["action", "trailing", "ok"])

    return plain.unionByName(m.where("not plain").select("output_id", first("raw_response").alias("o")).select("output_id", "o.*"))


# The star schema, for the general joins and groupings of the library.


@query("select n_name, count(*) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def revenue_by_nation(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = li.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(cast(l_discount as decimal(12, 2)))::double / count(l_discount), 9) as discount from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def line_report(spark, d):
    g = t(spark, d, "lineitem").groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], "l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double") / F.count("l_discount"), 9).alias("discount"))


@query("select user_id, event_type, count(*) as n, round(sum(value), 4) as total, max(ts) as last_ts from events group by user_id, event_type")
def event_totals(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))
