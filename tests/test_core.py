import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X, vectors as V
from foliospark.operators import blocks as B, caching, evaluation as E, ordering as O, protocol as P, resume, retrieval as R, traces as T, validation as C
from foliospark.plans import protocol as queries
from foliospark.sources import jsonl
from foliospark.streaming import cache_stream


def test_tokenize_and_strip(spark):
    df = spark.createDataFrame([("  Été ½ a_b, x² \n",), (None,), ("",)], "t string")
    rows = df.select(X.tokenize(F.col("t")).alias("k"), X.strip(F.col("t")).alias("s"), X.word_count(F.col("t")).alias("n")).collect()
    assert rows[0].k == ["été", "½", "a_b", "x²"] and rows[0].s == "Été ½ a_b, x²" and rows[0].n == 5
    assert rows[1].k == [] and rows[1].s is None and rows[2].n == 0


def test_backoff_and_retry_after(spark):
    now = dt.datetime(2026, 1, 1, 0, 0, 0)
    df = spark.createDataFrame([("7", 1), ("Thu, 01 Jan 2026 00:00:30 GMT", 3), ("soon", 2), ("-4", 1)], "v string, n int")
    got = df.select(X.retry_after_seconds(F.col("v"), F.lit(now)).alias("w"), X.backoff(F.col("n"), 2.0).alias("b")).collect()
    assert [r.w for r in got] == [7.0, 30.0, 0.0, 0.0] and [r.b for r in got] == [2.0, 8.0, 4.0, 2.0]


def test_first_json_object():
    assert X.first_json_object('Sure.\n```json\n{"b": 1, "action": "}"}\n``` done') == ("}", "``` done", True)
    assert X.first_json_object('{"a": 1} then {"action": "x"}') == (None, 'then {"action": "x"}', True)
    assert {X.first_json_object(x) for x in ('{"a": 1', None, "{'a': 1}", "none", "")} == {(None, "", False)}


def test_dense_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype("float32")
    v[7] = v[3]
    v[9] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [1.0]), (102, [1.0] * 30)]  # a malformed long vector empties nothing
    corpus = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(3)
    monkeypatch.setattr(R, "BLOCK_NUMBERS", 40)  # several blocks
    got = R.dense_topk(corpus.where("id < 12").withColumnRenamed("id", "qid"), corpus, 5).collect()
    u = v.astype("float64") / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v.astype("float64"), axis=1, keepdims=True))
    want = {(q, i, k + 1) for q in range(12) for k, i in enumerate(sorted(range(60), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:5])}
    assert {(r.qid, r.id, r["rank"]) for r in got} == want
    assert R.dense_topk(corpus.where("id < 0").withColumnRenamed("id", "qid"), corpus, 5).count() == 0


def test_bm25_pads_and_ties(spark):
    pages = spark.createDataFrame([("p1", "alpha beta"), ("p2", "gamma delta"), ("p3", ""), ("p4", "alpha beta")], "page_id string, text string")
    queries = spark.createDataFrame([(1, "Alpha"), (2, ""), (3, "nothing")], "query_id bigint, text string")
    got = {}
    for r in R.bm25_topk(queries, pages, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.page_id, r.score > 0))
    assert got == {1: [("p1", True), ("p4", True), ("p2", False)], 2: [("p1", False), ("p2", False), ("p3", False)], 3: [("p1", False), ("p2", False), ("p3", False)]}


def test_best_keeps_k_under_ties_in_small_buffers(monkeypatch):
    monkeypatch.setattr(R, "CELLS", 40)
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 4, (6, 90)).astype(float), np.array([f"p{i:03}" for i in rng.permutation(90)])
    scores[2] = np.nan
    hit = rng.random((6, 90)) < 0.9
    hit[3] = False
    best = R.Best(6, 5)
    for at in R._slices(90, 6):
        best.add(scores[:, at], ids[at], hit[:, at])
    got = {(q, i, s) for b in best.batch(np.arange(6)) for q, i, s in zip(*(c.to_pylist() for c in b.columns))}
    want = {(q, i, s) for q in range(6) for s, i in sorted(((s, i) for s, i, h in zip(scores[q], ids, hit[q]) if h and s == s), key=lambda x: (-x[0], x[1]))[:5]}
    assert got == want and {q for q, _, _ in got} == {0, 1, 4, 5}


def test_bm25_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = {f"p{i:02}": " ".join(rng.choices(words, weights=range(1, 31), k=rng.randint(0, 40))) for i in range(50)}
    asked = {i: " ".join(rng.choices(words + ["unseen"], k=rng.randint(1, 5))) for i in range(12)}
    monkeypatch.setattr(R, "BLOCK_TERMS", 9)  # several blocks
    pages = spark.createDataFrame([*texts.items(), (None, "w1 w2")], "page_id string, text string").withColumn("score", F.lit(1)).repartition(3)
    queries = spark.createDataFrame([*asked.items(), (None, "w1")], "query_id bigint, text string").withColumn("page_id", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.page_id, r.score) for r in R.bm25_topk(queries, pages, 4).collect()}
    tokens = {p: t.split() for p, t in texts.items()}
    mean = float(np.float32(sum(map(len, tokens.values())) / len(tokens)))
    want = {}
    for q, text in asked.items():
        def score(p):
            total = 0.0
            for w in text.split():
                df, tf = sum(w in t for t in tokens.values()), tokens[p].count(w)
                total += math.log(1 + (50 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[p]) / mean))
            return round(total, 9)
        for k, p in enumerate(sorted(tokens, key=lambda p: (-score(p), p))[:4]):
            want[q, k + 1] = (p, score(p))
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-6 for x in want)
    assert R.bm25_topk(queries, pages.where("false"), 4).count() == 0 and R.bm25_topk(queries.where("false"), pages, 4).count() == 0


def test_deep_rankings_bound_what_a_task_holds(spark, monkeypatch):
    """Queries of the same words are sent once, and a block's queries times the depth stay bounded."""
    sent = []
    send = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: (sent.append(len(x[0])), send(x))[1])
    monkeypatch.setattr(R, "HELD", 120, raising=False)
    pages = spark.createDataFrame([(f"p{i:02}", "red " * (i % 3) + "blue " * (i % 4) + "green") for i in range(40)], "page_id string, text string").repartition(3)
    texts = ["red blue", "blue  red", "Red Blue red", "green", "", "blue", "none"]
    asked = spark.createDataFrame([(i, texts[i % 7]) for i in range(70)], "query_id bigint, text string")
    got = {(r.query_id, r["rank"]): (r.page_id, r.score) for r in R.bm25_topk(asked, pages, 60).collect()}
    assert len(got) == 70 * 40 and sum(sent) == 4 and len(sent) > 1
    assert all(got[i, k] == got[i % 7 if i % 7 != 1 else 0, k] for i, k in got)
    assert [got[4, k][0] for k in range(1, 41)] == [f"p{i:02}" for i in range(40)] and got[2, 1] != got[0, 1]
    sent.clear()
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, vec array<float>")
    assert R.dense_topk(v.withColumnRenamed("id", "qid"), v, 60).count() == 400 and sum(sent) == 20 and len(sent) == 10


def test_maxsim_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    many = {i: rng.normal(size=(1 + i % 4, 6)).astype("float32") for i in range(30)}
    many[8] = many[4]
    rows = [(i, [[float(x) for x in v] for v in m]) for i, m in many.items()] + [(90, None), (91, []), (92, [[1.0] * 6, [1.0]]), (93, [[None] + [1.0] * 5]), (None, [[1.0] * 6])]
    pages = spark.createDataFrame(rows, "id bigint, vecs array<array<float>>").repartition(3)
    got = {(r.qid, r.id, r["rank"]) for r in R.maxsim_topk(pages.where("id < 7 or id > 90").withColumnRenamed("id", "qid"), pages, 3).collect()}
    score = lambda q, i: round(float((many[q].astype("float64") @ many[i].astype("float64").T).max(1).sum()), 9)
    assert got == {(q, i, k + 1) for q in range(7) for k, i in enumerate(sorted(many, key=lambda i: (-score(q, i), i))[:3])}
    assert R.maxsim_topk(pages.where("false").withColumnRenamed("id", "qid"), pages, 3).count() == 0
    assert R.maxsim_topk(pages.withColumnRenamed("id", "qid"), pages.where("false"), 3).count() == 0


def test_rrf_order(spark):
    rows = [("q", p, i + 1) for ranking in ("abc", "bcd") for i, p in enumerate(ranking)]
    got = R.rrf(spark.createDataFrame(rows, "query_id string, page_id string, rank int"), 4).orderBy("rank").collect()
    assert [r.page_id for r in got] == ["b", "c", "a", "d"]


def test_evaluator_golden(spark):
    """A valid list, a repeated one, one with unknown pages, none at all: only the first counts."""
    pages = spark.createDataFrame([(f"p{i}",) for i in range(1, 14)], "page_id string")
    mapping = spark.createDataFrame([(f"h{i}", f"p{i}") for i in range(1, 14)], "page_handle string, page_id string")
    ann = spark.createDataFrame([("q1", "p1", 1, "t"), ("q1", "p1", 1, "t"), ("q2", "p1", 2, None), ("q3", "p1", 3, "t"), ("q4", "p1", 3, "t")], "query_id string, answer_page_id string, level int, topic_id string")
    a = lambda hs: [(h, float(99 - i), [], "") for i, h in enumerate(hs)]
    t = dt.datetime(2026, 1, 1)
    subs = [(1, "q1", "r", "submitted", a([f"h{i}" for i in range(1, 12)]), t), (2, "q2", "r", "submitted", a(["h1"] * 10), t), (3, "q3", "r", "submitted", a(["h1"] + [f"x{i}" for i in range(9)]), t)]
    p = spark.createDataFrame(subs, "prediction_id bigint, query_id string, run_name string, status string, ranked_answers array<struct<page_handle string, relevance_score double, evidence_page_handles array<string>, rationale string>>, generated_at timestamp")
    rep = {(r.part, r.key): r for r in E.report(E.scored_queries(ann, E.latest_submissions(p), mapping, pages)).collect()}
    assert rep["overall", ""]["count"] == 4 and rep["overall", ""].valid_rankings == 1 and rep["overall", ""].recall_at_1 == 25.0
    assert rep["level", "2"].recall_at_10 == 0 and rep["level", "3"].mrr_at_10 == 0
    assert E.scored_queries(ann, E.latest_submissions(p.where("false")), mapping, pages).count() == 0


def test_running_and_trailing_equal_one_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), dt.datetime(2026, 1, rng.randint(1, 9)), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, logged_at timestamp, output_id bigint, x int")
    order = [F.col("logged_at"), F.col("output_id")]
    run = O.running(df, ["k"], F.to_date("logged_at"), order, {"n": F.lit(1), "s": F.col("x")})
    got = {r.output_id: (r.n, r.s) for r in run.collect()}
    want, last = {}, {}
    for k in "ab":
        n = s = 0
        seen = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            n, s = n + 1, s + r[3]
            seen.append(r[2])
            want[r[2]], last[r[2]] = (n, s), seen[-4:]
    assert got == want
    ranged = O.running(df, ["k"], O.ranges(df, "logged_at", 40), order, {"n": F.lit(1), "s": F.col("x")})
    assert {r.output_id: (r.n, r.s) for r in ranged.collect()} == want and df.select(O.ranges(df, "logged_at", 40).alias("b")).distinct().count() > 3
    tr = O.trailing(run.select("k", "output_id", "n"), ["k"], "n", 4, "last", F.col("output_id"), segment=7)
    assert {r.output_id: r["last"] for r in tr.collect()} == last


def test_global_positions(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 200)], "x int").repartition(5)
    got = sorted((r.place, r.x) for r in O.global_positions(df, ["x"], "place").collect())
    assert [p for p, _ in got] == list(range(1, 201)) and [x for _, x in got] == sorted(x for _, x in got)


def test_cache_states(spark):
    rows = [(1, "a", True, "c"), (2, "b", False, "c"), (3, "c", True, "old"), (4, "z", True, "c"), (5, "c2", None, "c"), (6, None, True, "c")]
    cache = spark.createDataFrame([(*r, f"image of {r[1]}") for r in rows], "cache_seq bigint, page_id string, ocr_ok boolean, ocr_config_sha256 string, image_sha256 string")
    pages = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "page_id string")
    got = dict(caching.cache_state(cache, pages, caching.commonest(cache, "ocr_config_sha256")).collect())
    assert got == {"a": "reused", "b": "failed", "c": "stale", "z": "orphan", "d": "pending", "c2": "orphan"}
    images = spark.createDataFrame([("a", "image of a"), ("b", "another"), ("z", "another")], "page_id string, image_sha256 string")
    assert dict(caching.cache_state(cache, pages, "c", images).collect()) == got | {"b": "stale"}
    assert dict(caching.cache_state(cache, pages, "c", images.withColumn("image_sha256", F.lit("new"))).collect())["a"] == "stale"
    assert caching.commonest(cache.where("false"), "ocr_config_sha256") is None
    state = cache.where("page_id = 'a'")
    assert caching.upsert(state, state, "page_id", "cache_seq").collect() == state.collect()


def test_rules_on_empty_and_bad_rows(spark):
    ann = spark.createDataFrame([("q", "p1", 3, ["p1", "p1"]), ("r", None, None, None)], "query_id string, answer_page_id string, level int, support_page_ids array<string>")
    pages = spark.createDataFrame([("p2",)], "page_id string")
    got = sorted((r.rule, r.key) for r in C.dataset_rules(ann, pages).collect())
    assert got == [("answer_in_support", "q"), ("answer_not_in_corpus", "p1"), ("level_out_of_range", "r"), ("support_not_in_corpus", "p1"), ("support_repeats", "q")]
    assert C.preview(C.dataset_rules(ann.where("false"), pages)).count() == 0


def test_request_audit(spark):
    at = [(1, True), (2, True), (3, False)]
    t = dt.datetime(2026, 1, 1)
    rows = [(1, "q", "a", 1, "p", 3, "transport_failure", False, at, t), (2, "q", "a", 1, "p", 1, "accepted_response", True, [(1, False)], t), (2, "q", "a", 1, "p", 1, "accepted_response", True, [(1, False)], t)]
    df = spark.createDataFrame(rows, "output_id bigint, query_id string, provider string, step int, phase string, attempts int, event_type string, response_accepted boolean, request_attempts array<struct<attempt int, retry_scheduled boolean>>, logged_at timestamp")
    r = T.request_audit(T.turns(df), "provider").first()
    assert (r.logical_turns, r.events, r.attempts, r.retries, r.accepted, r.rejected) == (1, 2, 4, 2, 1, 1)


def test_vectors_and_numbers(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(V.norm(F.col("a")).alias("n"), V.l2_normalize(F.col("a")).alias("u"), V.l2_normalize(F.col("z")).alias("z")).first()
    assert r.n == 5 and r.u == [0.6, 0.8] and r.z == [0.0, 0.0]
    xs = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "x double").select(X.finite(F.col("x")).alias("x")).collect()
    assert [r.x for r in xs] == [1.0, None, None, None]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "ü")], "b int, a string")
    jsonl.write_jsonl(df, str(tmp_path / "x"), ["b"])
    back = jsonl.read_jsonl(spark, str(tmp_path / "x"), "a string, b int")
    assert sorted(map(tuple, back.collect()), key=str) == [("ü", 1), (None, 2)]
    jsonl.write_jsonl(df.where("b = 1"), str(tmp_path / "x"), mode="append")
    assert sorted(r.b for r in jsonl.read_jsonl(spark, str(tmp_path / "x"), "a string, b int").collect()) == [1, 1, 2]
    (tmp_path / "bad.jsonl").write_text('{"b": 3}\nno object\n')
    assert [(r.line_no, r.line) for r in jsonl.invalid_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [(2, "no object")]
    loose = {r.b: r._corrupt for r in jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "b int", strict=False).collect()}
    assert loose == {3: None, None: "no object"}
    assert jsonl.read_jsonl_if_present(spark, str(tmp_path / "none"), "a string").count() == 0


def test_images_against_the_manifest(spark, tmp_path):
    head = lambda w, h: bytes.fromhex("89504e470d0a1a0a0000000d49484452") + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"more"
    for name, content in (("a.png", head(30, 40)), ("b.png", head(30, 40)), ("c.png", b"no image")):
        (tmp_path / name).write_bytes(content)
    images = jsonl.read_images(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    manifest = spark.createDataFrame([("a.png", 30, 40), ("b.png", 30, 41), ("c.png", 1, 1), ("d.png", 1, 1), (None, 1, 1)], "path string, width int, height int")
    assert dict(jsonl.image_violations(images, manifest).collect()) == {"b.png": "other size", "c.png": "no PNG", "d.png": "missing"}


def test_stream_takes_up_new_files_and_replays(spark, tmp_path):
    schema = "page_id string, cache_seq bigint, ocr_ok boolean"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    now = lambda: {r.page_id: r.cache_seq for r in cache_stream.upsert_stream(stream(), str(tmp_path / "out"), "page_id", "cache_seq").collect()}
    put("1", [("a", 1, True), ("b", 2, False), ("a", 3, True), (None, 9, True)])
    assert now() == {"a": 3, "b": 2}
    put("2", [("b", 5, True), ("a", 2, True), ("c", 4, None)])
    assert now() == {"a": 3, "b": 5, "c": 4} == now()  # a call without new files changes nothing
    late = cache_stream._exists(spark, str(tmp_path / "out" / "state" / "000000001"))
    assert late and not cache_stream._exists(spark, str(tmp_path / "out" / "state" / "000000002"))


def test_requests(spark):
    q = spark.createDataFrame([("a", None), ("a", "50"), ("a", "51"), ("a", "ten"), (" ", "3"), (None, "3")], "q string, k string")
    assert [r[0] for r in q.select(P.search_error(F.col("q"), F.col("k"))).collect()] == ["", "", "top_k out of range", "top_k is no integer", "empty query", "empty query"]
    r = spark.createDataFrame([([0.1, 0.2, 0.5, 0.6], True), ([0.1, 0.2, 0.5, 0.6], False), ([0.1, 0.2, 0.5], True), ([0.5, 0.2, 0.1, 0.6], True), ([0.0, 0.0, 1.1, 0.5], True), ([0.0, None, 1.0, 0.5], True), (None, True)], "r array<double>, seen boolean")
    assert [x[0] for x in r.select(P.crop_error(F.col("r"), F.col("seen"))).collect()] == ["", "page not inspected", "no four numbers", "empty, reversed or too small", "outside the page", "not numeric", "no four numbers"]
    assert [x[0] for x in spark.createDataFrame([(0, 5), (9, 5), (3, 5)], "k int, n int").select(P.clamped(F.col("k"), F.col("n"))).collect()] == [1, 5, 3]
    t = [dt.datetime(2026, 1, 1, 0, i) for i in range(4)]
    turns = spark.createDataFrame([("q", t[0], 1, "page_1 page_2"), ("q", t[1], 2, "page_1 page_3"), ("r", t[2], 3, "page_1")], "query_id string, logged_at timestamp, output_id bigint, raw_response string")
    req = spark.createDataFrame([("q", t[1], 2, ["page_1"]), ("q", t[1], 4, ["page_1", "page_1"]), ("q", t[0], 5, ["page_3"]), ("q", t[1], 6, ["page_9"]), ("q", t[1], 7, []), ("q", t[1], 8, None), ("r", t[3], 9, ["page_1", "page_2"]), ("q", t[3], 10, [f"page_{i}" for i in range(11)])], "query_id string, logged_at timestamp, output_id bigint, handles array<string>")
    mapping = spark.createDataFrame([(f"page_{i}",) for i in range(4)], "page_handle string")
    got = {x.output_id: x.error for x in P.inspect_checks(req, P.first_seen(turns), mapping).collect()}
    assert got == {2: "", 4: "repeated handle", 5: "handle not seen before", 6: "unknown handle", 7: "no handles", 8: "no handles", 9: "handle not seen before", 10: "too many handles"}


def test_assessments_come_back_in_order(spark):
    schema = f"a {P.ASSESSMENTS}, e array<string>"
    rows = [([("p2", 20.0), ("p1", 90.0), ("p3", 10.0)], ["p1", "p2", "p3"]), ([("p1", 20.0), ("p1", 90.0)], ["p1", "p2"]), ([("p1", 20.0), ("p9", 90.0)], ["p1", "p2"]), ([("p1", 120.0)], ["p1"]), ([("p1", None)], ["p1"]), ([("p1", float("nan"))], ["p1"]), ([], ["p1"]), (None, ["p1"])]
    df = spark.createDataFrame(rows, schema)
    got = df.select(P.assessment_error(F.col("a"), F.col("e")).alias("x"), P.in_expected_order(F.col("a"), F.col("e")).alias("o")).collect()
    assert [r.x for r in got] == ["", "repeated handle", "unexpected handle", "invalid score", "invalid score", "invalid score", "wrong number of assessments", "no assessments"]
    assert [x.page_handle for x in got[0].o] == ["p1", "p2", "p3"]
    turns = spark.createDataFrame([(True, "accepted_response"), (False, "format_error"), (None, None)], "response_accepted boolean, event_type string")
    assert [tuple(r) for r in P.with_schema_rejections(turns, F.lit("bad")).collect()] == [(False, "schema_error"), (False, "format_error"), (None, None)]


def test_submissions_against_what_was_seen(spark):
    schema = "prediction_id bigint, query_id string, ranked_answers array<struct<page_handle string, evidence_page_handles array<string>>>"
    a = lambda *hs: [(h, ["p0", "p0", "far"]) for h in hs]
    ten = [f"p{i}" for i in range(10)]
    answers = spark.createDataFrame([(1, "q", a(*ten)), (2, "q", a(*ten[:9])), (3, "q", a(*ten[:9], "p0")), (4, "q", a(*ten[:9], "other")), (5, "few", a("p0", "p1")), (6, "none", a()), (7, "q", None), (8, "q", a(*ten, "p1")), (9, "q", a(*ten[:9], None))], schema)
    eligible = spark.createDataFrame([("q", p) for p in ten + ["p0"]] + [("few", "p0"), ("few", "p1")], "query_id string, page_handle string")
    mapping = spark.createDataFrame([(p,) for p in ten], "page_handle string")
    got = {r.prediction_id: r for r in P.submission_checks(answers, eligible, mapping, need_ten=False).collect()}
    assert {k: r.error for k, r in got.items()} == {1: "", 2: "wrong number of answers", 3: "repeated handle", 4: "unknown handle", 5: "", 6: "no answers", 7: "wrong number of answers", 8: "too many answers", 9: "unknown handle"}
    assert got[1].n_evidence_dropped == 10 and got[5].target == 2
    assert {r.prediction_id for r in P.submission_checks(answers, eligible, mapping).where("error = 'too few candidates'").collect()} == {5, 6}


def test_resume(spark):
    rows = spark.createDataFrame([("r", "a", "x", "p1", "f", 1), ("r", "a", "x", "p1", "f", 2), ("r", "b", "other", "p2", "f", 3), ("r", "c", "x", "p9", "g", 4), ("r", "z", "x", "p1", "f", 5), ("r", None, "x", "p1", "f", 6), ("s", "a", "x", "p1", "f", 7)],
                                 "run_name string, query_id string, query string, gold_page_id string, print string, n int")
    contract = spark.createDataFrame([("a", "x", "p1", "f"), ("b", "x", "p2", "f"), ("c", "x", "p3", "f")], "query_id string, query string, gold_page_id string, expected string")
    v = resume.scope_violations(rows, contract, F.col("n"), "print")
    report = {r.run_name: r for r in resume.scope_report(rows, v).collect()}
    r = report["r"]
    assert (r.n_duplicate, r.n_outside, r.n_query_mismatch, r.n_gold_mismatch, r.n_fingerprint_mismatch, r.compatible) == (2, 1, 1, 1, 1, False) and r.outside_ids == "z" and r.duplicate_ids == ",a"
    assert report["s"].compatible and report["s"].prediction_rows == 1
    resume.require_compatible(resume.scope_report(rows.where("run_name = 's'"), v.where("run_name = 's'")))
    with pytest.raises(ValueError, match="scope: r$"):
        resume.require_compatible(resume.scope_report(rows, v))
    a = [(f"h{i}",) for i in range(10)]
    subs = spark.createDataFrame([("r", "a", "submitted", a), ("r", "b", "worker_exception", a), ("r", "c", "submitted", a[:9] + a[:1]), ("r", "z", "submitted", a), ("r", "d", "submitted", a[:9] + [("unknown",)])], "run_name string, query_id string, status string, ranked_answers array<struct<page_handle string>>")
    now = spark.createDataFrame([(q, 2, "t", "p3") for q in "abcd"], "query_id string, level int, topic_id string, answer_page_id string")
    mapping = spark.createDataFrame([(f"h{i}", f"p{i}") for i in range(10)], "page_handle string, page_id string")
    kept = resume.reusable_rows(subs, now, mapping, ("submitted",)).collect()
    assert [(k.query_id, k.level, k.gold_rank, k.recall_at_3, k.recall_at_5, k.mrr_at_10) for k in kept] == [("a", 2, 4, 0.0, 1.0, 0.25)]
    c = spark.createDataFrame([(3, "f", "f", True), (14, "f", "f", True), (1, "f", "g", True), (1, None, "f", True), (1, "f", "f", False)], "n int, a string, b string, s boolean")
    assert [x[0] for x in c.select(resume.checkpoint_error(F.col("n"), 12, F.col("a"), F.col("b"), F.col("s"))).collect()] == ["", "too many steps", "fingerprint differs", "fingerprint differs", "no state"]


def test_replies(spark):
    rows = ['{"output_text": "a"}', '{"output": [{"content": [{"text": "b"}, {"text": "c"}]}]}', '{"content": [{"type": "text", "text": "d"}, {"type": "tool", "text": "no"}]}', '{"choices": [{"message": {"content": "e"}}]}', '{"content": "f"}', "none"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [x[0] for x in df.select(P.reply_text(F.col("r"))).collect()] == ["a", "b\nc", "d", "e", "f", None]
    df = spark.createDataFrame([('{"choices": [{"finish_reason": "Safety"}]}',), ("blocked by the content filtering policy",), ('{"finish_reason": "stop"}',), (None,)], "r string")
    assert [x[0] for x in df.select(P.content_filtered(F.col("r"))).collect()] == [True, True, False, False]
    s = spark.createDataFrame([(429, "http://a/b//"), (409, "http://a/v1"), (None, None)], "s int, u string").select(P.retryable(F.col("s")).alias("r"), P.retryable(F.col("s"), (409,)).alias("e"), P.normalised_url(F.col("u"), "/v1").alias("u"), P.body_preview(F.col("u"), 4).alias("p")).collect()
    assert [tuple(x) for x in s] == [(True, True, "http://a/b/v1", "http"), (False, True, "http://a/v1", "http"), (False, False, None, "")]


def test_support_order_is_a_seeded_shuffle():
    got = {q: queries.shuffled(q, ["a", "b"], 17) for q in map(str, range(40))}
    assert {tuple(v) for v in got.values()} == {("a", "b"), ("b", "a")} and got == {q: queries.shuffled(q, ["a", "b"], 17) for q in got} and queries.shuffled("q", [], 1) == []


def test_vector_states(spark):
    items = spark.createDataFrame([(i, f"p{i}", "h") for i in range(1, 7)], "position bigint, id string, input_hash string")
    vectors = spark.createDataFrame([("p1", "h"), ("p2", "old"), ("p6", None), ("gone", "h")], "id string, input_hash string")
    got = {r.id: r.state for r in caching.vector_states(items, vectors, 3).collect()}
    assert got == {"p1": "reuse", "p2": "invalidate", "p3": "embed", "p4": "embed", "p5": "deferred", "p6": "deferred"}
    assert {r.id for r in caching.matching(items, vectors, "id", "input_hash").collect()} == {"p1"}


def test_text_blocks(spark):
    deep = '{"text": "' + "x" + '", "items": [{"transcription": " a ", "poly": [1, 2], "score": 0.5}, {"content": "b", "children": {"text": "c"}}, {"text": 7}, "label: title\\nbbox: [1, 2]\\ncontent: one\\ntwo \\n#################\\nrest"]}'
    df = spark.createDataFrame([(deep,), ("[" * 5000 + "]" * 5000,), ("no json",), (None,), ("label: t\nbbox: (1)\ncontent: x",), ("content: x",)], "v string")
    got = [r[0] for r in df.select(B.text_blocks(F.col("v"))).collect()]
    assert [(b.text, b.bbox, b.label, b.confidence) for b in got[0]] == [("x", None, None, None), ("a", "[1, 2]", None, 0.5), ("b", None, None, None), ("c", None, None, None), ("one\ntwo", "[1, 2]", "title", None)]
    assert [len(x) for x in got] == [5, 0, 0, 0, 1, 0]
    assert df.limit(1).select(B.assembled(B.text_blocks(F.concat(F.lit("["), "v", F.lit(","), "v", F.lit("]"))))).first()[0] == "x\na\nb\nc\none\ntwo"
