import duckdb
import pytest

from foliospark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TURNS = {3: "red", 7: "blue blue", 20: "green red", 21: "red", 47: "blue red", 48: ""}  # 3 and 7 have vectors


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hybrid"))
    reply = '{"action": "search", "arguments": {"query": "%s"}}'
    rows = {
        "ocr_cache": ([(i, f"p{i:02}", "red " * (i % 3) + "blue " * (i % 4) + "green" * (i % 5 == 0)) for i in range(1, 15)], "cache_seq bigint, page_id string, ocr_text string"),
        "handle_mapping": ([(f"page_{i:09}", f"p{i:02}") for i in range(1, 15)], "page_handle string, page_id string"),
        "embeddings": ([(i, [float(i), 1.0, float(i % 3)], 0) for i in range(15)], "vec_id bigint, embedding array<float>, label int"),
        "model_outputs": ([(i, f"q{i}", reply % x) for i, x in TURNS.items()] + [(None, "q3", reply % "red"), (60, "q60", "no search")], "output_id bigint, query_id string, raw_response string"),
        "annotations": ([("q3", "p14", 1, "a"), ("q21", "p05", 1, "a"), ("q47", "p11", 2, None), ("q20", "p01", 2, "b"), ("q60", "p02", 1, "a")], "query_id string, answer_page_id string, level int, topic_id string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def by_sql(folder, name):
    con = duckdb.connect()
    for n in ("ocr_cache", "handle_mapping", "embeddings", "model_outputs", "annotations"):
        con.execute(f"create view {n} as select * from '{folder}/{n}.parquet/*.parquet'")
    return con.execute(SQL[name]).df().to_dict("records")


def test_hybrid_eval_counts_every_annotated_search_turn(spark, folder):
    """Not only the turns whose id is divisible by 20."""
    got = [r.asDict() for r in QUERIES["hybrid_eval"](spark, folder).collect()]
    assert [r["n_queries"] for r in got] == [4] and got == by_sql(folder, "hybrid_eval")


def test_hybrid_topk_ranks_every_search_turn(spark, folder):
    """Turns without a vector, also several of the same words, have their BM25 ranking; those with one both."""
    got = [r.asDict() for r in QUERIES["hybrid_topk"](spark, folder).collect()]
    lists = {i: [r["page_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] for i in TURNS}
    assert len(got) == 10 * len(TURNS) and all(len(set(x)) == 10 for x in lists.values())
    assert lists[48] == [f"p{i:02}" for i in range(1, 11)] and lists[3] != lists[21]
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(got, key=key) == sorted(by_sql(folder, "hybrid_topk"), key=key)
