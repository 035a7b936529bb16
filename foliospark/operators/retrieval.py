"""Rankers: exact cosine, late interaction, BM25 and reciprocal-rank fusion, with fixed tie rules.

Query sets are met with the corpus in blocks of bounded size: a block is broadcast, every task keeps its k best per
query, and only these are shuffled. The corpus is never shuffled nor paired as rows, and a task scores at most about
CELLS (query, row) cells at once, however large block and Arrow batch are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokenize
from ..session import materialize

#: Query vectors (rows x width) sent to the tasks at once.
BLOCK_NUMBERS = 4_000_000
#: (query, term) rows of sparse queries sent to the tasks at once.
BLOCK_TERMS = 50_000
#: Scores a task holds at once, besides the k best per query.
CELLS = 2_000_000
#: (query, place) pairs a task keeps for one block of queries; deep rankings meet the corpus in more blocks.
HELD = 1_000_000
K1, B, RRF_K = 1.2, 0.75, 60
#: Scores are compared to this many digits; equal ones rank by id.
DIGITS = 9


def _matrix(column, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def query_blocks(queries: DataFrame, width: int, k: int = 1) -> Iterator[DataFrame]:
    """The queries (qid, vec) in hashed parts of about BLOCK_NUMBERS numbers, whose k best are about HELD at most."""
    n = queries.count()
    parts = max(-(-n * width // BLOCK_NUMBERS), -(-n * k // HELD) if width else 0)
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)


def _width(vectors: DataFrame, of: Column | None = None) -> int:
    """The commonest width; of equally common ones the largest."""
    top = vectors.select((F.size("vec") if of is None else of).alias("w")).where("w > 0").groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    return top[0][0] if top else 0


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Best:
    """The k best scores of each of n queries, ties by the smaller id; NaN is no score. With names the ids are places in them, and ties go by the smaller name."""

    def __init__(self, n: int, k: int, names: list[pa.Array] | None = None):
        self.n, self.k, self.names, self.held = n, k, names, 0
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, hit: np.ndarray | bool = True) -> None:
        """scores: n rows, a column per id; cells without a hit are left out."""
        q, c = np.nonzero((scores >= self.floor[:, None]) & hit)
        self.parts.append((q.astype(np.int32), scores[q, c], ids[c]))
        self.held += len(q)
        if self.held > 2 * self.n * self.k + CELLS // 4:
            self._cut()

    def _cut(self) -> None:
        q, s, i = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        at = np.lexsort((i if self.names is None else self._places()[i], -s, q))
        q, s, i = q[at], s[at], i[at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        keep = place < self.k
        self.parts, self.held = [(q[keep], s[keep], i[keep])], int(keep.sum())

    def _places(self) -> np.ndarray:
        """Of each id, the place of its name in their order."""
        order = pc.sort_indices(pa.chunked_array(self.names)).to_numpy()
        places = np.empty(len(order), dtype=np.int32)
        places[order] = np.arange(len(order), dtype=np.int32)
        return places

    def batch(self, qids, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            qids, names = pa.array(qids), self.names and pa.concat_arrays(self.names)
            for at in range(0, len(self.parts[0][0]), rows):
                q, s, i = (pa.array(x[at : at + rows]) for x in self.parts[0])
                yield pa.RecordBatch.from_arrays([qids.take(q), names.take(i) if names else i, s], names=["qid", "id", "score"])


def _slices(n: int, per: int) -> Iterator[slice]:
    """Cuts n rows so that each part meets `per` query rows in about CELLS cells."""
    step = max(1, CELLS // max(1, per))
    return (slice(i, i + step) for i in range(0, n, step))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank by cosine; ties by id (the input order). queries: qid bigint, vec; corpus: id bigint, vec.

    Null ids and vectors and vectors of another width than the commonest are left out (validation lists them); a zero vector scores 0, a
    vector with a number that isn't finite ranks nowhere. No query or no corpus row gives no row.
    """
    width = _width(corpus)
    ok = (F.size("vec") == width) & F.forall("vec", lambda x: x.isNotNull())
    queries, corpus = queries.where(ok & F.col("qid").isNotNull()), corpus.where(ok & F.col("id").isNotNull())
    schema = "qid bigint, id bigint, score double"
    found = []
    for block in query_blocks(queries, width, k):
        got = block.select("qid", "vec").toArrow()  # at most about BLOCK_NUMBERS numbers
        qids = got.column("qid").to_numpy()
        shared = corpus.sparkSession.sparkContext.broadcast((qids, _unit(_matrix(got.column("vec"), width))))

        def run(batches, shared=shared):
            qids, q = shared.value
            best = Best(len(qids), k)
            for batch in batches:
                ids, rows = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1), width))
                for at in _slices(len(ids), len(qids)):
                    best.add(np.round(q @ rows[at].T, DIGITS), ids[at])
            yield from best.batch(qids)

        found.append(corpus.select("id", "vec").mapInArrow(run, schema))
    if not found:
        return queries.select("qid", F.col("qid").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    return ranked(_union(found), "qid", k, "id")


def ranked(scores: DataFrame, group: str, k: int, item: str) -> DataFrame:
    """The k best per group with their rank; ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gold_ranks(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, gold_id, gold_rank: the gold row's place in the whole corpus, null if the corpus lacks it. queries: qid, vec, gold_id.

    Null ids and vectors and those of another width than the commonest count as missing.
    """
    width = _width(corpus)
    fits = lambda c: (F.size(c) == width) & F.forall(c, lambda x: x.isNotNull())
    corpus = corpus.where(fits("vec") & F.col("id").isNotNull())
    gold = corpus.select(F.col("id").alias("gold_id"), F.col("vec").alias("gold_vec"))
    known = materialize(queries.join(gold, "gold_id", "left"))
    found = []
    for block in query_blocks(known.where(F.col("gold_vec").isNotNull() & fits("vec") & F.col("qid").isNotNull()), width * 2):
        got = block.select("qid", "vec", "gold_id", "gold_vec").toArrow()
        q, g = _unit(_matrix(got.column("vec"), width)), _unit(_matrix(got.column("gold_vec"), width))
        shared = corpus.sparkSession.sparkContext.broadcast((got.column("qid").to_numpy(), q, got.column("gold_id").to_numpy(), np.round((q * g).sum(1), DIGITS)))

        def run(batches, shared=shared):
            qids, q, gold, score = shared.value
            above = np.zeros(len(qids), dtype=np.int64)
            for batch in batches:
                ids, rows = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1), width))
                for at in _slices(len(ids), len(qids)):
                    s = np.round(q @ rows[at].T, DIGITS)
                    above += ((s > score[:, None]) | ((s == score[:, None]) & (ids[at] < gold[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(above)], names=["qid", "above"])

        found.append(corpus.select("id", "vec").mapInArrow(run, "qid bigint, above bigint"))
    if not found:
        return known.select("qid", "gold_id", F.lit(None).cast("bigint").alias("gold_rank"))
    above = _union(found).groupBy("qid").agg((F.sum("above") + 1).alias("gold_rank"))
    return known.select("qid", "gold_id").join(above, "qid", "left")


def maxsim_topk(queries: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank by late interaction: for each query vector its best page vector, summed. queries: qid, vecs; pages: id, vecs (array<array<float>>).

    Rows with a null id, no vector, or a null number or another width than the commonest in one are left out.
    """
    width = _width(pages, F.coalesce(F.size(F.get("vecs", F.lit(0))), F.lit(0)))
    ok = (F.size("vecs") > 0) & F.forall("vecs", lambda v: (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull()))
    queries, pages = queries.where(ok & F.col("qid").isNotNull()), pages.where(ok & F.col("id").isNotNull())
    per = (queries.agg(F.max(F.size("vecs"))).first()[0]) or 1
    found = []
    for block in query_blocks(queries, width * per, k):
        got = block.select("qid", "vecs").toArrow()
        vecs = got.column("vecs").combine_chunks()
        shared = pages.sparkSession.sparkContext.broadcast((got.column("qid").to_numpy(), _matrix(vecs.flatten(), width), np.diff(vecs.offsets.to_numpy())))

        def run(batches, shared=shared):
            qids, q, many = shared.value
            starts = np.cumsum(many) - many
            best = Best(len(qids), k)
            for batch in batches:
                ids, vecs = batch.column(0).to_numpy(), batch.column(1)
                rows, first = _matrix(vecs.flatten(), width), vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
                longest = int(np.diff(first).max(initial=1))
                for at in _slices(len(ids), len(q) * longest):
                    cuts = first[at.start : at.stop + 1]  # where the slice's pages begin, and where the last one ends
                    s = np.maximum.reduceat(q @ rows[cuts[0] : cuts[-1]].T, cuts[:-1] - cuts[0], axis=1)
                    best.add(np.round(np.add.reduceat(s, starts, axis=0), DIGITS), ids[at])
            yield from best.batch(qids)

        found.append(pages.select("id", "vecs").mapInArrow(run, "qid bigint, id bigint, score double"))
    if not found:
        return queries.select("qid", F.col("qid").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    return ranked(_union(found), "qid", k, "id")


def term_counts(pages: DataFrame) -> DataFrame:
    """page_id, length, tokens: one row a page, no shuffle. pages: page_id, text."""
    tokens = tokenize(F.col("text"))
    return pages.select("page_id", tokens.alias("tokens")).select("page_id", F.size("tokens").alias("length"), "tokens")


def corpus_stats(pages: DataFrame) -> DataFrame:
    """n_pages, mean_length (rounded to single precision, as lengths are kept), total."""
    return term_counts(pages).agg(F.count(F.lit(1)).alias("n_pages"), F.avg("length").cast("float").cast("double").alias("mean_length"), F.sum("length").cast("bigint").alias("total_tokens"))


def document_frequencies(pages: DataFrame) -> DataFrame:
    return term_counts(pages).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df, n):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_topk(queries: DataFrame, pages: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, page_id, score, rank; ties by page id. Pages without a query term score 0 and fill up the list.

    queries: query_id, text; pages: page_id, text, one row a page, or term_counts() of them as a table. An empty query ranks all pages at 0; empty pages
    have length 0. Null ids are left out. Terms are counted in one pass over the texts without a shuffle; frequencies are
    summed for the queries' terms only, and no (query, page) pair leaves its task unless it is among the task's k best.
    Queries of the same words, in any order, are ranked once.
    """
    terms = queries.where("query_id is not null").select("query_id", F.explode_outer(tokenize(F.col("text"))).alias("term"))
    asked = materialize(terms.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("words")))
    queries = materialize(asked.groupBy("words").agg(F.min("query_id").alias("query_id")))
    best = _bm25(queries, pages.where("page_id is not null"), k, k1, b)
    same = asked.join(queries.withColumnRenamed("query_id", "first"), "words").select("query_id", "first")
    return best.withColumnRenamed("query_id", "first").join(same, "first").select("query_id", "page_id", "score", "rank")


def _bm25(queries: DataFrame, pages: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """bm25_topk() of queries (query_id, words) that differ."""
    wanted = materialize(queries.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    counted = pages if "tokens" in pages.columns else materialize(term_counts(pages))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").cast("float").cast("double").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    found = counted.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = materialize(wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.col("df"), F.lit(n))).alias("weight")))
    schema = f"qid {queries.schema['query_id'].dataType.simpleString()}, id string, score double"
    rows, n_queries = weighted.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
    parts = max(-(-rows // BLOCK_TERMS), -(-n_queries * k // HELD))
    scores = []
    for part in range(parts):
        block = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()  # about BLOCK_TERMS rows
        qids, terms = block.column("query_id").combine_chunks().dictionary_encode(), block.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        many = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
        shared = pages.sparkSession.sparkContext.broadcast((qids.dictionary, terms.dictionary, many, qids.indices.to_numpy()[order], block.column("weight").to_numpy()[order]))

        def run(batches, shared=shared):
            qids, vocabulary, many, owner, weight = shared.value
            starts, nq = np.cumsum(many) - many, len(qids)
            names, first = [], 0
            best = Best(nq, k, names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                lengths, tokens = batch.column(1).to_numpy(), batch.column(2)
                ids = np.arange(first, first := first + batch.num_rows, dtype=np.int32)
                names.append(batch.column(0).take(pa.array(ids - ids[0])))  # a copy, or the whole batch would stay
                term = pc.index_in(tokens.flatten(), value_set=vocabulary)
                page = np.repeat(np.arange(len(ids)), np.diff(tokens.offsets.to_numpy()))
                known = term.is_valid().to_numpy(zero_copy_only=False)
                cell, tf = np.unique(page[known] * len(many) + term.drop_null().to_numpy(), return_counts=True)
                page, term = np.divmod(cell, len(many))
                x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[page] / mean))
                for at in _slices(len(ids), max(nq, len(owner))):
                    lo, hi = np.searchsorted(page, (at.start, at.stop))
                    m, times = min(at.stop, len(ids)) - at.start, many[term[lo:hi]]
                    entry = np.repeat(starts[term[lo:hi]] - np.cumsum(times) + times, times) + np.arange(times.sum())  # the queries of each hit
                    to = owner[entry] * m + np.repeat(page[lo:hi] - at.start, times)
                    s = np.bincount(to, weight[entry] * np.repeat(x[lo:hi], times), nq * m).reshape(nq, m)
                    best.add(np.round(s, DIGITS), ids[at], s > 0)
            yield from best.batch(qids)

        scores.append(counted.mapInArrow(run, schema))
    first = [r[0] for r in counted.select("page_id").orderBy("page_id").limit(2 * k).collect()]  # no list needs more to fill it
    best = (_union(scores) if scores else queries.select(F.col("query_id").alias("qid"), F.lit("").alias("id"), F.lit(0.0).alias("score")).where("false"))
    best = materialize(ranked(best.select(F.col("qid").alias("query_id"), F.col("id").alias("page_id"), "score"), "query_id", k, "page_id"))
    if not first:
        return best
    few = queries.select("query_id").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    fill = few.select("query_id", F.explode(F.split(F.lit("\0".join(first)), "\0")).alias("page_id")).join(best, ["query_id", "page_id"], "left_anti")
    both = best.drop("rank").unionByName(fill.withColumn("score", F.lit(0.0)))
    return ranked(both, "query_id", k, "page_id")


def rrf(rankings: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, page_id, score, best_rank, rank from (query_id, page_id, rank) of any number of rankers; ties by best rank, then page id."""
    fused = rankings.groupBy("query_id", "page_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "page_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
