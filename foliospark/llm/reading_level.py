"""Problem 8: reading level by a latent difficulty model of Rasch's kind for word counts.

A word occurs in a document of n words and level t about n * exp(b + d * t) times: d is how much more often the
word comes in harder texts, b its ease at the scale's middle. Levels and words are estimated in turn, both as Spark
jobs. Given the levels, the counts of each word per level step are summed over all documents, and each word's two
parameters follow from its own sums, in the task that holds them. Given the words, a document's likelihood at any
level follows from two sums over its words, of b and of d. Every word has parameters of its own: those of the
VOCABULARY most frequent words are sent to the tasks, the others are joined to the documents that hold them.

Labelled documents hold the scale: their mean label is part of their likelihood while the model is fitted, and none
when levels are reported. Only sentences count: a list of hard words in an easy text, headings, tables and traces don't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize
from .common import FUNCTION_SETS, map_rows

#: Words sent to the tasks at once: the most frequent ones.
VOCABULARY = 1 << 18
GRID = np.arange(0.5, 5.51, 0.25)
ROUNDS = 3
#: Spread of the labels about the level, of the levels, and the ridge on a word's slope.
LABEL_SD, LEVEL_SD, SLOPE_SD = 0.35, 1.5, 1.0
#: Weight of a labelled document's words beside its label while fitting: words of one text aren't independent.
WORDS_WEIGHT = 0.02
#: Documents from this level on are as demanding as those labelled 4 or 5.
DEMANDING = 3.5
#: A document is prose if sentences hold this share of its letters, English from this share of English function words in them.
PROSE_SHARE, ENGLISH_SHARE = 0.55, 0.05

SENTENCE = re.compile(r"(?<=[.!?])[\"')]?\s+(?=[\"'(]?[^\Wa-z\d_])|\n\s*\n")
TOKEN = re.compile(r"[^\W\d_][^\W\d_'’-]*[^\W\d_]|[aAI]\b")


def read(text: str) -> tuple[float, str, list[str]]:
    """(share of the letters that is in sentences, language of these, their words in lower case)."""
    kept: list[str] = []
    inside = 0
    for s in SENTENCE.split(text):
        s = s.strip()
        if not s or s[-1] not in ".!?\"')" or s[0] in "{[|<" or "\t" in s or " | " in s or ": {" in s:
            continue
        lines = s.split("\n")
        if len(lines) > 1 and any(not x.rstrip() or len(x) < 30 and x[:1].isupper() and not x.rstrip().endswith((".", ",")) for x in lines[:-1]):
            s = " ".join(lines[1 + max(i for i, x in enumerate(lines[:-1]) if not x.rstrip() or len(x) < 30) :])  # a heading stands before the sentence
        words = TOKEN.findall(s.lower())
        if len(words) < 4:
            continue
        inside += len(s)
        kept += words
    n = len(kept)
    best, share = "und", 0.0
    for k, common in FUNCTION_SETS.items():
        if n and (x := sum(map(common.__contains__, kept)) / n) > share:
            best, share = k, x
    return inside / max(1, len(text.strip())), best if share >= ENGLISH_SHARE else "und", kept


def counted(documents: DataFrame) -> DataFrame:
    """doc_id, share, lang, n, words, counts of every document with text."""
    def make():
        def each(doc_id, text):
            share, lang, words = read(text)
            found = Counter(words)
            return [(doc_id, share, lang, len(words), list(found), list(found.values()))]

        return each

    rows = documents.where("doc_id is not null and text rlike '\\\\S'").select("doc_id", "text")
    return map_rows(rows, "doc_id bigint, share double, lang string, n int, words array<string>, counts array<int>", make)


STEPS = len(GRID)
_SUMS = [f"x{i}" for i in range(STEPS)]


def _words(held: DataFrame) -> DataFrame:
    """word, weight, b, d of every word, from documents with a level step `k`. A task's sums per word come as one row."""
    exposed = np.zeros(STEPS)
    for k, n in held.groupBy("k").agg(F.sum("n")).collect():  # a row per step
        exposed[k] = n

    def count(batches):
        for batch in batches:
            k, words, counts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            coded = words.flatten().dictionary_encode()
            at = coded.indices.to_numpy() * STEPS + np.repeat(k, np.diff(words.offsets.to_numpy()))
            table = np.bincount(at, np.sqrt(counts.flatten().to_numpy()), len(coded.dictionary) * STEPS).reshape(-1, STEPS)
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, table.T)], names=["word", *_SUMS])

    summed = held.select("k", "words", "counts").mapInArrow(count, "word string, " + ", ".join(f"{x} double" for x in _SUMS)).groupBy("word").agg(*[F.sum(x).alias(x) for x in _SUMS])

    def fitted(batches):
        for batch in batches:
            seen = np.stack([batch.column(1 + i).to_numpy() for i in range(STEPS)], 1)
            b, d = difficulty(seen, exposed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen.sum(1)), pa.array(b), pa.array(d)], names=["word", "weight", "b", "d"])

    return materialize(summed.mapInArrow(fitted, "word string, weight double, b double, d double"))


def difficulty(seen: np.ndarray, exposed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b and d of each word by Newton steps, from its counts per level step and the words read at each step."""
    t = GRID - 3
    b, d = np.log((seen.sum(1) + 0.1) / (exposed.sum() + 1)), np.zeros(len(seen))
    for _ in range(25):
        rate = exposed * np.exp(np.clip(b[:, None] + d[:, None] * t, -40, 5))
        r = seen - rate
        gb, gd = r.sum(1) + 0.1 - 0.1 * rate.sum(1) / np.maximum(seen.sum(1), 0.1), (r * t).sum(1) - d / SLOPE_SD**2
        hbb, hbd, hdd = rate.sum(1) + 0.1, (rate * t).sum(1), (rate * t * t).sum(1) + 1 / SLOPE_SD**2
        det = np.maximum(hbb * hdd - hbd**2, 1e-9)
        b += np.clip((hdd * gb - hbd * gd) / det, -1, 1)
        d += np.clip((hbb * gd - hbd * gb) / det, -1, 1)
    return b, np.clip(d, -4, 4)


_KEPT = "n int, words array<string>, counts array<int>, "


def _totals(docs: DataFrame, words: DataFrame, keep: bool) -> DataFrame:
    """doc_id, weight, sum_b, sum_d (the sums of each document over its words), label and, with keep, n, words, counts."""
    frequent = words.orderBy(F.desc("weight"), "word").limit(VOCABULARY).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).combine_chunks() if c == "word" else frequent.column(c).to_numpy() for c in ("word", "b", "d")))

    def run(batches):
        vocabulary, b, d = shared.value
        for batch in batches:
            lists = batch.column(2)
            n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            at = np.repeat(np.arange(len(n)), n)
            weight = np.sqrt(batch.column(3).flatten().to_numpy())
            index = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy()
            known = index >= 0
            sums = [np.bincount(at[known], (weight * x)[known], len(n)) for x in (np.where(known, 1.0, 0.0), np.where(known, b[index], 0.0), np.where(known, d[index], 0.0))] if len(b) else [np.zeros(len(n))] * 3
            rare = np.flatnonzero(~known)
            starts = np.concatenate(([0], np.cumsum(np.bincount(at[rare], minlength=len(n)))))
            rest = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in (flat.take(pa.array(rare)), pa.array(weight[rare]))]
            kept = [batch.column(i) for i in (1, 2, 3)] if keep else []  # the documents go along: no shuffle brings them back
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), batch.column(4), *kept, *rest], names=["doc_id", "weight", "sum_b", "sum_d", "label", *(["n", "words", "counts"] if keep else []), "rare", "rare_weights"])

    out = docs.select("doc_id", "n", "words", "counts", "label").mapInArrow(run, "doc_id bigint, weight double, sum_b double, sum_d double, label double, " + (_KEPT if keep else "") + "rare array<string>, rare_weights array<double>")
    if words.count() <= VOCABULARY:  # no word is left
        return out.drop("rare", "rare_weights")
    out = materialize(out)
    long = out.select("doc_id", F.explode(F.arrays_zip("rare", "rare_weights")).alias("x")).select("doc_id", F.col("x.rare").alias("word"), F.col("x.rare_weights").alias("w"))
    more = long.join(words.select("word", "b", "d"), "word").groupBy("doc_id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("b")).alias("wb"), F.sum(F.col("w") * F.col("d")).alias("wd"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0.0))).alias(a)
    return out.join(more, "doc_id", "left").select("doc_id", plus("weight", "w"), plus("sum_b", "wb"), plus("sum_d", "wd"), "label", *(["n", "words", "counts"] if keep else []))


def _levels(docs: DataFrame, words: DataFrame, anchored: bool, keep: bool = False) -> DataFrame:
    """doc_id, k (the most likely step), level (the mean over the steps' likelihoods), fit (the log likelihood at k) and, with keep, n, words, counts."""
    t = GRID - 3
    mass = words.agg(F.array(*[F.sum(F.exp(F.col("b") + F.col("d") * float(x))) for x in t])).first()[0]
    mass = np.log(np.maximum(np.array([x or 0.0 for x in mass]), 1e-30))
    prior = -(t**2) / (2 * LEVEL_SD**2)

    def run(batches):
        for batch in batches:
            weight, sum_b, sum_d = (batch.column(i).to_numpy()[:, None] for i in (1, 2, 3))
            ll = sum_b + sum_d * t - weight * mass + prior
            if anchored:
                label = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(label)
                ll[known] = ll[known] * WORDS_WEIGHT - (label[known][:, None] - GRID) ** 2 / (2 * LABEL_SD**2)
            p = np.exp(ll - ll.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            kept = [batch.column(i) for i in range(5, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ll.argmax(1), pa.int32()), pa.array(p @ GRID, pa.float64()), pa.array(ll.max(1)), *kept], names=["doc_id", "k", "level", "fit", *(["n", "words", "counts"] if keep else [])])

    totals = _totals(docs, words, keep).drop("rare", "rare_weights")
    return totals.mapInArrow(run, "doc_id bigint, k int, level double, fit double" + (", " + _KEPT.rstrip(", ") if keep else ""))


def _prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n, words, counts, label of the documents that are English prose; label is the mean of the annotators'."""
    consensus = labels.where("level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("label"))
    english = counted(documents).where((F.col("share") >= PROSE_SHARE) & (F.col("lang") == "en") & (F.col("n") >= 4)).drop("share", "lang")
    return materialize(english.join(consensus, "doc_id", "left"))


def _rounds(docs: DataFrame) -> Iterator[DataFrame]:
    """The words' parameters after each round; none without a labelled document. The first round has the labelled documents only."""
    first = docs.where("label is not null")
    if first.isEmpty():
        return
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.round((F.col("label") - float(GRID[0])) / 0.25))).cast("int")
    words = _words(first.withColumn("k", step))
    yield words
    for _ in range(ROUNDS - 1):
        held = materialize(_levels(docs, words, True, keep=True).select("k", "n", "words", "counts"))
        words = _words(held)
        discard(held)
        yield words


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, level of every document that is English prose; on the labels' scale.

    Null and blank texts and texts that aren't English prose have none. Null labels and labels of unknown documents
    are ignored; a document's label is the mean of its annotators'. Without any label there is no scale and no row.
    """
    docs, words = _prose(documents, labels), None
    for words in _rounds(docs):
        pass
    if words is None:
        return docs.select("doc_id", F.col("label").alias("level")).where("false")
    return _levels(docs, words, False).select("doc_id", "level")


def fit_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """round, n_words, n_documents, log_likelihood, n_demanding: what each round of the estimation reaches; no label, no row."""
    docs = _prose(documents, labels)
    out = docs.sparkSession.createDataFrame([], "round int, n_words bigint, n_documents bigint, log_likelihood double, n_demanding bigint")
    for i, words in enumerate(_rounds(docs), 1):
        reached = _levels(docs, words, True).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("fit").alias("log_likelihood"), F.count_if(F.col("level") >= DEMANDING).alias("n_demanding"))
        out = out.unionByName(reached.select(F.lit(i).alias("round"), F.lit(words.count()).alias("n_words"), "*"))
    return out


def demanding(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return reading_levels(documents, labels).where(F.col("level") >= DEMANDING).select("doc_id")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, level_step, n_documents: how demanding each source's English prose is."""
    levels = reading_levels(documents, labels).join(documents.select("doc_id", "source"), "doc_id")
    return levels.groupBy("source", F.round("level").cast("int").alias("level_step")).agg(F.count(F.lit(1)).alias("n_documents"))
