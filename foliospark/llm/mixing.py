"""Problem 7: sources mixed to target weights.

Every source's records are dealt at random into blocks, once per repeat, each repeat with a permutation of its
own. A source's quota in tokens fixes how many of its blocks are used; the last one is cut to the quota at a
record. The block quotas are divided among the output shards by a splitting tree: at each node the left half's
share of every source is a multivariate hypergeometric draw without replacement. A shard walks the tree from the root on
its own, as every node's draw has a seed of its own, so shards need no common step; the walk also gives the
disjoint range of each source's permuted blocks that is the shard's. Inside a shard records are ordered by a
keyed hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import running
from ..session import materialize
from .common import map_rows
from .tokens import TOKENIZER, with_tokens

#: Blocks of the whole mix: at least this many, and more where a block would pass MOST_TOKENS.
BLOCKS, MOST_TOKENS = 4096, 4_000_000
#: Tokens of an output shard, and shards at least.
SHARD_TOKENS, LEAST_SHARDS, SEED = 32_000_000, 8, 20_26


def source_key(source: Column) -> Column:
    """Spellings that differ in case, spacing or hyphens are one source; '' for null."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(source, F.lit("")))), r"[\s\-_‐–]+", "_")


def split_counts(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) per source of one shard: a walk down the splitting tree."""
    lo, hi = 0, shards
    start, counts = np.zeros_like(counts), counts.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = int(counts.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts
        if shard < mid:
            counts, hi = left, mid
        else:
            start, counts, lo = start + left, counts - left, mid
    return start, counts


def _sizes(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, key, tokens of every row; a row without text has 0."""
    keyed = documents.select("doc_id", "text", source_key(F.col("source")).alias("key"))
    return materialize(with_tokens(keyed, "doc_id", "key", path=path))


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, key, share, max_repeats, total, quota, available, records: one row per target source.

    Null or negative shares and repeats count as 0; the total is that of all rows, whatever their source.
    """
    t = targets.where("source is not null").select("source", source_key(F.col("source")).alias("key"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"),
                                                   F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    have = sizes.groupBy("key").agg(F.sum("tokens").alias("available"), F.count_if(F.col("tokens") > 0).alias("records"))
    total = have.agg(F.sum("available")).first()[0] or 0
    return (t.withColumn("total", F.lit(total).cast("bigint")).join(have, "key", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "records": F.coalesce("records", F.lit(0))})
            .withColumn("quota", F.floor(F.col("share") * F.col("total")).cast("bigint")))


def shards_of(plan: DataFrame) -> int:
    """The number of shards grows with the mix, so that no shard outgrows a task."""
    return max(LEAST_SHARDS, -(-(plan.agg(F.sum("quota")).first()[0] or 0) // SHARD_TOKENS))


def mixed(sizes: DataFrame, plan: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """shard, source, doc_id, repeat, tokens, order_key of every use of a record.

    A source that can't reach its quota gives all records max_repeats times. plan has one row per source and is broadcast.
    """
    shards = shards or shards_of(plan)
    per = F.greatest(F.least(F.ceil(F.col("total") / BLOCKS), F.lit(MOST_TOKENS)), F.lit(1))
    p = plan.where("quota > 0 and available > 0 and max_repeats > 0").withColumns({
        "repeats": F.least(F.col("max_repeats"), F.ceil(F.col("quota") / F.col("available"))).cast("int"), "blocks": F.ceil(F.col("available") / per).cast("int")})
    uses = (sizes.where("tokens > 0").join(F.broadcast(p.select("key", "source", "repeats", "blocks", "quota", "max_repeats", "available")), "key")
            .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats")))))
    dice = F.xxhash64("doc_id", "repeat", F.lit(seed))
    uses = uses.select("source", "doc_id", "repeat", "tokens", "quota", F.pmod(dice, F.col("blocks")).cast("int").alias("block"), F.xxhash64(F.lit(seed + 1), "doc_id", "repeat").alias("order_key"))
    blocks = materialize(uses.groupBy("source", "repeat", "block").agg(F.sum("tokens").alias("tokens"), F.first("quota").alias("quota")))
    dealt = blocks.withColumn("dice", F.xxhash64(F.lit(seed + 2), "source", "repeat", "block"))
    # a source's blocks in order of repeat and dice, in 256 steps per repeat: a running total is no task's whole work
    upto = running(dealt, ["source"], F.col("repeat") * 256 + F.shiftright("dice", 56).cast("int") + 128, [F.col("repeat"), F.col("dice"), F.col("block")], {"upto": F.col("tokens"), "position": F.lit(1)})
    upto = upto.withColumn("position", F.col("position") - 1)
    used = materialize(upto.where(F.col("upto") - F.col("tokens") < F.col("quota"))
                       .select("source", "repeat", "block", "position", F.least(F.col("tokens"), F.col("quota") - (F.col("upto") - F.col("tokens"))).alias("room"), (F.col("upto") > F.col("quota")).alias("last")))
    counts = sorted((r[0], r[1]) for r in used.groupBy("source").agg(F.count(F.lit(1))).collect())  # one number per source
    names, numbers = [c[0] for c in counts], [c[1] for c in counts]

    def walk():
        def each(shard):
            start, n = split_counts(np.array(numbers, dtype=np.int64), shards, shard, seed)
            return [(shard, s, int(a), int(k)) for s, a, k in zip(names, start, n) if k]
        return each

    spark = sizes.sparkSession
    ranges = map_rows(spark.range(shards), "shard bigint, source string, start bigint, blocks bigint", walk)
    ranges = ranges.select("shard", "source", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("position"))
    placed = used.join(ranges, ["source", "position"])
    records = uses.drop("quota").join(placed, ["source", "repeat", "block"])
    cut = Window.partitionBy("source", "repeat", "block").orderBy("order_key", "doc_id")
    whole = records.where("not last").drop("room", "last", "block", "position")
    tail = records.where("last").withColumn("upto", F.sum("tokens").over(cut)).where("upto <= room").drop("room", "last", "block", "position", "upto")  # one block a source
    return whole.unionByName(tail).select("shard", "source", "doc_id", "repeat", "tokens", "order_key")


def mix(documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = SEED, path: str = TOKENIZER) -> DataFrame:
    """The mixed records, each shard in its shuffled order within its partition."""
    sizes = _sizes(documents, path)
    plan = materialize(quotas(sizes, targets))
    shards = shards or shards_of(plan)
    return mixed(sizes, plan, shards, seed).repartition(shards, "shard").sortWithinPartitions("shard", "order_key")


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """source, target_share, actual_share, tokens, quota, uses, most_repeats, reached of every target source.

    actual_share is of the mix's own tokens. reached is false where all uses of all records are in the mix and still miss the quota.
    """
    sizes = _sizes(documents, path)
    plan = materialize(quotas(sizes, targets))
    got = mixed(sizes, plan).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("repeat").alias("most_repeats"))
    made = materialize(plan.join(got, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "uses": F.coalesce("uses", F.lit(0))}))
    whole = made.agg(F.sum("tokens")).first()[0] or 1
    exhausted = F.col("uses") == F.col("records") * F.col("max_repeats")
    return made.select("source", F.col("share").alias("target_share"), (F.col("tokens") / F.lit(whole)).alias("actual_share"), "tokens", "quota", "uses",
                                                     F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (~(exhausted & (F.col("tokens") < F.col("quota")))).alias("reached"))


def mixing_check(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """source, n_overused, n_repeated, over_quota, short: what a mix must keep to. A record is overused beyond max_repeats uses,
    a use repeated if it comes twice; a source is short if it misses its quota by a whole record though records are left."""
    sizes = _sizes(documents, path)
    plan = materialize(quotas(sizes, targets))
    largest = sizes.groupBy("key").agg(F.max("tokens").alias("largest"))
    uses = mixed(sizes, plan).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("repeat").alias("repeats"), F.sum("tokens").alias("tokens"))
    uses = uses.join(F.broadcast(plan.select("source", "max_repeats")), "source")
    got = uses.groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("n_overused"), F.count_if(F.col("uses") != F.col("repeats")).alias("n_repeated"), F.sum("uses").alias("uses"), F.sum("tokens").alias("tokens"))
    j = plan.join(got, "source", "left").join(largest, "key", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    short = (n("uses") < F.col("records") * F.col("max_repeats")) & (F.col("quota") - n("tokens") > n("largest"))
    return j.select("source", n("n_overused").alias("n_overused"), n("n_repeated").alias("n_repeated"), (n("tokens") > F.col("quota")).alias("over_quota"), short.alias("short"))


def unreachable_sources(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """source of the targets that the mix can't reach."""
    return shares(documents, targets, path).where("not reached").select("source")
