"""Incremental caches keyed by content: what can be reused, what is stale, what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import last_wins


def latest_rows(cache: DataFrame, key: str = "page_id", seq: str = "cache_seq") -> DataFrame:
    """The row written last per key; rows without a key are dropped."""
    return last_wins(cache.where(F.col(key).isNotNull()), [key], F.col(seq))


def commonest(df: DataFrame, column: str) -> str | None:
    """The most frequent non-null value; ties go to the smaller."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).collect()
    return top[0][0] if top else None


def cache_state(cache: DataFrame, manifest: DataFrame, config: str | None, images: DataFrame | None = None) -> DataFrame:
    """page_id, state of every cached or listed page: reused, stale (other configuration or another image), failed, orphan (not in the manifest) or pending (no row).

    images: page_id, image_sha256 of the pages' images as they are now, one row a page; a page it lacks keeps its
    image. manifest and cache may repeat pages: the manifest counts a page once, of the cache the last row holds.
    """
    rows = latest_rows(cache).select("page_id", F.coalesce("ocr_ok", F.lit(False)).alias("ok"), F.col("ocr_config_sha256").alias("config"), F.col("image_sha256").alias("image"), F.lit(True).alias("cached"))
    listed = manifest.where("page_id is not null").select("page_id").distinct().withColumn("listed", F.lit(True))
    joined = listed.join(rows, "page_id", "full_outer")
    changed = F.lit(False)
    if images is not None:
        joined = joined.join(images.select("page_id", F.col("image_sha256").alias("now")), "page_id", "left")
        changed = F.col("now").isNotNull() & ~F.coalesce(F.col("image") == F.col("now"), F.lit(False))
    state = (F.when(F.col("listed").isNull(), "orphan").when(F.col("cached").isNull(), "pending")
             .when(F.coalesce(F.col("config") != F.lit(config), F.lit(True)) | changed, "stale").when(~F.col("ok"), "failed").otherwise("reused"))
    return joined.select("page_id", state.alias("state"))


def upsert(state: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """State after a batch: the row with the larger seq holds, so a batch that comes twice changes nothing."""
    return last_wins(state.unionByName(batch), [key], F.col(seq))


def insert_if_absent(rows: DataFrame, key: str, order: Column, existing: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first of each key that `existing` lacks."""
    from .ordering import first_wins

    new = first_wins(rows.where(F.col(key).isNotNull()), [key], order)
    return new if existing is None else new.join(existing.select(key), key, "left_anti")


def matching(existing: DataFrame, current: DataFrame, *on: str) -> DataFrame:
    """Existing rows that the current inputs still ask for: equal in all columns of `on` (id and fingerprint)."""
    return existing.join(current.select(*on).distinct(), list(on), "left_semi")


def vector_states(items: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """position, id, state of every item (position, id, input_hash): reuse, invalidate (other input), embed, or deferred beyond the first `limit` to embed.

    vectors: id, input_hash of what is cached, one row an id. Both invalid and missing items are embedded, in the items' order.
    """
    known = vectors.select("id", F.col("input_hash").alias("cached_hash"), F.lit(True).alias("cached"))
    j = items.join(known, "id", "left").withColumn("kept", F.coalesce(F.col("cached_hash") == F.col("input_hash"), F.lit(False)))
    last = j.where(~F.col("kept")).orderBy("position").limit(limit).agg(F.max("position")).first()[0]  # the limit is the feature
    state = F.when(F.col("kept"), "reuse").when(F.col("position") > F.lit(last), "deferred").when(F.col("cached"), "invalidate").otherwise("embed")
    return j.select("position", "id", state.alias("state"))
