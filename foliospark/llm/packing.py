"""Problem 6: items into containers of fixed capacity by a grouping genetic algorithm.

Items are dealt at random into blocks of about BLOCK. Every block has several islands, each a population of
packings evolved by its own task: crossover injects whole well-filled bins of one parent into the other, drops the
bins that hold an injected item, and puts displaced items back by best fit, for as long as this gains. Between the rounds each island's best
packing migrates to the next island of its block. The best island of a block wins; bins that stayed badly filled
are dissolved, dealt into new blocks and packed once more, so that no block keeps a badly filled rest of its own.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from itertools import chain, compress
from math import sumprod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, settled
from .common import lists
from .tokens import TOKENIZER, with_tokens

BLOCK, ISLANDS, ROUNDS = 512, 2, 3
POPULATION, CHILDREN = 8, 4
#: An island stops after so many generations without a better packing, or at one that no packing has fewer containers than.
PATIENCE = 10
#: Bins filled less are dissolved and packed again with those of other blocks.
WELL_FILLED = 0.97


class Packing(list):
    """Bins, each a tuple of items, the fullest first; rooms: what is left in each."""

    __slots__ = ("rooms",)


def packing(bins, rooms) -> Packing:
    out = Packing(bins)
    out.rooms = rooms
    return out


def best_fit(order, sizes, capacity: int, bins=(), rooms=()) -> Packing:
    """Items, in this order, each into the bin it fills most; new bins as needed. The fullest bin comes first."""
    bins, n = [*bins], len(bins)
    bits = (n + len(order)).bit_length()  # a bin's room and number in one integer: number in the last bits
    last = (1 << bits) - 1
    codes = sorted([(r << bits) + k for k, r in enumerate(rooms)])
    for i in order:
        size = sizes[i] << bits
        at = bisect_left(codes, size)
        if at < n:
            code = codes.pop(at)
            bins[code & last] += (i,)
            insort(codes, code - size, 0, at)
        else:
            insort(codes, (capacity << bits) - size + n)
            bins.append((i,))
            n += 1
    return packing([bins[c & last] for c in codes], [c >> bits for c in codes])


def fitness(bins: Packing, capacity: int) -> float:
    """Mean squared fill: a full and an empty bin are worth more than two half full ones."""
    n, rooms = len(bins), bins.rooms
    return (n * capacity * capacity - 2 * capacity * sum(rooms) + sumprod(rooms, rooms)) / (capacity * capacity * max(1, n))


def crossover(a: Packing, b: Packing, sizes, capacity: int, rng: random.Random, places: list[int] | None = None) -> Packing:
    """Whole well-filled bins of b injected into a. The fullest bins come first in both. places: where(a), if known."""
    draw = rng.random
    picked = [draw() < 0.5 for _ in range(max(1, len(b) // 2))]
    if True not in picked:
        picked = [True]
    donors = [*compress(b, picked)]
    injected = {*chain.from_iterable(donors)}
    hit = set(map((places or where(a, len(sizes))).__getitem__, injected))
    kept = [k not in hit for k in range(len(a))]
    displaced = [i for k in sorted(hit) for i in a[k] if i not in injected]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, [*compress(a, kept), *donors], [*compress(a.rooms, kept), *compress(b.rooms, picked)])


def where(bins, n: int) -> list[int]:
    """The bin of each of n items."""
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def mutate(bins: Packing, sizes, capacity: int, rng: random.Random) -> Packing:
    """Dissolves the worst bins and a few others. The fullest bins come first."""
    n = len(bins) - max(1, len(bins) // 10)
    draw = rng.random
    kept = [draw() >= 0.05 for _ in range(n)]
    loose = [*chain.from_iterable(bins[n:]), *chain.from_iterable([bins[k] for k in range(n) if not kept[k]])]
    rng.shuffle(loose)
    return best_fit(loose, sizes, capacity, [*compress(bins, kept)], [*compress(bins.rooms, kept)])


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: items too large to stand beside each other, and the room they leave to the rest (Martello and Toth's second bound)."""
    n, up = len(sizes), np.sort(np.array(sizes, "int64"))
    sums = np.append(0, np.cumsum(up[::-1]))  # of so many of the largest
    half = n - int(np.searchsorted(up, capacity / 2, "right"))  # items over half a bin
    small = up[: n - half]
    big = n - np.searchsorted(up, capacity - small, "right")  # items that don't go beside one of these
    end = n - np.searchsorted(up, small)
    more = -(-(sums[end] - sums[half] - ((half - big) * capacity - sums[half] + sums[big])) // capacity)
    return max(half + int(more.max(initial=0)), -(-int(sums[-1]) // capacity))


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[int]]) -> list[int]:
    """The bin of each item in the best packing found. guests: packings to start from, as bin numbers."""
    rng = random.Random(seed)
    draw = rng.random
    n = len(sizes)
    least = least_bins(sizes, capacity)
    down = sorted(range(n), key=lambda i: (-sizes[i], i))
    people = []
    for g in guests:
        made: dict[int, list[int]] = {}
        for i, k in enumerate(g):
            made.setdefault(k, []).append(i)
        rooms = {k: capacity - sum([sizes[i] for i in b]) for k, b in made.items()}
        order = sorted(made, key=rooms.__getitem__)
        people.append(packing([tuple(made[k]) for k in order], [rooms[k] for k in order]))
    if not people:
        people = [best_fit(down, sizes, capacity)]
    while len(people) < POPULATION and not (len(people[0]) <= least):
        shaken = np.array([-x * (0.7 + (1.3 - 0.7) * draw()) for x in sizes])
        people.append(best_fit(np.argsort(shaken, kind="stable").tolist(), sizes, capacity))
    rated = [(len(p), -fitness(p, capacity), k, p) for k, p in enumerate(people)]
    rated.sort()
    born, since, places = len(rated), 0, {}
    while rated[0][0] > least and len(rated) > 1 and since < PATIENCE:
        before = rated[0][:2]
        for _ in range(CHILDREN):
            a, b = rng.sample(rated[: max(2, POPULATION // 2 + 1)], 2)
            if a[2] not in places:
                places[a[2]] = where(a[3], n)
            child = crossover(a[3], b[3], sizes, capacity, rng, places[a[2]])
            if rng.random() < 0.4:
                child = mutate(child, sizes, capacity, rng)
            rated.append((len(child), -fitness(child, capacity), born, child))
            born += 1
        rated = sorted(rated)[:POPULATION]
        since = 0 if rated[0][:2] < before else since + 1
    return where(rated[0][3], n)


def _pack_blocks(items: DataFrame, blocks: int, salt: int) -> DataFrame:
    """item, size, capacity, container of items dealt into `blocks` blocks; container is unique per capacity and salt."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(blocks)).cast("int"))
    state = (dealt.groupBy("capacity", "block").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("items"))
             .select("capacity", "block", F.col("items.item").alias("items"), F.col("items.size").alias("sizes")))
    state = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")).withColumn("guests", F.array().cast("array<array<int>>"))
    state = state.repartition("capacity", "block", "island")
    for round_ in range(ROUNDS):
        def run(batches, round_=round_):
            for batch in batches:
                *same, guests = batch.columns  # items stay in Arrow
                capacity, block, island = (x.to_pylist() for x in same[:3])
                bins = [evolve(z, c, hash((b, i, round_, salt)), g) for c, b, i, z, g in zip(capacity, block, island, lists(same[4]), lists(guests))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(bins, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "bins"])

        evolved = state.select("capacity", "block", "island", "items", "sizes", "guests").mapInArrow(run, "capacity int, block int, island int, items array<string>, sizes array<int>, bins array<int>")
        worth = F.struct((-F.array_max("bins")).alias("bins"), (-F.col("island")).alias("island"))
        if round_ == ROUNDS - 1:
            state = evolved.groupBy("capacity", "block").agg(F.max_by(F.struct("items", "sizes", "bins"), worth).alias("b"))
            break
        state = (evolved.groupBy("capacity", "block").agg(F.first("items").alias("items"), F.first("sizes").alias("sizes"), F.map_from_entries(F.collect_list(F.struct("island", "bins"))).alias("best"))
                 .select("*", F.explode(F.map_keys("best")).alias("island"))
                 .withColumn("guests", F.array(F.element_at("best", F.col("island")), F.element_at("best", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
                 .repartition("capacity", "block", "island"))
    packed = state.select("capacity", "block", F.explode(F.arrays_zip("b.items", "b.sizes", "b.bins")).alias("x"))
    return packed.select(F.col("x.items").alias("item"), F.col("x.sizes").alias("size"), "capacity", F.concat_ws("-", F.lit(salt), "block", "x.bins").alias("container"))


def pack(items: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, container, item, piece, size for every capacity; items are (item string, size int).

    Items without size are left out. One that exceeds the capacity is split into full pieces and a rest; only the
    rest is packed with others. Empty tables give no rows.
    """
    each = items.where("size > 0 and item is not null").withColumn("capacity", F.explode(F.array(*[F.lit(int(c)) for c in sorted(capacities)])))
    pieces = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    cut = each.select("item", "capacity", F.posexplode(F.transform(F.sequence(F.lit(1), pieces), lambda i: F.when(i < pieces, F.col("capacity")).otherwise(F.col("size") - (pieces - 1) * F.col("capacity")).cast("int"))).alias("piece", "part"))
    cut = materialize(cut.select("capacity", F.concat_ws("#", "item", "piece").alias("item"), F.col("part").alias("size")))
    whole = cut.where("size = capacity").select("item", "size", "capacity", F.concat_ws("-", F.lit("w"), "item").alias("container"))
    rest = cut.where("size < capacity")
    n = rest.count() // max(1, len(capacities))
    first = materialize(_pack_blocks(rest, max(1, n // BLOCK), 1))
    fill = first.groupBy("capacity", "container").agg((F.sum("size") / F.first("capacity")).alias("fill"))
    poor = fill.where(F.col("fill") < WELL_FILLED).select("capacity", "container")
    loose = materialize(first.join(poor, ["capacity", "container"], "left_semi").select("item", "size", "capacity"))
    again = _pack_blocks(loose, max(1, loose.count() // (BLOCK * max(1, len(capacities)))), 2)
    kept = first.join(poor, ["capacity", "container"], "left_anti").select("item", "size", "capacity", "container")
    return whole.unionByName(kept).unionByName(again).select("capacity", "container", F.substring_index("item", "#", 1).alias("item"), F.substring_index("item", "#", -1).cast("int").alias("piece"), "size")


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """item, size of every document with text."""
    return with_tokens(documents.where("doc_id is not null and text is not null"), "doc_id", path=path).select(F.col("doc_id").cast("string").alias("item"), F.col("tokens").cast("int").alias("size"))


def packed_documents(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """container_kind, container, doc_id, piece, tokens. containers has a handful of rows; a null or non-positive capacity is none."""
    return _packed(documents, containers, path).drop("capacity")


def _packed(documents: DataFrame, containers: DataFrame, path: str) -> DataFrame:
    """packed_documents() with the capacity."""
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").alias("capacity"))
    capacities = [r[0] for r in kinds.select("capacity").distinct().collect()]
    return (pack(materialize(sized(documents, path)), capacities).join(F.broadcast(kinds), "capacity")
            .select("container_kind", "capacity", "container", F.col("item").cast("bigint").alias("doc_id"), "piece", F.col("size").alias("tokens")))


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, n_containers, tokens, fill, least_containers (no packing has fewer)."""
    total = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens"))
    return (total.join(F.broadcast(containers), "container_kind")
            .select("container_kind", "n_containers", "tokens", (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")))


def oversize_documents(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id of the documents that the packing into containers of every kind had to split even for the largest."""
    largest = containers.where("capacity_tokens > 0").agg(F.max("capacity_tokens").alias("largest"))
    packed = _packed(documents, containers, path).join(F.broadcast(largest), F.col("capacity") == F.col("largest"))
    return packed.where("piece >= 1").select("doc_id").distinct()


def packing_check(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """container_kind, n_documents, n_overfull, n_incomplete, n_cut: what a packing must keep to. A document is incomplete if
    its pieces don't add up to its tokens, and cut if it is in more pieces than it needs."""
    sizes = settled(lambda: sized(documents, path))
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").alias("capacity"))
    packed = materialize(pack(sizes, [r[0] for r in kinds.select("capacity").distinct().collect()]))
    full = packed.groupBy("capacity", "container").agg(F.sum("size").alias("fill")).groupBy("capacity").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("n_overfull"))
    back = packed.groupBy("capacity", "item").agg(F.sum("size").alias("packed"), F.count(F.lit(1)).alias("pieces")).join(sizes, "item")
    kept = back.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("packed") != F.col("size")).alias("n_incomplete"), F.count_if(F.col("pieces") > F.ceil(F.col("size") / F.col("capacity"))).alias("n_cut"))
    return kept.join(full, "capacity").join(F.broadcast(kinds), "capacity").select("container_kind", "n_documents", "n_overfull", "n_incomplete", "n_cut")
