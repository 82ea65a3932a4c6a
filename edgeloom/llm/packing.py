"""Filling fixed-capacity containers with items (problem 7).

Method: best-fit decreasing with a segment tree over remaining capacities. Sizes are whole tokens, so items of one size and
open containers with one remaining capacity are alike: the tree has a leaf per remaining capacity, and the tightest fit for
a size is found in logarithmic time. One step places as many equal items as the containers of that remaining capacity take,
which gives the very packing that item by item gives. The state depends on the capacity only: at most ``capacity`` counts
come to the driver, whatever the number of items, and the plan that goes back names ranges of items and of containers.
Items take their place in the plan by their rank among the items of their size; ranks are counted in salted groups, so a
size that many items share is no hot group.

Defined cases: an item over the capacity is split into full containers and a rest that is packed like any item; an item of
size 0 takes no room and is spread over the containers (all share one container if there is none); a null size is 0;
repeated ids are items of their own; capacities below 1 are refused; no items give no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_if_small, cut

#: Items per rank group; only the number of salts depends on it.
ITEMS_PER_GROUP = 100_000


class Tightest:
    """Segment tree over 0..capacity: the least remaining capacity, at least a given one, that has an open container."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, leaf: int, on: bool) -> None:
        i = leaf + self.width
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def first_from(self, leaf: int) -> int | None:
        i = leaf + self.width
        if self.any[i]:
            return leaf
        while i > 1:  # up to the first right sibling that has something, then down its left edge
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_plan(counts: Mapping[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first rank, items per container, first container)..., containers) for counts of items by size 1..capacity.

    Item ``rank`` of ``size`` goes to container ``first + (rank - first rank) // items per container`` of the last step
    of its size that begins at or before the rank.
    """
    tree, opened = Tightest(capacity), {}
    steps, containers = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n:
            if not opened.setdefault(left, []):
                tree.set(left, True)
            opened[left].append((first, n))

    for size in sorted((s for s, n in counts.items() if s > 0 and n > 0), reverse=True):
        todo, rank = counts[size], 0
        while todo:
            room = tree.first_from(size)
            if room is None:
                room, first, n = capacity, containers, -(-todo // (capacity // size))
                containers += n
            else:
                first, n = opened[room].pop()
                if not opened[room]:
                    tree.set(room, False)
            each = room // size
            placed = min(todo, n * each)
            full, rest = divmod(placed, each)
            steps.append((size, rank, each, first))
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            used = full + (rest > 0)
            put(room, first + used, n - used)
            todo, rank = todo - placed, rank + placed
    return steps, containers


def _assigner(shared: Broadcast[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for b in batches:
            size_id = b.column("size_id").to_numpy()
            size, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
            at = np.zeros(len(size), np.int64)
            for sid in np.unique(size_id):
                keys, each, first, containers = plans[int(sid)]
                m = (size_id == sid) & (size == 0)
                at[m] = rank[m] % max(1, containers)
                m = np.flatnonzero((size_id == sid) & (size > 0))
                if len(m):
                    k = np.searchsorted(keys, (size[m] << 48) + rank[m], side="right") - 1
                    at[m] = first[k] + (rank[m] - (keys[k] & ((1 << 48) - 1))) // each[k]
            yield pa.RecordBatch.from_arrays(
                [b.column("size_id"), b.column("item"), b.column("piece"), pa.array(at), b.column("tokens")],
                names=["size_id", "item", "piece", "container", "tokens"],
            )

    return run


def pack(items: DataFrame, capacities: Mapping[int, int], id_col: str, size_col: str) -> DataFrame:
    """(size_id, item, piece, container, tokens): for each capacity, the container of each piece of each item."""
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be at least 1")
    sizes = cut(items.select(F.col(id_col).cast("bigint").alias("item"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("n")))
    caps = F.array(*(F.struct(F.lit(int(k)).alias("size_id"), F.lit(int(v)).cast("bigint").alias("capacity")) for k, v in capacities.items()))
    whole = F.expr("n div capacity")
    rest = F.col("n") % F.col("capacity")
    lengths = F.when(rest > 0, F.concat(F.array_repeat("capacity", whole.cast("int")), F.array(rest))).when(
        F.col("n") == 0, F.array(F.lit(0).cast("bigint"))
    ).otherwise(F.array_repeat("capacity", whole.cast("int")))
    pieces = sizes.select("item", "n", F.inline(caps)).select("size_id", "item", F.posexplode(lengths).alias("piece", "tokens"))
    # At most capacity + 1 rows per capacity, whatever the number of items.
    counts: dict[int, dict[int, int]] = {int(k): {} for k in capacities}
    for r in pieces.groupBy("size_id", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.size_id][r.tokens] = r.n
    # Only sizes that many items share get salts, so there are no more groups than sizes and items/ITEMS_PER_GROUP.
    spread = [(k, t, -(-n // ITEMS_PER_GROUP)) for k, per in counts.items() for t, n in per.items() if n > ITEMS_PER_GROUP]
    spark = items.sparkSession
    if spread:
        salts = spark.createDataFrame(spread, "size_id int, tokens bigint, salts int")
        pieces = pieces.join(F.broadcast(salts), ["size_id", "tokens"], "left")
        pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        tally = pieces.join(F.broadcast(salts.select("size_id", "tokens")), ["size_id", "tokens"]).groupBy("size_id", "tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    else:
        pieces, tally = pieces.withColumn("salt", F.lit(0)), None
    plans = {}
    for sid, capacity in capacities.items():
        steps, containers = best_fit_plan(counts[int(sid)], int(capacity))
        s = np.array(steps, np.int64).reshape(-1, 4)
        s = s[np.lexsort((s[:, 1], s[:, 0]))]
        plans[int(sid)] = ((s[:, 0] << 48) + s[:, 1], s[:, 2], s[:, 3], containers)

    within = Window.partitionBy("size_id", "tokens", "salt").orderBy("item", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
    if tally is not None:
        before = Window.partitionBy("size_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = tally.select("size_id", "tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        ranked = ranked.join(broadcast_if_small(offsets), ["size_id", "tokens", "salt"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0)))
    ranked = ranked.select("size_id", "item", "piece", "tokens", "rank")
    return ranked.mapInArrow(_assigner(spark.sparkContext.broadcast(plans)), "size_id int, item bigint, piece int, container bigint, tokens bigint")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(size_id, containers, tokens, fill): how full the containers of each capacity are."""
    used = packed.groupBy("size_id", "container").agg(F.sum("tokens").alias("used"))
    per = used.groupBy("size_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return per.join(F.broadcast(capacities), "size_id").select(
        "size_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )
