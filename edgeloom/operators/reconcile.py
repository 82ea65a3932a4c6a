"""Differences between two copies of data (problem 2).

Method. Each side is cut into leaves, ranges of ``leaf_keys`` adjacent keys. A leaf's checksum is the count and the two
32-bit halves of the row hashes, summed; sums of both sides are taken with opposite signs in one pre-aggregated pass, so
equal leaves come out as zero. The signed leaf checksums of a wide key range form a tree whose nodes are differences of
prefix sums; the tree is bisected from its root and only mismatching halves are followed. Rows are read again, and fields
compared, only in the leaves that are left.

Defined cases: a repeated row only adds a leaf to compare, never a difference; an id that stands in several unequal rows
of one side is compared as the set of its values; a null id is an id of its own; null equals null and nothing else;
strings are compared by their bytes; empty tables on one side give every id of the other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_if_small, null_safe_hash

LEAF_KEYS = 16
LEAVES_PER_TREE = 1 << 14
#: Mismatching leaves (one bigint each) are broadcast up to this number, 8 MB; beyond it they are joined by shuffle.
BROADCAST_LEAVES = 1_000_000


def _bisect(tree: pa.Table) -> pa.Table:
    """Leaves of one tree whose signed checksum is not zero, found from the root by halving mismatching ranges."""
    leaf = tree["leaf"].to_numpy(zero_copy_only=False)
    order = np.argsort(leaf, kind="stable")
    sums = np.stack([tree[c].to_numpy()[order] for c in ("lo", "hi", "n")])
    prefix = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(sums, axis=1)], axis=1)
    lo, hi = np.array([0]), np.array([len(order)])
    while True:
        off = (prefix[:, hi] != prefix[:, lo]).any(axis=0)
        lo, hi = lo[off], hi[off]
        if not len(lo) or (hi - lo == 1).all():
            break
        mid = (lo + hi) // 2
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        keep = hi > lo
        lo, hi = lo[keep], hi[keep]
    return pa.table({"leaf": tree["leaf"].take(pa.array(order[lo]))})


def mismatching_leaves(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """(leaf) of the key ranges in which the two sides do not hold the same rows."""
    h = null_safe_hash(key, *fields)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.expr(f"`{key}` div {leaf_keys}").alias("leaf"), h.alias("h"), F.lit(sign).cast("bigint").alias("s"))

    sums = (
        signed(left, 1).unionByName(signed(right, -1)).groupBy("leaf")
        .agg(
            F.sum(F.col("s") * F.col("h").bitwiseAND(0xFFFFFFFF)).alias("lo"),
            F.sum(F.col("s") * F.shiftright("h", 32)).alias("hi"),
            F.sum("s").alias("n"),
        )
        .withColumn("tree", F.expr(f"leaf div {LEAVES_PER_TREE}"))
    )
    return sums.groupBy("tree").applyInArrow(_bisect, schema="leaf bigint")


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], names: tuple[str, str], leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """(key, diff): ``<left>_only``, ``<right>_only`` or the name of a field that differs."""
    leaf = F.expr(f"`{key}` div {leaf_keys}")
    bad = broadcast_if_small(mismatching_leaves(left, right, key, fields, leaf_keys), BROADCAST_LEAVES)

    def rows(df: DataFrame, side: int) -> DataFrame:
        return df.select(leaf.alias("leaf"), F.col(key).alias("key"), F.struct(*fields).alias("row"), F.lit(side).alias("side"))

    suspects = rows(left, 0).unionByName(rows(right, 1)).alias("r").join(
        bad.alias("b"), F.col("r.leaf").eqNullSafe(F.col("b.leaf")), "left_semi"
    )
    sides = suspects.where(F.col("key").isNotNull()).groupBy("leaf", "key").agg(
        *(F.collect_set(F.when(F.col("side") == i, F.col("row"))).alias(f"s{i}") for i in (0, 1))
    )

    def values(side: str, f: str):
        return F.array_sort(F.array_distinct(F.transform(side, lambda r: F.struct(r[f]))))

    diffs = F.when(F.size("s1") == 0, F.array(F.lit(f"{names[0]}_only"))).when(
        F.size("s0") == 0, F.array(F.lit(f"{names[1]}_only"))
    ).otherwise(
        F.array_compact(F.array(*(F.when(values("s0", f) != values("s1", f), F.lit(f)) for f in fields)))
    )
    found = sides.select("key", F.explode(diffs).alias("diff"))
    if bad.where(F.col("leaf").isNull()).isEmpty():
        return found
    return found.unionByName(_of_no_key(suspects.where(F.col("key").isNull()), fields, names))


def _of_no_key(rows: DataFrame, fields: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """The differences of the rows without a key, of which there may be very many: each value is counted by itself."""
    value = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"row.{f}").cast("string").alias("v")) for f in fields))).alias("x")
    sides = [F.max(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"s{i}") for i in (0, 1)]
    each = rows.select("key", "side", value).groupBy("key", "x").agg(*sides)
    off = [F.max(F.when((F.col("x.f") == f) & (F.col("s0") != F.col("s1")), F.lit(f))).alias(f"off_{f}") for f in fields]
    one = each.groupBy("key").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"), *off)
    only = F.when(F.col("s1") == 0, F.array(F.lit(f"{names[0]}_only"))).when(F.col("s0") == 0, F.array(F.lit(f"{names[1]}_only")))
    return one.select("key", F.explode(only.otherwise(F.array_compact(F.array(*(f"off_{f}" for f in fields))))).alias("diff"))
