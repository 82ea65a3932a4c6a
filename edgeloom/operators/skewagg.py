"""Per-key results when a few keys hold most records (problem 5).

Method: two-stage salted aggregation. A first pre-aggregated count names the heavy keys, those with at least
``heavy_share`` of all rows; there are at most ``1 / heavy_share`` of them, which bounds what is broadcast. Rows of heavy
keys get a salt, rows of other keys salt 0; partial results are computed per key and salt, then merged by key. The salt
is a hash of the counted attribute rather than a fresh random number: it spreads just as evenly, gives the same rows again
when a lost task is rerun, and keeps each distinct value in one salt, so that distinct counts add up exactly.

Defined cases: a null key is a key of its own; null attribute values are not counted as distinct; kinds outside the named
ones and null count as other; repeated rows count as often as they are stored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import cut

HEAVY_SHARE = 0.001
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(k) of keys with at least ``share`` of all rows: at most 1/share rows."""
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= share * df.count()).select("k")


def salted_stats(
    df: DataFrame,
    key: str,
    distinct_of: str,
    kind: str,
    kinds: Sequence[str],
    heavy_share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """(key, n_rows, n_distinct, n_<kind>..., n_other) for every key."""
    heavy = cut(heavy_keys(df, key, heavy_share))

    def tally(name: str, cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).alias(name)

    slim = df.select(F.col(key).alias("k"), F.col(distinct_of).alias("d"), F.col(kind).alias("kind"))
    salted = (
        slim.join(F.broadcast(heavy.select(F.col("k").alias("hk"), F.lit(True).alias("hot"))), F.col("k").eqNullSafe(F.col("hk")), "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("d"), F.lit(salts))).otherwise(0).cast("int"))
    )
    named = [f"n_{x.lower()}" for x in kinds]
    each = salted.groupBy("k", "salt", "d").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(tally(n, F.col("kind") == x) for n, x in zip(named, kinds)),
    )
    sums = [F.sum(c).alias(c) for c in ("n_rows", *named)]
    partial = each.groupBy("k", "salt").agg(F.count("d").alias("n_distinct"), *sums)
    merged = partial.groupBy("k").agg(F.sum("n_distinct").alias("n_distinct"), *sums)
    other = F.col("n_rows")
    for n in named:
        other = other - F.col(n)
    return merged.select(F.col("k").alias(key), "n_rows", "n_distinct", *named, other.alias("n_other"))


def keys_of_share(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Keys whose rows are at least ``share`` of all rows; null is no name and is left out."""
    stats = cut(stats)
    total = stats.agg(F.sum("n_rows")).first()[0] or 0
    return stats.where((F.col("n_rows") >= share * total) & F.col(key).isNotNull()).select(key)
