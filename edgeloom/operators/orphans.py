"""References to records that do not exist (problem 1).

Targets carry validity intervals; a reference is an orphan if its target is not live at the reference's own time.

Method. Keys (numbers and names) are hashed to 64 bits and range-partitioned over the hashed key space, so every range
holds about as many distinct targets as any other whatever the keys look like. The targets of a range are kept as sorted
arrays; the references of a range arrive as Arrow batches and are probed by vectorised binary search, with the real key
compared after the hash. A range that receives far more references than the others (a hot key) is split into salted
slots: its references are spread over the slots by row id, its targets (bounded by the range) are copied into each slot.
A key with very many intervals (a hot parent) is cut along time: its overlapping intervals are merged, what is left goes
into slices of time, and a reference meets only the slice of its own time. Only misses leave the operator.

References are read twice, once for the histogram of ranges, which takes only the key columns, and once to be probed;
writing them down in between would move more bytes than the second column-pruned scan.

Defined cases: null keys are no references; a reference without a time can be live at no time and is an orphan if its
key is not exempt; an exempt name is never a case, with or without a time, however many names are exempt; targets without
a start are never live; intervals of one key may overlap or repeat; repeated references count once; with no targets every reference is an orphan; columns of the inputs beyond the named ones are
ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import BROADCAST_ROWS, broadcast_if_small, cut

ROWS_PER_SLOT = 131_072
TARGETS_PER_RANGE = 65_536
#: Intervals of one key beyond which they are merged and cut along time.
INTERVALS_PER_SLICE = 16_384
_FOREVER = np.iinfo(np.int64).max
_MISS = "tag int, period string, row_id bigint"


@dataclass(frozen=True)
class Reference:
    """One referring field: where it stands, which columns say row, period time and reference time, and its key kind."""

    src_table: str
    frame: DataFrame
    field: str
    kind: str  # "id" or "name"
    row_id: str = "id"
    created: str = "created_at"
    seen: str = "loaded_at"


def lifetimes(functions: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kid, start, stop) per function id and (kname, start, stop) per id of each name; a null stop means still live."""
    first = functions.groupBy("id").agg(F.min("loaded_at").alias("start"))
    gone = removed.groupBy(F.col("function_id").alias("id")).agg(F.min("removed_at").alias("stop"))
    lives = first.join(gone, "id", "left").where(F.col("id").isNotNull() & F.col("start").isNotNull())
    names = functions.select("id", "name").where(F.col("name").isNotNull()).distinct()
    by_name = names.join(lives, "id").select(F.col("name").alias("kname"), "start", "stop")
    return lives.select(F.col("id").alias("kid"), "start", "stop"), by_name


def _hashed(df: DataFrame) -> DataFrame:
    h = F.when(F.col("kid").isNotNull(), F.xxhash64(F.lit(1), "kid")).otherwise(F.xxhash64(F.lit(2), "kname"))
    return df.withColumn("h", h)


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), _FOREVER).to_numpy()


def _probe(refs: pa.Table, targets: pa.Table) -> pa.Table:
    """The references of one slot that no live target answers."""
    out = refs.select(["tag", "period", "row_id"])
    if refs.num_rows == 0 or targets.num_rows == 0:
        return out
    t_h = targets["h"].to_numpy()
    t_start = _micros(targets["start"])
    order = np.lexsort((t_start, t_h))
    targets = targets.take(pa.array(order))
    t_h, t_start, t_stop = t_h[order], t_start[order], _micros(targets["stop"])
    t_ever = targets["ever"].to_numpy(zero_copy_only=False)
    uniq, first, code = np.unique(t_h, return_index=True, return_inverse=True)
    at = _micros(refs["at"])
    known = pc.is_valid(refs["at"]).to_numpy(zero_copy_only=False)

    r_h = refs["h"].to_numpy()
    where = np.minimum(np.searchsorted(uniq, r_h), len(uniq) - 1)
    hit = uniq[where] == r_h
    named = pa.array(first[where])

    def same(col: str) -> np.ndarray:
        x = pc.fill_null(pc.equal(refs[col], targets[col].take(named)), False)
        return x.to_numpy(zero_copy_only=False)

    # A hash shared by two different keys inside one range is resolved exactly, row by row; it hardly ever happens.
    twin = np.zeros(len(uniq), bool)
    if len(t_h) > 1:
        a, b = targets.slice(0, len(t_h) - 1), targets.slice(1)
        differs = ~(
            pc.fill_null(pc.equal(a["kid"], b["kid"]), False).to_numpy(zero_copy_only=False)
            | pc.fill_null(pc.equal(a["kname"], b["kname"]), False).to_numpy(zero_copy_only=False)
        )
        twin[code[1:][differs & (t_h[1:] == t_h[:-1])]] = True
    ever = np.bincount(code, weights=t_ever, minlength=len(uniq)) > 0

    # Any interval that began by `at` and ends after it: the running maximum of stops up to the last start <= at.
    starts = np.unique(t_start)
    width = len(starts) + 1
    t_comp = code * width + np.searchsorted(starts, t_start) + 1
    longest = _running_max(code, t_stop)
    r_comp = where * width + np.searchsorted(starts, at, side="right")
    pos = np.searchsorted(t_comp, r_comp, side="right") - 1
    safe = np.maximum(pos, 0)
    then = known & (pos >= 0) & (code[safe] == where) & (longest[safe] > at)
    live = hit & (same("kid") | same("kname")) & (ever[where] | then)
    if twin.any():
        for i in np.flatnonzero(hit & twin[where]):
            lo, hi = np.searchsorted(t_h, [r_h[i], r_h[i]], side="left")[0], np.searchsorted(t_h, r_h[i], side="right")
            key = (refs["kid"][i].as_py(), refs["kname"][i].as_py())
            live[i] = any(
                (targets["kid"][int(j)].as_py(), targets["kname"][int(j)].as_py()) == key
                and (t_ever[j] or known[i] and t_start[j] <= at[i] < t_stop[j])
                for j in range(lo, hi)
            )
    return out.filter(pa.array(~live))


def _running_max(code: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running maximum within runs of equal ``code``: doubling steps, as many as the longest run needs."""
    best, step, n = values.copy(), 1, len(values)
    longest = int(np.bincount(code).max()) if n else 0
    while step < longest:
        same = code[step:] == code[:-step]
        best[step:] = np.where(same, np.maximum(best[step:], best[:-step]), best[step:])
        step *= 2
    return best


def _merge(part: pa.Table) -> pa.Table:
    """The intervals of one key in one slice of time, overlapping and touching ones made one."""
    part = part.take(pc.sort_indices(part, sort_keys=[("start", "ascending")]))
    start, stop = _micros(part["start"]), _micros(part["stop"])
    reach = np.maximum.accumulate(stop)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    end = np.maximum.reduceat(stop, first)
    ever = np.maximum.reduceat(part["ever"].to_numpy(zero_copy_only=False).astype(np.int8), first) > 0
    out = part.take(pa.array(first)).drop_columns(["stop", "ever"])
    stops = pa.array(np.where(end == _FOREVER, 0, end), pa.int64(), mask=end == _FOREVER).cast(pa.timestamp("us"))
    return out.append_column("stop", stops).append_column("ever", pa.array(ever)).select(part.column_names)


def _slices(targets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``targets`` with the slices of time they go to, and (h, bounds) of the keys that were cut, None if there are none.

    Only keys with more than ``limit`` intervals are cut, so there are at most targets/limit of them, with at most
    targets/limit bounds in all; that bounds what is broadcast.
    """
    counts = targets.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    counts = cut(counts.withColumn("slices", F.ceil(F.col("n") / limit).cast("int")))
    most = counts.agg(F.max("slices")).first()[0]
    whole = targets.withColumn("slice", F.lit(0))
    if most is None:
        return whole, None
    hot = targets.join(F.broadcast(counts.select("h", "slices")), "h")
    grid = hot.groupBy("h").agg(F.percentile_approx("start", [i / most for i in range(1, most + 1)]).alias("grid"), F.first("slices").alias("slices"))
    picked = F.transform(F.sequence(F.lit(1), F.col("slices") - 1), lambda i: F.get("grid", F.floor(i * most / F.col("slices")).cast("int") - 1))
    bounds = cut(grid.select("h", F.when(F.col("slices") > 1, F.array_distinct(picked)).otherwise(F.expr("array()").cast("array<timestamp_ntz>")).alias("bounds")))
    cold = whole.join(F.broadcast(bounds.select("h")), "h", "left_anti")
    placed = targets.join(F.broadcast(bounds), "h").withColumn("slice", _slice_of("start"))
    merged = placed.groupBy("h", "slice", "kid", "kname").applyInArrow(_merge, schema=placed.schema)
    last = F.when(F.col("stop").isNull(), F.size("bounds")).otherwise(_slice_of("stop"))
    spread = merged.withColumn("slice", F.explode(F.sequence(F.col("slice"), last))).select(*whole.columns)
    return cold.select(*whole.columns).unionByName(spread), bounds


def _slice_of(time: str) -> Column:
    """The slice of time, 0 for an unknown one: the number of bounds not after it."""
    return F.when(F.col(time).isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col(time))))


def find_orphans(
    references: Sequence[Reference],
    targets_by_id: DataFrame,
    targets_by_name: DataFrame,
    exempt_names: DataFrame,
    always_exempt: Sequence[str] = (),
    rows_per_slot: int = ROWS_PER_SLOT,
    broadcast_rows: int = BROADCAST_ROWS,
    intervals_per_slice: int = INTERVALS_PER_SLICE,
) -> DataFrame:
    """(src_table, period, row_id, ref_field) of every reference whose target is not live at its time.

    ``targets_by_id`` (kid, start, stop) and ``targets_by_name`` (kname, start, stop) may be of any size.
    ``exempt_names`` (one column ``kname``) with at most ``broadcast_rows`` names leave the references by a broadcast;
    more of them go among the targets, marked as exempt whatever the time. The result is the same.
    """
    spark = targets_by_id.sparkSession
    exempt = cut(exempt_names.select("kname").where(F.col("kname").isNotNull()).distinct())
    small = exempt.count() <= broadcast_rows
    parts, n_refs = [], 0
    for tag, r in enumerate(references):
        is_id = r.kind == "id"
        part = r.frame.where(F.col(r.field).isNotNull()).select(
            F.lit(tag).alias("tag"),
            F.date_format(r.created, "yyyy-MM").alias("period"),
            F.col(r.row_id).cast("bigint").alias("row_id"),
            F.col(r.seen).cast("timestamp_ntz").alias("at"),
            (F.col(r.field).cast("bigint") if is_id else F.lit(None).cast("bigint")).alias("kid"),
            (F.lit(None).cast("string") if is_id else F.col(r.field).cast("string")).alias("kname"),
        )
        if not is_id:
            part = part.where(~F.col("kname").isin(list(always_exempt))) if always_exempt else part
            part = part.join(F.broadcast(exempt), "kname", "left_anti") if small else part
        parts.append(part)
        n_refs += r.frame.count()  # from file footers
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    # One row per key and start, with the latest end, so that repeated intervals are folded before anything is counted.
    end = F.when(F.count_if(F.col("stop").isNull()) == 0, F.max("stop")).alias("stop")
    by_id = targets_by_id.where("start is not null").groupBy("kid", "start").agg(end)
    by_name = targets_by_name.where("start is not null").groupBy("kname", "start").agg(end)
    targets = by_id.withColumn("kname", F.lit(None).cast("string")).unionByName(by_name.withColumn("kid", F.lit(None).cast("bigint")))
    targets = targets.withColumn("ever", F.lit(False))
    if not small:
        ever = exempt.select(
            F.lit(None).cast("bigint").alias("kid"),
            "kname",
            F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("start"),
            F.lit(None).cast("timestamp_ntz").alias("stop"),
            F.lit(True).alias("ever"),
        )
        targets = targets.unionByName(ever)
    targets = cut(_hashed(targets))
    bits = max(1, math.ceil(math.log2(max(n_refs / rows_per_slot, targets.count() / TARGETS_PER_RANGE, 2))))
    rng = F.shiftrightunsigned("h", 64 - bits)
    targets, bounds = _slices(targets, intervals_per_slice)
    refs = _hashed(refs)
    if bounds is None:
        refs = refs.withColumn("slice", F.lit(0))
    else:
        refs = refs.join(F.broadcast(bounds), "h", "left").withColumn("slice", F.when(F.col("bounds").isNull(), 0).otherwise(_slice_of("at"))).drop("bounds")
    refs = refs.withColumn("rng", rng)

    # Ranges with a hot key get more slots; the histogram is pre-aggregated on the map side.
    hot = (
        refs.groupBy("rng", "slice").count().where(F.col("count") > 2 * rows_per_slot)
        .select("rng", "slice", F.ceil(F.col("count") / rows_per_slot).cast("int").alias("slots"))
    )
    hot = broadcast_if_small(hot)
    refs = (
        refs.join(hot, ["rng", "slice"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("slots", F.lit(1))).cast("int"))
        .drop("slots")
    )
    targets = (
        targets.withColumn("rng", rng).join(hot, ["rng", "slice"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    )
    slot = ("rng", "slice", "salt")
    misses = refs.groupBy(*slot).cogroup(targets.groupBy(*slot)).applyInArrow(_probe, schema=_MISS).distinct()
    labels = spark.createDataFrame(
        [(i, r.src_table, r.field) for i, r in enumerate(references)], "tag int, src_table string, ref_field string"
    )
    return misses.join(F.broadcast(labels), "tag").select("src_table", "period", "row_id", "ref_field")


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Orphan references per table, field and month; a null period is its own group."""
    return found.groupBy("src_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("orphans"))
