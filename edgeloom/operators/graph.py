"""Closures and shortest paths over edge DataFrames.

Edges are projected to distinct (src, dst) and written once. What happens then depends on their counted size, the result
does not:

* A small graph (edges times roots at most ``LOCAL_WORK``) is walked to its end by one task over integer arrays, so a deep
  chain costs no job per level.
* Any other graph is laid out once in buckets by source, a hub's edges salted over several buckets, and the visited nodes
  lie in buckets by (root, node). A hop shuffles only the frontier and its neighbours, neither edges nor visited nodes. Up
  to ``HOPS`` hops are one job while the frontier is thin, as a single chain of joins. Each job
  appends to the visited table in the shared folder, which bounds the plan and survives the loss of executors.

A seed is part of its closure even if no edge knows it; null ends are never followed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgeloom.cluster import BROADCAST_ROWS, Bucketed, cut, drop_cut

#: Edges times roots that one task walks by itself, and the pairs it traces back: some 200 MB of arrays.
LOCAL_WORK = 2_000_000
#: Hops of one job over a frontier of at most ``THIN`` rows; a larger one is cut after every hop.
HOPS = 4
THIN = BROADCAST_ROWS
#: A source with more edges is a hub: it is spread over several buckets. There are never more than MAX_HUBS of them.
HUB_EDGES, MAX_HUBS = 100_000, 50_000


def edge_set(calls: DataFrame, src: str, dst: str, kinds: tuple[str, ...] | None = None, backward: bool = False) -> DataFrame:
    """Distinct (src, dst) of calls of the given kinds, reversed on demand; written once, so that they can be counted."""
    e = calls if kinds is None else calls.where(F.col("kind").isin(*kinds))
    a, b = (dst, src) if backward else (src, dst)
    e = e.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null").distinct()
    return cut(e)


# ---- one task --------------------------------------------------------------------------------------------------------

class _Walk:
    """Breadth-first search from all roots at once; nodes are ranks of their sorted names, a state is root times nodes plus node."""

    def __init__(self, edges: pa.Table, roots: pa.ChunkedArray, starts: pa.ChunkedArray, max_depth: int | None = None) -> None:
        self.names, (src, dst, at) = _ranks(edges["src"], edges["dst"], starts)
        self.roots, (of,) = _ranks(roots)
        self.n = n = max(len(self.names), 1)
        order = np.argsort(src, kind="stable")
        first, dst = np.searchsorted(src[order], np.arange(n + 1)), dst[order]
        self.depth = np.full(len(self.roots) * n, -1, np.int32)
        self.parent = np.full(len(self.roots) * n, -1, np.int64)
        front, level = np.unique(of * n + at), 0
        self.depth[front] = 0
        while len(front) and (max_depth is None or level < max_depth):
            level += 1
            node, root = front % n, front // n
            many = first[node + 1] - first[node]
            edge = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            to, by = np.repeat(root * n, many) + dst[edge], np.repeat(node, many)
            new = self.depth[to] < 0
            to, by = to[new], by[new]
            order = np.lexsort((by, to))
            to, by = to[order], by[order]
            least = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            front = to[least]
            self.depth[front], self.parent[front] = level, by[least]


def _ranks(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of all columns in order, and each column as positions among them."""
    chunks = [c for x in columns for c in x.chunks]
    every = pa.chunked_array(chunks, type=columns[0].type).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[every.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
    ends = np.cumsum([0, *(len(x) for x in columns)])
    return every.dictionary.take(pa.array(order)), [codes[a:b] for a, b in zip(ends, ends[1:])]


def _closed(max_depth: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def close(edges: pa.Table, seeds: pa.Table) -> pa.Table:
        w = _Walk(edges, seeds["root"], seeds["n"], max_depth)
        met = np.flatnonzero(w.depth >= 0)
        return pa.table({"root": w.roots.take(pa.array(met // w.n)), "n": w.names.take(pa.array(met % w.n)), "depth": w.depth[met]})

    return close


def _traced(edges: pa.Table, pairs: pa.Table) -> pa.Table:
    """The path of every pair that has one."""
    w = _Walk(edges, pairs["src"], pairs["src"])
    nodes = pc.index_in(pairs["dst"], value_set=w.names)
    root = pc.index_in(pairs["src"], value_set=w.roots).to_numpy().astype(np.int64)
    known = np.flatnonzero(nodes.is_valid().to_numpy())
    state = root[known] * w.n + pc.fill_null(nodes, 0).to_numpy().astype(np.int64)[known]
    known, state = known[w.depth[state] >= 0], state[w.depth[state] >= 0]
    base, at = state - state % w.n, state % w.n
    steps = []
    while (at >= 0).any():
        steps.append(at)
        at = np.where(at >= 0, w.parent[base + np.maximum(at, 0)], -1)
    grid = np.stack(steps[::-1], axis=1) if steps else np.zeros((len(known), 0), np.int64)
    upto = np.concatenate([[0], np.cumsum((grid >= 0).sum(axis=1))]).astype(np.int32)
    paths = pa.ListArray.from_arrays(pa.array(upto), w.names.take(pa.array(grid[grid >= 0])))
    return pa.table({"src": pairs["src"].take(pa.array(known)), "dst": pairs["dst"].take(pa.array(known)), "path": paths})


def _in_one_task(left: DataFrame, right: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Both sides, counted and small, in one group."""
    one = F.lit(0).alias("one")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b)

    return cut(left.select("*", one).groupBy("one").cogroup(right.select("*", one).groupBy("one")).applyInArrow(run, schema))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# ---- many tasks ------------------------------------------------------------------------------------------------------

class _Layout:
    """Edges in buckets by src, or by (src, salt) if there are hubs: only a hub has salts other than 0."""

    def __init__(self, edges: DataFrame) -> None:
        n = edges.count()
        limit = max(HUB_EDGES, n // MAX_HUBS)
        hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        self.hubs = cut(hubs.select("src", F.ceil(F.col("n") / limit).cast("int").alias("slots")))
        self.any_hub = not self.hubs.isEmpty()
        self.keys = ("src", "salt") if self.any_hub else ("src",)
        if self.any_hub:
            salt = F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1))).cast("int")
            edges = edges.join(F.broadcast(self.hubs), "src", "left").withColumn("salt", salt)
        self.table = Bucketed(edges.select(*self.keys, "dst"), self.keys, n)

    def step(self, found: DataFrame, depth: int, keep: Sequence[str], hashed: bool) -> DataFrame:
        """``found`` (root, n, x) and the neighbours of its nodes at ``depth``, with their own depth and their parent.

        ``hashed`` tells that ``found`` is thin: its buckets are hashed and the edges streamed past them unsorted.
        """
        left = found.withColumnRenamed("n", "src")
        if self.any_hub:
            salt = F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))
            left = left.join(F.broadcast(self.hubs), "src", "left").withColumn("salt", salt).drop("slots")
        edges = self.table.frame().alias("e")
        at = (left.hint("shuffle_hash") if hashed else left).alias("f")
        here = [F.col(f"f.{k}") == F.col(f"e.{k}") for k in self.keys]
        both = at.join(edges, reduce(and_, here, F.col("f.x.depth") == depth), "left")
        x = {"depth": F.lit(depth + 1), "parent": F.col("f.src")}
        ends = F.array(
            F.struct(F.col("f.src").alias("n"), F.col("f.x").alias("x")),
            F.struct(F.col("e.dst").alias("n"), F.struct(*(x[k].alias(k) for k in keep)).alias("x")),
        )
        return both.select("root", F.inline(ends)).where("n is not null")


def _walk(edges: DataFrame, seeds: DataFrame, max_depth: int | None, parents: bool, enough: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """(root, n, depth[, parent]) by jobs of several hops; ``enough`` may end the walk after a job."""
    layout = _Layout(edges)
    keep = ("depth", "parent") if parents else ("depth",)
    first = seeds.select("root", "n").where("n is not null").distinct().withColumn("depth", F.lit(0))
    if parents:
        first = first.withColumn("parent", F.lit(None).cast(first.schema["n"].dataType))
    visited = Bucketed(first, ("root", "n"), edges.count())
    depth, size = 0, None
    while max_depth is None or depth < max_depth:
        seen = visited.frame().select("root", "n")
        thin = size is not None and size <= THIN
        hops = HOPS if size is None or thin else 1
        hops = hops if max_depth is None else min(hops, max_depth - depth)
        new = visited.frame().where(F.col("depth") == depth).select("root", "n", F.struct(*keep).alias("x"))
        for i in range(hops):
            # One chain of joins: a hop keeps what the hops before it found and adds what its frontier leads to.
            new = layout.step(new, depth + i, keep, hashed=hops > 1).groupBy("root", "n").agg(F.min("x").alias("x")).join(seen, ["root", "n"], "left_anti")
        new = new.select("root", "n", "x.*")
        depth += hops
        seen_now = Observation()
        visited.append(new.observe(seen_now, F.count_if(F.col("depth") == depth).alias("last")))
        size = seen_now.get["last"]
        if not size or enough and enough(visited.frame()):
            break
    layout.table.drop()
    drop_cut(layout.hubs)
    return visited.close()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, n, depth): what each root reaches, itself at depth 0; ``seeds`` has (root, n).

    Roots are walked together, so many roots cost as many levels as the deepest one. For one common root pass a constant.
    """
    seeds = cut(seeds.select("root", "n").where("n is not null").distinct())
    roots = seeds.select("root").distinct().count()
    if max(edges.count(), seeds.count()) * max(roots, 1) <= LOCAL_WORK:
        found = f"root {_type(seeds, 'root')}, n {_type(seeds, 'n')}, depth int"
        return _in_one_task(edges, seeds, _closed(max_depth), found)
    return _walk(edges, seeds, max_depth, parents=False)


def one_root(seeds: DataFrame, column: str) -> DataFrame:
    """Seeds that share one closure."""
    return seeds.select(F.lit(0).alias("root"), F.col(column).alias("n"))


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, path): a shortest path per pair, the least by names among the shortest; no row if there is none.

    Each node remembers its least predecessor on the level before; all pairs are read back together, one step of all of
    them at a time.
    """
    pairs = cut(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    roots = pairs.select("src").distinct().count()
    if max(edges.count(), pairs.count()) * max(roots, 1) <= LOCAL_WORK:
        t = _type(pairs, "src")
        return _in_one_task(edges, pairs, _traced, f"src {t}, dst {t}, path array<{t}>")
    wanted = pairs.select(F.col("src").alias("root"), F.col("dst").alias("n"))
    seeds = pairs.select(F.col("src").alias("root"), F.col("src").alias("n"))
    visited = _walk(edges, seeds, None, parents=True, enough=lambda v: wanted.join(v, ["root", "n"], "left_anti").isEmpty())
    deepest = wanted.join(visited, ["root", "n"]).agg(F.max("depth")).first()[0] or 0
    back = visited.select("root", F.col("n").alias("at"), F.col("parent").alias("next"))
    here = wanted.join(visited, ["root", "n"]).select("root", F.col("n").alias("dst"), F.array("n").alias("path"), F.col("parent").alias("at"))
    for step in range(deepest):
        path: Column = F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), F.col("path")))
        here = here.join(back, ["root", "at"], "left").select("root", "dst", path.alias("path"), F.col("next").alias("at"))
        if step % HOPS == HOPS - 1:
            here = cut(here)
    return here.select(F.col("root").alias("src"), "dst", "path")


def neighborhood(edges: DataFrame, start: DataFrame, depth: int, cap: int) -> DataFrame:
    """(n, depth): nodes within ``depth`` steps in either direction, the closest ``cap`` of them, ties by name.

    ``cap`` is the feature's page size: levels are taken whole until it is reached, and the walk ends there. No frontier is
    therefore larger than the cap; it is broadcast to the edges, which are neither made distinct nor moved.
    """
    seen = cut(start.select("n").where("n is not null").distinct().orderBy("n").limit(cap).withColumn("depth", F.lit(0)))
    frontier, room = seen, cap - seen.count()
    for level in range(1, max(1, min(5, depth)) + 1):
        at = F.broadcast(frontier.select(F.col("n").alias("at")))
        out = edges.join(at, edges["src"] == F.col("at")).select(F.col("dst").alias("n"))
        back = edges.join(at, edges["dst"] == F.col("at")).select(F.col("src").alias("n"))
        new = out.unionByName(back).where("n is not null").distinct().join(F.broadcast(seen.select("n")), "n", "left_anti")
        frontier = cut(new.orderBy("n").limit(room).withColumn("depth", F.lit(level)))
        n = frontier.count()
        if not n:
            break
        seen, room = seen.unionByName(frontier), room - n
        if not room:
            break
    return seen
