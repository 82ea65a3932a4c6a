"""Closures, verdicts and refusals on hand-made and random graphs, against a ten-line search."""

import collections
import random

import pytest
from edgeloom.errors import RefusedError
from edgeloom.operators import graph
from edgeloom.plans import registry
from edgeloom.plans import verbs as v
from edgeloom.schemas import DDL
from pyspark.sql import functions as F

FLAT = DDL["calls_flat"]


def flat(spark, edges):
    return spark.createDataFrame([(a, None, b, None, f"{a}:{i}", k) for i, (a, b, k) in enumerate(edges)], FLAT)


SMALL = [("clean", "a", "MUST"), ("a", "b", "MAY_ENUMERATED"), ("dirty", "t", "MUST"), ("t", "*TOP*", "MAY_TOP")]


def names(df, col=0):
    return sorted(r[col] for r in df.collect())


def pair_df(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


def test_must_reach(spark):
    got = {(r.a, r.b): r.result for r in v.reaches(flat(spark, SMALL), pair_df(spark, ("clean", "a"), ("clean", "b"), ("clean", "z"), ("nobody", "nobody"))).collect()}
    assert got["clean", "a"] == "PATH EXISTS (must-reach): clean -> a"
    assert got["clean", "b"].startswith("no MUST path: clean -> b") and got["clean", "z"].startswith("no MUST path")
    assert got["nobody", "nobody"].startswith("PATH EXISTS")


def test_unreachable_verdicts(spark):
    edges = [*SMALL, ("dirty", "b", "MUST"), ("nul", "x", None)]
    got = {(r.a, r.b): r.verdict.split(":")[0] for r in v.unreachable(flat(spark, edges), pair_df(spark, ("clean", "b"), ("clean", "z"), ("dirty", "z"), ("dirty", "b"), ("nul", "x"))).collect()}
    assert got == {("clean", "b"): "REACHABLE (may-reach)", ("clean", "z"): "UNREACHABLE", ("dirty", "z"): "UNKNOWN", ("dirty", "b"): "REACHABLE (may-reach)", ("nul", "x"): "UNKNOWN"}


def test_escapes(spark):
    assert names(v.escapes(flat(spark, SMALL), "dirty")) == ["t"] and names(v.escapes(flat(spark, SMALL), "clean")) == []
    assert [tuple(r) for r in v.escapes(flat(spark, [("m", "s", None)]), "m").collect()] == [("m", "m:0", "NULL")]


def test_contract_is_required(spark):
    ok = flat(spark, SMALL)
    stamp, other = ("callgraph_contract", "v1"), ("built_by", "x")
    meta = spark.createDataFrame([stamp, other], "key string, value string")
    bare, wrong = spark.createDataFrame([other], "key string, value string"), spark.createDataFrame([("callgraph_contract", "v0")], "key string, value string")
    v.require_contract(ok, meta)
    cases = (
        (ok, bare, "does not carry"), (ok, bare.limit(0), "does not carry"), (ok, wrong, "does not carry"), (ok.drop("kind"), meta, "no edge kinds"),
        (flat(spark, [("m", "s", None), ("m", "t", "MUST")]), meta, "1 call edges"), (flat(spark, [("m", "s", "must"), ("m", "s", None)]), meta, "2 call edges"),
    )
    for calls, m, why in cases:
        with pytest.raises(RefusedError, match=why):
            v.require_contract(calls, m)
    assert v.contract_line(meta).first().line == "contract: v1" and v.contract_line(bare).first().line.startswith("contract: <none")


def test_unknown_root_is_refused_by_ids(spark):
    fn = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    calls = spark.createDataFrame([(1, 2, "a", "b", "s", "MUST")], "caller_id long, callee_id long, caller_name string, callee_name string, call_site string, kind string")
    assert v.unreachable_main(fn, calls, pair_df(spark, ("a", "b"))).first().verdict.startswith("REACHABLE")
    with pytest.raises(RefusedError):
        v.unreachable_main(fn, calls, pair_df(spark, ("zz", "b")))


def search(edges, root):
    seen, todo = {root: 0}, collections.deque([root])
    while todo:
        n = todo.popleft()
        for a, b in edges:
            if a == n and b not in seen:
                seen[b] = seen[n] + 1
                todo.append(b)
    return seen


def least_path(edges, a, b):
    """The shortest path whose nodes, from the end back, are the least predecessors one level up."""
    depth = search(edges, a)
    if b not in depth:
        return None
    path = [b]
    while depth[path[0]]:
        path.insert(0, min(x for x, y in edges if y == path[0] and depth.get(x) == depth[path[0]] - 1))
    return path


@pytest.mark.parametrize("work", (graph.LOCAL_WORK, 0))
@pytest.mark.parametrize("seed", range(2))
def test_closure_and_paths_match_search(spark, seed, work, monkeypatch):
    """In one task and over buckets, with hubs spread and jobs of three hops."""
    for name, value in (("LOCAL_WORK", work), ("HOPS", 3), ("HUB_EDGES", 3), ("THIN", 10)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(seed)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(32)] + [(i, i + 1) for i in range(30, 38)] + [(7, i) for i in range(40, 52)]
    df = graph.edge_set(spark.createDataFrame([(*e, "k") for e in edges + edges[:5]] + [(None, 1, "k"), (1, None, "k")], "x int, y int, kind string"), "x", "y")
    roots = [0, 1, 2, 30, 99]
    seeds = spark.createDataFrame([(x, x) for x in roots] + [(1, 1), (5, None)], "root int, n int")
    got = {(x.root, x.n): x.depth for x in graph.closure(df, seeds).collect()}
    assert got == {(x, n): d for x in roots for n, d in search(edges, x).items()}
    for depth in (0, 1, 4):
        assert {(x.root, x.n): x.depth for x in graph.closure(df, seeds, depth).collect()} == {k: d for k, d in got.items() if d <= depth}
    pairs = [(x, y) for x in roots for y in (0, 7, 13, 38, 45, 99, 1000)] + [(1, None)]
    paths = {(p.src, p.dst): p.path for p in graph.shortest_paths(df, spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert paths == {(x, y): least_path(edges, x, y) for x, y in pairs if least_path(edges, x, y)}
    none = spark.createDataFrame([], "src int, dst int")
    assert graph.closure(df.limit(0), seeds).count() == len(roots) and graph.closure(df, seeds.limit(0)).count() == 0
    assert graph.shortest_paths(df, none).count() == 0


def test_cycles_and_empty_graphs(spark):
    assert names(v.reachable_from(flat(spark, [("p", "q", "MUST"), ("q", "p", "MUST"), ("q", "*TOP*", "MAY_TOP")]), "p")) == ["*TOP*", "q"]
    assert v.reachable_from(flat(spark, []), "p").count() == 0


def test_effects_verbs(spark):
    calls = flat(spark, [("main", "mut", "MUST"), ("mut", "leaf", "MAY_ENUMERATED"), ("open", "*TOP*", "MAY_TOP"), ("pure", "leaf2", "MUST")])
    fn = spark.createDataFrame([(n, "f.ml", int(n == "main")) for n in ("main", "mut", "leaf", "open", "pure", "leaf2", "island", None)], "name string, file_path string, exported int")
    fx = spark.createDataFrame([("leaf", "f.ml", "HeapRef", "x", 1, "sound"), ("main", None, "HashTbl", None, 0, "manual")], "function_name string, file_path string, value_kind string, target string, is_direct int, soundness string")
    assert sorted((r.function_name, r.how, r.soundness) for r in v.mutators_of(calls, fn, fx, "HeapRef").collect()) == [("leaf", "direct", "sound"), ("main", "transitive", "candidate"), ("mut", "transitive", "candidate")]
    assert [r.mutating_fn for r in v.effects_of(calls, fx, "main").collect()] == ["leaf"]
    assert names(v.pure_fns(calls, fn, fx)) == ["island", "leaf2", "pure"]
    assert names(v.dead_code(calls, fn, v.roots_exported(fn), True)) == ["island", "leaf2", "open", "pure"]
    assert names(v.dead_code(calls, fn, v.roots_named(fn, ["pure", "nothere"]), False)) == ["island", "leaf", "main", "mut", "open"]


def test_neighborhood_caps_nearest_first(spark):
    e = graph.edge_set(spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "d"), ("d", "e")], "x string, y string"), "x", "y")
    start = spark.createDataFrame([("a",)], "n string")
    assert names(graph.neighborhood(e, start, 2, 100)) == ["a", "b", "c", "d"]
    assert sorted(tuple(r) for r in graph.neighborhood(e, start, 2, 100).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert names(graph.neighborhood(e, start, 9, 3)) == ["a", "b", "c"] and names(graph.neighborhood(e, start, 9, 2)) == ["a", "b"]
    assert names(graph.neighborhood(e, start, 9, 1)) == ["a"] and names(graph.neighborhood(e, start.limit(0), 2, 9)) == []
    assert names(graph.neighborhood(e, start, 5, 100)) == ["a", "b", "c", "d", "e"]


def test_actor_paths_over_a_grid(spark, monkeypatch):
    rows = [(f"f{i}", f"r{i % 3}" if i % 4 else None, "HashTbl" if i % 2 else "HeapRef", '[{"kind":"hashtbl"}]' if i % 5 == 0 else None) for i in range(40)]
    fx = spark.createDataFrame(rows, "function_name string, actor_role string, value_kind string, value_touched string")
    mine = [r for r in rows if r[1] and (r[2] == "HashTbl" or r[3])]  # touched values match in any letter case
    want = sorted((a[0], a[1], b[0], b[1]) for a in mine for b in mine if a[0] != b[0] and a[1] != b[1])
    for cell in (4096, 3):
        monkeypatch.setattr(v, "CELL", cell)
        assert sorted((r.action_a, r.actor_a, r.action_b, r.actor_b) for r in v.actor_paths(fx, "HashTbl").collect()) == want


@pytest.mark.parametrize("tasks", (10_000, 10))
def test_actor_paths_are_spread_over_tasks(spark, tasks, monkeypatch):
    """Each cell of the grid is its own task, or cells are dealt evenly, however few bytes there are; nothing is broadcast."""
    monkeypatch.setattr(v, "CELL", 50)
    monkeypatch.setattr(v, "CELL_TASKS", tasks, raising=False)
    rows = [(f"f{i}", f"r{i % 100}", "HashTbl", None) for i in range(400)]
    fx = spark.createDataFrame(rows + rows[:7], "function_name string, actor_role string, value_kind string, value_touched string")
    out = v.actor_paths(fx, "HashTbl")
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 400 * 396 == out.distinct().count() and len(per) == min(64, tasks) and max(per) < 2 * sum(per) / len(per)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("actor_paths", "actor_paths_touched"))
def test_registered_actor_paths_are_spread_over_tasks(spark, name, monkeypatch):
    folder = "/root/testdata/sf0.01"
    whole = registry.QUERIES[name](spark, folder)
    monkeypatch.setattr(v, "CELL", 20)
    out = registry.QUERIES[name](spark, folder)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 25 and max(per) < 4 * sum(per) / len(per)  # five or six parts a side
    assert sum(per) > 0 and out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty()


@pytest.mark.parametrize("hub", (graph.HUB_EDGES, 20))
def test_a_hop_moves_only_the_frontier(spark, hub, monkeypatch):
    """Neither the edges nor the visited nodes are shuffled again by a hop, even where nothing can be broadcast."""
    monkeypatch.setattr(graph, "HUB_EDGES", hub)
    edges = graph.edge_set(spark.range(5000).selectExpr("id % 100 as x", "id as y"), "x", "y")
    front = spark.range(3000).selectExpr("id % 3 as root", "id as n", "struct(0 as depth) as x")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = graph._Layout(edges)
        visited = graph.Bucketed(front.select("root", "n"), ("root", "n"), 3000)
        step = layout.step(front, 0, ("depth",), hashed=hub == 20)
        new = step.groupBy("root", "n").agg(F.min("x").alias("x")).join(visited.frame(), ["root", "n"], "left_anti")
        one, both = (df._jdf.queryExecution().executedPlan().toString() for df in (step, new))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    hubs = one.count("BroadcastExchange")
    assert layout.any_hub == (hub == 20) == (hubs == 1)
    assert one.count("Exchange") - hubs == 1 and one.count("Bucketed: true") == 1  # the frontier
    assert both.count("Exchange") - hubs == 2 and both.count("Bucketed: true") == 2  # the frontier and its neighbours
    layout.table.drop()
    visited.drop()


def test_actor_paths_match_touched_values_in_any_case(spark):
    rows = [("f", "user", None, '[{"kind":"IoSideEffect","direction":"debit"}]'), ("g", "admin", "IoSideEffect", None), ("h", "ops", None, '[{"kind":"iosideeffect"}]'), ("i", "ops", "iosideeffect", None)]
    fx = spark.createDataFrame(rows, "function_name string, actor_role string, value_kind string, value_touched string")
    got = {(r.action_a, r.action_b) for r in v.actor_paths(fx, "IoSideEffect").collect()}
    assert got == {(a, b) for a in "fgh" for b in "fgh" if a != b}


def test_prune_rows_below_the_verdict(spark):
    edges = spark.createDataFrame([("s_a", "c_b", "shares_resource", "e1"), ("s_a", "x", "shares_resource", "e2"), ("s_a", "c_b", "sequence", "e3")], "from_action string, to_action string, edge_type string, evidence string")
    fx = spark.createDataFrame([("s_a", "x.ml"), ("s_a", "y.ml"), ("c_b", None), ("x", "Core/c.ml"), (None, "core")], "function_name string, file_path string")
    assert [(r.verdict[:15], r.n) for r in v.prune(edges, fx, "S_", "c").collect()] == [("DO NOT PRUNE: 4", 4)]
    assert sorted(r.evidence for r in v.prune_rows(edges, fx, "S_", "c").collect()) == ["e1", "e1", "e2", "e2"]
    assert v.prune(edges, fx, "c_b", "s_a").first().n == 0 and v.prune_rows(edges, fx, "c_b", "s_a").count() == 0


def test_effect_verbs_over_ids_keep_names_apart(spark):
    fn = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, "g", 1), (4, "h", None)], "id long, name string, module_id long")
    modules = spark.createDataFrame([(1, "a.ml"), (2, "b.ml")], "id long, path string")
    calls = spark.createDataFrame([(3, 1, "MUST", "MUST"), (4, 2, "MAY_TOP", None)], "caller_id long, callee_id long, kind string, raw_kind string")
    fx = spark.createDataFrame([(1, "f", None, "HeapRef", "t", 1, "sound"), (None, "ext", None, "HeapRef", None, 1, "sound")], "function_id long, function_name string, file_path string, value_kind string, target string, is_direct int, soundness string")
    assert sorted((r.function_id, r.file_path, r.how) for r in v.mutators_of_ids(calls, fn, modules, fx, "HeapRef").collect()) == [(1, "a.ml", "direct"), (3, "a.ml", "transitive")]
    assert [r.mutating_fn for r in v.effects_of_ids(calls, fn, fx, "g").collect()] == ["f"] and v.effects_of_ids(calls, fn, fx, "h").count() == 0
    assert sorted((r.id, r.file_path) for r in v.pure_fns_ids(calls, fn, modules, fx).collect()) == [(2, "b.ml"), (4, None)]
