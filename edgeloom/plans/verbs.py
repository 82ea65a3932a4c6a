"""The query verbs over a call graph: DataFrames in, one DataFrame out.

``calls`` is name-keyed (caller_name, caller_file, callee_name, callee_file, call_site, kind, raw_kind) and, for the id
variants, id-keyed (caller_id, callee_id). Names are compared exactly. A null kind is never resolved: it is excluded from
closures over resolved kinds and counts as an escape; only the ``_main`` verbs over effects walk it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import cut
from edgeloom.errors import RefusedError
from edgeloom.operators.graph import closure, edge_set, one_root
from edgeloom.schemas import CONTRACT, CONTRACT_KEY, KINDS, RESOLVED, TOP

#: The verdict texts.
PATH_EXISTS = "PATH EXISTS (must-reach): {a} -> {b}"
NO_PATH = "no MUST path: {a} -> {b}  (NOT proof of unreachability — use `unreachable`)"
REACHABLE = "REACHABLE (may-reach): {a} -> {b}"
UNKNOWN = (
    "UNKNOWN: no resolved path {a} -> {b}, but {a} reaches a non-resolved (MAY_TOP / NULL / unknown-kind) edge — could-call-anything; "
    "cannot rule out a path. Do NOT kill G2."
)
UNREACHABLE = "UNREACHABLE: no resolved path {a} -> {b} and no reachable MAY_TOP — sound; G2 fails by construction."
CONTRACT_LINE, NO_CONTRACT = "contract: ", "<none — not ⊤-marked; 'unreachable' will refuse>"
PRUNE = "PRUNE: no shared resource found between '{a}' and '{b}' — safe to prune (P13 passes)"
DO_NOT_PRUNE = "DO NOT PRUNE: {n} shared_resource edge(s) between '{a}' and '{b}' — P13 signal"


def text(template: str) -> Column:
    """A verdict text with the columns it names in braces put in."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x))


def unresolved_kind(kind: str = "kind") -> Column:
    return F.col(kind).isNull() | ~F.col(kind).isin(*RESOLVED)


def contract_report(calls: DataFrame, kind: str = "raw_kind") -> DataFrame:
    """(edges, null_kinds, foreign_kinds)."""
    k = F.col(kind)
    return calls.agg(F.count(F.lit(1)).alias("edges"), F.count_if(k.isNull()).alias("null_kinds"), F.count_if(~k.isin(*KINDS)).alias("foreign_kinds"))


def contract_verdict(calls: DataFrame, meta: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind_column, edges, null_kinds, foreign_kinds, verdict): ``ok``, or why sound questions are refused.

    An index without the stamp is refused first, then one without kinds, then one with null or foreign kinds.
    """
    stamp = meta.where((F.col("key") == CONTRACT_KEY) & (F.col("value") == CONTRACT)).agg((F.count(F.lit(1)) > 0).alias("stamped"))
    if kind in calls.columns:
        report, none = contract_report(calls, kind), F.lit(False)
    else:
        report, none = calls.agg(F.count(F.lit(1)).alias("edges"), F.lit(None).cast("bigint").alias("null_kinds"), F.lit(None).cast("bigint").alias("foreign_kinds")), F.lit(True)
    bad = F.col("null_kinds") + F.col("foreign_kinds")
    verdict = (
        F.when(~F.col("stamped"), "REFUSED: the index does not carry the call-graph contract").when(none, "REFUSED: the index has no edge kinds")
        .when(bad > 0, F.concat(F.lit("REFUSED: "), bad, F.lit(" call edges with a null or foreign kind"))).otherwise("ok")
    )
    one = report.withColumn("one", F.lit(1)).join(stamp.withColumn("one", F.lit(1)), "one")  # one row each
    return one.select(F.lit(kind).alias("kind_column"), "edges", "null_kinds", "foreign_kinds", verdict.alias("verdict"))


def require_contract(calls: DataFrame, meta: DataFrame, kind: str = "kind") -> None:
    """Refuse unless the index is stamped and every edge carries one of the three kinds; ``meta`` has (key, value)."""
    verdict = contract_verdict(calls, meta, kind).first().verdict
    if verdict != "ok":
        raise RefusedError(verdict)


# ---- one hop ---------------------------------------------------------------------------------------------------------

def callers_of(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("callee_name") == name).select("caller_name", "caller_file").distinct()


def callees_of(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("caller_name") == name).select("callee_name", "callee_file").distinct()


def fan_in(calls: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` names with most distinct callers, ties by name."""
    pairs = calls.select("callee_name", "caller_name").distinct()  # spreads a hot callee over its callers first
    return pairs.groupBy("callee_name").agg(F.count("caller_name").alias("callers")).orderBy(F.desc("callers"), "callee_name").limit(top)


def exported(functions: DataFrame, flag: str = "exported") -> DataFrame:
    return functions.where(F.col(flag) == 1).select("name", "file_path")


def exported_main(functions: DataFrame, modules: DataFrame) -> DataFrame:
    m = modules.select(F.col("id").alias("module_id"), F.col("path").alias("file_path"))
    return functions.where("exposed = 1").select("name", "module_id").join(m, "module_id", "left").select("name", "file_path")


def unresolved(calls: DataFrame, functions: DataFrame) -> DataFrame:
    names = functions.select(F.col("name").alias("callee_name")).distinct()
    return calls.select("callee_name").where("callee_name is not null").distinct().join(names, "callee_name", "left_anti")


def find(functions: DataFrame, pattern: str) -> DataFrame:
    """Names that contain the pattern, ASCII case ignored; ``%`` and ``_`` in it are wildcards."""
    return functions.where(F.col("name").ilike(f"%{pattern}%")).select("name", "file_path", "exported")


def stats(functions: DataFrame, calls: DataFrame) -> DataFrame:
    f = functions.select(F.lit(1).alias("f"), F.when(F.col("exported") == 1, 1).otherwise(0).alias("e"), F.lit(0).alias("c"))
    both = f.unionByName(calls.select(F.lit(0).alias("f"), F.lit(0).alias("e"), F.lit(1).alias("c")))
    return both.agg(F.sum("f").alias("functions"), F.sum("e").alias("exported"), F.sum("c").alias("call_edges"))


def contract_line(meta: DataFrame) -> DataFrame:
    """(line): the first line of the statistics, which names the contract of the index or says that it has none."""
    stamp = meta.where(F.col("key") == CONTRACT_KEY).agg(F.min("value").alias("value"))
    return stamp.select(F.concat(F.lit(CONTRACT_LINE), F.coalesce("value", F.lit(NO_CONTRACT))).alias("line"))


def kind_stats(calls: DataFrame, kind: str = "kind") -> DataFrame:
    return calls.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


def effect_stats(effects: DataFrame) -> DataFrame:
    return effects.agg(F.count(F.lit(1)).alias("effect_rows"), F.countDistinct("function_name").alias("fns_with_effects"), F.countDistinct("value_kind").alias("value_kinds_seen"))


# ---- closures --------------------------------------------------------------------------------------------------------

def by_name(calls: DataFrame, kinds: Sequence[str] | None, backward: bool = False) -> DataFrame:
    return edge_set(calls, "caller_name", "callee_name", None if kinds is None else tuple(kinds), backward)


def by_id(calls: DataFrame, kinds: Sequence[str] | None, backward: bool = False) -> DataFrame:
    return edge_set(calls, "caller_id", "callee_id", None if kinds is None else tuple(kinds), backward)


def _root(calls: DataFrame, name: str) -> DataFrame:
    return calls.sparkSession.createDataFrame([(0, name)], "root int, n string")


def reachable_from(calls: DataFrame, name: str) -> DataFrame:
    """All names reached over edges of any kind, without the start itself."""
    return closure(by_name(calls, None), _root(calls, name)).where(F.col("n") != name).select(F.col("n").alias("reachable"))


def _pair_seeds(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("root"), F.col("a").alias("n")).distinct()


def reaches(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, result) for name pairs (a, b) over MUST edges; reflexive."""
    c = closure(by_name(calls, ["MUST"]), _pair_seeds(pairs)).select(F.col("root").alias("a"), F.col("n").alias("b"), F.lit(True).alias("hit"))
    return pairs.join(c, ["a", "b"], "left").select("a", "b", F.when(F.col("hit"), text(PATH_EXISTS)).otherwise(text(NO_PATH)).alias("result"))


def _id_seeds(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    return functions.join(pairs.select(F.col("a").alias("name")).distinct(), "name").select(F.col("name").alias("root"), F.col("id").alias("n"))


def _hits(functions: DataFrame, reached: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = functions.join(pairs.select(F.col("b").alias("name")).distinct(), "name").select(F.col("id").alias("n"), F.col("name").alias("b"))
    return reached.join(ends, "n").select(F.col("root").alias("a"), "b").distinct().withColumn("hit", F.lit(True))


def reaches_main(functions: DataFrame, calls: DataFrame, pairs: DataFrame) -> DataFrame:
    reached = closure(by_id(calls, ["MUST"]), _id_seeds(functions, pairs))
    hit = _hits(functions, reached, pairs)
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.when(F.col("hit"), text(PATH_EXISTS)).otherwise(text(NO_PATH)).alias("result"))


def _verdicts(pairs: DataFrame, hit: DataFrame, open_roots: DataFrame) -> DataFrame:
    """Reachable wins over unknown, unknown over unreachable."""
    out = pairs.join(hit, ["a", "b"], "left").join(open_roots.withColumn("open", F.lit(True)), "a", "left")
    return out.select("a", "b", F.when(F.col("hit"), text(REACHABLE)).when(F.col("open"), text(UNKNOWN)).otherwise(text(UNREACHABLE)).alias("verdict"))


def unreachable(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, verdict) for name pairs; the caller checks the contract first."""
    reached = closure(by_name(calls, RESOLVED), _pair_seeds(pairs))
    hit = reached.select(F.col("root").alias("a"), F.col("n").alias("b"), F.lit(True).alias("hit"))
    tops = calls.where(unresolved_kind()).select(F.col("caller_name").alias("n")).distinct()
    open_roots = reached.join(tops, "n", "left_semi").select(F.col("root").alias("a")).distinct()
    return _verdicts(pairs, hit, open_roots)


def unreachable_main(functions: DataFrame, calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """As ``unreachable`` over ids; refuses a start that names no function."""
    seeds = _id_seeds(functions, pairs)
    lost = pairs.select(F.col("a").alias("root")).distinct().join(seeds, "root", "left_anti").first()
    if lost is not None:
        raise RefusedError(f"source {lost.root!r} resolves to no function in this index")
    reached = closure(by_id(calls, RESOLVED), seeds)
    tops = calls.where(unresolved_kind()).select(F.col("caller_id").alias("n")).distinct()
    open_roots = reached.join(tops, "n", "left_semi").select(F.col("root").alias("a")).distinct()
    return _verdicts(pairs, _hits(functions, reached, pairs), open_roots)


def escapes(calls: DataFrame, name: str) -> DataFrame:
    """(escaping_fn, call_site, kind): non-resolved edges that leave what the name reaches over resolved ones."""
    reached = closure(by_name(calls, RESOLVED), _root(calls, name)).select(F.col("n").alias("caller_name"))
    out = calls.where(unresolved_kind()).join(reached, "caller_name", "left_semi")
    return out.select(F.col("caller_name").alias("escaping_fn"), "call_site", F.coalesce("kind", F.lit("NULL")).alias("kind")).distinct()


def escapes_main(functions: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    seeds = one_root(functions.where(F.col("name") == name), "id")
    reached = closure(by_id(calls, RESOLVED), seeds).select(F.col("n").alias("caller_id"))
    out = calls.where(unresolved_kind()).join(reached, "caller_id", "left_semi")
    return out.select(F.col("caller_name").alias("escaping_fn"), "call_site", F.coalesce("kind", F.lit("NULL")).alias("kind")).distinct()


def traversed_main(calls: DataFrame) -> DataFrame:
    """Calls the id-keyed index walks for effects: the resolved ones and those without a kind (foreign kinds stay unresolved)."""
    return calls.where(F.col("raw_kind").isNull() | F.col("kind").isin(*RESOLVED))


def _module_paths(functions: DataFrame, modules: DataFrame) -> DataFrame:
    m = modules.select(F.col("id").alias("module_id"), F.col("path").alias("file_path"))
    return functions.select("name", "module_id").join(m, "module_id", "left").select("name", "file_path")


def mutators_of(calls: DataFrame, functions: DataFrame, effects: DataFrame, value_kind: str) -> DataFrame:
    """(function_name, file_path, how, soundness) of all that mutate the kind, themselves or through resolved calls."""
    return _mutators(by_name(calls, RESOLVED, backward=True), functions, effects, value_kind)


def mutators_of_main(calls: DataFrame, functions: DataFrame, modules: DataFrame, effects: DataFrame, value_kind: str) -> DataFrame:
    """As ``mutators_of``, also through calls without a kind; files are those of the modules."""
    return _mutators(by_name(traversed_main(calls), None, backward=True), _module_paths(functions, modules), effects, value_kind)


def _mutators(edges: DataFrame, functions: DataFrame, effects: DataFrame, value_kind: str) -> DataFrame:
    mine = effects.where(F.col("value_kind") == value_kind)
    direct = mine.select(F.col("function_name").alias("n")).distinct()
    reached = closure(edges, one_root(direct, "n")).select("n")
    fx = mine.select(F.col("function_name").alias("n"), F.col("file_path").alias("fx_file"), "soundness").distinct()
    fn = functions.select(F.col("name").alias("n"), F.col("file_path").alias("fn_file")).distinct()
    out = reached.join(direct.withColumn("direct", F.lit(True)), "n", "left").join(fx, "n", "left").join(fn, "n", "left")
    return out.select(
        F.col("n").alias("function_name"), F.coalesce("fx_file", "fn_file").alias("file_path"),
        F.when(F.col("direct"), "direct").otherwise("transitive").alias("how"), F.coalesce("soundness", F.lit("candidate")).alias("soundness"),
    ).distinct()


def mutators_of_ids(calls: DataFrame, functions: DataFrame, modules: DataFrame, effects: DataFrame, value_kind: str) -> DataFrame:
    """As ``mutators_of_main`` over ids: two functions of one name stay apart, and effects of unknown functions are left out."""
    mine = effects.where((F.col("value_kind") == value_kind) & F.col("function_id").isNotNull())
    direct = mine.select(F.col("function_id").alias("n")).distinct()
    reached = closure(by_id(traversed_main(calls), None, backward=True), one_root(direct, "n")).select("n")
    fx = mine.select(F.col("function_id").alias("n"), F.col("file_path").alias("fx_file"), "soundness").distinct()
    m = modules.select(F.col("id").alias("module_id"), F.col("path").alias("fn_file"))
    fn = functions.select(F.col("id").alias("n"), "name", "module_id").join(m, "module_id", "left")
    out = reached.join(fn, "n").join(direct.withColumn("direct", F.lit(True)), "n", "left").join(fx, "n", "left")
    return out.select(
        F.col("n").alias("function_id"), F.col("name").alias("function_name"), F.coalesce("fx_file", "fn_file").alias("file_path"),
        F.when(F.col("direct"), "direct").otherwise("transitive").alias("how"), F.coalesce("soundness", F.lit("candidate")).alias("soundness"),
    ).distinct()


def effects_of(calls: DataFrame, effects: DataFrame, name: str) -> DataFrame:
    """Direct effects of everything the name reaches over resolved calls."""
    return _effects(by_name(calls, RESOLVED), effects, name)


def effects_of_main(calls: DataFrame, effects: DataFrame, name: str) -> DataFrame:
    """As ``effects_of``, also over calls without a kind."""
    return _effects(by_name(traversed_main(calls), None), effects, name)


def _effects(edges: DataFrame, effects: DataFrame, name: str) -> DataFrame:
    reached = closure(edges, _root(edges, name)).select(F.col("n").alias("function_name"))
    fx = effects.where("is_direct = 1").join(reached, "function_name", "left_semi")
    return fx.select("value_kind", F.col("function_name").alias("mutating_fn"), "file_path", "target", "soundness").distinct()


def effects_of_ids(calls: DataFrame, functions: DataFrame, effects: DataFrame, name: str) -> DataFrame:
    """As ``effects_of_main`` over ids, from all functions of the name."""
    seeds = one_root(functions.where(F.col("name") == name), "id")
    reached = closure(by_id(traversed_main(calls), None), seeds).select(F.col("n").alias("function_id"))
    fx = effects.where("is_direct = 1").join(reached, "function_id", "left_semi")
    return fx.select("function_id", "value_kind", F.col("function_name").alias("mutating_fn"), "file_path", "target", "soundness").distinct()


def _not_named(functions: DataFrame, names: DataFrame) -> DataFrame:
    f = functions.where(F.col("name").isNotNull() & ~F.col("name").contains(TOP))
    return f.join(names.select(F.col("n").alias("name")), "name", "left_anti")


def pure_fns(calls: DataFrame, functions: DataFrame, effects: DataFrame) -> DataFrame:
    """Functions that neither have direct effects nor reach, over resolved calls, one that has or that calls the unknown."""
    return _pure(by_name(calls, RESOLVED, backward=True), calls.where("kind = 'MAY_TOP'"), functions, effects)


def pure_fns_main(calls: DataFrame, functions: DataFrame, modules: DataFrame, effects: DataFrame) -> DataFrame:
    """As ``pure_fns``; a call without a kind is walked and is no call of the unknown; files are those of the modules."""
    unknown = calls.where("kind = 'MAY_TOP' and raw_kind is not null")
    return _pure(by_name(traversed_main(calls), None, backward=True), unknown, _module_paths(functions, modules), effects)


def _pure(edges: DataFrame, unknown: DataFrame, functions: DataFrame, effects: DataFrame) -> DataFrame:
    bad = effects.where("is_direct = 1").select(F.col("function_name").alias("n")).unionByName(unknown.select(F.col("caller_name").alias("n")))
    impure = closure(edges, one_root(bad, "n"))
    return _not_named(functions, impure).select("name", "file_path")


def pure_fns_ids(calls: DataFrame, functions: DataFrame, modules: DataFrame, effects: DataFrame) -> DataFrame:
    """As ``pure_fns_main`` over ids: a function is pure by itself, whatever others bear its name."""
    bad = effects.where("is_direct = 1").select(F.col("function_id").alias("n"))
    bad = bad.unionByName(calls.where("kind = 'MAY_TOP' and raw_kind is not null").select(F.col("caller_id").alias("n")))
    impure = closure(by_id(traversed_main(calls), None, backward=True), one_root(bad, "n")).select(F.col("n").alias("id"))
    m = modules.select(F.col("id").alias("module_id"), F.col("path").alias("file_path"))
    f = functions.where(F.col("name").isNotNull() & ~F.col("name").contains(TOP)).select("id", "name", "module_id").join(impure, "id", "left_anti").join(m, "module_id", "left")
    return f.select("id", "name", "file_path")


def dead_code(calls: DataFrame, functions: DataFrame, roots: DataFrame, contract: bool) -> DataFrame:
    """Functions no root reaches over edges of any kind; ``roots`` has (n), names that exist."""
    reached = closure(by_name(calls, None), one_root(roots, "n"))
    label = F.lit("sound" if contract else "candidate")
    return _not_named(functions, reached).select(F.col("name").alias("function_name"), "file_path", label.alias("verdict_soundness"))


def roots_exported(functions: DataFrame, flag: str = "exported") -> DataFrame:
    return functions.where(F.col(flag) == 1).select(F.col("name").alias("n")).distinct()


def roots_named(functions: DataFrame, names: Sequence[str]) -> DataFrame:
    return functions.where(F.col("name").isin(list(names))).select(F.col("name").alias("n")).distinct()


# ---- capabilities ----------------------------------------------------------------------------------------------------

def matches(component: str, name: str = "function_name", path: str = "file_path") -> Column:
    """Case-insensitive substring of the path or the name; wildcards stay live."""
    p = f"%{component.lower()}%"
    return F.lower(F.coalesce(path, F.lit(""))).like(p) | F.lower(name).like(p)


def capabilities_of(effects: DataFrame, component: str) -> DataFrame:
    def or_mark(c: str, mark: str = "?", name: str | None = None) -> Column:
        return F.coalesce(c, F.lit(mark)).alias(name or c)

    return effects.where(matches(component)).select(
        "function_name", or_mark("reachability_class", name="rclass"), or_mark("actor_role"), or_mark("temporal_class"), or_mark("gating"),
        or_mark("value_touched", "[]"), or_mark("precondition"), "soundness",
    ).distinct()


def one_effect(effects: DataFrame) -> DataFrame:
    """(function_name, reachability_class, actor_role) of each name's least row, nulls last."""
    key = F.struct(F.coalesce("reachability_class", F.lit("~")), F.coalesce("actor_role", F.lit("~")))
    return effects.groupBy("function_name").agg(F.min_by(F.struct("reachability_class", "actor_role"), key).alias("x")).select("function_name", "x.*")


def compose(edges: DataFrame, effects: DataFrame, action: str) -> DataFrame:
    """What the action leads on to, with the class and role of one effect row of each target."""
    e = edges.where((F.col("from_action") == action) & F.col("edge_type").isin("sequence", "removes_guard"))
    fx = one_effect(effects).withColumnRenamed("function_name", "to_action")
    return e.join(fx, "to_action", "left").select(
        "to_action", "edge_type", "evidence", F.coalesce("reachability_class", F.lit("?")).alias("to_rclass"), F.coalesce("actor_role", F.lit("?")).alias("to_actor_role")
    )


def removes_guard(edges: DataFrame, effects: DataFrame, guard: str) -> DataFrame:
    e = edges.where("edge_type = 'removes_guard'").select(F.col("to_action").alias("function_name"), "from_action", "evidence")
    gated = effects.where(F.lower(F.coalesce("gating", F.lit(""))).like(f"%{guard.lower()}%"))
    return gated.join(e, "function_name", "left").select(F.col("function_name").alias("gated_action"), "gating", F.col("from_action").alias("unlocker"), "evidence")


#: Rows of a side in one cell of the grid of an unequal join, and the tasks that the cells are dealt to at most.
CELL, CELL_TASKS = 2048, 10_000


def actor_paths(effects: DataFrame, value_kind: str) -> DataFrame:
    """Pairs of actions of different roles that touch the kind; both orders are given. Letter case counts in ``value_kind`` only.

    The result is quadratic in the touching actions by definition. It is made as a join on the cells of a grid: each row
    is copied along one row or column of cells, so a cell holds about CELL rows of a side. Cells are dealt to tasks
    by number: copies are few bytes and pairs many, so partitions merged by bytes would leave all pairs to a few tasks,
    and a side that looks small must not be broadcast with its copies. Repeated effects need not be folded before.
    """
    touched = F.col("value_kind").eqNullSafe(value_kind) | F.coalesce("value_touched", F.lit("")).ilike(f'%"kind":"{value_kind}"%')
    side = effects.where(touched & F.col("actor_role").isNotNull()).select("function_name", "actor_role", "value_touched").distinct()
    side = cut(side)
    grid = max(1, -(-side.count() // CELL))
    own = F.pmod(F.xxhash64("function_name", "actor_role", "value_touched"), F.lit(grid)).cast("int")
    side, every = side.withColumn("own", own), F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))

    def copies(end: str, cell: Column) -> DataFrame:
        named = [F.col(c).alias(f"{n}_{end}") for c, n in (("function_name", "action"), ("actor_role", "actor"), ("value_touched", "value_touched"))]
        return side.withColumn("other", every).select(*named, cell.alias("cell")).repartitionById(min(grid * grid, CELL_TASKS), "cell").hint("merge")

    a, b = copies("a", F.col("own") * grid + F.col("other")), copies("b", F.col("other") * grid + F.col("own"))
    out = a.join(b, "cell").where((F.col("action_a") != F.col("action_b")) & (F.col("actor_a") != F.col("actor_b")))
    return out.select("action_a", "actor_a", "action_b", "actor_b", "value_touched_a", "value_touched_b")


def _shared(edges: DataFrame, effects: DataFrame, components: Sequence[str]) -> DataFrame:
    """The shared-resource edges between functions of the components (a to b), with how often their effect rows repeat them."""
    mine = F.explode(F.array_compact(F.array(*(F.when(matches(c), F.lit(c)) for c in components))))

    def side(name: str, column: str) -> DataFrame:
        return effects.select(F.col("function_name").alias(column), mine.alias(name)).groupBy(column, name).agg(F.count(F.lit(1)).alias(f"n_{name}"))

    e = edges.where("edge_type = 'shares_resource'").join(side("a", "from_action"), "from_action").join(side("b", "to_action"), "to_action")
    return e.select("a", "b", "from_action", "to_action", "evidence", (F.col("n_a") * F.col("n_b")).alias("times"))


def prune_pairs(edges: DataFrame, effects: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, verdict, n): whether functions of two components share a resource; rows multiply with their effect rows."""
    n = _shared(edges, effects, list(dict.fromkeys(x for p in pairs for x in p))).groupBy("a", "b").agg(F.sum("times").alias("n"))
    asked = edges.sparkSession.createDataFrame(list(pairs), "a string, b string").distinct()
    n = asked.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.select("a", "b", F.when(F.col("n") == 0, text(PRUNE)).otherwise(text(DO_NOT_PRUNE)).alias("verdict"), "n")


def prune(edges: DataFrame, effects: DataFrame, a: str, b: str) -> DataFrame:
    """(verdict, n) of one pair."""
    return prune_pairs(edges, effects, [(a, b)]).select("verdict", "n")


def prune_rows(edges: DataFrame, effects: DataFrame, a: str, b: str) -> DataFrame:
    """(from_action, to_action, evidence): the edges below the verdict, as often as ``prune`` counts them."""
    rows = _shared(edges, effects, [a, b]).where((F.col("a") == a) & (F.col("b") == b))
    return rows.select("from_action", "to_action", "evidence", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("i")).drop("i")
