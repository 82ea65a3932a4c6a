"""The verbs as registered queries with fixed arguments, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import cut
from edgeloom.functions import text
from edgeloom.plans import verbs as v
from edgeloom.plans.substrate import Store, sql
from edgeloom.schemas import CONTRACT_KEY, RESOLVED

PATTERN, COMPONENT, OTHER, VALUE_KIND, GUARD, TOUCHED = "store_", "store", "core", "HashTbl", "lock", "IoSideEffect"
#: What values touch, written unlike the data writes it; components that share resources and some that do not.
RESOURCE = "Balance"
COMPONENTS = ("basalt", "indigo", "opal", "pewter", "fjord", "amber", "no_such_component")


def hub(s: Store) -> str:
    """The caller with most MUST calls, ties by name: the fixed argument of the one-root verbs."""
    g = s.graph.where("kind = 'MUST'").groupBy("caller_name").count().orderBy(F.desc("count"), "caller_name").first()
    return g.caller_name if g else ""


HUB = "(SELECT caller_name FROM fc WHERE kind = 'MUST' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def pairs(s: Store) -> DataFrame:
    """(a, b): five callers, three with most and two with fewest MUST calls, against the first and the last name."""
    g = cut(s.graph.where("kind = 'MUST'").groupBy("caller_name").count())
    most = g.orderBy(F.desc("count"), "caller_name").limit(3).select(F.col("caller_name").alias("a"))
    least = g.orderBy("count", "caller_name").limit(2).select(F.col("caller_name").alias("a"))
    ends = s.functions.agg(F.array_distinct(F.array(F.min("name"), F.max("name"))).alias("b")).select(F.explode("b").alias("b"))
    return cut(most.union(least).distinct().join(F.broadcast(ends)))  # at most ten rows


PAIRS = """SELECT a, b FROM (SELECT a FROM (SELECT caller_name AS a FROM fc WHERE kind = 'MUST' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
 UNION SELECT a FROM (SELECT caller_name AS a FROM fc WHERE kind = 'MUST' GROUP BY 1 ORDER BY count(*), 1 LIMIT 2)), (SELECT min(name) AS b FROM fn UNION SELECT max(name) FROM fn)"""


def _q(f):
    return lambda spark, d: f(Store(spark, d))


def _checked(s: Store) -> DataFrame:
    v.require_contract(s.graph, s.meta)
    return s.graph


def contract_verdicts(s: Store) -> DataFrame:
    """The verdict on the kinds as they are read, and on the raw ones, where nulls and foreign kinds are refused."""
    return v.contract_verdict(s.graph, s.meta, "kind").union(v.contract_verdict(s.graph, s.meta, "raw_kind"))


def as_loaded(s: Store) -> DataFrame:
    """Effects, repeated rows included, with touched values in the form in which capabilities are stored."""
    return s.raw("function_effects").withColumn("value_touched", text.encode_value_touched(text.parse_value_touched(F.col("value_touched"))))


def dead_named(s: Store) -> DataFrame:
    return v.dead_code(s.graph, s.functions, v.roots_named(s.functions, [hub(s)]), contract=False)


def action(s: Store) -> str:
    r = s.attack_edges.where("edge_type in ('sequence', 'removes_guard')").groupBy("from_action").count().orderBy(F.desc("count"), "from_action").first()
    return r.from_action if r else ""


QUERIES = {
    "callers_of": _q(lambda s: v.callers_of(s.flat_calls, "Corelib.Result.bind")),
    "callees_of": _q(lambda s: v.callees_of(s.flat_calls, hub(s))),
    "reachable_from": _q(lambda s: v.reachable_from(s.graph, hub(s))),
    "reaches": _q(lambda s: v.reaches(s.graph, pairs(s))),
    "reaches_main": _q(lambda s: v.reaches_main(s.functions, s.graph, pairs(s))),
    "unreachable": _q(lambda s: v.unreachable(_checked(s), pairs(s))),
    "unreachable_main": _q(lambda s: v.unreachable_main(s.functions, s.graph, pairs(s))),
    "require_contract": _q(lambda s: v.contract_report(s.flat_calls)),
    "require_contract_verdicts": _q(contract_verdicts),
    "escapes": _q(lambda s: v.escapes(_checked(s), hub(s))),
    "escapes_main": _q(lambda s: v.escapes_main(s.functions, s.graph, hub(s))),
    "fan_in": _q(lambda s: v.fan_in(s.flat_calls)),
    "exported": _q(lambda s: v.exported(s.functions)),
    "exported_main": _q(lambda s: v.exported_main(s.functions, s.modules)),
    "unresolved": _q(lambda s: v.unresolved(s.flat_calls, s.functions)),
    "find": _q(lambda s: v.find(s.functions, PATTERN)),
    "stats": _q(lambda s: v.stats(s.functions, s.calls)),
    "stats_contract": _q(lambda s: v.contract_line(s.meta)),
    "stats_kinds": _q(lambda s: v.kind_stats(s.calls, "raw_kind")),
    "stats_effects": _q(lambda s: v.effect_stats(s.effects)),
    "mutators_of": _q(lambda s: v.mutators_of(s.named_calls, s.functions, s.effects, VALUE_KIND)),
    "effects_of": _q(lambda s: v.effects_of(s.graph, s.effects, hub(s))),
    "pure_fns": _q(lambda s: v.pure_fns(s.graph, s.functions, s.effects)),
    "mutators_of_main": _q(lambda s: v.mutators_of_main(s.named_calls, s.functions, s.modules, s.effects, VALUE_KIND)),
    "effects_of_main": _q(lambda s: v.effects_of_main(s.graph, s.effects, hub(s))),
    "pure_fns_main": _q(lambda s: v.pure_fns_main(s.graph, s.functions, s.modules, s.effects)),
    "mutators_of_ids": _q(lambda s: v.mutators_of_ids(s.named_calls, s.functions, s.modules, s.effects, VALUE_KIND)),
    "effects_of_ids": _q(lambda s: v.effects_of_ids(s.graph, s.functions, s.effects, hub(s))),
    "pure_fns_ids": _q(lambda s: v.pure_fns_ids(s.graph, s.functions, s.modules, s.effects)),
    "dead_code": _q(lambda s: v.dead_code(_checked(s), s.functions, v.roots_exported(s.functions), contract=True)),
    "dead_code_roots": _q(dead_named),
    "capabilities_of": _q(lambda s: v.capabilities_of(s.effects, COMPONENT)),
    "compose": _q(lambda s: v.compose(s.attack_edges, s.effects, action(s))),
    "removes_guard": _q(lambda s: v.removes_guard(s.attack_edges, s.effects, GUARD)),
    "actor_paths": _q(lambda s: v.actor_paths(s.raw("function_effects"), TOUCHED)),
    "actor_paths_touched": _q(lambda s: v.actor_paths(as_loaded(s), RESOURCE)),
    "prune": _q(lambda s: v.prune(s.attack_edges, s.effects, COMPONENT, OTHER)),
    "prune_pairs": _q(lambda s: v.prune_pairs(s.attack_edges, s.effects, [(a, b) for a in COMPONENTS for b in COMPONENTS if a != b])),
    "prune_rows": _q(lambda s: v.prune_rows(s.attack_edges, s.effects, "a", "s")),
    "src_meta": _q(lambda s: s.meta),
}


def _closure(seed: str, kinds: str | None, backward: bool = False, key: str = "name", nulls: bool = False) -> str:
    a, b = (f"callee_{key}", f"caller_{key}") if backward else (f"caller_{key}", f"callee_{key}")
    where = f" AND (c.raw_kind IS NULL OR c.kind IN ({kinds}))" if nulls else f" AND c.kind IN ({kinds})" if kinds else ""
    return f"{seed} UNION SELECT c.{b} FROM fc c JOIN r ON c.{a} = r.n WHERE c.{b} IS NOT NULL{where}"


def _rooted(kinds: str, key: str = "name") -> str:
    seed = "SELECT a AS root, a AS n FROM pr" if key == "name" else "SELECT p.a AS root, f.id AS n FROM pr p JOIN fn f ON f.name = p.a"
    return f"{seed} UNION SELECT r.root, c.callee_{key} FROM fc c JOIN r ON c.caller_{key} = r.n WHERE c.callee_{key} IS NOT NULL AND c.kind IN ({kinds})"


def _text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"


MUST, BOTH = "'MUST'", "'MUST', 'MAY_ENUMERATED'"
_HIT = "EXISTS (SELECT 1 FROM r WHERE r.root = pr.a AND r.n = pr.b)"
_HIT_ID = "EXISTS (SELECT 1 FROM r JOIN fn f ON f.id = r.n WHERE r.root = pr.a AND f.name = pr.b)"
_OPEN = "EXISTS (SELECT 1 FROM r JOIN fc c ON c.caller_{k} = r.n WHERE r.root = pr.a AND (c.kind IS NULL OR c.kind NOT IN ('MUST', 'MAY_ENUMERATED')))"


def _reaches(hit: str) -> str:
    return f"SELECT a, b, CASE WHEN {hit} THEN {_text(v.PATH_EXISTS)} ELSE {_text(v.NO_PATH)} END AS result FROM pr"


def _unreachable(hit: str, key: str) -> str:
    return f"SELECT a, b, CASE WHEN {hit} THEN {_text(v.REACHABLE)} WHEN {_OPEN.format(k=key)} THEN {_text(v.UNKNOWN)} ELSE {_text(v.UNREACHABLE)} END AS verdict FROM pr"


_ESC = "SELECT DISTINCT c.caller_name AS escaping_fn, c.call_site, coalesce(c.kind, 'NULL') AS kind FROM fc c WHERE c.caller_{k} IN (SELECT n FROM r) AND (c.kind IS NULL OR c.kind NOT IN ('MUST', 'MAY_ENUMERATED'))"
_ONE = "SELECT function_name, x.c AS reachability_class, x.r AS actor_role FROM (SELECT function_name, first(struct_pack(c := reachability_class, r := actor_role) ORDER BY coalesce(reachability_class, '~'), coalesce(actor_role, '~')) AS x FROM fx GROUP BY 1)"
_M = "(lower(coalesce({x}.file_path, '')) LIKE '%{c}%' OR lower({x}.function_name) LIKE '%{c}%')"
_ACTION = "(SELECT from_action FROM ae WHERE edge_type IN ('sequence', 'removes_guard') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_TOUCH = "({x}.value_kind = '{t}' OR coalesce({x}.value_touched, '') ILIKE '%\"kind\":\"{t}\"%')"
_LOADED = """SELECT * REPLACE (replace(replace(replace(value_touched, '": "', '":"'), '", "', '","'), '}, {', '},{') AS value_touched) FROM fx"""


def _actor_paths(effects: str, t: str) -> str:
    return f"""SELECT DISTINCT a.function_name AS action_a, a.actor_role AS actor_a, b.function_name AS action_b, b.actor_role AS actor_b, a.value_touched AS value_touched_a, b.value_touched AS value_touched_b
 FROM {effects} a JOIN {effects} b ON a.actor_role <> b.actor_role AND a.function_name <> b.function_name WHERE {_TOUCH.format(x='a', t=t)} AND {_TOUCH.format(x='b', t=t)}"""


def _shared(a: str, b: str) -> str:
    return f"""FROM ae e JOIN fx a ON e.from_action = a.function_name JOIN fx b ON e.to_action = b.function_name
 WHERE e.edge_type = 'shares_resource' AND {_M.format(x='a', c=a)} AND {_M.format(x='b', c=b)}"""


def _prune(a: str, b: str) -> str:
    return f"""SELECT CASE WHEN n = 0 THEN 'PRUNE: no shared resource found between ''{a}'' and ''{b}'' — safe to prune (P13 passes)'
 ELSE 'DO NOT PRUNE: ' || n || ' shared_resource edge(s) between ''{a}'' and ''{b}'' — P13 signal' END AS verdict, n FROM (SELECT count(*) AS n {_shared(a, b)})"""


def _verdict(kind: str) -> str:
    bad = f"count(*) FILTER (WHERE {kind} IS NULL OR {kind} NOT IN ('MUST', 'MAY_ENUMERATED', 'MAY_TOP'))"
    return f"""SELECT '{kind}' AS kind_column, count(*) AS edges, count(*) FILTER (WHERE {kind} IS NULL) AS null_kinds, count(*) FILTER (WHERE {kind} NOT IN ('MUST', 'MAY_ENUMERATED', 'MAY_TOP')) AS foreign_kinds,
 CASE WHEN NOT EXISTS (SELECT 1 FROM me WHERE key = '{CONTRACT_KEY}') THEN 'REFUSED: the index does not carry the call-graph contract' WHEN {bad} > 0 THEN 'REFUSED: ' || {bad} || ' call edges with a null or foreign kind' ELSE 'ok' END AS verdict FROM fc"""


_DEAD = "SELECT f.name AS function_name, f.file_path, '{l}' AS verdict_soundness FROM fn f WHERE f.name IS NOT NULL AND NOT contains(f.name, '*TOP*') AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = f.name)"

SQL = {
    "callers_of": sql("SELECT DISTINCT caller_name, caller_file FROM fc WHERE callee_name = 'Corelib.Result.bind'"),
    "callees_of": sql(f"SELECT DISTINCT callee_name, callee_file FROM fc WHERE caller_name = {HUB}"),
    "reachable_from": sql(f"SELECT n AS reachable FROM r WHERE n <> {HUB}", r__n_end=_closure(f"SELECT {HUB}", None)),
    "reaches": sql(_reaches(_HIT), pr=PAIRS, r=_rooted(MUST)),
    "reaches_main": sql(_reaches(_HIT_ID), pr=PAIRS, r=_rooted(MUST, "id")),
    "unreachable": sql(_unreachable(_HIT, "name"), pr=PAIRS, r=_rooted(BOTH)),
    "unreachable_main": sql(_unreachable(_HIT_ID, "id"), pr=PAIRS, r=_rooted(BOTH, "id")),
    "require_contract": sql("SELECT count(*) AS edges, count(*) FILTER (WHERE raw_kind IS NULL) AS null_kinds, count(*) FILTER (WHERE raw_kind NOT IN ('MUST', 'MAY_ENUMERATED', 'MAY_TOP')) AS foreign_kinds FROM fc"),
    "require_contract_verdicts": sql(_verdict("kind") + " UNION ALL " + _verdict("raw_kind")),
    "escapes": sql(_ESC.format(k="name"), r__n_end=_closure(f"SELECT {HUB}", BOTH)),
    "escapes_main": sql(_ESC.format(k="id"), r__n_end=_closure(f"SELECT id FROM fn WHERE name = {HUB}", BOTH, key="id")),
    "fan_in": sql("SELECT callee_name, count(DISTINCT caller_name) AS callers FROM fc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    "exported": sql("SELECT name, file_path FROM fn WHERE exported = 1"),
    "exported_main": sql("SELECT f.name, m.path AS file_path FROM fn f LEFT JOIN modules m ON f.module_id = m.id WHERE f.exposed = 1"),
    "unresolved": sql("SELECT DISTINCT callee_name FROM fc WHERE callee_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fn WHERE fn.name = fc.callee_name)"),
    "find": sql(f"SELECT name, file_path, exported FROM fn WHERE name ILIKE '%{PATTERN}%'"),
    "stats": sql("SELECT (SELECT count(*) FROM fn) AS functions, (SELECT count(*) FROM fn WHERE exported = 1) AS exported, (SELECT count(*) FROM cl) AS call_edges"),
    "stats_contract": sql("SELECT 'contract: ' || coalesce((SELECT min(value) FROM me WHERE key = 'callgraph_contract'), '<none — not ⊤-marked; ''unreachable'' will refuse>') AS line"),
    "stats_kinds": sql("SELECT raw_kind AS kind, count(*) AS edges FROM cl GROUP BY 1"),
    "stats_effects": sql("SELECT count(*) AS effect_rows, count(DISTINCT function_name) AS fns_with_effects, count(DISTINCT value_kind) AS value_kinds_seen FROM fx"),
    "mutators_of": sql(
        f"""SELECT DISTINCT r.n AS function_name, coalesce(e.file_path, f.file_path) AS file_path,
 CASE WHEN r.n IN (SELECT function_name FROM fx WHERE value_kind = '{VALUE_KIND}') THEN 'direct' ELSE 'transitive' END AS how, coalesce(e.soundness, 'candidate') AS soundness
 FROM r LEFT JOIN fx e ON e.function_name = r.n AND e.value_kind = '{VALUE_KIND}' LEFT JOIN fn f ON f.name = r.n""",
        r__n_end=_closure(f"SELECT function_name FROM fx WHERE value_kind = '{VALUE_KIND}' AND function_name IS NOT NULL", BOTH, backward=True),
    ),
    "effects_of": sql(
        "SELECT DISTINCT value_kind, function_name AS mutating_fn, file_path, target, soundness FROM fx WHERE is_direct = 1 AND function_name IN (SELECT n FROM r)",
        r__n_end=_closure(f"SELECT {HUB}", BOTH),
    ),
    "pure_fns": sql(
        "SELECT f.name, f.file_path FROM fn f WHERE f.name IS NOT NULL AND NOT contains(f.name, '*TOP*') AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = f.name)",
        r__n_end=_closure("(SELECT function_name FROM fx WHERE is_direct = 1 AND function_name IS NOT NULL UNION SELECT caller_name FROM fc WHERE kind = 'MAY_TOP')", BOTH, backward=True),
    ),
    "mutators_of_main": sql(
        f"""SELECT DISTINCT r.n AS function_name, coalesce(e.file_path, m.path) AS file_path,
 CASE WHEN r.n IN (SELECT function_name FROM fx WHERE value_kind = '{VALUE_KIND}') THEN 'direct' ELSE 'transitive' END AS how, coalesce(e.soundness, 'candidate') AS soundness
 FROM r LEFT JOIN fx e ON e.function_name = r.n AND e.value_kind = '{VALUE_KIND}' LEFT JOIN fn f ON f.name = r.n LEFT JOIN modules m ON m.id = f.module_id""",
        r__n_end=_closure(f"SELECT function_name FROM fx WHERE value_kind = '{VALUE_KIND}' AND function_name IS NOT NULL", BOTH, backward=True, nulls=True),
    ),
    "effects_of_main": sql(
        "SELECT DISTINCT value_kind, function_name AS mutating_fn, file_path, target, soundness FROM fx WHERE is_direct = 1 AND function_name IN (SELECT n FROM r)",
        r__n_end=_closure(f"SELECT {HUB}", BOTH, nulls=True),
    ),
    "pure_fns_main": sql(
        "SELECT f.name, m.path AS file_path FROM fn f LEFT JOIN modules m ON m.id = f.module_id WHERE f.name IS NOT NULL AND NOT contains(f.name, '*TOP*') AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = f.name)",
        r__n_end=_closure("(SELECT function_name FROM fx WHERE is_direct = 1 AND function_name IS NOT NULL UNION SELECT caller_name FROM fc WHERE kind = 'MAY_TOP' AND raw_kind IS NOT NULL)", BOTH, backward=True, nulls=True),
    ),
    "mutators_of_ids": sql(
        f"""SELECT DISTINCT r.n AS function_id, f.name AS function_name, coalesce(e.file_path, m.path) AS file_path,
 CASE WHEN r.n IN (SELECT function_id FROM fx WHERE value_kind = '{VALUE_KIND}') THEN 'direct' ELSE 'transitive' END AS how, coalesce(e.soundness, 'candidate') AS soundness
 FROM r JOIN fn f ON f.id = r.n LEFT JOIN fx e ON e.function_id = r.n AND e.value_kind = '{VALUE_KIND}' LEFT JOIN modules m ON m.id = f.module_id""",
        r__n_end=_closure(f"SELECT function_id FROM fx WHERE value_kind = '{VALUE_KIND}' AND function_id IS NOT NULL", BOTH, backward=True, key="id", nulls=True),
    ),
    "effects_of_ids": sql(
        "SELECT DISTINCT function_id, value_kind, function_name AS mutating_fn, file_path, target, soundness FROM fx WHERE is_direct = 1 AND function_id IN (SELECT n FROM r)",
        r__n_end=_closure(f"SELECT id FROM fn WHERE name = {HUB}", BOTH, key="id", nulls=True),
    ),
    "pure_fns_ids": sql(
        "SELECT f.id, f.name, m.path AS file_path FROM fn f LEFT JOIN modules m ON m.id = f.module_id WHERE f.name IS NOT NULL AND NOT contains(f.name, '*TOP*') AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = f.id)",
        r__n_end=_closure("(SELECT function_id FROM fx WHERE is_direct = 1 AND function_id IS NOT NULL UNION SELECT caller_id FROM fc WHERE kind = 'MAY_TOP' AND raw_kind IS NOT NULL)", BOTH, backward=True, key="id", nulls=True),
    ),
    "dead_code": sql(_DEAD.format(l="sound"), r__n_end=_closure("SELECT name FROM fn WHERE exported = 1 AND name IS NOT NULL", None)),
    "dead_code_roots": sql(_DEAD.format(l="candidate"), r__n_end=_closure(f"SELECT name FROM fn WHERE name = {HUB}", None)),
    "capabilities_of": sql(
        f"""SELECT DISTINCT function_name, coalesce(reachability_class, '?') AS rclass, coalesce(actor_role, '?') AS actor_role, coalesce(temporal_class, '?') AS temporal_class,
 coalesce(gating, '?') AS gating, coalesce(value_touched, '[]') AS value_touched, coalesce(precondition, '?') AS precondition, soundness FROM fx WHERE {_M.format(x='fx', c=COMPONENT)}"""
    ),
    "compose": sql(
        f"""SELECT e.to_action, e.edge_type, e.evidence, coalesce(o.reachability_class, '?') AS to_rclass, coalesce(o.actor_role, '?') AS to_actor_role
 FROM ae e LEFT JOIN ({_ONE}) o ON o.function_name = e.to_action WHERE e.from_action = {_ACTION} AND e.edge_type IN ('sequence', 'removes_guard')"""
    ),
    "removes_guard": sql(
        f"""SELECT x.function_name AS gated_action, x.gating, e.from_action AS unlocker, e.evidence FROM fx x LEFT JOIN ae e ON e.to_action = x.function_name AND e.edge_type = 'removes_guard'
 WHERE lower(coalesce(x.gating, '')) LIKE '%{GUARD}%'"""
    ),
    "actor_paths": sql(_actor_paths("fx", TOUCHED)),
    "actor_paths_touched": sql(_actor_paths("lo", RESOURCE), lo=_LOADED),
    "prune": sql(_prune(COMPONENT, OTHER)),
    "prune_pairs": sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, verdict, n FROM ({_prune(a, b)})" for a in COMPONENTS for b in COMPONENTS if a != b)),
    "prune_rows": sql("SELECT e.from_action, e.to_action, e.evidence " + _shared("a", "s")),
    "src_meta": sql("SELECT * FROM me"),
}
