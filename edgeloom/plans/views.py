"""The canned views and documented ad-hoc questions as DataFrames, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.comments import ENTRIES
from edgeloom.plans.substrate import Store, sql
from edgeloom.plans.verbs import one_effect

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def view(body: str, **ctes: str) -> Callable:
    """Registers a ``Store -> DataFrame`` function under its name, with SQL unless ``body`` is empty."""
    def register(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(Store(spark, d))
        if body:
            SQL[f.__name__] = sql(body, **ctes)
        return f

    return register


def paths(s: Store, key: str = "module_id", name: str = "path") -> DataFrame:
    return s.modules.select(F.col("id").alias(key), F.col("path").alias(name))


def located(s: Store) -> DataFrame:
    """Functions with the path of their module."""
    return s.functions.join(paths(s), "module_id")


def joined(column: Column, order: Column | None = None, sep: str = ",") -> Column:
    """The group's texts in a defined order; the groups here are a category or a type, bounded by its members."""
    return F.listagg(column, F.lit(sep)) if order is None else F.array_join(F.sort_array(F.collect_list(column)), sep)


# ---- views -----------------------------------------------------------------------------------------------------------

@view("SELECT path, lines, intent, has_mli FROM modules WHERE lines > 500")
def v_large_files(s: Store) -> DataFrame:
    return s.modules.where("lines > 500").select("path", "lines", "intent", "has_mli")


@view("SELECT m.path, f.name, f.line_count, f.intent, f.exposed FROM fn f JOIN modules m ON f.module_id = m.id WHERE f.line_count > 50")
def v_large_functions(s: Store) -> DataFrame:
    return located(s).where("line_count > 50").select("path", "name", "line_count", "intent", "exposed")


@view("SELECT m.path, f.name, f.signature, f.exposed FROM fn f JOIN modules m ON f.module_id = m.id WHERE f.intent IS NULL AND f.exposed = 1")
def v_undocumented(s: Store) -> DataFrame:
    return located(s).where("intent is null and exposed = 1").select("path", "name", "signature", "exposed")


@view("SELECT m.path, f.name, u.param_name, u.current_type, u.target_type, u.github_issue FROM up u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id WHERE u.fixed = 0")
def v_unsafe_params(s: Store) -> DataFrame:
    f = located(s).select(F.col("id").alias("function_id"), "path", "name")
    return s.unsafe_params.where("fixed = 0").join(f, "function_id").select("path", "name", "param_name", "current_type", "target_type", "github_issue")


@view("SELECT m.path, f.name, c.percentage, c.covered_lines, c.total_lines FROM cov c JOIN fn f ON c.function_id = f.id JOIN modules m ON f.module_id = m.id WHERE c.percentage < 50")
def v_low_coverage(s: Store) -> DataFrame:
    f = located(s).select(F.col("id").alias("function_id"), "path", "name")
    return s.coverage.where("percentage < 50").join(f, "function_id").select("path", "name", "percentage", "covered_lines", "total_lines")


@view("SELECT m.path, f.name, count(c.id) AS caller_count FROM fn f JOIN modules m ON f.module_id = m.id LEFT JOIN cl c ON f.id = c.callee_id GROUP BY f.id, m.path, f.name HAVING count(c.id) > 5")
def v_most_called(s: Store) -> DataFrame:
    counts = s.calls.where("callee_id is not null").groupBy(F.col("callee_id").alias("id")).agg(F.count("id").alias("caller_count")).where("caller_count > 5")
    return located(s).join(counts, "id").select("path", "name", "caller_count")


@view("SELECT c.callee_name, f.name AS caller_name, m.path AS caller_path, c.call_site FROM cl c JOIN fn f ON c.caller_id = f.id JOIN modules m ON f.module_id = m.id")
def v_callers(s: Store) -> DataFrame:
    f = located(s).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("path").alias("caller_path"))
    return s.calls.join(f, "caller_id").select("callee_name", "caller_name", "caller_path", "call_site")


@view("""SELECT f.name AS caller_name, m.path AS caller_path, c.callee_name, coalesce(tm.path, 'external') AS callee_path, c.call_site FROM cl c JOIN fn f ON c.caller_id = f.id
 JOIN modules m ON f.module_id = m.id LEFT JOIN fn t ON c.callee_id = t.id LEFT JOIN modules tm ON t.module_id = tm.id""")
def v_callees(s: Store) -> DataFrame:
    f = located(s).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("path").alias("caller_path"))
    t = located(s).select(F.col("id").alias("callee_id"), F.col("path").alias("callee_path"))
    c = s.calls.join(f, "caller_id").join(t, "callee_id", "left")
    return c.select("caller_name", "caller_path", "callee_name", F.coalesce("callee_path", F.lit("external")).alias("callee_path"), "call_site")


@view("SELECT category, count(*) AS count, string_agg(github_issue, ',' ORDER BY github_issue) AS issues FROM gt WHERE status = 'open' GROUP BY category")
def v_open_tasks(s: Store) -> DataFrame:
    t = s.tasks.where("status = 'open'")
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("count"), joined(F.col("github_issue"), F.col("github_issue")).alias("issues"))


def _fields(s: Store) -> DataFrame:
    t = s.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"), "kind", "module_id").join(paths(s), "module_id")
    return s.type_fields.join(t, "type_id")


_TF = "FROM tf f JOIN ty t ON f.type_id = t.id JOIN modules m ON t.module_id = m.id"


@view(f"SELECT m.path, t.name AS type_name, t.kind, f.field_name, f.field_type {_TF}")
def v_type_fields(s: Store) -> DataFrame:
    return _fields(s).select("path", "type_name", "kind", "field_name", "field_type")


@view(f"SELECT m.path, t.name AS type_name, f.field_name, f.field_type {_TF}")
def v_types_with_field_type(s: Store) -> DataFrame:
    return _fields(s).select("path", "type_name", "field_name", "field_type")


@view("SELECT m.path, t.name AS type_name, c.constructor_name, c.arg_types FROM tc c JOIN ty t ON c.type_id = t.id JOIN modules m ON t.module_id = m.id")
def v_variant_constructors(s: Store) -> DataFrame:
    t = s.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"), "module_id").join(paths(s), "module_id")
    return s.constructors.join(t, "type_id").select("path", "type_name", "constructor_name", "arg_types")


@view("""SELECT m.path AS source_path, d.target_path, d.dep_kind, d.alias_name, d.line_number, CASE WHEN d.target_module IS NOT NULL THEN 'resolved' ELSE 'external' END AS status
 FROM md d JOIN modules m ON d.source_module = m.id""")
def v_module_deps(s: Store) -> DataFrame:
    d = s.module_deps.join(paths(s, "source_module", "source_path"), "source_module")
    return d.select("source_path", "target_path", "dep_kind", "alias_name", "line_number", F.when(F.col("target_module").isNotNull(), "resolved").otherwise("external").alias("status"))


@view("SELECT m.path, count(*) AS dep_count FROM modules m JOIN md d ON m.id = d.source_module GROUP BY m.id, m.path HAVING count(*) > 10")
def v_high_deps(s: Store) -> DataFrame:
    n = s.module_deps.groupBy("source_module").agg(F.count(F.lit(1)).alias("dep_count")).where("dep_count > 10")
    return n.join(paths(s, "source_module"), "source_module").select("path", "dep_count")


def _usage(s: Store) -> DataFrame:
    f = located(s).select(F.col("id").alias("function_id"), F.col("path").alias("function_path"), F.col("name").alias("function_name"), "signature")
    status = F.when(F.col("type_id").isNotNull(), "resolved").otherwise("external")
    return s.type_usage.join(f, "function_id").withColumn("status", status)


@view("""SELECT m.path AS function_path, f.name AS function_name, u.type_name, u.usage_role, u.position, CASE WHEN u.type_id IS NOT NULL THEN 'resolved' ELSE 'external' END AS status,
 coalesce(tm.path, 'external') AS type_module_path FROM tu u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id LEFT JOIN ty t ON u.type_id = t.id LEFT JOIN modules tm ON t.module_id = tm.id""")
def v_types_used_by(s: Store) -> DataFrame:
    t = s.types.select(F.col("id").alias("type_id"), "module_id").join(paths(s, name="type_module_path"), "module_id").drop("module_id")
    u = _usage(s).join(t, "type_id", "left")
    return u.select("function_path", "function_name", "type_name", "usage_role", "position", "status", F.coalesce("type_module_path", F.lit("external")).alias("type_module_path"))


@view("""SELECT u.type_name, u.usage_role, m.path AS function_path, f.name AS function_name, f.signature, CASE WHEN u.type_id IS NOT NULL THEN 'resolved' ELSE 'external' END AS status
 FROM tu u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id""")
def v_functions_using(s: Store) -> DataFrame:
    return _usage(s).select("type_name", "usage_role", "function_path", "function_name", "signature", "status")


def _common(s: Store, role: str) -> DataFrame:
    each = s.type_usage.where(F.col("usage_role") == role).groupBy("type_name", "function_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("type_name").agg(F.sum("n").alias("usage_count"), F.count("function_id").alias("function_count")).where("usage_count > 3")


_COMMON = "SELECT type_name, count(*) AS usage_count, count(DISTINCT function_id) AS function_count FROM tu WHERE usage_role = '{}' GROUP BY 1 HAVING count(*) > 3"


@view(_COMMON.format("param"))
def v_common_param_types(s: Store) -> DataFrame:
    return _common(s, "param")


@view(_COMMON.format("return"))
def v_common_return_types(s: Store) -> DataFrame:
    return _common(s, "return")


@view("SELECT f.id AS function_id, f.name AS function_name, m.path AS module_path, CASE WHEN EXISTS (SELECT 1 FROM fx e WHERE e.function_id = f.id) THEN 0 ELSE 1 END AS is_pure FROM fn f JOIN modules m ON f.module_id = m.id")
def v_pure_functions(s: Store) -> DataFrame:
    e = s.effects.select(F.col("function_id").alias("id")).where("id is not null").distinct().withColumn("has", F.lit(True))
    return located(s).join(e, "id", "left").select(
        F.col("id").alias("function_id"), F.col("name").alias("function_name"), F.col("path").alias("module_path"), F.when(F.col("has"), 0).otherwise(1).alias("is_pure")
    )


@view("SELECT function_name, file_path, value_kind, target, soundness, producer FROM fx WHERE is_direct = 1")
def v_direct_mutators(s: Store) -> DataFrame:
    return s.effects.where("is_direct = 1").select("function_name", "file_path", "value_kind", "target", "soundness", "producer")


_CAP = ("function_name", "file_path", "reachability_class", "actor_role", "temporal_class", "gating", "value_touched", "precondition", "soundness", "producer")


@view(f"SELECT {', '.join(_CAP)} FROM fx WHERE reachability_class IS NOT NULL OR actor_role IS NOT NULL OR gating IS NOT NULL OR value_touched IS NOT NULL")
def v_capabilities(s: Store) -> DataFrame:
    return s.effects.where("coalesce(reachability_class, actor_role, gating, value_touched) is not null").select(*_CAP)


_ONE = "(SELECT function_name, x.c AS rclass, x.r AS actor FROM (SELECT function_name, first(struct_pack(c := reachability_class, r := actor_role) ORDER BY coalesce(reachability_class, '~'), coalesce(actor_role, '~')) AS x FROM fx GROUP BY 1))"


@view(f"""SELECT e.id, e.from_action, e.from_path, e.to_action, e.to_path, e.edge_type, e.evidence, e.source, a.rclass AS from_rclass, b.rclass AS to_rclass, a.actor AS from_actor, b.actor AS to_actor
 FROM ae e LEFT JOIN {_ONE} a ON e.from_action = a.function_name LEFT JOIN {_ONE} b ON e.to_action = b.function_name""")
def v_attack_edges(s: Store) -> DataFrame:
    one = one_effect(s.effects)

    def end(side: str) -> DataFrame:
        return one.select(F.col("function_name").alias(f"{side}_action"), F.col("reachability_class").alias(f"{side}_rclass"), F.col("actor_role").alias(f"{side}_actor"))

    e = s.attack_edges.join(end("from"), "from_action", "left").join(end("to"), "to_action", "left")
    return e.select("id", "from_action", "from_path", "to_action", "to_path", "edge_type", "evidence", "source", "from_rclass", "to_rclass", "from_actor", "to_actor")


_RAW = "'[{\"name\":\"' || {n} || '\",\"reason\":\"by intent\"},{\"name\":\"Missing.' || f.id || '\",\"reason\":\"gone\"}]'"


@view(f"""SELECT v.function_id, v.function_name, v.violator, v.reason, CASE WHEN EXISTS (SELECT 1 FROM fn g WHERE g.name = v.violator) THEN 'resolved' ELSE 'broken' END AS link_status FROM (
 SELECT f.id AS function_id, f.name AS function_name, json_extract_string(j.value, '$.name') AS violator, json_extract_string(j.value, '$.reason') AS reason
 FROM (SELECT id, name, {_RAW.replace('{n}', 'f.name')} AS raw FROM fn f WHERE has_violators = 1 AND name IS NOT NULL) f, json_each(f.raw) j) v""")
def v_violation_graph(s: Store) -> DataFrame:
    raw = F.concat(F.lit('[{"name":"'), "name", F.lit('","reason":"by intent"},{"name":"Missing.'), F.col("id"), F.lit('","reason":"gone"}]'))
    f = s.functions.where("has_violators = 1 and name is not null").select(F.col("id").alias("function_id"), F.col("name").alias("function_name"), raw.alias("violators_raw"))
    return violation_graph(f, s.functions)


def violation_graph(documented: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per entry of ``violators_raw``; broken if no function has the entry's name. Null and ``[]`` give no row."""
    v = documented.select("function_id", "function_name", F.inline(F.from_json("violators_raw", ENTRIES))).withColumnRenamed("name", "violator")
    names = functions.select(F.col("name").alias("violator")).where("violator is not null").distinct().withColumn("known", F.lit(True))
    return v.join(names, "violator", "left").select("function_id", "function_name", "violator", "reason", F.when(F.col("known"), "resolved").otherwise("broken").alias("link_status"))


# ---- documented ad-hoc questions -------------------------------------------------------------------------------------

@view("SELECT m.path, f.name, u.current_type FROM up u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id WHERE u.fixed = 0 AND u.param_name = 'p1'")
def sq_unsafe_by_param(s: Store) -> DataFrame:
    return v_unsafe_params(s).where("param_name = 'p1'").select("path", "name", "current_type")


@view("SELECT m.path, f.name, count(c.id) AS caller_count FROM fn f JOIN modules m ON f.module_id = m.id JOIN cl c ON f.id = c.callee_id GROUP BY f.id, m.path, f.name HAVING count(c.id) > 5 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def sq_hotspots(s: Store) -> DataFrame:
    return v_most_called(s).orderBy(F.desc("caller_count"), "path", "name").limit(10)


@view("SELECT category, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'open') AS open FROM gt GROUP BY category")
def sq_gardening_progress(s: Store) -> DataFrame:
    return s.tasks.groupBy("category").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "open").alias("open"))


@view("SELECT m.path, count(f.id) AS func_count, count(*) FILTER (WHERE f.intent IS NULL) AS undoc FROM modules m JOIN fn f ON f.module_id = m.id GROUP BY m.id, m.path HAVING count(*) FILTER (WHERE f.intent IS NULL) = count(f.id)")
def sq_undocumented_modules(s: Store) -> DataFrame:
    g = s.functions.groupBy("module_id").agg(F.count("id").alias("func_count"), F.count_if(F.col("intent").isNull()).alias("undoc")).where("undoc = func_count")
    return g.join(paths(s), "module_id").select("path", "func_count", "undoc")


def _with_type(s: Store, *tests: Column) -> DataFrame:
    """Types that have, for each test, a field that passes it."""
    g = s.type_fields.groupBy("type_id").agg(*(F.max(t.cast("int")).alias(f"t{i}") for i, t in enumerate(tests)))
    return g.where(" and ".join(f"t{i} = 1" for i in range(len(tests)))).select(F.col("type_id").alias("id"))


@view("""SELECT DISTINCT t.name, m.path FROM ty t JOIN tf a ON t.id = a.type_id AND a.field_type = 'string' JOIN tf b ON t.id = b.type_id AND b.field_type = 'int' JOIN modules m ON t.module_id = m.id""")
def sq_types_two_fields(s: Store) -> DataFrame:
    k = F.col("field_type")
    return s.types.join(_with_type(s, k == "string", k == "int"), "id").join(paths(s), "module_id").select("name", "path").distinct()


@view("SELECT m.path, t.name AS type_name, t.kind, f.field_type " + _TF + " WHERE f.field_name = 'open_lease'")
def sq_field_named(s: Store) -> DataFrame:
    return v_type_fields(s).where("field_name = 'open_lease'").select("path", "type_name", "kind", "field_type")


@view("SELECT m.path, t.name AS type_name, f.field_name, f.field_type " + _TF + " WHERE f.field_type ILIKE '%page%'")
def sq_field_type_like(s: Store) -> DataFrame:
    return v_types_with_field_type(s).where(F.col("field_type").ilike("%page%"))


@view("""SELECT t.name, m.path, string_agg(f.field_name || ':' || f.field_type, ', ' ORDER BY f.field_name || ':' || f.field_type) AS fields FROM ty t JOIN modules m ON t.module_id = m.id JOIN tf f ON t.id = f.type_id
 WHERE t.id IN (SELECT type_id FROM tf WHERE field_type = 'string') AND t.id IN (SELECT type_id FROM tf WHERE field_type = 'int') AND t.id IN (SELECT type_id FROM tf WHERE field_type ILIKE '%page%')
 GROUP BY t.id, t.name, m.path""")
def sq_types_three_fields(s: Store) -> DataFrame:
    k = F.col("field_type")
    t = s.types.join(_with_type(s, k == "string", k == "int", k.ilike("%page%")), "id").join(paths(s), "module_id").select(F.col("id").alias("type_id"), "name", "path")
    text = F.concat_ws(":", "field_name", "field_type")
    return s.type_fields.join(t, "type_id").groupBy("type_id", "name", "path").agg(joined(text, text, ", ").alias("fields")).select("name", "path", "fields")


def _using(s: Store, pattern: str, role: str) -> DataFrame:
    return v_functions_using(s).where(F.col("type_name").ilike(pattern) & (F.col("usage_role") == role))


_USING = "SELECT u.type_name, u.usage_role, m.path AS function_path, f.name AS function_name, f.signature, CASE WHEN u.type_id IS NOT NULL THEN 'resolved' ELSE 'external' END AS status FROM tu u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id"


@view(_USING + " WHERE u.type_name ILIKE '%lease%' AND u.usage_role = 'param'")
def sq_accepts_type(s: Store) -> DataFrame:
    return _using(s, "%lease%", "param")


@view(_USING + " WHERE u.type_name ILIKE '%result%' AND u.usage_role = 'return'")
def sq_returns_type(s: Store) -> DataFrame:
    return _using(s, "%result%", "return")


@view("""SELECT u.type_name, u.usage_role, u.position FROM tu u JOIN fn f ON u.function_id = f.id JOIN modules m ON f.module_id = m.id WHERE f.name = (SELECT min(name) FROM fn WHERE signature IS NOT NULL)""")
def sq_types_of_fn(s: Store) -> DataFrame:
    first = s.functions.where("signature is not null").agg(F.min("name").alias("function_name"))
    return v_types_used_by(s).join(F.broadcast(first), "function_name").select("type_name", "usage_role", "position")


@view("""SELECT f.name, m.path FROM fn f JOIN modules m ON f.module_id = m.id WHERE f.id IN (SELECT function_id FROM tu WHERE type_name ILIKE '%lease%') AND f.id IN (SELECT function_id FROM tu WHERE type_name ILIKE '%result%')""")
def sq_uses_both_types(s: Store) -> DataFrame:
    t = F.col("type_name")
    both = s.type_usage.groupBy(F.col("function_id").alias("id")).agg(F.max(t.ilike("%lease%").cast("int")).alias("a"), F.max(t.ilike("%result%").cast("int")).alias("b")).where("a = 1 and b = 1")
    return located(s).join(both, "id").select("name", "path")


@view("SELECT name, file_path, score FROM fn WHERE score < 50 AND exposed = 1")
def sq_underdocumented_api(s: Store) -> DataFrame:
    return s.functions.where("score < 50 and exposed = 1").select("name", "file_path", "score")


@view("SELECT 'modules: ' || count(*) AS line FROM modules UNION ALL SELECT 'functions: ' || count(*) FROM fn UNION ALL SELECT 'calls: ' || count(*) FROM cl")
def sq_golden_stats(s: Store) -> DataFrame:
    def line(label: str, df: DataFrame) -> DataFrame:
        return df.agg(F.concat(F.lit(f"{label}: "), F.count(F.lit(1))).alias("line"))

    return line("modules", s.modules).union(line("functions", s.functions)).union(line("calls", s.calls))
