"""The fact store's tables over the files of a data folder, as DataFrames and as SQL common table expressions.

Repeated deliveries are folded: functions to the latest delivery of each id, all other tables to distinct rows. Calls
whose kind is none of the three are read as unknown targets (MAY_TOP), which keeps every over-approximation sound; the raw
kind stays in ``raw_kind`` for the contract check. Tables the folder does not have (fields, usages, dependencies,
coverage, tasks, unsafe parameters) are derived from those it has.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.cluster import cut, table
from edgeloom.operators.resolve import stamp_contract
from edgeloom.schemas import KINDS


class Store:
    """Lazily built DataFrames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def modules(self) -> DataFrame:
        return self.raw("modules").select("id", "path", "lines", "intent", "has_mli")

    @cached_property
    def functions(self) -> DataFrame:
        latest = Window.partitionBy("id").orderBy(
            F.desc("loaded_at"), F.desc("created_at"), "name", F.coalesce("signature", F.lit("")), F.coalesce("intent", F.lit("")), F.coalesce("exposed", F.lit(-1)), F.coalesce("exported", F.lit(-1))
        )
        f = self.raw("code_functions").withColumn("rn", F.row_number().over(latest)).where("rn = 1")
        return f.select(
            "id", "module_id", "name", "file_path", "signature", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("line_count"),
            "exposed", "exported", "intent", F.col("comment_quality_score").alias("score"), "has_pre", "has_post", "has_violators", "has_violates",
        )

    @cached_property
    def calls(self) -> DataFrame:
        c = self.raw("calls").select("id", "caller_id", "callee_id", "callee_name", "call_site", F.col("kind").alias("raw_kind")).distinct()
        return c.withColumn("kind", F.when(F.col("raw_kind").isin(*KINDS), F.col("raw_kind")).otherwise("MAY_TOP"))

    @cached_property
    def flat_calls(self) -> DataFrame:
        f = self.functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
        g = self.functions.select(F.col("id").alias("callee_id"), F.col("file_path").alias("callee_file"))
        c = self.calls.join(f, "caller_id").join(g, "callee_id", "left")
        return c.select("id", "caller_id", "callee_id", "caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind", "raw_kind")

    @cached_property
    def named_calls(self) -> DataFrame:
        """The flat calls without files: one join less, for questions about edges."""
        f = self.functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
        return self.calls.join(f, "caller_id").select("id", "caller_id", "callee_id", "caller_name", "callee_name", "call_site", "kind", "raw_kind")

    @cached_property
    def graph(self) -> DataFrame:
        """The named calls, written once: for questions that look at them several times."""
        return cut(self.named_calls)

    @cached_property
    def meta(self) -> DataFrame:
        """(key, value): the stamp, which an index without functions does not get, who built the facts, and the languages of the files."""
        stamp = stamp_contract(self.functions)
        built = self.raw("function_effects").agg(F.array_join(F.sort_array(F.collect_set("producer")), ",").alias("value"))
        known = self.functions.select(F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("x")).where("x <> ''")
        languages = known.agg(F.array_join(F.sort_array(F.collect_set("x")), ",").alias("value"))
        return stamp.unionByName(built.select(F.lit("built_by").alias("key"), "value")).unionByName(languages.select(F.lit("languages").alias("key"), "value"))

    @cached_property
    def effects(self) -> DataFrame:
        return self.raw("function_effects").drop("created_at").distinct()

    @cached_property
    def attack_edges(self) -> DataFrame:
        return self.raw("attack_edges").drop("created_at", "loaded_at").distinct()

    @cached_property
    def types(self) -> DataFrame:
        return self.raw("code_types").drop("created_at")

    @cached_property
    def constructors(self) -> DataFrame:
        return self.raw("type_constructors").distinct()

    @cached_property
    def type_fields(self) -> DataFrame:
        kind = F.when(F.col("position") % 3 == 0, "string").when(F.col("position") % 3 == 1, "int").otherwise("page_ref")
        return self.constructors.select("id", "type_id", F.lower("constructor_name").alias("field_name"), kind.alias("field_type"), "position")

    @cached_property
    def type_usage(self) -> DataFrame:
        parts = F.split("signature", " -> ")
        f = self.functions.where(F.col("signature").isNotNull())
        last = F.element_at(parts, -1)
        used = f.select(F.col("id").alias("function_id"), F.element_at(parts, 1).alias("type_name"), F.lit("param").alias("usage_role"), F.lit(0).alias("position")).unionByName(
            f.select(F.col("id").alias("function_id"), last.alias("type_name"), F.lit("return").alias("usage_role"), F.lit(None).cast("int").alias("position"))
        )
        known = self.types.groupBy("name").agg(F.min("id").alias("type_id")).withColumnRenamed("name", "type_name")
        return used.join(known, "type_name", "left").select("function_id", "type_id", "type_name", "usage_role", "position")

    @cached_property
    def module_deps(self) -> DataFrame:
        f = self.functions.select(F.col("id").alias("caller_id"), F.col("module_id").alias("source_module"))
        g = self.functions.select(F.col("id").alias("callee_id"), F.col("module_id").alias("target_module"))
        c = self.calls.join(f, "caller_id").join(g, "callee_id", "left").join(self.modules.select(F.col("id").alias("target_module"), "path"), "target_module", "left")
        line = F.split("call_site", ":").getItem(1).try_cast("int")
        c = c.where(F.col("source_module").isNotNull()).select(
            "source_module", "target_module", F.coalesce("path", F.split("callee_name", r"\.").getItem(0)).alias("target_path"), line.alias("line")
        )
        return c.groupBy("source_module", "target_module", "target_path").agg(F.min("line").alias("line_number")).select(
            "source_module", "target_module", "target_path", F.when(F.col("target_module").isNotNull(), "open").otherwise("alias").alias("dep_kind"),
            F.when(F.col("target_module").isNull(), F.upper(F.substring("target_path", 1, 1))).alias("alias_name"), "line_number",
        )

    @cached_property
    def coverage(self) -> DataFrame:
        total = F.col("line_count")
        c = self.functions.where("line_count is not null").select(F.col("id").alias("function_id"), (F.col("id") * 37 % (total + 1)).alias("covered_lines"), total.alias("total_lines"))
        return c.withColumn("percentage", F.when(F.col("total_lines") > 0, F.col("covered_lines") * F.lit(100.0) / F.col("total_lines")).otherwise(0.0).cast("double"))

    @cached_property
    def tasks(self) -> DataFrame:
        status = F.when(F.col("function_id") % 3 == 0, "open").when(F.col("function_id") % 3 == 1, "in_progress").otherwise("done")
        r = self.raw("removed_functions").select("function_id", "note").distinct()
        return r.select(F.coalesce("note", F.lit("other")).alias("category"), status.alias("status"), F.concat(F.lit("#"), F.col("function_id")).alias("github_issue"))

    @cached_property
    def unsafe_params(self) -> DataFrame:
        f = self.functions.where("signature is not null and has_violators = 1")
        return f.select(
            F.col("id").alias("function_id"), F.concat(F.lit("p"), F.col("id") % 5).alias("param_name"), F.split("signature", " -> ").getItem(0).alias("current_type"),
            F.lit("checked").alias("target_type"), (F.col("id") % 2).cast("int").alias("fixed"), F.concat(F.lit("#"), F.col("id")).alias("github_issue"),
        )


#: The same tables in SQL, each usable by those after it.
CTES = {
    "fn": """SELECT id, module_id, name, file_path, signature, line_start, line_end, line_end - line_start + 1 AS line_count, exposed, exported, intent,
 comment_quality_score AS score, has_pre, has_post, has_violators, has_violates FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC,
 name, coalesce(signature, ''), coalesce(intent, ''), coalesce(exposed, -1), coalesce(exported, -1)) AS rn FROM code_functions) WHERE rn = 1""",
    "cl": """SELECT DISTINCT id, caller_id, callee_id, callee_name, call_site, kind AS raw_kind,
 CASE WHEN kind IN ('MUST', 'MAY_ENUMERATED', 'MAY_TOP') THEN kind ELSE 'MAY_TOP' END AS kind FROM calls""",
    "fc": """SELECT c.id, c.caller_id, c.callee_id, f.name AS caller_name, f.file_path AS caller_file, c.callee_name, g.file_path AS callee_file, c.call_site, c.kind, c.raw_kind
 FROM cl c JOIN fn f ON c.caller_id = f.id LEFT JOIN fn g ON c.callee_id = g.id""",
    "me": """SELECT 'callgraph_contract' AS key, 'v1' AS value WHERE EXISTS (SELECT 1 FROM fn)
 UNION ALL SELECT 'built_by', coalesce(string_agg(DISTINCT producer, ',' ORDER BY producer), '') FROM function_effects
 UNION ALL SELECT 'languages', coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') FROM (SELECT regexp_extract(file_path, '\\.([a-z]+)$', 1) AS x FROM fn) WHERE x <> ''""",
    "fx": "SELECT DISTINCT * EXCLUDE (created_at) FROM function_effects",
    "ae": "SELECT DISTINCT * EXCLUDE (created_at, loaded_at) FROM attack_edges",
    "ty": "SELECT * EXCLUDE (created_at) FROM code_types",
    "tc": "SELECT DISTINCT * FROM type_constructors",
    "tf": """SELECT id, type_id, lower(constructor_name) AS field_name, CASE WHEN position % 3 = 0 THEN 'string' WHEN position % 3 = 1 THEN 'int' ELSE 'page_ref' END AS field_type, position FROM tc""",
    "tu": """SELECT u.function_id, k.type_id, u.type_name, u.usage_role, u.position FROM (
 SELECT id AS function_id, string_split(signature, ' -> ')[1] AS type_name, 'param' AS usage_role, 0 AS position FROM fn WHERE signature IS NOT NULL
 UNION ALL SELECT id, string_split(signature, ' -> ')[-1], 'return', NULL FROM fn WHERE signature IS NOT NULL) u
 LEFT JOIN (SELECT name, min(id) AS type_id FROM ty GROUP BY 1) k ON k.name = u.type_name""",
    "md": """SELECT source_module, target_module, target_path, CASE WHEN target_module IS NOT NULL THEN 'open' ELSE 'alias' END AS dep_kind,
 CASE WHEN target_module IS NULL THEN upper(substring(target_path, 1, 1)) END AS alias_name, line_number FROM (
 SELECT f.module_id AS source_module, g.module_id AS target_module, coalesce(m.path, string_split(c.callee_name, '.')[1]) AS target_path,
 min(TRY_CAST(string_split(c.call_site, ':')[2] AS INT)) AS line_number FROM cl c JOIN fn f ON c.caller_id = f.id LEFT JOIN fn g ON c.callee_id = g.id
 LEFT JOIN modules m ON m.id = g.module_id WHERE f.module_id IS NOT NULL GROUP BY 1, 2, 3)""",
    "cov": """SELECT function_id, covered_lines, total_lines, CASE WHEN total_lines > 0 THEN covered_lines * 100.0::DOUBLE / total_lines ELSE 0.0 END AS percentage
 FROM (SELECT id AS function_id, id * 37 % (line_count + 1) AS covered_lines, line_count AS total_lines FROM fn WHERE line_count IS NOT NULL)""",
    "gt": """SELECT coalesce(note, 'other') AS category, CASE function_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'done' END AS status,
 '#' || function_id AS github_issue FROM (SELECT DISTINCT function_id, note FROM removed_functions)""",
    "up": """SELECT id AS function_id, 'p' || (id % 5) AS param_name, string_split(signature, ' -> ')[1] AS current_type, 'checked' AS target_type,
 CAST(id % 2 AS INT) AS fixed, '#' || id AS github_issue FROM fn WHERE signature IS NOT NULL AND has_violators = 1""",
}


def sql(body: str, **more: str) -> str:
    """``body`` over the tables above; ``more`` names further common table expressions, recursive ones included."""
    parts = [f"{k} AS ({v})" for k, v in CTES.items()] + [f"{k.replace('__', '(', 1).replace('_end', ')', 1)} AS ({v})" for k, v in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
