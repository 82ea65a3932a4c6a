"""Queries p1 to p5 over the tables of the fact store, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import table
from edgeloom.operators import drift, multivalue, orphans, reconcile, skewagg

KINDS = ("MUST", "MAY_ENUMERATED", "MAY_TOP")
COMPARED = ("callee_name", "call_site", "kind")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    by_id, by_name = orphans.lifetimes(table(spark, d, "code_functions"), table(spark, d, "removed_functions"))
    calls, edges = table(spark, d, "calls"), table(spark, d, "attack_edges")
    refs = [
        orphans.Reference("calls", calls, "callee_id", "id"),
        orphans.Reference("calls", calls, "callee_name", "name"),
        orphans.Reference("attack_edges", edges, "from_action", "name"),
        orphans.Reference("attack_edges", edges, "to_action", "name"),
    ]
    known = table(spark, d, "external_symbols").select(F.col("symbol").alias("kname"))
    return orphans.find_orphans(refs, by_id, by_name, known, always_exempt=["*TOP*"])


def p1_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = reconcile.reconcile(table(spark, d, "calls"), table(spark, d, "calls_mirror"), "id", COMPARED, ("calls", "mirror"))
    return found.select(F.col("key").alias("call_id"), "diff")


def _packed(spark: SparkSession, d: str) -> list[multivalue.Packed]:
    effects, cons = table(spark, d, "function_effects"), table(spark, d, "type_constructors")
    return [
        multivalue.Packed("function_effects", effects, "id", "actor_role", "producer", "word"),
        multivalue.Packed("function_effects", effects, "id", "temporal_class", "producer", "word"),
        multivalue.Packed("type_constructors", cons, "id", "arg_types", None, "type"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.split_values(_packed(spark, d))


def p3_separators(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.separators(_packed(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "extract_lines"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_records(table(spark, d, "extract_lines"))


def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.fused_schema(table(spark, d, "extract_lines"))


def p5_callee_stats(spark: SparkSession, d: str) -> DataFrame:
    return skewagg.salted_stats(table(spark, d, "calls"), "callee_name", "caller_id", "kind", KINDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skewagg.keys_of_share(p5_callee_stats(spark, d), "callee_name", 0.01)


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_period, p2_found, p3_found, p3_separators, p4_found, p4_records, p4_schema, p5_callee_stats, p5_found)}

_P1 = """
WITH gone AS (SELECT function_id AS id, min(removed_at) AS stop FROM removed_functions GROUP BY 1),
life AS (SELECT f.id, min(f.loaded_at) AS start, min(g.stop) AS stop FROM code_functions f LEFT JOIN gone g ON f.id = g.id GROUP BY f.id),
names AS (SELECT DISTINCT f.name, l.start, l.stop FROM code_functions f JOIN life l ON f.id = l.id),
refs AS (
  SELECT 'calls' AS src_table, created_at, id AS row_id, 'callee_id' AS ref_field, callee_id AS k, CAST(NULL AS VARCHAR) AS n, loaded_at FROM calls WHERE callee_id IS NOT NULL
  UNION ALL SELECT 'calls', created_at, id, 'callee_name', NULL, callee_name, loaded_at FROM calls WHERE callee_name IS NOT NULL
  UNION ALL SELECT 'attack_edges', created_at, id, 'from_action', NULL, from_action, loaded_at FROM attack_edges WHERE from_action IS NOT NULL
  UNION ALL SELECT 'attack_edges', created_at, id, 'to_action', NULL, to_action, loaded_at FROM attack_edges WHERE to_action IS NOT NULL),
found AS (SELECT DISTINCT src_table, strftime(created_at, '%Y-%m') AS period, row_id, ref_field FROM refs r
  WHERE (n IS NULL OR (n <> '*TOP*' AND NOT EXISTS (SELECT 1 FROM external_symbols e WHERE e.symbol = r.n)))
  AND NOT EXISTS (SELECT 1 FROM life l WHERE l.id = r.k AND l.start <= r.loaded_at AND (l.stop IS NULL OR r.loaded_at < l.stop))
  AND NOT EXISTS (SELECT 1 FROM names l WHERE l.name = r.n AND l.start <= r.loaded_at AND (l.stop IS NULL OR r.loaded_at < l.stop)))
"""

_TYPE = "CASE {x} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END"
_AT = """'$."' || k || '"'"""
_P4 = f"""
WITH l AS (SELECT DISTINCT stream_id, file_seq, payload FROM extract_lines WHERE CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
kv AS (SELECT stream_id, file_seq, nullif(CAST(json_extract(payload, '$.id') AS VARCHAR), 'null') AS rid, k, {_TYPE.format(x=f"json_type(payload, {_AT})")} AS t, CAST(json_extract(payload, {_AT}) AS VARCHAR) AS v
 FROM (SELECT *, unnest(json_keys(payload)) AS k FROM l))"""

# A walk over the characters of a text: q is the open quote, p whether it may just have been closed, d the depth of brackets.
_STATE = "STRUCT(q VARCHAR, p BOOLEAN, d INT, cur VARCHAR, items VARCHAR[])"
_WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def _walk(quotes: str, brackets: bool, allowed: str) -> str:
    def state(q: str = "s.q", p: str = "false", d: str = "s.d", cur: str = "s.cur", items: str = "s.items") -> str:
        return f"struct_pack(q := {q}, p := {p}, d := {d}, cur := {cur}, items := {items})"

    cut = state(cur="''", items="list_append(s.items, s.cur)")
    more, double = state(cur="s.cur || c.cur"), "s.cur[-1] = ' ' AND c.cur = ' '" if brackets else "false"
    nested = f"WHEN contains('([{{', c.cur) THEN {state(d='s.d + 1', cur='s.cur || c.cur')} WHEN s.d > 0 AND contains(')]}}', c.cur) THEN {state(d='s.d - 1', cur='s.cur || c.cur')} WHEN s.d > 0 THEN {more}" if brackets else ""
    step = f"""CASE WHEN s.q <> '' AND s.p THEN {state(cur="s.cur || c.cur")} WHEN s.q <> '' AND c.cur = s.q THEN {state(p='true')} WHEN s.q <> '' THEN {more}
 WHEN s.d = 0 AND contains({quotes}, c.cur) AND trim(s.cur, {_WS}) = '' THEN {state(q='c.cur', cur="''")} {nested} WHEN {double} THEN {cut} WHEN NOT contains({allowed}, c.cur) THEN {cut} ELSE {more} END"""
    closed = f"CASE WHEN s.q <> '' AND s.p AND c.cur <> s.q THEN {cut.replace('q := s.q', chr(113) + ' := ' + chr(39) * 2)} ELSE s END"
    start = f"CAST({state(q=chr(39) * 2, d='0', cur=chr(39) * 2, items='[]')} AS {_STATE})"
    chars = f"list_transform(string_split(t, ''), lambda x: CAST({state(q=chr(39) * 2, d='0', cur='x', items='[]')} AS {_STATE}))"
    return f"list_reduce({chars}, lambda s, c: list_transform([{closed}], lambda s: {step})[1], {start})"


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'"
_AROUND = "CASE WHEN length(t) > 1 AND t[1] = '[' AND t[-1] = ']' AND {whole} THEN substring(t, 2, length(t) - 2) ELSE t END"
# Around a whole field of types if no bracket closes before the end to depth 0, and the field itself is no variant.
_FLAT = "regexp_replace({x}, '[(\\[{{][^(){{}}\\[\\]]*[)\\]}}]', '', 'g')"
_ALONE = "NOT contains(" + _FLAT.format(x=_FLAT.format(x="substring(t, 2, length(t) - 2)")) + ", '`') AND len(list_filter(list_transform(range(1, length(t)), lambda i: length(regexp_replace(t[1:i], '[^(\\[{]', '', 'g')) - length(regexp_replace(t[1:i], '[^)\\]}]', '', 'g'))), lambda d: d = 0)) = 0"
_P3 = f"""
WITH raw AS (SELECT DISTINCT 'function_effects' AS src_table, id AS row_id, 'actor_role' AS field, trim(actor_role, {_WS}) AS t FROM function_effects UNION SELECT 'function_effects', id, 'temporal_class', trim(temporal_class, {_WS}) FROM function_effects
 UNION SELECT 'type_constructors', id, 'arg_types', trim(arg_types, {_WS}) FROM type_constructors),
bare AS (SELECT src_table, row_id, field, CASE WHEN field = 'arg_types' THEN {_AROUND.format(whole=_ALONE)} ELSE {_AROUND.format(whole='true')} END AS t FROM raw WHERE t <> ''),
walked AS (SELECT src_table, row_id, field, CASE WHEN field = 'arg_types' THEN {_walk("chr(34)", True, _LETTERS + " || '_.'':' || chr(32)")} ELSE {_walk("chr(34) || chr(39)", False, _LETTERS + " || '_-.:'")} END AS s FROM bare),
pieces AS (SELECT src_table, row_id, field, list_filter(list_transform(list_append(s.items, s.cur), lambda x: trim(x, {_WS})), lambda x: x <> '') AS items FROM walked)
SELECT src_table, row_id, field, CAST(i - 1 AS BIGINT) AS pos, item FROM (SELECT src_table, row_id, field, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM pieces)"""

SQL = {
    "p3_found": _P3,
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_orphans_by_period": _P1 + "SELECT src_table, ref_field, period, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
    "p2_found": """
WITH a AS (SELECT DISTINCT id, callee_name, call_site, kind FROM calls), b AS (SELECT DISTINCT id, callee_name, call_site, kind FROM calls_mirror),
j AS (SELECT a.id AS aid, b.id AS bid, a.callee_name AS an, b.callee_name AS bn, a.call_site AS ac, b.call_site AS bc, a.kind AS ak, b.kind AS bk FROM a FULL OUTER JOIN b ON a.id = b.id)
SELECT aid AS call_id, 'calls_only' AS diff FROM j WHERE bid IS NULL
UNION ALL SELECT bid, 'mirror_only' FROM j WHERE aid IS NULL
UNION ALL SELECT aid, 'callee_name' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND an IS DISTINCT FROM bn
UNION ALL SELECT aid, 'call_site' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND ac IS DISTINCT FROM bc
UNION ALL SELECT aid, 'kind' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND ak IS DISTINCT FROM bk""",
    "p4_found": _P4 + """,
files AS (SELECT DISTINCT stream_id, file_seq FROM extract_lines WHERE stream_id IS NOT NULL),
pr AS (SELECT * FROM (SELECT stream_id, file_seq, lag(file_seq) OVER (PARTITION BY stream_id ORDER BY file_seq) AS before FROM files) WHERE before IS NOT NULL),
un AS (SELECT stream_id, file_seq, k, list_sort(list(DISTINCT t) FILTER (WHERE t IS NOT NULL)) AS ts FROM kv GROUP BY 1, 2, 3),
now AS (SELECT pr.*, un.k, un.ts FROM pr JOIN un USING (stream_id, file_seq)),
old AS (SELECT pr.*, un.k, un.ts FROM pr JOIN un ON un.stream_id = pr.stream_id AND un.file_seq = pr.before),
came AS (SELECT * FROM now n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE (o.stream_id, o.file_seq, o.k) = (n.stream_id, n.file_seq, n.k))),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE (o.stream_id, o.file_seq, o.k) = (n.stream_id, n.file_seq, n.k))),
cm AS (SELECT DISTINCT pr.*, a.rid FROM pr JOIN kv a ON (a.stream_id, a.file_seq) = (pr.stream_id, pr.before) JOIN kv b ON (b.stream_id, b.file_seq) = (pr.stream_id, pr.file_seq) AND a.rid = b.rid),
gv AS (SELECT g.stream_id, g.file_seq, g.k, list_sort(list(DISTINCT (c.rid, v.t, v.v))) AS x FROM gone g JOIN cm c ON (c.stream_id, c.file_seq) = (g.stream_id, g.file_seq) JOIN kv v ON (v.stream_id, v.file_seq, v.rid, v.k) = (g.stream_id, g.before, c.rid, g.k) WHERE v.t IS NOT NULL GROUP BY 1, 2, 3),
cv AS (SELECT g.stream_id, g.file_seq, g.k, list_sort(list(DISTINCT (c.rid, v.t, v.v))) AS x FROM came g JOIN cm c ON (c.stream_id, c.file_seq) = (g.stream_id, g.file_seq) JOIN kv v ON (v.stream_id, v.file_seq, v.rid, v.k) = (g.stream_id, g.file_seq, c.rid, g.k) WHERE v.t IS NOT NULL GROUP BY 1, 2, 3),
rn AS (SELECT g.stream_id, g.file_seq, g.k AS o, c.k AS n FROM gv g JOIN cv c ON (c.stream_id, c.file_seq, c.x) = (g.stream_id, g.file_seq, g.x))
SELECT stream_id, file_seq, 'renamed' AS change, o || '>' || n AS field FROM rn
UNION ALL SELECT stream_id, file_seq, 'removed', k FROM gone WHERE (stream_id, file_seq, k) NOT IN (SELECT stream_id, file_seq, o FROM rn)
UNION ALL SELECT stream_id, file_seq, 'added', k FROM came WHERE (stream_id, file_seq, k) NOT IN (SELECT stream_id, file_seq, n FROM rn)
UNION ALL SELECT n.stream_id, n.file_seq, 'type_changed', n.k FROM now n JOIN old o ON (o.stream_id, o.file_seq, o.k) = (n.stream_id, n.file_seq, n.k) WHERE len(n.ts) > 0 AND len(o.ts) > 0 AND n.ts <> o.ts""",
    "p4_schema": _P4 + """,
tr AS (SELECT l.stream_id, l.file_seq, regexp_replace(regexp_replace(t.fullkey, '^\\$\\.', ''), '\\[[0-9]+\\]', '[]', 'g') AS field, """ + _TYPE.format(x="t.type") + """ AS type FROM l, json_tree(l.payload) t WHERE t.fullkey <> '$'),
pf AS (SELECT DISTINCT stream_id, file_seq, field, coalesce(type, 'null') AS type FROM tr r WHERE type IS NOT NULL OR NOT EXISTS (SELECT 1 FROM tr q WHERE (q.stream_id, q.file_seq, q.field) = (r.stream_id, r.file_seq, r.field) AND q.type IS NOT NULL))
SELECT stream_id, field, type, min(file_seq) AS first_file, count(*) AS files FROM pf GROUP BY 1, 2, 3""",
    "p5_callee_stats": """
SELECT callee_name, count(*) AS n_rows, count(DISTINCT caller_id) AS n_distinct, count(*) FILTER (WHERE kind = 'MUST') AS n_must,
 count(*) FILTER (WHERE kind = 'MAY_ENUMERATED') AS n_may_enumerated, count(*) FILTER (WHERE kind = 'MAY_TOP') AS n_may_top,
 count(*) FILTER (WHERE kind IS NULL OR kind NOT IN ('MUST', 'MAY_ENUMERATED', 'MAY_TOP')) AS n_other FROM calls GROUP BY 1""",
    "p5_found": "SELECT callee_name FROM calls WHERE callee_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM calls)",
}
