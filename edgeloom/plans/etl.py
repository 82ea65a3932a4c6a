"""Sources, sinks, fact derivation and scalar functions as registered queries with their SQL.

Inputs that only compilers or language servers produce are derived from the folder's tables, whole, by the expressions
given here in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import shared_path
from edgeloom.functions import comments, text
from edgeloom.operators import compare, resolve, store
from edgeloom.plans.substrate import Store
from edgeloom.plans.views import QUERIES as _Q
from edgeloom.plans.views import SQL as _S
from edgeloom.plans.views import view
from edgeloom.schemas import DEP_KINDS, EDGE_TYPES, TOP, VALUE_KINDS
from edgeloom.sources import files, lsp, ndjson, sidecar

_BEFORE = set(_Q)
_CAP = "upper(substring({x}, 1, 1)) || substring({x}, 2)"
_BASE = "regexp_replace(string_split({x}, '/')[-1], '\\.[^./]*$', '')"


def cap_of(x: str) -> str:
    """SQL of the capitalised base name of a path."""
    return _CAP.format(x=_BASE.format(x=x))


# ---- sources ---------------------------------------------------------------------------------------------------------

def call_lines(s: Store) -> DataFrame:
    """The graph as records: functions, then calls; a call's line number is its id."""
    f = s.functions.where("name is not null").select(F.col("id").alias("line_no"), F.to_json(F.struct(F.lit("function").alias("type"), "name", "file_path", F.when(F.col("exported") == 1, True).otherwise(False).alias("exported"))).alias("line"))
    c = s.flat_calls.where("callee_name <> ''").select((F.col("id") + 1_000_000_000).alias("line_no"), F.to_json(F.struct("caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind")).alias("line"))
    return f.unionByName(c).unionByName(s.spark.createDataFrame([(-1, "  ")], "line_no long, line string"))


_KNOWN = "kn AS (SELECT name, arg_max(coalesce(file_path, '~'), id) AS fp, arg_max(CASE WHEN exported = 1 THEN 1 ELSE 0 END, id) AS exported FROM fn WHERE name IS NOT NULL GROUP BY 1)"


@view("SELECT name, nullif(fp, '~') AS file_path, exported FROM kn UNION ALL SELECT DISTINCT n, NULL, 0 FROM (SELECT caller_name AS n FROM fc UNION SELECT callee_name FROM fc) WHERE n <> '*TOP*' AND n NOT IN (SELECT name FROM kn)", kn=_KNOWN[7:-1])
def src_ndjson_callgraph(s: Store) -> DataFrame:
    return ndjson.callgraph(call_lines(s))[0]


@view("""SELECT name, nullif(fp, '~') AS file_path, exported FROM kn UNION ALL SELECT n, arg_max(f, o), 0 FROM (SELECT caller_name AS n, caller_file AS f, id * 2 AS o FROM fc UNION ALL SELECT callee_name, callee_file, id * 2 + 1 FROM fc)
 WHERE n <> '*TOP*' AND n NOT IN (SELECT name FROM kn) GROUP BY 1""", kn=_KNOWN[7:-1])
def src_ndjson_callgraph_lib(s: Store) -> DataFrame:
    return ndjson.callgraph(call_lines(s), mode="lib")[0]


_KINDS_SQL = ", ".join(f"'{k}'" for k, _ in VALUE_KINDS)


_EFFECT_SQL = f"""SELECT function_name, file_path, CASE WHEN value_kind IN ({_KINDS_SQL}) THEN value_kind ELSE 'UnknownMut' END AS value_kind, target, CASE WHEN coalesce(is_direct, 1) = 0 THEN 0 ELSE 1 END AS is_direct,
 CASE WHEN soundness IN ('sound', 'manual') THEN soundness ELSE 'candidate' END AS soundness, coalesce(producer, 'unknown') AS producer FROM fx WHERE function_name IS NOT NULL"""


@view(_EFFECT_SQL)
def src_ndjson_effects(s: Store) -> DataFrame:
    rec = F.to_json(F.struct(F.lit("effect").alias("type"), "function_name", "file_path", "value_kind", "target", "is_direct", "soundness", "producer"))
    return ndjson.effects(s.effects.select(F.col("id").alias("line_no"), rec.alias("line")))


@view("")
def src_sidecar_yaml(s: Store) -> DataFrame:
    """Capabilities of sidecars written from the effects, one file per producer-free function."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("precondition", F.lit("none")), '"', "'"), F.lit('"'))
    t = F.concat(F.lit("capabilities:\n  - fn: "), "function_name", F.lit("\n    precondition: "), quoted, F.lit("  # from the index\n    value_touched: "), F.coalesce("value_touched", F.lit("[]")))
    texts = s.effects.where("function_name is not null").select(F.concat(F.lit("sidecar/"), "id").alias("path"), t.alias("text"))
    return sidecar.parse_sidecars(texts).select("path", F.inline("caps"))


@view("SELECT * FROM code_functions")
def src_sqlite_scan(s: Store) -> DataFrame:
    return s.raw("code_functions")


def unit_paths(s: Store) -> DataFrame:
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    dune = F.concat_ws("/", F.regexp_replace("path", "/[^/]*$", ""), F.concat(F.lit("dune__"), F.substring_index("path", "/", -1), F.lit(".cmt")))
    return s.modules.select(F.explode(F.array(F.concat(stem, F.lit(".cmt")), F.concat(stem, F.lit(".cmti")), dune, "path")).alias("path"))


@view("SELECT regexp_replace(path, '\\.[^.]*$', '') || x AS path FROM modules, (VALUES ('.cmt'), ('.cmti')) t(x)")
def src_cmt_files(s: Store) -> DataFrame:
    return files.compiled(unit_paths(s))


_LANG = "CASE WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.ml' THEN 'ocaml' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.py' THEN 'python' END"


@view(f"SELECT * FROM (SELECT {_LANG} AS language, path FROM modules) WHERE language IS NOT NULL")
def src_source_files(s: Store) -> DataFrame:
    return files.source_files(s.modules.select("path"))


@view("SELECT name, file_path, 12 AS kind, line_start, line_end, CASE WHEN starts_with(name, '_') THEN 0 ELSE 1 END AS exported FROM fn WHERE name IS NOT NULL AND file_path IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL")
def src_lsp_symbols(s: Store) -> DataFrame:
    f = s.functions.where("name is not null and file_path is not null and line_start is not null and line_end is not null")
    span = F.struct(F.struct((F.col("line_start") - 1).alias("line")).alias("start"), F.struct((F.col("line_end") - 1).alias("line")).alias("end"))
    child = F.struct("name", F.lit(12).alias("kind"), span.alias("range"))
    tree = F.to_json(F.array(F.struct(F.lit("M").alias("name"), F.lit(2).alias("kind"), F.array(child).alias("children"))))
    return lsp.symbols(f.select(F.concat(F.lit("file:///w/"), "file_path").alias("uri"), tree.alias("response")), "/w")


@view("SELECT caller_name, caller_file, callee_name, callee_file, caller_file || ':' || id AS call_site FROM fc WHERE caller_file IS NOT NULL")
def src_lsp_calls(s: Store) -> DataFrame:
    c = s.flat_calls.where("caller_file is not null")
    uri = F.coalesce(F.concat(F.lit("file:///w/"), "callee_file"), F.lit("file:///usr/lib/x.ml"))
    r = F.to_json(F.array(F.struct(F.struct(F.col("callee_name").alias("name"), uri.alias("uri")).alias("to"), F.array(F.struct(F.struct((F.col("id") - 1).alias("line")).alias("start"))).alias("fromRanges"))))
    return lsp.outgoing_calls(c.select("caller_name", "caller_file", r.alias("response")), "/w")


@view("SELECT c.caller_name, c.caller_file, c.callee_name, l.f AS callee_file, c.call_site FROM fc c LEFT JOIN (SELECT name, arg_max(file_path, id) AS f FROM fn WHERE file_path IS NOT NULL GROUP BY 1) l ON l.name = c.callee_name WHERE c.callee_name <> '*TOP*'")
def src_cmt_calls_fallback(s: Store) -> DataFrame:
    return lsp.callee_files(s.flat_calls, s.functions.where("file_path is not null").select("id", "name", "file_path"))


def project_files(s: Store) -> DataFrame:
    """A manifest per module folder, by the module's extension."""
    ext = F.substring_index("path", ".", -1)
    manifest = F.when(ext == "ts", "package.json").when(ext == "ml", "dune-project").when(ext == "rs", "Cargo.toml").when(ext == "go", "go.mod").otherwise("setup.py")
    root = F.substring_index("path", "/", 1)
    at = F.when(F.col("id") % 5 == 0, manifest).otherwise(F.concat(F.substring_index(F.substring_index("path", "/", 2), "/", -1), F.lit("/"), manifest))
    return s.modules.select(root.alias("root"), at.alias("path"))


_MF = "SELECT string_split(path, '/')[1] AS root, id % 5 = 0 AS top, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.ml' THEN 'ocaml' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END AS lang FROM modules"
_ORDER = "CASE lang WHEN 'typescript' THEN 1 WHEN 'ocaml' THEN 2 WHEN 'rust' THEN 3 WHEN 'go' THEN 4 ELSE 5 END"


@view(f"SELECT root, arg_min(CASE WHEN top THEN lang END, CASE WHEN top THEN {_ORDER} END) AS language, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM mf GROUP BY root", mf=_MF)
def src_lang_detect(s: Store) -> DataFrame:
    d = files.detect_languages(project_files(s))
    return d.withColumn("languages", F.array_join(F.array_sort(F.split("languages", ",")), ","))


_DOCS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"


def docs(s: Store) -> DataFrame:
    return s.raw("documents").where("text is not null")


@view("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents WHERE text IS NOT NULL")
def src_file_lines(s: Store) -> DataFrame:
    return docs(s).select("doc_id", F.array_join(text.line_range(F.col("text"), F.lit(2), F.lit(4)), "\n").alias("part"))


#: A function's definition on a line; what is indented under ``let`` is an expression.
_DEFINITION = (
    r"^(?:(?:let (?:rec )?|and (?=.*=)|val |external )|[ \t]*(?:(?:export|default|pub|async|static) +)*(?:fn|func|function|def) +(?:\([^)]*\) *)?)([A-Za-z_][A-Za-z_0-9']*)"
)


def definitions(texts: DataFrame, pattern: str) -> DataFrame:
    """The texts' rows, one per line that defines a function, with line_no from 1, the name (fn), the line and the text's lines (ls)."""
    ls = texts.withColumn("ls", text.lines(F.col("text"))).drop("text")
    each = ls.select("*", F.posexplode("ls").alias("at", "line")).withColumn("fn", F.regexp_extract("line", pattern, 1))
    return each.where("fn <> ''").withColumn("line_no", F.col("at") + 1).drop("at")


def doc_comments(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, fn, comment) of (doc_id, module_path, text): every definition and the comment above it, null if there is none."""
    from edgeloom.functions.scan import REACH, find_doc_comment

    d = definitions(texts.select("doc_id", "module_path", "text"), _DEFINITION).withColumn("first", F.greatest(F.col("line_no") - REACH, F.lit(1)))
    n = F.col("line_no") - F.col("first") + 1
    near = F.array_join(F.slice("ls", F.col("first"), n), "\n")  # no more of the text is looked at
    return d.select("doc_id", "line_no", "fn", find_doc_comment(near, n, F.col("module_path")).alias("comment"))


@view("")
def src_doc_comment(s: Store) -> DataFrame:
    return doc_comments(docs(s))


# The functions that a folder of sorted record files gives for a set of functions and calls: of a name's records the last line counts.
def _ingested(calls: str) -> str:
    return f"""SELECT name, x.f AS file_path, x.e AS exported FROM g UNION ALL SELECT DISTINCT n, NULL, 0 FROM (SELECT caller_name AS n FROM fc WHERE {calls} UNION SELECT callee_name FROM fc WHERE {calls})
 WHERE n IS NOT NULL AND n <> '*TOP*' AND n NOT IN (SELECT name FROM g)"""


def _last_lines(where: str) -> str:
    return f"""SELECT name, last(struct_pack(f := file_path, e := CASE WHEN exported = 1 THEN 1 ELSE 0 END) ORDER BY file_path NULLS FIRST, exported NULLS LAST) AS x
 FROM fn WHERE name IS NOT NULL AND name <> '*TOP*' AND {where} GROUP BY 1"""


def record_files(s: Store, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """The records as a producer writes them, sorted, in files of the shared folder, and read from there line by line."""
    folder = shared_path(s.spark, "records")
    named = calls.where("caller_name <> '' and callee_name <> ''")
    store.write_ndjson(functions.where("name is not null").select("name", "file_path", "exported"), named, folder)
    return ndjson.read_lines(s.spark, folder)


def of_files(df: DataFrame, path: str, ext: str) -> DataFrame:
    return df.where(F.col(path).endswith(ext))


_NAMED = "caller_name <> '' AND callee_name <> ''"


@view(_ingested(_NAMED), g=_last_lines("true"))
def src_ndjson_files(s: Store) -> DataFrame:
    """All functions and calls through record files, with every rule of the loader."""
    lines = record_files(s, s.functions, s.flat_calls)
    return ndjson.callgraph(lines)[0]


@view(f"SELECT caller_name, callee_name, call_site, min(kind) AS kind FROM fc WHERE caller_file LIKE '%.go' AND {_NAMED} GROUP BY 1, 2, 3")
def src_go_callgraph(s: Store) -> DataFrame:
    """The Go producer's record files: one call per caller, callee and site, under the least of its kinds."""
    lines = record_files(s, of_files(s.functions, "file_path", ".go"), of_files(s.flat_calls, "caller_file", ".go"))
    return ndjson.callgraph(lines, allow_empty=True)[1].groupBy("caller_name", "callee_name", "call_site").agg(F.min("kind").alias("kind"))


@view(_ingested("false"), g=_last_lines("file_path LIKE '%.ts'"))
def src_ts_shim(s: Store) -> DataFrame:
    """The TypeScript producer's record files, which hold functions only."""
    lines = record_files(s, of_files(s.functions, "file_path", ".ts"), s.flat_calls.limit(0))
    return ndjson.callgraph(lines, allow_empty=True)[0]


def _effects_of_producer(name: str, producer: str) -> None:
    """A producer's effect records in text files, read with the loader's defaults."""
    @view(f"SELECT function_name, file_path, value_kind, target, is_direct, soundness, producer FROM ({_EFFECT_SQL}) WHERE producer = '{producer}'")
    @named(name)
    def f(s: Store) -> DataFrame:
        folder = shared_path(s.spark, "effects")
        mine = s.effects.where(F.col("producer") == producer)
        mine.select(F.to_json(F.struct(F.lit("effect").alias("type"), *_EFFECT_FIELDS)).alias("line")).write.text(folder)
        return ndjson.effects(ndjson.read_lines(s.spark, folder))


def named(name: str):
    def rename(f):
        f.__name__ = name
        return f

    return rename


_EFFECT_FIELDS = ("function_name", "file_path", "value_kind", "target", "is_direct", "soundness", "producer")
for _n, _p in (("src_go_effects", "effects-go"), ("src_ocaml_effects", "effects-ml")):
    _effects_of_producer(_n, _p)


# ---- sinks -----------------------------------------------------------------------------------------------------------

@view("SELECT 'functions' AS name, count(*) AS n FROM fn UNION ALL SELECT 'calls', count(*) FROM fc UNION ALL SELECT 'meta', 1")
def snk_flat_db(s: Store) -> DataFrame:
    """Writes the three tables to the shared folder and counts what can be read back."""
    folder = shared_path(s.spark, "flat")
    meta = s.spark.createDataFrame([("callgraph_contract", "v1")], "key string, value string")
    store.write_tables(folder, functions=s.functions.select("name", "file_path", "exported"), calls=s.flat_calls.select("caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind"), meta=meta)
    counts = [s.spark.read.parquet(f"{folder}/{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("functions", "calls", "meta")]
    return counts[0].union(counts[1]).union(counts[2])


@view("SELECT module_id, name, max(id) AS id FROM fn WHERE module_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2")
def snk_main_db(s: Store) -> DataFrame:
    rows = s.functions.where("module_id is not null and name is not null").select("module_id", "name", "id")
    return store.replace_table(store.last_binding(rows, ["module_id", "name"], "id"), shared_path(s.spark, "main"))


@view("SELECT DISTINCT name, file_path, line_start, line_end, exported FROM fn")
def snk_lsp_db(s: Store) -> DataFrame:
    """Written beside the table that is there, here an empty one, and put in its place when it is whole."""
    rows = s.functions.select("name", "file_path", "line_start", "line_end", "exported").distinct()
    path = shared_path(s.spark, "lsp")
    store.replace_table(rows.limit(0), path)
    return store.replace_table(rows, path)


_ID_FX = ("function_name", "file_path", "value_kind", "target", "producer", "is_direct")
_FOLD = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _ID_FX)


@view(f"""SELECT n.function_name, n.file_path, n.value_kind, n.target, n.producer, n.is_direct, f.function_id FROM (SELECT * FROM fx WHERE soundness <> 'sound' QUALIFY row_number() OVER (PARTITION BY {_FOLD} ORDER BY id) = 1) n
 LEFT JOIN (SELECT name, min(id) AS function_id FROM fn GROUP BY 1) f ON f.name = n.function_name
 WHERE ({_FOLD.replace('CAST(', 'CAST(n.')}) NOT IN (SELECT ({_FOLD}) FROM fx WHERE soundness = 'sound')""")
def snk_effects(s: Store) -> DataFrame:
    """Candidate and manual effects inserted beside the sound ones."""
    there, new = s.effects.where("soundness = 'sound'"), s.effects.where("soundness <> 'sound'")
    got = store.insert_effects(there, new.withColumn("at", F.col("id")), s.functions, "at")
    return got.select("function_name", "file_path", "value_kind", "target", "producer", "is_direct", "function_id")


@view(f"""SELECT i AS inserted, n - i AS skipped FROM (SELECT (SELECT count(*) FROM fx WHERE soundness <> 'sound') AS n, (SELECT count(*) FROM (SELECT DISTINCT {_FOLD} FROM fx WHERE soundness <> 'sound' EXCEPT SELECT {_FOLD} FROM fx WHERE soundness = 'sound')) AS i)""")
def snk_effects_counts(s: Store) -> DataFrame:
    """How many of the candidate and manual effects are inserted beside the sound ones, and how many are skipped."""
    there, new = s.effects.where("soundness = 'sound'"), s.effects.where("soundness <> 'sound'")
    return store.insert_counts(new, store.insert_effects(there, new.withColumn("at", F.col("id")), s.functions, "at"))


@view("""SELECT e.id, CASE WHEN c.function_name IS NOT NULL THEN c.role ELSE e.actor_role END AS actor_role FROM fx e LEFT JOIN cp c ON c.function_name = e.function_name
 UNION ALL SELECT NULL, c.role FROM cp c WHERE NOT EXISTS (SELECT 1 FROM fx e WHERE e.function_name = c.function_name OR e.function_name = string_split(c.function_name, '.')[-1])""",
    cp="SELECT name AS function_name, 'role' || max(id) AS role FROM fn WHERE name IS NOT NULL AND exposed = 1 GROUP BY 1")
def snk_capabilities(s: Store) -> DataFrame:
    caps = s.functions.where("name is not null and exposed = 1").groupBy(F.col("name").alias("function_name")).agg(F.concat(F.lit("role"), F.max("id")).alias("actor_role"))
    none = F.lit(None).cast("string")
    caps = caps.select("function_name", none.alias("file_path"), "actor_role", *(none.alias(c) for c in store.CAPABILITY_COLUMNS if c != "actor_role"))
    return store.upsert_capabilities(s.effects, caps).select("id", "actor_role")


_ID_AE = "from_action, to_action, edge_type, coalesce(from_path, ''), coalesce(to_path, '')"


@view(f"""SELECT id FROM (SELECT * FROM ae WHERE source IS DISTINCT FROM 'static' QUALIFY row_number() OVER (PARTITION BY {_ID_AE} ORDER BY id) = 1) n
 WHERE NOT EXISTS (SELECT 1 FROM ae o WHERE o.source = 'static' AND coalesce(o.from_action, '') = coalesce(n.from_action, '') AND coalesce(o.to_action, '') = coalesce(n.to_action, '') AND coalesce(o.edge_type, '') = coalesce(n.edge_type, '')
 AND coalesce(o.from_path, '') = coalesce(n.from_path, '') AND coalesce(o.to_path, '') = coalesce(n.to_path, ''))""")
def snk_attack_edges(s: Store) -> DataFrame:
    e = s.attack_edges
    return store.insert_edges(e.where("source = 'static'"), e.where("source is null or source <> 'static'").withColumn("at", F.col("id")), "at").select("id")


@view("SELECT id, from_action, NULL::VARCHAR AS from_path FROM ae")
def snk_migrate(s: Store) -> DataFrame:
    """A script that adds the path columns, run twice, and the columns of the schema."""
    script = "-- paths; of both ends\nALTER TABLE attack_edges ADD COLUMN from_path TEXT DEFAULT 'a;--b';\nALTER TABLE attack_edges ADD COLUMN to_path TEXT -- the other end\n"
    old = {"attack_edges": s.attack_edges.drop("from_path", "to_path")}
    new = store.run_migration(store.run_migration(old, script), script)["attack_edges"]
    return store.migrate(new, "attack_edges").select("id", "from_action", "from_path")


@view("SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i + 1, k, d.replace("'", "''")) for i, (k, d) in enumerate(VALUE_KINDS)) + ") t(id, name, description)")
def snk_value_kind_seed(s: Store) -> DataFrame:
    return store.value_kind_seed(s.spark)


@view("""SELECT f.id, coalesce(b.saved, CASE WHEN f.exposed = 1 THEN f.intent END) AS intent FROM fn f LEFT JOIN (SELECT module_id, name, max(intent) AS saved FROM fn WHERE intent IS NOT NULL GROUP BY 1, 2) b
 ON b.module_id = f.module_id AND b.name = f.name""")
def snk_intent_restore(s: Store) -> DataFrame:
    rebuilt = s.functions.withColumn("intent", F.when(F.col("exposed") == 1, F.col("intent")))
    return store.restore_intents(rebuilt, store.backup_intents(s.functions, ["module_id", "name"]), ["module_id", "name"]).select("id", "intent")


_FOUND = "SELECT name, CASE WHEN id % 2 = 0 THEN file_path ELSE 'other/' || array_to_string(string_split(file_path, '/')[-2:], '/') END AS file_path, max('sig' || id) AS sig FROM fn WHERE name IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2"


@view("""SELECT f.id, coalesce(x.sig, f.signature, y.sig) AS signature FROM fn f LEFT JOIN fo x ON x.name = f.name AND x.file_path = f.file_path
 LEFT JOIN (SELECT o.name, array_to_string(string_split(o.file_path, '/')[-2:], '/') AS tail, max(o.sig) AS sig FROM fo o WHERE NOT EXISTS (SELECT 1 FROM fn g WHERE g.name = o.name AND g.file_path = o.file_path) GROUP BY 1, 2) y
 ON y.name = f.name AND y.tail = array_to_string(string_split(f.file_path, '/')[-2:], '/')""", fo=_FOUND)
def snk_enrich_signature(s: Store) -> DataFrame:
    moved = F.concat(F.lit("other/"), F.substring_index("file_path", "/", -2))
    found = s.functions.where("name is not null and file_path is not null").select("name", F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(moved).alias("file_path"), F.concat(F.lit("sig"), "id").alias("signature"))
    return store.enrich_signatures(s.functions, found).select("id", "signature")


@view("""SELECT f.id, coalesce(x.sig, f.signature) AS signature, coalesce(x.exported, f.exported) AS exported FROM fn f LEFT JOIN (SELECT name, file_path, x.s AS sig, x.e AS exported FROM (SELECT name, file_path,
 max(struct_pack(s := 'ts' || id, e := 1 - exported)) AS x FROM fn WHERE file_path LIKE '%.ts' AND exported IS NOT NULL GROUP BY 1, 2)) x ON x.name = f.name AND x.file_path = f.file_path""")
def snk_enrich_ts(s: Store) -> DataFrame:
    found = s.functions.where(F.col("file_path").endswith(".ts") & F.col("exported").isNotNull()).select("name", "file_path", F.concat(F.lit("ts"), "id").alias("signature"), (F.lit(1) - F.col("exported")).alias("exported"))
    return store.enrich_exported(s.functions, found).select("id", "signature", "exported")


@view("SELECT 0 AS part, count(*) AS n, min(name) AS first_key FROM fn UNION ALL SELECT 1, count(*), min(caller_name || '→' || callee_name || coalesce('@' || call_site, '')) FROM fc")
def snk_ndjson_sorted(s: Store) -> DataFrame:
    """Counts and least keys of what the sorted files hold; ``snk_ndjson_file`` writes them."""
    return store.ndjson_sorted(s.functions, s.flat_calls).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@view("SELECT count(*) AS lines, 0 AS unsorted FROM (SELECT 1 FROM fn WHERE name IS NOT NULL UNION ALL SELECT 1 FROM fc WHERE " + _NAMED + ")")
def snk_ndjson_file(s: Store) -> DataFrame:
    """Lines of the sorted files as they are read back, and how many of them do not stand in order behind the line before."""
    lines = record_files(s, s.functions, s.flat_calls)
    call = F.get_json_object("line", "$.caller_name")
    key = F.when(call.isNull(), F.get_json_object("line", "$.name")).otherwise(
        F.concat_ws("→", call, F.concat_ws("@", F.get_json_object("line", "$.callee_name"), F.get_json_object("line", "$.call_site")))
    )
    at = F.struct(call.isNotNull().cast("int").alias("part"), key.alias("key"), F.col("line"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("line_no"))
    inside = lines.select("file", "line_no", at.alias("at")).withColumn("off", (before > F.col("at")).cast("int"))
    files = inside.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("off"), F.min("at").alias("first"), F.max("at").alias("last"))
    over = files.withColumn("off", F.coalesce("off", F.lit(0)) + F.coalesce((F.lag("last").over(Window.orderBy("file")) > F.col("first")).cast("int"), F.lit(0)))  # one row per file
    return over.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.coalesce(F.sum("off"), F.lit(0)).alias("unsorted"))


@view("")
def snk_box_table(s: Store) -> DataFrame:
    """The three most called names as lines of a box."""
    from edgeloom.plans import verbs

    lines = store.boxed(verbs.fan_in(s.flat_calls, 3).orderBy(F.desc("callers"), "callee_name")).split("\n")
    return s.spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@view("SELECT '{\"id\":' || id || ',\"name\":' || coalesce(to_json(name), 'null') || ',\"exposed\":' || CASE WHEN coalesce(exposed, 0) = 1 THEN 'true' ELSE 'false' END || '}' AS json FROM fn")
def snk_http_json(s: Store) -> DataFrame:
    return store.as_json(s.functions.select("id", "name", (F.coalesce("exposed", F.lit(0)) == 1).alias("exposed")))


# ---- fact derivation -------------------------------------------------------------------------------------------------

def pending(s: Store) -> DataFrame:
    c = s.flat_calls.where("caller_file is not null")
    own = F.col("callee_file") == F.col("caller_file")
    kind = F.when(F.col("callee_name") == TOP, "unknown").when(F.col("callee_id").isNull(), "qualified").when(F.col("id") % 3 == 0, "enumerated").when(own, "local").otherwise("qualified")
    mod = F.when(F.col("callee_id").isNull(), F.substring_index("callee_name", ".", 1)).when(own | (F.col("id") % 11 == 0), F.lit(None)).otherwise(F.concat(F.lit("Lib."), text.module_of(F.col("callee_file"))))
    return c.select(
        F.col("caller_file").alias("caller_module"), "caller_name", kind.alias("head_kind"), mod.alias("head_module"), F.col("callee_name").alias("head_name"),
        (F.col("id") % 4 == 0).alias("cond"), (F.col("id") % 13 == 0).alias("partial"), "call_site",
    )


_PENDING = f"""SELECT caller_file AS caller_module, caller_name, CASE WHEN callee_name = '*TOP*' THEN 'unknown' WHEN callee_id IS NULL THEN 'qualified' WHEN id % 3 = 0 THEN 'enumerated' WHEN callee_file = caller_file THEN 'local' ELSE 'qualified' END AS head_kind,
 CASE WHEN callee_id IS NULL THEN string_split(callee_name, '.')[1] WHEN callee_file = caller_file OR id % 11 = 0 THEN NULL ELSE {cap_of('callee_file')} END AS head_module, callee_name AS head_name, id % 4 = 0 OR id % 13 = 0 AS weak, call_site FROM fc WHERE caller_file IS NOT NULL"""
_LOOK = "SELECT file_path AS at, name AS fn, max(id) AS fid FROM fn WHERE name IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2"
_MODS = f"SELECT {cap_of('file_path')} AS mod, max(file_path) AS p FROM fn WHERE file_path IS NOT NULL GROUP BY 1"


@view("""SELECT c.fid AS caller_id, CASE WHEN p.head_kind <> 'unknown' THEN t.fid END AS callee_id, CASE WHEN p.head_kind = 'unknown' THEN '*TOP*' ELSE p.head_name END AS callee_name, p.call_site,
 CASE WHEN p.head_kind = 'unknown' THEN 'MAY_TOP' WHEN p.head_kind = 'enumerated' THEN 'MAY_ENUMERATED' WHEN p.head_kind = 'local' AND t.fid IS NULL THEN 'MAY_TOP'
 WHEN p.head_kind = 'qualified' AND p.head_module IS NULL AND t.fid IS NULL AND NOT p.weak THEN 'MAY_TOP' WHEN p.weak THEN 'MAY_ENUMERATED' ELSE 'MUST' END AS kind
 FROM pc p JOIN lk c ON c.at = p.caller_module AND c.fn = p.caller_name LEFT JOIN mo m ON m.mod = p.head_module LEFT JOIN lk t ON t.fn = p.head_name AND t.at = CASE WHEN p.head_module IS NULL THEN p.caller_module ELSE m.p END""",
    pc=_PENDING, lk=_LOOK, mo=_MODS)
def etl_resolve_calls(s: Store) -> DataFrame:
    return resolve.resolve_calls(pending(s), s.functions)


@view("SELECT 'callgraph_contract' AS key, 'v1' AS value WHERE EXISTS (SELECT 1 FROM fn)")
def etl_stamp_contract(s: Store) -> DataFrame:
    return resolve.stamp_contract(s.functions)


@view(f"""SELECT d.source_module, d.target, coalesce(a.id, b.id) AS target_module FROM dp d LEFT JOIN modules a ON a.path = d.target LEFT JOIN (SELECT {cap_of('path')} AS mod, arg_max(id, path) AS id FROM modules GROUP BY 1) b
 ON b.mod = string_split(d.target, '.')[-1]""", dp=f"SELECT id AS source_module, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 THEN 'Lib.' || {cap_of('path')} ELSE 'Nowhere.X' END AS target FROM modules")
def etl_resolve_deps(s: Store) -> DataFrame:
    r = F.col("id") % 3
    target = F.when(r == 0, F.col("path")).when(r == 1, F.concat(F.lit("Lib."), text.module_of(F.col("path")))).otherwise("Nowhere.X")
    return resolve.resolve_deps(s.modules.select(F.col("id").alias("source_module"), target.alias("target")), s.modules)


@view(f"""SELECT u.id, u.type_name, t.type_id FROM us u LEFT JOIN (SELECT {cap_of('m.path')} AS mod, t.name, max(t.id) AS type_id FROM ty t JOIN modules m ON t.module_id = m.id GROUP BY 1, 2) t
 ON u.type_name LIKE '%.%' AND t.name = string_split(u.type_name, '.')[-1] AND t.mod = string_split(u.type_name, '.')[-2]""",
    us=f"SELECT t.id, CASE WHEN t.id % 4 = 0 THEN t.name ELSE 'Lib.' || {cap_of('m.path')} || '.' || t.name END AS type_name FROM ty t JOIN modules m ON t.module_id = m.id")
def etl_resolve_type_usage(s: Store) -> DataFrame:
    t = s.types.join(s.modules.select(F.col("id").alias("module_id"), "path"), "module_id")
    name = F.when(F.col("id") % 4 == 0, F.col("name")).otherwise(F.concat_ws(".", F.lit("Lib"), text.module_of(F.col("path")), "name"))
    return resolve.resolve_type_usage(t.select("id", name.alias("type_name")), s.types, s.modules).select("id", "type_name", "type_id")


@view("")
def etl_signature_types(s: Store) -> DataFrame:
    return resolve.usage_of_signatures(s.functions)


@view("SELECT t.id, m.path, t.name, t.kind, c.constructor_name, c.arg_types, c.position FROM ty t JOIN modules m ON t.module_id = m.id LEFT JOIN tc c ON c.type_id = t.id")
def etl_type_rows(s: Store) -> DataFrame:
    t = s.types.join(s.modules.select(F.col("id").alias("module_id"), "path"), "module_id")
    c = s.constructors.select(F.col("type_id").alias("id"), "constructor_name", "arg_types", "position")
    return t.join(c, "id", "left").select("id", "path", "name", "kind", "constructor_name", "arg_types", "position")


@view("""SELECT f.id, f.name, CASE WHEN i.name IS NOT NULL THEN 1 ELSE 0 END AS exposed, coalesce(i.doc, f.intent) AS doc FROM fn f LEFT JOIN (SELECT module_id, name, max('mli: ' || signature) AS doc FROM fn WHERE exported = 1 GROUP BY 1, 2) i
 ON i.module_id = f.module_id AND i.name = f.name""")
def etl_exposed_docs(s: Store) -> DataFrame:
    i = s.functions.where("exported = 1").select("module_id", "name", F.concat(F.lit("mli: "), "signature").alias("doc"))
    return resolve.exposed_docs(s.functions.select("id", "module_id", "name", F.col("intent").alias("doc")), i)


@view("SELECT source_module, target_module, target_path, dep_kind, alias_name, line_number FROM md WHERE dep_kind IN (" + ", ".join(f"'{k}'" for k in DEP_KINDS) + ")")
def etl_module_deps(s: Store) -> DataFrame:
    return s.module_deps.where(F.col("dep_kind").isin(*DEP_KINDS))


_BLOCKS = """SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount) - 1 AS blk, l_returnflag AS rf,
 (l_linestatus = 'F' AND l_discount >= 0.08) AS term FROM lineitem"""
_EDGES = """WITH b AS ({b}), m AS (SELECT fn, max(blk) AS mx FROM b GROUP BY fn)
 SELECT b.fn, blk AS src, blk + 1 AS dst FROM b JOIN m ON b.fn = m.fn WHERE blk < mx AND NOT term UNION ALL SELECT b.fn, blk, blk + 2 FROM b JOIN m ON b.fn = m.fn WHERE blk + 2 <= mx AND rf = 'R' AND NOT term
 UNION ALL SELECT b.fn, blk, -1 FROM b JOIN m ON b.fn = m.fn WHERE blk = mx OR term""".format(b=_BLOCKS)


def cfg_blocks(s: Store) -> DataFrame:
    """Block records with the lines of an order as the blocks of a function."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount")
    of = Window.partitionBy("l_orderkey")
    return s.raw("lineitem").select(
        F.col("l_orderkey").alias("fn"), (F.row_number().over(of.orderBy(*order)) - 1).alias("block"), (F.count(F.lit(1)).over(of) - 1).alias("last"),
        (F.col("l_returnflag") == "R").alias("skips"), ((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.08)).alias("stops"),
    )


def cfg_edges(s: Store) -> DataFrame:
    return resolve.cfg_edges(cfg_blocks(s))


@view("SELECT fn, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst FROM ce", ce=_EDGES)
def etl_cfg_lower(s: Store) -> DataFrame:
    return cfg_edges(s)


@view("""SELECT b.fn, CAST(b.blk AS INT) AS block, r.n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM av a WHERE a.fn = b.fn AND a.j = b.blk AND a.n = -1) AND EXISTS (SELECT 1 FROM rc x WHERE x.fn = b.fn AND x.n = -1) AS always,
 r.n IS NOT NULL AS reachable FROM bl b LEFT JOIN rc r ON r.fn = b.fn AND r.n = b.blk""",
    ce=_EDGES, bl="SELECT fn, src AS blk FROM ce UNION SELECT fn, dst FROM ce WHERE dst >= 0",
    rc="SELECT DISTINCT fn, 0::BIGINT AS n FROM ce UNION SELECT ce.fn, ce.dst FROM rc JOIN ce ON ce.fn = rc.fn AND ce.src = rc.n",
    av="SELECT fn, blk AS j, 0::BIGINT AS n FROM bl WHERE blk <> 0 UNION SELECT ce.fn, av.j, ce.dst FROM av JOIN ce ON ce.fn = av.fn AND ce.src = av.n WHERE ce.dst <> av.j")
def etl_cfg_solve(s: Store) -> DataFrame:
    return resolve.cfg_solve(cfg_edges(s))


@view("""SELECT id, p || '.<fun:' || l || ':' || c || CASE WHEN n > 1 THEN '#' || n ELSE '' END || '>' AS name FROM (SELECT id, string_split(name, '.<fun:')[1] AS p, line_start AS l, coalesce(score, 0) % 3 AS c,
 row_number() OVER (PARTITION BY string_split(name, '.<fun:')[1], line_start, coalesce(score, 0) % 3 ORDER BY id) AS n FROM fn WHERE name LIKE '%.<fun:%' AND line_start IS NOT NULL)""")
def etl_lambda_names(s: Store) -> DataFrame:
    f = s.functions.where(F.col("name").contains(".<fun:") & F.col("line_start").isNotNull())
    return resolve.lambda_names(f.select("id", text.lambda_root(F.col("name")).alias("parent"), F.col("line_start").alias("line"), (F.coalesce("score", F.lit(0)) % 3).alias("col")))


_APPS = "SELECT c.id, c.callee_name, c.id % 6 AS nargs, e.arity, c.id % 9 = 0 AS arrow FROM cl c JOIN external_symbols e ON c.callee_name = e.symbol"


@view("SELECT id, callee_name, arrow OR nargs < arity AS partial, false AS residual FROM ap UNION ALL SELECT id, '*TOP*', false, true FROM ap WHERE arity > 0 AND nargs > arity", ap=_APPS)
def etl_partial_over_app(s: Store) -> DataFrame:
    e = s.raw("external_symbols").select(F.col("symbol").alias("callee_name"), "arity")
    return resolve.applications(s.calls.join(e, "callee_name").select("id", "callee_name", (F.col("id") % 6).alias("nargs"), "arity", (F.col("id") % 9 == 0).alias("arrow")))


@view("SELECT id, callee_name IN ('Corelib.Err.wrap', 'Corelib.Log.emit') AND id % 2 >= 1 AS stops FROM cl")
def etl_noreturn(s: Store) -> DataFrame:
    name = F.when(F.col("callee_name") == "Corelib.Err.wrap", "Stdlib.failwith").when(F.col("callee_name") == "Corelib.Log.emit", "Stdlib.exit").otherwise(F.col("callee_name"))
    return s.calls.select("id", resolve.never_returns(name, F.col("id") % 2).alias("stops"))


_MODE = "CASE c.id % 5 WHEN 0 THEN 'cha' WHEN 1 THEN 'invoke' WHEN 2 THEN 'closure' ELSE 'static' END"


@view(f"""SELECT caller, callee, site, min(kind) AS kind FROM (SELECT c.caller_id AS caller, CASE WHEN c.id % 17 = 0 THEN '*TOP*' ELSE c.callee_name END AS callee, c.call_site AS site,
 CASE WHEN c.id % 17 = 0 THEN 'MAY_TOP' WHEN {_MODE} IN ('invoke', 'closure') THEN 'MAY_TOP' WHEN {_MODE} = 'cha' THEN 'MAY_ENUMERATED' WHEN c.id % 7 > 2 THEN 'MUST' ELSE 'MAY_ENUMERATED' END AS kind FROM cl c) GROUP BY 1, 2, 3""")
def etl_go_kind(s: Store) -> DataFrame:
    r = F.col("id") % 5
    mode = F.when(r == 0, "cha").when(r == 1, "invoke").when(r == 2, "closure").otherwise("static")
    c = s.calls.select(F.col("caller_id").alias("caller"), F.col("callee_name").alias("callee"), F.col("call_site").alias("site"), mode.alias("mode"), (F.col("id") % 7 > 2).alias("always"), (F.col("id") % 17 == 0).alias("top"))
    return resolve.go_kinds(c)


_TABLE = "VALUES " + ", ".join(f"('{n}', '{k}', {i})" for i, (k, ns) in enumerate(resolve.CALLEE_KINDS.items()) for n in ns)
_STD = ("Stdlib.Hashtbl.replace", "Array.set", "print_endline", "Unix.Unix.rename", "Fmt.epr", "My.Buffer.clear")


def std_names(s: Store) -> DataFrame:
    at = (F.col("id") % len(_STD)).cast("int")
    return s.calls.select(F.when(F.col("callee_name").startswith("Corelib."), F.get(F.array(*map(F.lit, _STD)), at)).otherwise(F.col("callee_name")).alias("name"))


@view("SELECT n.name, arg_min(t.k, t.p) AS value_kind FROM nm n JOIN tb t ON t.n = n.name OR t.n = array_to_string(string_split(n.name, '.')[-2:], '.') GROUP BY 1",
    nm="SELECT DISTINCT CASE WHEN callee_name LIKE 'Corelib.%' THEN [" + ", ".join(f"'{x}'" for x in _STD) + f"][id % {len(_STD)} + 1] ELSE callee_name END AS name FROM cl", tb=f"SELECT * FROM ({_TABLE}) t(n, k, p)")
def etl_classify_callee(s: Store) -> DataFrame:
    return resolve.classify_callees(std_names(s))


_GO = (("os.WriteFile", "", ""), ("x.Write", "*bytes.Buffer", "WriteString"), ("x.Sync", "*os.File", "Sync"), ("x.Send", "net.UDPConn", "SendTo"), ("fmt.Println", "", ""), ("x.Reset", "strings.Builder", "Reset"))
_GO_KIND = ("FileSystem", "BytesBuf", None, "Network", "IoSideEffect", "BytesBuf")


@view("SELECT id, [" + ", ".join(f"'{g[0]}'" for g in _GO) + f"][id % {len(_GO)} + 1] AS name, [" + ", ".join("NULL" if k is None else f"'{k}'" for k in _GO_KIND) + f"][id % {len(_GO)} + 1] AS value_kind FROM cl WHERE id % {len(_GO)} <> 2")
def etl_go_classify(s: Store) -> DataFrame:
    at = (F.col("id") % len(_GO)).cast("int")
    cols = [F.get(F.array(*(F.lit(g[i]) for g in _GO)), at).alias(n) for i, n in enumerate(("name", "receiver", "method"))]
    return resolve.classify_go(s.calls.select("id", *cols))


@view("SELECT id, NOT starts_with(string_split(name, '.')[-1], '_') AS exported FROM fn WHERE name IS NOT NULL")
def etl_is_exported(s: Store) -> DataFrame:
    return s.functions.where("name is not null").select("id", resolve.is_exported(text.last_segments(F.col("name"), 1)).alias("exported"))


@view("""SELECT coalesce(d.file_path, w.file_path) AS file_path, coalesce(d.name, w.name) AS name, CASE WHEN d.name IS NOT NULL THEN d.line_start ELSE w.line_start END AS line_start FROM (SELECT file_path, name, max(line_start) AS line_start FROM fn
 WHERE intent IS NOT NULL AND file_path IS NOT NULL AND name IS NOT NULL AND line_start IS NOT NULL GROUP BY 1, 2) d FULL OUTER JOIN (SELECT file_path, name, min(line_start) AS line_start FROM fn WHERE file_path IS NOT NULL AND name IS NOT NULL AND line_start IS NOT NULL GROUP BY 1, 2) w
 ON d.file_path = w.file_path AND d.name = w.name""")
def etl_merge_rows(s: Store) -> DataFrame:
    f = s.functions.where("file_path is not null and name is not null and line_start is not null").select("file_path", "name", "line_start", "intent")
    doc = f.where("intent is not null").select("file_path", "name", "line_start", F.col("line_start").alias("at"))
    return resolve.merge_rows(doc, f.select("file_path", "name", "line_start", (-F.col("line_start")).alias("at")), "at")


def _sec(tag: str, tags: str = "{tags}") -> str:
    return f"trim(CASE WHEN list_position(names, '{tag}') > 0 THEN parts[list_position(names, '{tag}') + 1] ELSE '' END, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))"


def _cut(tags: tuple[str, ...]) -> str:
    p = r"\{(" + "|".join(tags) + r")\}"
    return f"SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS names, string_split_regex(text, '{p}') AS parts FROM documents WHERE text IS NOT NULL"


_SUM = "trim(parts[1], chr(32) || chr(9) || chr(10) || chr(13) || chr(12))"


def _viol(tag: str) -> str:
    return f"CASE {_sec(tag)} WHEN '' THEN 0 WHEN '(none)' THEN 12 ELSE 25 END"


@view(f"SELECT doc_id, CASE WHEN {_SUM} <> '' THEN 15 ELSE 0 END + CASE WHEN {_sec('pre')} <> '' THEN 15 ELSE 0 END + CASE WHEN {_sec('post')} <> '' THEN 20 ELSE 0 END + {_viol('violators')} + {_viol('violates')} AS score FROM ct", ct=_cut(comments.INDEX_TAGS))
def etl_comment_score_cmt(s: Store) -> DataFrame:
    return docs(s).select("doc_id", comments.score_index(comments.parse_index(F.col("text"))).alias("score"))


@view("")
def etl_comment_score_lsp(s: Store) -> DataFrame:
    return docs(s).select("doc_id", comments.score_lsp(comments.parse_lsp(F.col("text"))).alias("score"))


@view("SELECT id, CASE WHEN intent IS NOT NULL AND name NOT LIKE '%.<fun:%' THEN score END AS score FROM fn")
def etl_score_gate(s: Store) -> DataFrame:
    return s.functions.select("id", comments.gated_score(F.col("score"), F.col("name"), F.col("intent")).alias("score"))


@view("")
def etl_line_count(s: Store) -> DataFrame:
    from edgeloom.functions.scan import count_code_lines

    return docs(s).select("doc_id", count_code_lines(F.col("text")).alias("code_lines"))


_DIGEST = r"md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))), lambda x: x <> ''), chr(10)))"


@view(f"""SELECT module_path, CASE WHEN count(DISTINCT d) = 0 THEN 'Not_found' WHEN count(DISTINCT d) = 1 THEN 'Identical' ELSE 'Differs' END AS verdict, count(d) AS copies, count(DISTINCT d) AS versions
 FROM (SELECT module_path, {_DIGEST} AS d FROM documents) GROUP BY 1""")
def etl_body_compare(s: Store) -> DataFrame:
    return compare.body_verdicts(s.raw("documents").select("module_path", F.col("text").alias("body")), "module_path")


def bodies(texts: DataFrame) -> DataFrame:
    """(id, line_no, fn, body) of (doc_id, text): every ``let`` at a line's start, also of a name that comes again."""
    d = definitions(texts.select("doc_id", "text"), r"^let (?:rec )?([A-Za-z_0-9']+)")
    named = F.col("line").rlike(r"^let (?:rec )?[A-Za-z_0-9']+(?:[ (=:]|\z)")  # else the name would be looked for in later lines
    rest = F.when(named, F.array_join(F.slice("ls", F.col("line_no"), F.size("ls")), "\n"))
    got = compare.extract_bodies(d.select(F.struct("doc_id", "line_no", "fn").alias("id"), rest.alias("source"), "fn"))
    return got.select(F.col("id.doc_id").alias("id"), "id.line_no", "id.fn", "body")


@view("")
def etl_extract_body(s: Store) -> DataFrame:
    return bodies(docs(s))


def diff_lines(s: Store) -> DataFrame:
    """One diff per module: functions leave their file and most come up in the next one by name."""
    short = text.last_segments(F.col("name"), 1)
    f = s.functions.where("name is not null and file_path is not null and module_id is not null").select("id", "module_id", "file_path", short.alias("fn"))
    rows = F.array(
        F.concat(F.lit("--- a/"), "file_path"), F.lit("+++ /dev/null"), F.concat(F.lit("-let rec "), "fn", F.lit(" x = x")),
        F.lit("--- /dev/null"), F.concat(F.lit("+++ b/lib/moved_"), F.col("id") % 3, F.lit(".ml")), F.concat(F.lit("+let "), F.when(F.col("id") % 4 == 0, "_").otherwise(F.col("fn")), F.lit("(y) = y")),
    )
    return f.select(F.col("module_id").alias("diff_id"), "id", F.posexplode(rows).alias("k", "line")).select("diff_id", (F.col("id") * 6 + F.col("k")).alias("line_no"), "line")


@view("""SELECT diff_id, fn_name, x.f AS from_file, x.t AS to_file FROM (SELECT a.module_id AS diff_id, a.fn AS fn_name, min(struct_pack(f := a.file_path, t := 'lib/moved_' || (b.id % 3) || '.ml')) AS x FROM sh a JOIN sh b ON a.module_id = b.module_id AND a.fn = b.fn
 WHERE b.id % 4 <> 0 AND a.fn NOT IN ('', '_') AND a.file_path <> 'lib/moved_' || (b.id % 3) || '.ml' GROUP BY 1, 2)""",
    sh=r"SELECT id, module_id, file_path, regexp_extract(string_split(name, '.')[-1], '^[^ (=:\r]*') AS fn FROM fn WHERE name IS NOT NULL AND file_path IS NOT NULL AND module_id IS NOT NULL")
def etl_diff_moves(s: Store) -> DataFrame:
    return compare.diff_moves(diff_lines(s))


def mirrored(s: Store) -> DataFrame:
    f = s.functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    return s.raw("calls_mirror").drop("mirrored_at").distinct().join(f, "caller_id").select("caller_name", "callee_name", "call_site", "kind")


_ROOT = "regexp_replace({x}, '\\.<fun:.*$', '')"
_POP = f"SELECT DISTINCT {_ROOT.format(x='caller_name')} AS caller, {_ROOT.format(x='callee_name')} AS callee, call_site FROM "
_MIRROR = "SELECT f.name AS caller_name, m.callee_name, m.call_site, m.kind FROM (SELECT DISTINCT * EXCLUDE (mirrored_at) FROM calls_mirror) m JOIN fn f ON f.id = m.caller_id"


@view("""SELECT CASE WHEN g.callee = '*TOP*' AND g.caller IN (SELECT caller FROM lm WHERE caller IS NOT NULL) OR g.callee <> '*TOP*' AND g.callee NOT LIKE '%.%' AND EXISTS (SELECT 1 FROM lm WHERE lm.caller = g.caller AND lm.call_site = g.call_site)
 THEN 'replaced' ELSE 'dropped' END AS status, g.caller, g.callee, g.call_site FROM (SELECT * FROM po EXCEPT SELECT * FROM pn) g UNION ALL SELECT 'added', * FROM (SELECT * FROM pn EXCEPT SELECT * FROM po)""",
    mr=_MIRROR, po=_POP + "fc", pn=_POP + "mr", lm=f"SELECT DISTINCT {_ROOT.format(x='caller_name')} AS caller, call_site FROM mr WHERE callee_name LIKE '%<fun:%'")
def etl_callgraph_diff(s: Store) -> DataFrame:
    return compare.callgraph_diff(s.flat_calls, mirrored(s))


@view("""SELECT old_kind, new_kind, count(*) AS edges FROM (SELECT DISTINCT o.caller_name, o.callee_name, o.call_site, o.raw_kind AS old_kind, n.kind AS new_kind FROM fc o JOIN mr n ON o.caller_name = n.caller_name AND o.callee_name = n.callee_name
 AND o.call_site = n.call_site WHERE o.raw_kind <> n.kind) GROUP BY 1, 2""", mr=_MIRROR)
def etl_kind_movements(s: Store) -> DataFrame:
    return compare.kind_movements(s.flat_calls.withColumn("kind", F.col("raw_kind")), mirrored(s))


# ---- scalar functions ------------------------------------------------------------------------------------------------

_TOP_DIR = "string_split(file_path, '/')[1]"


@view(f"SELECT id, {_TOP_DIR} = 'lib' AS equal, {_TOP_DIR} IN ('lib', 'bin') AS in_list, {_TOP_DIR} NOT IN ('lib', 'bin') AS not_in_list, EXISTS (SELECT 1 FROM fx e WHERE e.function_name = fn.name) AS has_effect FROM fn WHERE name IS NOT NULL")
def f_predicates(s: Store) -> DataFrame:
    e = s.effects.select(F.col("function_name").alias("name")).distinct().withColumn("has_effect", F.lit(True))
    top = F.substring_index("file_path", "/", 1)
    return s.functions.where("name is not null").join(e, "name", "left").select(
        "id", (top == "lib").alias("equal"), top.isin("lib", "bin").alias("in_list"), (~top.isin("lib", "bin")).alias("not_in_list"), F.coalesce("has_effect", F.lit(False)).alias("has_effect")
    )


@view("SELECT id, name ILIKE '%Store%' AS ci, lower(name) AS low, coalesce(intent, '?') AS intent FROM fn WHERE name IS NOT NULL")
def f_like_ci(s: Store) -> DataFrame:
    return s.functions.where("name is not null").select("id", F.col("name").ilike("%Store%").alias("ci"), F.lower("name").alias("low"), F.coalesce("intent", F.lit("?")).alias("intent"))


@view("SELECT id, json_extract_string(value_touched, '$[0].kind') AS first_kind, CAST(json_array_length(value_touched) AS INT) AS n FROM fx WHERE value_touched IS NOT NULL AND json_valid(value_touched) AND json_type(value_touched) = 'ARRAY'")
def f_json_extract(s: Store) -> DataFrame:
    """First kind and length of the arrays; what is no whole JSON array gives no row."""
    whole = F.try_parse_json("value_touched")
    e = s.effects.where(whole.isNotNull() & F.schema_of_variant(whole).startswith("ARRAY"))
    return e.select("id", F.get_json_object("value_touched", "$[0].kind").alias("first_kind"), F.json_array_length("value_touched").alias("n"))


@view("SELECT type_id, string_agg(constructor_name, ',' ORDER BY constructor_name) AS names FROM tc GROUP BY 1")
def f_group_concat(s: Store) -> DataFrame:
    return s.constructors.groupBy("type_id").agg(F.array_join(F.sort_array(F.collect_list("constructor_name")), ",").alias("names"))


_TRIM = "trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))"
_UNQUOTE = "CASE WHEN length({x}) > 1 AND {x}[1] = {x}[-1] AND {x}[1] IN ('\"', chr(39)) THEN substring({x}, 2, length({x}) - 2) ELSE {x} END"


@view(f"""SELECT id, list_filter(list_transform(string_split(regexp_replace({_TRIM.format(x='temporal_class')}, '^\\[(.*)\\]$', '\\1', 's'), ','), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') AS items
 FROM fx WHERE temporal_class IS NOT NULL""")
def f_parse_list_or_scalar(s: Store) -> DataFrame:
    """The items with their quotes; ``f_parse_list_items`` takes the quotes off."""
    return s.effects.where("temporal_class is not null").select("id", text.list_or_scalar(F.col("temporal_class")).alias("items"))


@view(f"""SELECT id, list_filter(CASE WHEN length(t) > 1 AND t[1] = '[' THEN list_transform(list_transform(string_split(substring(t, 2, length(t) - 2), ','), lambda x: {_TRIM.format(x='x')}), lambda y: {_UNQUOTE.format(x='y')})
 ELSE list_transform(string_split({_UNQUOTE.format(x='t')}, ','), lambda x: {_TRIM.format(x='x')}) END, lambda z: z <> '') AS items FROM tr""", tr=f"SELECT id, {_TRIM.format(x='temporal_class')} AS t FROM fx WHERE temporal_class IS NOT NULL")
def f_parse_list_items(s: Store) -> DataFrame:
    """The unquoted items of every list or scalar."""
    return s.effects.where("temporal_class is not null").select("id", text.list_items(F.col("temporal_class")).alias("items"))


def _touched(name: str) -> str:
    found = f"regexp_extract(o, '[\"'']?{name}[\"'']?\\s*:\\s*[\"'']?([^\"'',}}]*)', 1)"
    return _TRIM.format(x=found)


@view("""SELECT id, list_transform(entries, lambda e: e.kind) AS kinds, list_transform(entries, lambda e: e.direction) AS directions, CASE WHEN len(entries) > 0 THEN '[' || array_to_string(list_transform(entries, lambda e: '{"kind":"' || e.kind || '","direction":"' || e.direction || '"}'), ',') || ']' END AS encoded FROM en""",
    en=f"SELECT id, list_filter(list_transform(regexp_extract_all(value_touched, '\\{{[^{{}}]*\\}}'), lambda o: struct_pack(kind := {_touched('kind')}, direction := {_touched('direction')})), lambda e: e.kind <> '' AND e.direction <> '') AS entries FROM fx WHERE value_touched IS NOT NULL")
def f_parse_value_touched(s: Store) -> DataFrame:
    entries = text.parse_value_touched(F.col("value_touched"))
    parsed = s.effects.where("value_touched is not null").select("id", entries.alias("e"))
    return parsed.select("id", F.col("e.kind").alias("kinds"), F.col("e.direction").alias("directions"), text.encode_value_touched(F.col("e")).alias("encoded"))


@view("SELECT id, array_to_string(string_split(name, '.')[-2:], '.') AS two, string_split(name, '.')[-1] AS one FROM fn WHERE name IS NOT NULL")
def f_last_segments(s: Store) -> DataFrame:
    n = F.col("name")
    return s.functions.where("name is not null").select("id", text.last_segments(n, 2).alias("two"), text.last_segments(n, 1).alias("one"))


@view(f"SELECT doc_id, names AS tags FROM ct", ct=_cut(comments.LSP_TAGS))
def f_find_tags_brace(s: Store) -> DataFrame:
    return docs(s).select("doc_id", comments._parts(F.col("text"), comments._brace(comments.LSP_TAGS))["names"].alias("tags"))


@view("SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[ \\n\\t]'), lambda w: CASE WHEN contains(w, '@') THEN substr(w, strpos(w, '@') + 1) END), lambda x: x IN (" + ", ".join(f"'{t}'" for t in comments.LSP_TAGS) + ")) AS tags FROM documents WHERE text IS NOT NULL")
def f_find_tags_jsdoc(s: Store) -> DataFrame:
    """Tags after the first at-sign of a run without blanks, if they are all that follows it there."""
    return docs(s).select("doc_id", comments._parts(F.col("text"), comments._at(comments.LSP_TAGS))["names"].alias("tags"))


@view("")
def f_parse_lsp(s: Store) -> DataFrame:
    return docs(s).select("doc_id", comments.parse_lsp(F.col("text")).alias("p")).select("doc_id", "p.summary.state", F.col("p.violators.text").alias("violators"))


def _state(tag: str) -> str:
    return f"CASE {_sec(tag)} WHEN '' THEN 'absent' WHEN '(none)' THEN 'none' ELSE 'present' END"


def _body(tag: str) -> str:
    return f"CASE WHEN {_sec(tag)} NOT IN ('', '(none)') THEN {_sec(tag)} END"


@view(f"SELECT doc_id, {_state('post')} AS post_state, {_body('post')} AS post, {_state('violators')} AS violators_state, {_body('violators')} AS violators FROM ct", ct=_cut(comments.INDEX_TAGS))
def f_parse_cmt(s: Store) -> DataFrame:
    """State and text of two sections of every document; ``f_parse_cmt_sections`` gives all nine."""
    p = docs(s).select("doc_id", comments.parse_index(F.col("text")).alias("p"))
    return p.select("doc_id", F.col("p.post.state").alias("post_state"), F.col("p.post.text").alias("post"), F.col("p.violators.state").alias("violators_state"), F.col("p.violators.text").alias("violators"))


@view("")
def f_parse_cmt_sections(s: Store) -> DataFrame:
    """State and text of the summary and all eight sections of every document, and the warnings."""
    p = docs(s).select("doc_id", comments.parse_index(F.col("text")).alias("p"), comments.index_warnings(F.col("text")).alias("warnings"))
    return p.select("doc_id", "p.*", "warnings")


@view("")
def f_violators_json(s: Store) -> DataFrame:
    return docs(s).select("doc_id", comments.violators_json(comments.parse_lsp(F.col("text"))["violators"]["text"]).alias("violators_raw"))


_KEPT = f"list_filter(list_transform(string_split({_sec('violators')}, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x NOT IN ('', '(none)'))"
_SPLIT = f"[struct_pack(name := CASE WHEN contains(x, '—') THEN {_TRIM.format(x="split_part(x, '—', 1)")} END, reason := CASE WHEN contains(x, '—') THEN {_TRIM.format(x="substr(x, strpos(x, '—') + 1)")} ELSE x END)]"


@view("SELECT doc_id, unnest(entries, recursive := true) FROM vl", ct=_cut(comments.INDEX_TAGS), vl=f"""SELECT doc_id, list_reduce(list_transform({_KEPT}, lambda x: {_SPLIT}), lambda a, e: CASE WHEN e[1].name IS NULL THEN CASE WHEN len(a) > 0
 THEN list_concat(a[1:len(a) - 1], [struct_pack(name := a[-1].name, reason := a[-1].reason || ' ' || e[1].reason)]) ELSE a END WHEN e[1].name = '' OR starts_with(e[1].name, '(') THEN a ELSE list_concat(a, e) END,
 CAST([] AS STRUCT(name VARCHAR, reason VARCHAR)[])) AS entries FROM ct""")
def f_violator_entries(s: Store) -> DataFrame:
    return docs(s).select("doc_id", F.inline(comments.violator_entries(comments.parse_index(F.col("text"))["violators"]["text"])))


_WRITTEN = "SELECT doc_id, regexp_replace(text, ' — ([^\n]*)', ': \"\\1\"', 'g') AS text FROM documents WHERE text IS NOT NULL"


@view(f"""SELECT doc_id, file, case_name FROM (SELECT doc_id, {_TRIM.format(x="split_part(x, ':', 1)")} AS file, regexp_extract({_TRIM.format(x="substr(x, strpos(x, ':') + 1)")}, '^"(.+)"', 1) AS case_name FROM (
 SELECT doc_id, unnest(list_transform(string_split({_sec('tests')}, chr(10)), lambda x: {_TRIM.format(x='x')})) AS x FROM ct) WHERE x <> '(none)' AND contains(x, ':')) WHERE file <> '' AND case_name <> ''""",
    wr=_WRITTEN, ct=_cut(comments.INDEX_TAGS).replace("FROM documents", "FROM wr"))
def f_test_entries(s: Store) -> DataFrame:
    """Entries of the tests sections, whose lines ``a — b`` are first written as ``a: "b"``; most lines hold no entry."""
    t = F.regexp_replace("text", r" — ([^\n]*)", r': "$1"')
    return docs(s).select("doc_id", F.inline(comments.test_entries(comments.parse_index(t)["tests"]["text"])))


@view(f"SELECT id, string_split(path, '/')[-1] AS base, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '\\.[^./]*$', '') AS stem, {cap_of('path')} AS module FROM modules")
def f_path(s: Store) -> DataFrame:
    p = F.col("path")
    return s.modules.select("id", text.base_name(p).alias("base"), text.dir_name(p).alias("dir"), text.without_extension(p).alias("stem"), text.module_of(p).alias("module"))


@view("SELECT id, concat_ws(':', file_path, line_start) AS site FROM fn")
def f_call_site(s: Store) -> DataFrame:
    return s.functions.select("id", text.call_site(F.col("file_path"), F.col("line_start")).alias("site"))


@view("SELECT id, string_split(file_path, '/')[1] || '.' || CASE WHEN exported = 1 THEN '(T).' ELSE '' END || name AS go_name FROM fn WHERE name IS NOT NULL AND file_path IS NOT NULL")
def f_func_name_go(s: Store) -> DataFrame:
    f = s.functions.where("name is not null and file_path is not null")
    return f.select("id", F.concat(F.substring_index("file_path", "/", 1), F.lit("."), F.when(F.col("exported") == 1, "(T).").otherwise(""), "name").alias("go_name"))


@view("SELECT function_id, percentage, total_lines FROM cov")
def f_percentage(s: Store) -> DataFrame:
    return s.coverage.select("function_id", "percentage", "total_lines")


_TYPES_SQL = ", ".join(f"'{k}'" for k in EDGE_TYPES)


@view(f"SELECT id, CASE WHEN edge_type IN ({_TYPES_SQL}) THEN edge_type END AS edge_type FROM ae")
def f_enum(s: Store) -> DataFrame:
    return s.attack_edges.select("id", text.enum_or_null(F.col("edge_type"), EDGE_TYPES).alias("edge_type"))


@view("SELECT id, [" + ", ".join(f"'{k}'" for k in text.SYMBOL_KINDS) + "][CASE WHEN id % 30 BETWEEN 1 AND 26 THEN id % 30 END] AS kind FROM modules")
def f_symbol_kind_of_int(s: Store) -> DataFrame:
    return s.modules.select("id", text.symbol_kind(F.col("id") % 30).alias("kind"))


@view(f"SELECT doc_id, {_DIGEST} AS digest, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) = text AS trimmed FROM documents WHERE text IS NOT NULL")
def f_md5_trim(s: Store) -> DataFrame:
    return docs(s).select("doc_id", text.body_digest(F.col("text")).alias("digest"), (text.strip(F.col("text")) == F.col("text")).alias("trimmed"))


@view(f"""SELECT doc_id, CAST(i AS INT) AS line_no, {_TRIM.format(x="regexp_extract(line, '^(?:\"[^\"]*(?:\"|$)|''[^'']*(?:''|$)|[^\"''#]+)*', 0)")} AS kept
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)""")
def f_strip_inline_comment(s: Store) -> DataFrame:
    """The part of every line of a text before a number sign outside quotes; lines count from 1."""
    return stripped_lines(docs(s))


def stripped_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, kept) of (doc_id, text): quotes do not go on over a line's end."""
    each = texts.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("at", "line"))
    kept = F.regexp_extract("line", "^(?:\"[^\"]*(?:\"|\\z)|'[^']*(?:'|\\z)|[^\"'#]++)*+", 0)
    return each.select("doc_id", (F.col("at") + 1).alias("line_no"), text.strip(kept).alias("kept"))


QUERIES = {k: v for k, v in _Q.items() if k not in _BEFORE}
SQL = {k: v for k, v in _S.items() if k in QUERIES}
