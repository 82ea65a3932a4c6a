"""Writes and upserts: every change makes a new DataFrame version; files are written by overwriting whole tables.

Identities fold nulls to the empty string. Of equal new rows the first by its order column is kept; rows already there win.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import on_disk
from edgeloom.errors import LoadError
from edgeloom.schemas import DDL, EDGE_IDENTITY, EFFECT_IDENTITY, VALUE_KINDS


def folded(cols: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in cols]


def insert_new(existing: DataFrame, new: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` whose identity is not there yet, one per identity, without the order column."""
    keys = [f"_{c}" for c in identity]
    rest = [c for c in new.columns if c != order]
    first = new.groupBy(*folded(identity)).agg(F.min_by(F.struct(*rest), order).alias("r"))
    there = existing.select(*folded(identity)).distinct()
    return first.join(there, keys, "left_anti").select("r.*")


def insert_effects(existing: DataFrame, new: DataFrame, functions: DataFrame, order: str) -> DataFrame:
    """New effects with the first id of their function's name, null if it has none."""
    ids = functions.where("name is not null").groupBy(F.col("name").alias("function_name")).agg(F.min("id").alias("function_id"))
    fresh = insert_new(existing, new, EFFECT_IDENTITY, order)
    return fresh.drop("function_id").join(ids, "function_name", "left")


def insert_edges(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    return insert_new(existing, new, EDGE_IDENTITY, order)


def insert_counts(new: DataFrame, inserted: DataFrame) -> DataFrame:
    """(inserted, skipped)."""
    both = new.select(F.lit(0).alias("i")).unionByName(inserted.select(F.lit(1).alias("i")))
    n = F.count(F.lit(1))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("inserted"), (n - 2 * F.coalesce(F.sum("i"), F.lit(0))).alias("skipped"))


CAPABILITY_COLUMNS = ("actor_role", "temporal_class", "precondition", "gating", "value_touched")


def upsert_capabilities(effects: DataFrame, caps: DataFrame) -> DataFrame:
    """Effects with capability columns: updated where the function is known, else inserted as an effect-free manual row.

    A capability meets the rows of its exact name, or of an unqualified name equal to its last segment, in its own file if
    it names one. Both the question whether a row exists and the update use that match. New values win over old ones.
    ``effects`` has a unique id; ``caps``: function_name, file_path and the capability columns, one row per name and file.
    """
    news = [f"new_{x}" for x in CAPABILITY_COLUMNS]
    c = caps.select(F.col("function_name").alias("cap_name"), F.col("file_path").alias("cap_path"), *(F.col(x).alias(f"new_{x}") for x in CAPABILITY_COLUMNS))
    forms = c.withColumn("function_name", F.explode(F.array_distinct(F.array("cap_name", F.substring_index("cap_name", ".", -1)))))
    met = effects.select("id", "function_name", "file_path").join(forms, "function_name").where(F.col("cap_path").isNull() | (F.col("cap_path") == F.col("file_path")))
    rank = F.struct((F.col("cap_name") == F.col("function_name")).alias("exact"), F.col("cap_path").isNotNull().alias("scoped"), "cap_name", "cap_path")
    best = met.groupBy("id").agg(F.max_by(F.struct(*news), rank).alias("n"))
    updated = effects.join(best, "id", "left").select(*(F.coalesce(f"n.new_{x}", x).alias(x) if x in CAPABILITY_COLUMNS else F.col(x) for x in effects.columns))
    known = met.select("cap_name", "cap_path").distinct().alias("b")
    missing = c.alias("a").join(known, (F.col("a.cap_name") == F.col("b.cap_name")) & F.col("a.cap_path").eqNullSafe(F.col("b.cap_path")), "left_anti")
    fixed = {"value_kind": F.lit("NoEffect"), "is_direct": F.lit(0), "soundness": F.lit("manual"), "function_name": F.col("cap_name"), "file_path": F.col("cap_path")}
    new = [fixed[x] if x in fixed else F.col(f"new_{x}") if x in CAPABILITY_COLUMNS else F.lit(None) for x in effects.columns]
    types = dict(effects.dtypes)
    return updated.unionByName(missing.select(*(v.cast(types[x]).alias(x) for v, x in zip(new, effects.columns))))


def migrate(df: DataFrame, table: str) -> DataFrame:
    """The table with every column of its schema; columns it lacks are null. Running it again changes nothing."""
    for part in DDL[table].split(","):
        name, kind = part.strip().split(" ")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


_PIECE = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(--[^\n]*)|(;)|([^'\"\-;]+|.)", re.DOTALL)
_ADD = re.compile(r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", re.IGNORECASE)
#: Spark types by the leading letters of a column's declared type; anything else is text.
_AFFINITY = (("INT", "bigint"), ("REAL", "double"), ("DOUB", "double"), ("FLOA", "double"))


def statements(script: str) -> list[str]:
    """The statements of a script: comments go, a semicolon ends one, and neither counts inside quotes."""
    out, now = [], ""
    for quoted, comment, end, text in _PIECE.findall(script + "\n;"):
        if end:
            out, now = out + [now.strip()], ""
        elif not comment:
            now += quoted or text
    return [s for s in out if s]


def run_migration(tables: Mapping[str, DataFrame], script: str) -> dict[str, DataFrame]:
    """The tables after the script's ``ALTER TABLE .. ADD COLUMN`` statements; a column that is there already is no error.

    Other statements change no column of these tables and are passed over; an unknown table is an error.
    """
    done = dict(tables)
    for statement in statements(script):
        if m := _ADD.match(statement):
            name, column, declared = m.groups()
            if name not in done:
                raise LoadError(f"no table {name}")
            if column not in done[name].columns:
                kind = next((k for start, k in _AFFINITY if declared.upper().startswith(start)), "string")
                done[name] = done[name].withColumn(column, F.lit(None).cast(kind))
    return done


def value_kind_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, k, d) for i, (k, d) in enumerate(VALUE_KINDS)], "id int, name string, description string")


def last_binding(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``: what replacing inserts leave."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def backup_intents(functions: DataFrame, key: Sequence[str]) -> DataFrame:
    return functions.where("intent is not null").groupBy(*key).agg(F.max("intent").alias("saved"))


def restore_intents(rebuilt: DataFrame, backup: DataFrame, key: Sequence[str]) -> DataFrame:
    """Saved intents over rebuilt ones, by natural key."""
    return rebuilt.join(backup, list(key), "left").withColumn("intent", F.coalesce("saved", "intent")).drop("saved")


def enrich_signatures(functions: DataFrame, found: DataFrame) -> DataFrame:
    """Signatures by (name, file); entries that hit no row fill missing ones whose file ends in the entry's last two path parts."""
    f = found.groupBy("name", "file_path").agg(F.max("signature").alias("sig"))
    exact = functions.join(f, ["name", "file_path"], "left").withColumnRenamed("sig", "exact_sig")
    unused = f.join(functions.select("name", "file_path").distinct(), ["name", "file_path"], "left_anti")
    tail = F.substring_index("file_path", "/", -2)
    loose = unused.groupBy("name", tail.alias("tail")).agg(F.max("sig").alias("loose_sig"))
    out = exact.withColumn("tail", tail).join(loose, ["name", "tail"], "left")
    return out.withColumn("signature", F.coalesce("exact_sig", "signature", "loose_sig")).drop("tail", "exact_sig", "loose_sig")


def enrich_exported(functions: DataFrame, found: DataFrame) -> DataFrame:
    """Signature and export flag by (name, file)."""
    f = found.groupBy("name", "file_path").agg(F.max(F.struct("signature", "exported")).alias("x")).select("name", "file_path", F.col("x.signature").alias("sig"), F.col("x.exported").alias("flag"))
    out = functions.join(f, ["name", "file_path"], "left")
    return out.withColumn("signature", F.coalesce("sig", "signature")).withColumn("exported", F.coalesce("flag", "exported")).drop("sig", "flag")


def ndjson_sorted(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(part, key, line): functions first, then calls, to be ordered by all three; keys as the producers sort them."""
    f = functions.select(F.lit(0).alias("part"), F.col("name").alias("key"), F.to_json(F.struct(F.lit("function").alias("type"), "name", "file_path", "exported")).alias("line"))
    c = calls.select(
        F.lit(1).alias("part"), F.concat_ws("→", "caller_name", F.concat_ws("@", "callee_name", "call_site")).alias("key"),
        F.to_json(F.struct(F.lit("call").alias("type"), "caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind")).alias("line"),
    )
    return f.unionByName(c)


def write_ndjson(functions: DataFrame, calls: DataFrame, path: str) -> None:
    """Globally sorted text files; range partitions keep the order across files without one task holding all lines."""
    ndjson_sorted(functions, calls).orderBy("part", "key", "line").select("line").write.mode("overwrite").text(path)


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Each table as parquet; a table is replaced as a whole by the committer."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, made anew: readers see the old files until all new ones stand beside them and take their name."""
    fs, new = on_disk(df.sparkSession, f"{path}.tmp")
    _, old = on_disk(df.sparkSession, path)
    fs.delete(new, True)
    df.write.parquet(f"{path}.tmp")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise LoadError(f"{path} could not be replaced")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a table in a box, for people: as many as are shown come to the driver. Nulls are empty cells."""
    cells = [df.columns] + [["" if x is None else str(x).replace("\n", " ") for x in r] for r in df.limit(rows).collect()]
    wide = [max(map(len, column)) for column in zip(*cells)]

    def rule(left: str, mid: str, right: str) -> str:
        return left + mid.join("─" * (w + 2) for w in wide) + right

    body = ["│ " + " │ ".join(c.ljust(w) for c, w in zip(row, wide)) + " │" for row in cells]
    return "\n".join([rule("┌", "┬", "┐"), body[0], rule("├", "┼", "┤"), *body[1:], rule("└", "┴", "┘")])


def as_json(df: DataFrame) -> DataFrame:
    """(json): one object per row, flags as booleans where the column is one."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
