"""Newline-delimited JSON records of producers: call graphs and effects, with the loaders' rules as column checks.

Records come in any order, one object per line. ``read_lines`` gives (line_no, line); every loader takes such a frame, so
the same rules serve files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.cluster import cut
from edgeloom.errors import LoadError
from edgeloom.functions.text import strip
from edgeloom.schemas import CONTRACT, CONTRACT_KEY, KINDS, SOUNDNESS, TOP, VALUE_KINDS

CALL_RECORD = "type string, name string, file_path string, exported string, caller_name string, caller_file string, callee_name string, callee_file string, call_site string, kind string, bad string"
EFFECT_RECORD = "type string, function_name string, file_path string, value_kind string, target string, is_direct string, soundness string, producer string, bad string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files: line numbers count from 1 within a file, whatever splits it was read in.

    The lines are written down once with the split they came from, which loaders that look at them several times need
    anyway; what is counted over a file is one row per split.
    """
    t = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    t = cut(t)
    splits = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def parse(lines: DataFrame, ddl: str) -> DataFrame:
    """Non-blank lines with their fields; ``bad`` holds a line that is no JSON object."""
    rec = F.from_json("line", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    kept = lines.where(strip(F.col("line")) != "")
    out = kept.select("line_no", "line", rec.alias("r")).select("line_no", "line", "r.*")
    return out.withColumn("bad", F.when(F.col("bad").isNotNull() | ~F.col("line").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("line")))


def is_call(strict_type: bool = True) -> Column:
    """A record is a call if it says so, or has a callee and does not say it is a function."""
    return (F.col("type") == "call") | (F.col("callee_name").isNotNull() & (F.coalesce("type", F.lit("")) != "function"))


def check_callgraph(records: DataFrame, mode: str, allow_empty: bool) -> None:
    """One aggregation over all records; raises with the first offending line."""
    call = F.coalesce(is_call(), F.lit(False))
    no_name = F.col("caller_name").isNull() | F.col("callee_name").isNull()
    if mode == "strict":
        no_name = no_name | (F.col("caller_name") == "") | (F.col("callee_name") == "")
    bad_kind = F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)
    bad_flag = F.lit(mode == "lib") & F.col("exported").isNotNull() & ~F.col("exported").isin("true", "false")

    def first(cond: Column, name: str) -> Column:
        return F.min(F.when(cond, F.col("line_no"))).alias(name)

    r = records.agg(
        first(F.col("bad").isNotNull(), "bad"), first(F.col("bad").isNull() & call & no_name, "no_name"), first(F.col("bad").isNull() & call & bad_kind, "bad_kind"),
        first(F.col("bad").isNull() & ~call & bad_flag, "bad_flag"), F.count_if(F.col("bad").isNull() & call).alias("calls"),
    ).first()
    for field, what in (("bad", "not a JSON object"), ("bad_kind", "edge kind missing or not one of " + ", ".join(KINDS)), ("no_name", "call without caller or callee"), ("bad_flag", "exported is no boolean")):
        if r[field] is not None:
            raise LoadError(f"line {r[field]}: {what}")
    if not r.calls and not allow_empty:
        raise LoadError("no call edges; refusing to build an empty index")


def callgraph(lines: DataFrame, mode: str = "strict", allow_empty: bool = False, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, calls, meta) of a record stream.

    ``strict``: empty names abort, functions only seen in edges get no file. ``lib``: empty names are names, ``exported``
    must be a JSON boolean, functions only seen in edges get the last file an edge
    gives for them. Of several records
    of one function the last line wins. The unknown target never becomes a function.
    """
    rec = parse(lines, CALL_RECORD)
    if check:
        check_callgraph(rec, mode, allow_empty)
    rec = rec.where("bad is null")
    call = F.coalesce(is_call(), F.lit(False))
    calls = rec.where(call)
    flag = F.when(F.lower("exported").isin("true", "1"), 1).otherwise(0)
    named = rec.where(~call & F.col("name").isNotNull() & ((F.col("name") != TOP) | (F.lit(mode) == "lib")))
    known = named.groupBy("name").agg(F.max_by(F.struct("file_path", flag.alias("exported")), "line_no").alias("x")).select("name", "x.*")
    ends = calls.select(F.explode(F.array(
        F.struct(F.col("caller_name").alias("name"), F.col("caller_file").alias("file"), (F.col("line_no") * 2).alias("at")),
        F.struct(F.col("callee_name").alias("name"), F.col("callee_file").alias("file"), (F.col("line_no") * 2 + 1).alias("at")),
    )).alias("e")).select("e.*").where((F.col("name") != TOP))
    file = F.max_by("file", F.when(F.col("file").isNotNull(), F.col("at"))) if mode == "lib" else F.lit(None).cast("string")
    derived = ends.groupBy("name").agg(file.alias("file_path")).join(known, "name", "left_anti").select("name", "file_path", F.lit(0).alias("exported"))
    meta = lines.sparkSession.createDataFrame([(CONTRACT_KEY, CONTRACT), ("built_by", "edgeloom")], "key string, value string")
    return known.unionByName(derived), calls.select("caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind"), meta


def effects(lines: DataFrame, allow_skip: bool = False, check: bool = True) -> DataFrame:
    """Effect records with defaults: unknown kinds become UnknownMut, other soundness candidate, a missing producer unknown."""
    rec = parse(lines, EFFECT_RECORD)
    if check and not allow_skip:
        r = rec.agg(F.min(F.when(F.col("bad").isNotNull(), F.col("line_no"))).alias("bad")).first()
        if r.bad is not None:
            raise LoadError(f"line {r.bad}: not a JSON object")
    e = rec.where(F.col("bad").isNull() & ((F.col("type") == "effect") | F.col("value_kind").isNotNull()) & F.col("function_name").isNotNull())
    kinds = [k for k, _ in VALUE_KINDS]
    return e.select(
        "function_name", "file_path", F.when(F.col("value_kind").isin(*kinds), F.col("value_kind")).otherwise("UnknownMut").alias("value_kind"), "target",
        F.when(F.lower(F.coalesce("is_direct", F.lit("true"))).isin("false", "0"), 0).otherwise(1).alias("is_direct"),
        F.when(F.col("soundness").isin(*SOUNDNESS) & (F.col("soundness") != "candidate"), F.col("soundness")).otherwise("candidate").alias("soundness"),
        F.coalesce("producer", F.lit("unknown")).alias("producer"),
    )
