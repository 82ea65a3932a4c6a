"""Schemas that drift between files (problem 4).

Method: tagged-union inference. Every line is parsed to a variant value by the engine, and its fields keep the type they
were written with. Per file the schemas of all its lines are fused by pre-aggregation into one tagged union: each field with
the set of its alternatives. Consecutive files of a stream are compared on these unions, which are small; only for pairs of
files in which fields went and others came are records joined by id, and a field that went is the one that came if the
fingerprints of their (id, type, value) sets over the common records agree. ``unified_records`` then splits every conflict
into typed branches beside one canonical text form, carries a renamed field on under its first name, and follows objects
and arrays down to their single values: a nested field is ``outer.inner``, the elements of an array are ``outer[]``.

Defined cases: blank, broken, repeated and non-object lines count neither as fields nor as records, but their file still
exists (a file of only such lines has no fields); a key given twice in one object has its last value; a null stands for a
missing key in comparisons; a record without id is in no comparison; one id with several records in one file is compared
as the set of its values; numbers with a fraction or an exponent, and integers of more than 38 digits, have the type
``number``, and trailing zeros of a fraction are dropped; a stream with one file has no change; a key that holds a dot
is not told from a nested one in the paths of ``fused_schema`` and ``unified_records`` (``schema_changes`` has no paths).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_if_small, cut

TYPES = ("string", "integer", "boolean", "object", "array", "number")
#: Stands behind a line inside one array, so that a line with anything after its object is no longer one value.
_END = "\u241e"
_TWICE = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def _last_value_wins(spark: SparkSession) -> Iterator[None]:
    """Keys given twice are read, for the plans made inside; the session's own setting comes back after it."""
    was = spark.conf.get(_TWICE, None)
    spark.conf.set(_TWICE, "true")
    try:
        yield
    finally:
        spark.conf.set(_TWICE, was) if was is not None else spark.conf.unset(_TWICE)


def _tag(value: Column) -> Column:
    """The type a value was written with; null has none. A plain integer of up to 18 digits is never a decimal here."""
    schema = F.schema_of_variant(value)
    long_integer = schema.rlike(r"^DECIMAL\((19|[23]\d),0\)")
    named = (("STRING", "string"), ("BIGINT", "integer"), ("BOOLEAN", "boolean"), ("OBJECT", "object"), ("ARRAY", "array"))
    tag = F.when(schema == "VOID", None)
    for prefix, t in named:
        tag = tag.when(schema.startswith(prefix), t)
    return tag.when(long_integer, "integer").otherwise("number")


def _parsed(lines: DataFrame, *carried: str) -> DataFrame:
    """``carried``, rid and r (key to variant value) of the lines that are whole JSON objects.

    The parsed object goes through a generator, past which the optimizer moves nothing: each line is parsed once.
    """
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("payload"), F.lit(f',"{_END}"]'))), "$", "array<variant>")

    def whole(a: Column) -> Column:
        alone = (F.size(a) == 2) & (F.get(a, F.lit(1)).cast("string") == _END)
        return F.when(alone, F.try_variant_get(F.get(a, F.lit(0)), "$", "map<string,variant>"))

    record = F.filter(F.transform(F.array(both), whole), lambda r: r.isNotNull())
    rid = F.try_element_at("r", F.lit("id"))
    return lines.where(F.col("payload").contains("{")).select(*carried, F.explode(record).alias("r")).select(
        *carried, F.when(~F.is_variant_null(rid), F.to_json(rid)).alias("rid"), "r"
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """(stream_id, record_type, file_seq, line_no, rid, fields) of the lines that are whole JSON objects, written once.

    Nothing leaves the engine: lines are parsed, typed and taken apart by its own expressions. Null values keep their key.
    """
    keys = ("stream_id", "record_type", "file_seq", "line_no")
    fields = F.transform(F.map_entries("r"), lambda e: F.struct(e["key"].alias("k"), _tag(e["value"]).alias("t"), e["value"].cast("string").alias("v")))
    with _last_value_wins(lines.sparkSession):
        return cut(_parsed(lines, *keys).select(*keys, "rid", fields.alias("fields")))


def _inside(values: DataFrame) -> DataFrame:
    """The values directly inside the objects and arrays of ``values`` (path, tag, v and any others), one row each."""
    others = [c for c in values.columns if c not in ("path", "tag", "v")]
    outer = values.where(F.col("tag").isin("object", "array")).withColumn("x", F.try_parse_json("v"))
    members = F.transform(F.map_entries(F.try_variant_get("x", "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("k"), e["value"].alias("x")))
    elements = F.transform(F.try_variant_get("x", "$", "array<variant>"), lambda e: F.struct(F.lit("[]").alias("k"), e.alias("x")))
    each = outer.select(*others, "path", F.explode(F.when(F.col("tag") == "object", members).otherwise(elements)).alias("e"))
    return each.select(*others, F.concat("path", "e.k").alias("path"), _tag(F.col("e.x")).alias("tag"), F.col("e.x").cast("string").alias("v"))


def with_nested(values: DataFrame) -> DataFrame:
    """``values`` (path, tag, v and any others) and all that stands inside them, one job per level of nesting that occurs."""
    out = level = values
    while True:
        with _last_value_wins(values.sparkSession):
            level = cut(_inside(level))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _unions(values: DataFrame, field: Column, tag: Column) -> DataFrame:
    bit = F.lit(0)
    for i, t in enumerate(TYPES):
        bit = F.when(tag == t, 1 << i).otherwise(bit)
    return values.groupBy("stream_id", "file_seq", field.alias("field")).agg(F.bit_or(bit).alias("types"))


def fuse(lines: DataFrame) -> DataFrame:
    """(stream_id, file_seq, field, types): each file's fields with the bits of their alternatives, 0 for nulls only; written once."""
    keys = ("stream_id", "file_seq")
    with _last_value_wins(lines.sparkSession):
        return cut(_unions(_parsed(lines, *keys).select(*keys, F.explode("r").alias("k", "x")), F.col("k"), _tag(F.col("x"))))


def file_pairs(lines: DataFrame) -> DataFrame:
    """(stream_id, file_seq, before): each file of a stream with the one before it; one row per file goes into the window."""
    files = lines.select("stream_id", "file_seq").distinct()
    w = Window.partitionBy("stream_id").orderBy("file_seq")
    return files.withColumn("before", F.lag("file_seq").over(w)).where(F.col("before").isNotNull())


def schema_changes(lines: DataFrame) -> DataFrame:
    """(stream_id, file_seq, change, field): added, removed, renamed (``old>new``) or type_changed.

    A first pass over the lines takes only the types of the fields, a second one the values of the few files and fields
    that may have been renamed; no record is written down whole.
    """
    unions = fuse(lines)
    pairs = cut(file_pairs(lines))
    new = pairs.join(unions, ["stream_id", "file_seq"]).select("stream_id", "file_seq", "before", "field", F.col("types").alias("now"))
    old = pairs.join(
        unions.withColumnRenamed("file_seq", "before"), ["stream_id", "before"]
    ).select("stream_id", "file_seq", "before", "field", F.col("types").alias("then"))
    both = new.join(old, ["stream_id", "file_seq", "before", "field"], "full_outer")
    change = (
        F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when((F.col("then") != F.col("now")) & (F.col("then") != 0) & (F.col("now") != 0), "type_changed")
    )
    diffs = cut(both.withColumn("change", change).where(F.col("change").isNotNull()).select("stream_id", "file_seq", "before", "change", "field"))
    renames = cut(_renames(lines, diffs))
    took_part = renames.select("stream_id", "file_seq", F.explode(F.array(
        F.struct(F.lit("removed").alias("change"), F.col("old").alias("field")),
        F.struct(F.lit("added").alias("change"), F.col("new").alias("field")),
    )).alias("x")).select("stream_id", "file_seq", "x.change", "x.field")
    rest = diffs.drop("before").join(took_part, ["stream_id", "file_seq", "change", "field"], "left_anti")
    named = renames.select("stream_id", "file_seq", F.lit("renamed").alias("change"), F.concat_ws(">", "old", "new").alias("field"))
    return rest.select("stream_id", "file_seq", "change", "field").unionByName(named)


def _renames(lines: DataFrame, diffs: DataFrame) -> DataFrame:
    """(stream_id, file_seq, old, new) of fields that went and came with the same values in all common records."""
    def fields_that(change: str) -> Column:
        return F.collect_set(F.when(F.col("change") == change, F.col("field")))

    todo = (
        diffs.where(F.col("change").isin("added", "removed")).groupBy("stream_id", "file_seq", "before")
        .agg(fields_that("removed").alias("gone"), fields_that("added").alias("came"))
        .where((F.size("gone") > 0) & (F.size("came") > 0))
    )
    sides = F.array(
        F.struct(F.lit("old").alias("side"), F.col("before").alias("at"), F.col("gone").alias("keys")),
        F.struct(F.lit("new").alias("side"), F.col("file_seq").alias("at"), F.col("came").alias("keys")),
    )
    todo = broadcast_if_small(todo.select("stream_id", F.col("file_seq").alias("pair"), F.inline(sides)))
    near = lines.select("stream_id", F.col("file_seq").alias("at"), "payload").join(todo, ["stream_id", "at"])
    kept = F.filter(F.map_entries("r"), lambda e: ~F.is_variant_null(e["value"]) & F.array_contains("keys", e["key"]))
    values = F.transform(kept, lambda e: F.struct(e["key"].alias("k"), F.xxhash64(F.col("rid"), _tag(e["value"]), e["value"].cast("string")).alias("h")))
    with _last_value_wins(lines.sparkSession):
        known = cut(_parsed(near, "stream_id", "pair", "side", "keys").where(F.col("rid").isNotNull()).select(
            "stream_id", F.col("pair").alias("file_seq"), "side", "rid", F.array_sort(values).alias("x")
        ))
    was = known.where("side = 'old'").select("stream_id", "file_seq", "rid", F.col("x").alias("old")).distinct()
    now = known.where("side = 'new'").select("stream_id", "file_seq", "rid", F.col("x").alias("new")).distinct()
    common = was.join(now, ["stream_id", "file_seq", "rid"])

    def prints(side: str) -> DataFrame:
        f = common.select("stream_id", "file_seq", F.explode(side).alias("f")).select("stream_id", "file_seq", F.col("f.k").alias(side), F.col("f.h").alias("h"))
        return f.groupBy("stream_id", "file_seq", side).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum(F.shiftright("h", 32)).alias("hi")
        ).withColumnRenamed(side, f"{side}_field")

    same = prints("old").join(prints("new"), ["stream_id", "file_seq", "n", "lo", "hi"])
    return same.select("stream_id", "file_seq", F.col("old_field").alias("old"), F.col("new_field").alias("new"))


def _spans(changes: pd.DataFrame) -> pd.DataFrame:
    """For one stream: under which first name each renamed field goes on, and from and to which file."""
    rows, open_ = [], {}
    for seq, part in changes.sort_values("file_seq").groupby("file_seq"):
        nxt = dict(open_)
        for change, field in sorted(zip(part["change"], part["field"])):
            if change == "renamed":
                old, new = field.split(">", 1)
                nxt.pop(old, None)
                nxt[new] = (seq, open_[old][1] if old in open_ else old)
            elif change == "removed":
                nxt.pop(field, None)
        for name, (since, first) in open_.items():
            if nxt.get(name) != (since, first):
                rows.append((name, since, seq, first))
        open_ = nxt
    rows += [(name, since, None, first) for name, (since, first) in open_.items()]
    stream = str(changes["stream_id"].iloc[0])
    return pd.DataFrame([(stream, *r) for r in rows], columns=["stream_id", "k", "since", "until", "first"], dtype=object)


def unified_records(lines: DataFrame) -> DataFrame:
    """One row per record and field: the field under its first name, its tag, typed branches and the canonical text.

    ``record`` is a hash of the whole record: records of a file that differ stay apart, with or without an id, repeated
    ones count once, and one without any field is a row without a field. An object or array is a row by itself, followed by
    a row for each value inside it.

    Flags (``true``/``1``/``yes`` and their opposites) written as string, integer or boolean share the branch ``as_flag``.
    """
    records = parse_records(lines)
    changes = schema_changes(lines)
    spans = broadcast_if_small(changes.groupBy("stream_id").applyInPandas(
        _spans, "stream_id string, k string, since bigint, until bigint, first string"
    ))
    whole = records.select("stream_id", "record_type", "file_seq", "rid", F.array_sort("fields").alias("fields")).distinct()
    keys = ("stream_id", "record_type", "file_seq", "rid", "record")
    flat = whole.withColumn("record", F.md5(F.to_json("fields"))).select(*keys, F.explode_outer("fields").alias("f"))
    flat = flat.select(*keys, F.col("f.k").alias("k"), F.lit("").alias("path"), F.col("f.t").alias("tag"), F.col("f.v").alias("v"))
    s, r = spans.alias("s"), with_nested(flat).alias("r")
    on = (
        (F.col("r.stream_id") == F.col("s.stream_id")) & (F.col("r.k") == F.col("s.k")) & (F.col("r.file_seq") >= F.col("s.since"))
        & (F.col("s.until").isNull() | (F.col("r.file_seq") < F.col("s.until")))
    )
    tag, v = F.col("tag"), F.col("v")
    flag = F.when(F.lower(v).isin("true", "1", "yes", "t", "y"), 1).when(F.lower(v).isin("false", "0", "no", "f", "n"), 0)
    return r.join(s, on, "left").select(
        "r.stream_id", "r.record_type", "r.file_seq", "r.rid", "r.record",
        F.concat(F.coalesce("s.first", "r.k"), "r.path").alias("field"), F.concat("r.k", "r.path").alias("written_as"), "tag",
        F.when(tag == "string", v).alias("as_string"), F.when(tag == "integer", v.try_cast("decimal(38,0)")).alias("as_integer"),
        F.when(tag == "number", v.try_cast("double")).alias("as_number"),
        F.when(tag == "boolean", v == "true").alias("as_boolean"), F.when(tag.isin("object", "array"), v).alias("as_json"),
        F.when(tag.isin("string", "integer", "boolean"), flag).alias("as_flag"), v.alias("canonical"),
    )


def fused_schema(lines: DataFrame) -> DataFrame:
    """(stream_id, field, type, first_file, files): every alternative of every field, nested ones too, and the file in which it appeared.

    A value of type ``null`` is listed only for a field that is never anything else in a file.
    """
    records = parse_records(lines).select("stream_id", "file_seq", F.explode("fields").alias("f"))
    flat = records.select("stream_id", "file_seq", F.col("f.k").alias("path"), F.col("f.t").alias("tag"), F.col("f.v").alias("v"))
    unions = _unions(with_nested(flat), F.col("path"), F.col("tag"))
    alts = F.array_compact(F.array(*(F.when(F.col("types").bitwiseAND(1 << i) != 0, t) for i, t in enumerate(TYPES))))
    named = F.when(F.col("types") == 0, F.array(F.lit("null"))).otherwise(alts)
    return unions.select("stream_id", "field", "file_seq", F.explode(named).alias("type")).groupBy("stream_id", "field", "type").agg(
        F.min("file_seq").alias("first_file"), F.count(F.lit(1)).alias("files")
    )
