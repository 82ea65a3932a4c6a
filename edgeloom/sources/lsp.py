"""Captured language-server responses as rows: symbol trees and outgoing calls.

Only responses are read; sessions and transports are not part of this library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import call_site, relative_to, strip_scheme
from edgeloom.schemas import TOP

#: Function, Method, Constructor and Variable in the protocol's numbering.
KEPT_KINDS = (12, 6, 9, 13)
_ROW = [("name", pa.string()), ("uri", pa.string()), ("kind", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32())]


def flatten(response: str | None, uri: str | None) -> list[dict]:
    """Symbols of kept kinds in a tree of document symbols or a list of workspace symbols; a broken response has none."""
    try:
        todo = json.loads(response or "null")
    except ValueError:
        return []
    todo = list(reversed(todo)) if isinstance(todo, list) else []
    out = []
    while todo:
        s = todo.pop()
        if not isinstance(s, dict):
            continue
        at = s.get("location") or {}
        span = s.get("range") or at.get("range") or {}
        if s.get("kind") in KEPT_KINDS and isinstance(s.get("name"), str):
            line = [(span.get(k) or {}).get("line") for k in ("start", "end")]
            out.append({"name": s["name"], "uri": at.get("uri", uri), "kind": s["kind"], **{k: None if v is None else v + 1 for k, v in zip(("line_start", "line_end"), line)}})
        todo += reversed([c for c in s.get("children") or []])
    return out


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [flatten(r, u) for r, u in zip(b.column("response").to_pylist(), b.column("uri").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.struct(_ROW)))], names=["symbols"])


def symbols(responses: DataFrame, root: str) -> DataFrame:
    """(name, file_path, kind, line_start, line_end, exported) of (uri, response)."""
    flat = responses.select("uri", "response").mapInArrow(_flatten, "symbols array<struct<name:string,uri:string,kind:int,line_start:int,line_end:int>>")
    s = flat.select(F.inline("symbols"))
    return s.select("name", relative_to(strip_scheme(F.col("uri")), root).alias("file_path"), "kind", "line_start", "line_end", F.when(F.col("name").startswith("_"), 0).otherwise(1).alias("exported"))


_CALL = "array<struct<to:struct<name:string,uri:string>,fromRanges:array<struct<start:struct<line:int>>>>>"


def outgoing_calls(responses: DataFrame, root: str) -> DataFrame:
    """Edges of (caller_name, caller_file, response): the callee's file is null outside the project, the site is the first range."""
    c = responses.select("caller_name", "caller_file", F.inline(F.from_json("response", _CALL)))
    path = strip_scheme(F.col("to.uri"))
    inside = path.startswith(root.rstrip("/") + "/")
    return c.where("to.name is not null").select(
        "caller_name", "caller_file", F.col("to.name").alias("callee_name"), F.when(inside, relative_to(path, root)).alias("callee_file"),
        call_site(F.col("caller_file"), F.get("fromRanges", F.lit(0))["start"]["line"] + 1).alias("call_site"),
    )


def with_fallback(edges: DataFrame, fallback: DataFrame, functions: DataFrame) -> DataFrame:
    """The edges, or if there are none at all the fallback's, whose callees get the file of the last function of that name."""
    if not edges.isEmpty():
        return edges
    return callee_files(fallback, functions)


def callee_files(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_name, caller_file, callee_name, callee_file, call_site) with the file of the last function of the callee's name."""
    last = functions.where("name is not null").groupBy(F.col("name").alias("callee_name")).agg(F.max_by("file_path", "id").alias("callee_file"))
    e = edges.where(F.col("callee_name") != TOP).select("caller_name", "caller_file", "callee_name", "call_site")
    return e.join(last, "callee_name", "left").select("caller_name", "caller_file", "callee_name", "callee_file", "call_site")
