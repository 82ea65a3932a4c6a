"""Capability sidecars: indentation-keyed text files with ``capabilities:`` and ``attack_edges:`` sections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.schemas import EDGE_TYPES

_CAP_KEYS = ("fn", "file_path", "actor_role", "temporal_class", "precondition", "gating", "value_touched")
_EDGE_KEYS = ("from", "from_path", "to", "to_path", "edge_type", "evidence")
CAPABILITY = "function_name string, file_path string, actor_role string, temporal_class string, precondition string, gating string, value_touched string"
EDGE = "from_action string, from_path string, to_action string, to_path string, edge_type string, evidence string, source string"
#: A value up to a "#" outside quotes.
_UNCOMMENTED = re.compile(r"""(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^"'#])*""")


def without_comment(s: str) -> str:
    return _UNCOMMENTED.match(s).group().strip()


def unquoted(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def listed(s: str) -> str:
    """``[a, "b"]`` or ``a, b`` as ``a,b``."""
    s = s.strip()
    parts = [unquoted(p) for p in s[1:-1].split(",")] if s.startswith("[") and len(s) > 1 else [p.strip() for p in unquoted(s).split(",")]
    return ",".join(p for p in parts if p)


def touched(s: str) -> str | None:
    """Canonical JSON of the brace objects that have a kind and a direction, nothing escaped; null if there is none."""
    s = s.strip()
    if len(s) < 2 or s[0] != "[" or s[-1] != "]":
        return None
    out = []
    for body in re.findall(r"\{([^{}]*)\}", s):
        got = [re.search(rf"""(["']){k}\1[^:]*:[ \t]*(["'])(.*?)(?:\2|$)""", body) for k in ("kind", "direction")]
        if all(got) and all(m.group(3) for m in got):
            out.append('{"kind":"%s","direction":"%s"}' % tuple(m.group(3) for m in got))
    return "[" + ",".join(out) + "]" if out else None


def parse_sidecar(text: str, path: str = "") -> dict[str, list]:
    """``caps``, ``edges`` and ``errors`` of one file."""
    out: dict[str, list] = {"caps": [], "edges": [], "errors": []}
    section, item, content = "", {}, False

    def close() -> None:
        if section == "capabilities" and "fn" in item:
            cap = {k: item.get(k) for k in _CAP_KEYS}
            out["caps"].append({"function_name": cap.pop("fn"), **cap})
        elif section == "attack_edges" and item.keys() & {"from", "to", "edge_type"}:
            if not {"from", "to", "edge_type"} <= item.keys():
                out["errors"].append("an attack edge lacks its from, to or edge_type")
            elif item["edge_type"] not in EDGE_TYPES:
                out["errors"].append(f"unknown edge_type '{item['edge_type']}'")
            else:
                e = {k: item.get(k) for k in _EDGE_KEYS}
                out["edges"].append({"from_action": e["from"], "from_path": e["from_path"], "to_action": e["to"], "to_path": e["to_path"], "edge_type": e["edge_type"], "evidence": e["evidence"], "source": "sidecar"})
        item.clear()

    for line in text.split("\n"):
        bare = line.strip(" \t\n\r\f")
        if not bare or bare[0] == "#":
            continue
        content = True
        indent = len(line) - len(line.lstrip(" "))
        if indent == 0:
            if bare in ("capabilities:", "attack_edges:"):
                close()
                section = bare[:-1]
            continue
        if indent == 2 and bare[0] == "-" and len(bare) > 2:
            close()
            bare = bare[1:].strip()
        elif indent != 4:
            continue
        key, colon, value = bare.partition(":")
        key, value = key.strip(), without_comment(value.strip())
        if not colon or not key:
            continue
        if section == "capabilities" and key in _CAP_KEYS:
            item[key] = listed(value) if key in ("actor_role", "temporal_class") else touched(value) if key == "value_touched" else unquoted(value)
        elif section == "attack_edges" and key in _EDGE_KEYS:
            item[key] = unquoted(value)
    close()
    if content and not out["caps"] and not out["edges"]:
        out["errors"].append(f"{path}: the file is not empty, yet it holds neither capabilities nor attack edges in the form that is read here")
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [json.dumps(parse_sidecar(t or "", p or "")) for t, p in zip(b.column("text").to_pylist(), b.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(got, pa.string())], names=["path", "parsed"])


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """(path, caps, edges, errors) of (path, text)."""
    ddl = f"caps array<struct<{_inner(CAPABILITY)}>>, edges array<struct<{_inner(EDGE)}>>, errors array<string>"
    parsed = texts.select("path", "text").mapInArrow(_parse, "path string, parsed string")
    return parsed.select("path", F.from_json("parsed", ddl).alias("x")).select("path", "x.*")


def _inner(ddl: str) -> str:
    return ",".join(f"{c.strip().split(' ')[0]}:{c.strip().split(' ')[1]}" for c in ddl.split(","))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return parse_sidecars(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
