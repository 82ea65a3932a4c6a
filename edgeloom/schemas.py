"""Fact tables as StructTypes, closed value sets and identity keys."""

from __future__ import annotations

from pyspark.sql.types import StructType

RESOLVED = ("MUST", "MAY_ENUMERATED")
KINDS = (*RESOLVED, "MAY_TOP")
TOP = "*TOP*"
CONTRACT_KEY = "callgraph_contract"
CONTRACT = "v1"

#: Kinds of mutated places with their descriptions.
VALUE_KINDS = (
    ("GlobalVar", "Module-level mutable reference (ref, Hashtbl, array at module scope)"),
    ("FieldAccess", "Write to a mutable record field"),
    ("ArrayElem", "Write to an array element (Array.set, array.(i) <- v)"),
    ("HashTbl", "Hashtbl mutation (add, replace, remove, clear, reset)"),
    ("BytesBuf", "Bytes/Buffer mutation (Bytes.set, Buffer.add_*)"),
    ("HeapRef", "Dereference-and-write through a ref (:=) or mutable pointer"),
    ("IoSideEffect", "I/O side-effect (print, write, send, flush)"),
    ("EnvVar", "Environment variable mutation (Sys.putenv, os.Setenv, std::env::set_var)"),
    ("FileSystem", "File-system mutation (write, create, delete, rename, chmod)"),
    ("Network", "Network I/O (send, connect, listen, accept)"),
    ("UnknownMut", "Unknown or opaque mutation (used when kind cannot be determined)"),
)
SOUNDNESS = ("sound", "candidate", "manual")
EDGE_TYPES = ("sequence", "removes_guard", "shares_resource", "actor_distinct")
EDGE_SOURCES = ("static", "sidecar", "manual")
DEP_KINDS = ("open", "include", "alias", "local_open")
USAGE_ROLES = ("param", "return", "local", "field_access", "constructor")

#: Upsert identities; nullable parts are folded to the empty string.
EFFECT_IDENTITY = ("function_name", "file_path", "value_kind", "target", "producer", "is_direct")
EDGE_IDENTITY = ("from_action", "to_action", "edge_type", "from_path", "to_path")

DDL = {
    "modules": "id long, path string, lines int, intent string, last_analyzed string, has_mli int, quint_module_raw string, created_at string",
    "functions": "id long, module_id long, name string, signature string, line_start int, line_end int, line_count int, exposed int, intent string, "
    "comment_quality_score int, has_pre int, has_post int, has_violators int, has_violates int, violators_raw string, violates_raw string, "
    "tests_raw string, quint_raw string, created_at string",
    "functions_flat": "name string, file_path string, exported int",
    "calls": "id long, caller_id long, callee_id long, callee_name string, call_site string, kind string, created_at string",
    "calls_flat": "caller_name string, caller_file string, callee_name string, callee_file string, call_site string, kind string",
    "meta": "key string, value string",
    "module_deps": "id long, source_module long, target_module long, target_path string, dep_kind string, alias_name string, line_number int",
    "types": "id long, module_id long, name string, kind string, line_start int, line_end int, exposed int, manifest string, intent string",
    "type_fields": "id long, type_id long, field_name string, field_type string, position int",
    "type_constructors": "id long, type_id long, constructor_name string, position int, arg_types string",
    "type_usage": "id long, function_id long, type_id long, type_name string, usage_role string, position int",
    "unsafe_params": "id long, function_id long, param_name string, current_type string, target_type string, fixed int, fixed_at string, github_issue string",
    "coverage": "id long, function_id long, covered_lines int, total_lines int, percentage double, recorded_at string",
    "gardening_tasks": "id long, category string, status string, github_issue string",
    "function_effects": "id long, function_id long, function_name string, file_path string, value_kind_id long, value_kind string, target string, is_direct int, "
    "soundness string, producer string, reachability_class string, actor_role string, temporal_class string, gating string, value_touched string, "
    "precondition string, created_at string",
    "attack_edges": "id long, from_action string, to_action string, edge_type string, evidence string, source string, created_at string, from_path string, to_path string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
