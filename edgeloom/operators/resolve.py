"""Fact derivation: from what extractors saw to ids, edge kinds and effects. All joins and column rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.text import last_segments, module_of
from edgeloom.schemas import CONTRACT, CONTRACT_KEY, TOP

#: Names whose call changes the state of the kind; matched whole or by their last two segments.
CALLEE_KINDS = {
    "HashTbl": (
        "Hashtbl.add", "Hashtbl.replace", "Hashtbl.remove", "Hashtbl.clear", "Hashtbl.reset", "Hashtbl.filter_map_inplace",
    ),
    "ArrayElem": (
        "Array.set", "Array.unsafe_set", "Bigarray.Array1.set", "Bigarray.Array2.set", "Bigarray.Array3.set",
    ),
    "BytesBuf": (
        "Bytes.set", "Bytes.blit", "Bytes.fill", "Bytes.unsafe_set", "Buffer.add_string", "Buffer.add_bytes", "Buffer.add_char",
        "Buffer.add_channel", "Buffer.add_buffer", "Buffer.add_utf_8_uchar", "Buffer.add_subbytes", "Buffer.add_substring", "Buffer.reset",
        "Buffer.clear",
    ),
    "IoSideEffect": (
        "print_string", "print_int", "print_float", "print_char", "print_endline", "print_newline", "Printf.printf", "Printf.eprintf",
        "Printf.fprintf", "Printf.bprintf", "output_string", "output_bytes", "output_char", "output_value", "flush", "Format.printf",
        "Format.eprintf", "Format.fprintf", "Format.kasprintf", "Fmt.pr", "Fmt.epr",
    ),
    "EnvVar": (
        "Sys.putenv", "Unix.putenv",
    ),
    "FileSystem": (
        "open_out", "open_out_bin", "open_out_gen", "Unix.openfile", "Unix.creat", "Unix.unlink", "Unix.rename", "Unix.chmod",
        "Unix.chown", "Unix.mkdir", "Unix.rmdir", "Unix.symlink", "Unix.truncate", "Unix.ftruncate",
    ),
    "Network": (
        "Unix.connect", "Unix.bind", "Unix.listen", "Unix.accept", "Unix.send", "Unix.recv", "Unix.sendto", "Unix.recvfrom",
        "Unix.sendmsg", "Unix.recvmsg", "Unix.shutdown", "Unix.socket", "Unix.socketpair",
    ),
}
#: The same for Go, whole names only.
GO_CALLEE_KINDS = {
    "IoSideEffect": (
        "fmt.Print", "fmt.Println", "fmt.Printf", "fmt.Fprintf", "fmt.Fprintln", "fmt.Fprint", "log.Print", "log.Println", "log.Printf",
        "log.Fatal", "log.Fatalf", "log.Fatalln",
    ),
    "EnvVar": (
        "os.Setenv",
    ),
    "FileSystem": (
        "os.Create", "os.OpenFile", "os.Remove", "os.RemoveAll", "os.Rename", "os.Mkdir", "os.MkdirAll", "os.MkdirTemp",
        "ioutil.WriteFile", "os.WriteFile",
    ),
    "Network": (
        "net.Dial", "net.DialTCP", "net.Listen", "net.ListenTCP",
    ),
}
#: Go receivers by suffix, with the method names that mutate them (a star stands for any rest).
GO_RECEIVERS = (
    ("BytesBuf", ("bytes.Buffer", "strings.Builder"), ("Write*", "Reset", "Grow")),
    ("IoSideEffect", ("os.File",), ("Write*",)),
    ("Network", ("net.Conn", "net.UDPConn", "net.TCPConn"), ("Write*", "Send*")),
)
#: Functions that do not return.
NORETURN = ("Stdlib.raise", "Stdlib.raise_notrace", "Stdlib.failwith", "Stdlib.invalid_arg", "Stdlib.exit")


def _lookup(functions: DataFrame) -> DataFrame:
    """(at, fn, fid): the last id of each name in each file."""
    return functions.where("name is not null and file_path is not null").groupBy(F.col("file_path").alias("at"), F.col("name").alias("fn")).agg(F.max("id").alias("fid"))


def module_map(paths: DataFrame) -> DataFrame:
    """(mod, mod_path): the last path of each capitalised base name; ``paths`` has (path)."""
    return paths.where("path is not null").groupBy(module_of(F.col("path")).alias("mod")).agg(F.max("path").alias("mod_path"))


def resolve_calls(pending: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_id, callee_id, callee_name, call_site, kind) of pending calls.

    ``pending``: caller_module, caller_name, head_kind (unknown, enumerated, local, qualified), head_module, head_name, cond,
    partial, call_site. Calls of functions that are not indexed are dropped. A conditional or partial call is no MUST.
    """
    look = _lookup(functions)
    callers = look.select(F.col("at").alias("caller_module"), F.col("fn").alias("caller_name"), F.col("fid").alias("caller_id"))
    mods = module_map(functions.select(F.col("file_path").alias("path")))
    p = pending.join(callers, ["caller_module", "caller_name"]).withColumn("mod", last_segments(F.col("head_module"), 1)).join(mods, "mod", "left")
    p = p.withColumn("at", F.when(F.col("head_module").isNull(), F.col("caller_module")).otherwise(F.col("mod_path")))
    p = p.join(look.withColumnRenamed("fn", "head_name"), ["at", "head_name"], "left")
    unknown = F.col("head_kind") == "unknown"
    weak = F.col("cond") | F.col("partial")
    firm = F.when(weak, "MAY_ENUMERATED").otherwise("MUST")
    found, bare = F.col("fid").isNotNull(), F.col("head_module").isNull()
    kind = (
        F.when(unknown, "MAY_TOP").when(F.col("head_kind") == "enumerated", "MAY_ENUMERATED")
        .when(F.col("head_kind") == "local", F.when(found, firm).otherwise("MAY_TOP"))
        .when(bare & ~found, F.when(weak, "MAY_ENUMERATED").otherwise("MAY_TOP")).otherwise(firm)
    )
    return p.select(
        "caller_id", F.when(~unknown, F.col("fid")).alias("callee_id"), F.when(unknown, TOP).otherwise(F.col("head_name")).alias("callee_name"), "call_site", kind.alias("kind")
    )


def stamp_contract(functions: DataFrame) -> DataFrame:
    """The contract row, only if at least one function is indexed."""
    return functions.select(F.lit(CONTRACT_KEY).alias("key"), F.lit(CONTRACT).alias("value")).limit(1)


def resolve_deps(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """``deps`` (source_module, target) with target_module: the exact path, else the last segment as a module's name."""
    exact = modules.select(F.col("path").alias("target"), F.col("id").alias("by_path"))
    named = modules.groupBy(module_of(F.col("path")).alias("mod")).agg(F.max_by("id", "path").alias("by_name"))
    d = deps.withColumn("mod", last_segments(F.col("target"), 1)).join(exact, "target", "left").join(named, "mod", "left")
    return d.select("source_module", "target", F.coalesce("by_path", "by_name").alias("target_module"))


def resolve_type_usage(usage: DataFrame, types: DataFrame, modules: DataFrame) -> DataFrame:
    """``usage`` (type_name) with type_id: ``A.B.t`` is type t of module B; unqualified names never resolve."""
    m = modules.select(F.col("id").alias("module_id"), module_of(F.col("path")).alias("mod"))
    t = types.join(m, "module_id").groupBy("mod", F.col("name").alias("short")).agg(F.max("id").alias("type_id"))
    u = usage.withColumn("short", last_segments(F.col("type_name"), 1)).withColumn(
        "mod", F.when(F.col("type_name").contains("."), F.substring_index(last_segments(F.col("type_name"), 2), ".", 1))
    )
    return u.join(t, ["mod", "short"], "left").drop("mod", "short")


def exposed_docs(functions: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(id, name, exposed, doc): exposed by (module, name) in the interface, whose comment is preferred to the own one."""
    i = interfaces.groupBy("module_id", "name").agg(F.max("doc").alias("interface_doc")).withColumn("seen", F.lit(True))
    f = functions.join(i, ["module_id", "name"], "left")
    return f.select("id", "name", F.when(F.col("seen"), 1).otherwise(0).alias("exposed"), F.coalesce("interface_doc", "doc").alias("doc"))


def lambda_names(lambdas: DataFrame) -> DataFrame:
    """``lambdas`` (id, parent, line, col) with name: ``parent.<fun:LINE:COL>``, ``#N`` from the second at one place on."""
    n = F.row_number().over(Window.partitionBy("parent", "line", "col").orderBy("id"))
    base = F.concat(F.col("parent"), F.lit(".<fun:"), F.col("line"), F.lit(":"), F.col("col"))
    return lambdas.select("id", F.concat(base, F.when(n > 1, F.concat(F.lit("#"), n)).otherwise(""), F.lit(">")).alias("name"))


def applications(apps: DataFrame) -> DataFrame:
    """``apps`` (id, callee_name, nargs, arity, arrow) with partial, and one residual edge to the unknown per over-application."""
    a = apps.select("id", "callee_name", (F.col("arrow") | (F.col("nargs") < F.col("arity"))).alias("partial"), F.lit(False).alias("residual"))
    over = apps.where("arity > 0 and nargs > arity").select("id", F.lit(TOP).alias("callee_name"), F.lit(False).alias("partial"), F.lit(True).alias("residual"))
    return a.unionByName(over)


def never_returns(name: Column, nargs: Column) -> Column:
    """A saturated call of one of the names that do not return."""
    return name.isin(*NORETURN) & (nargs >= 1)


def go_kinds(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee, site, kind). ``calls``: caller, callee, site, mode (static, cha, invoke, closure), always, top."""
    kind = (
        F.when(F.col("top"), "MAY_TOP").when(F.col("mode").isin("invoke", "closure"), "MAY_TOP").when(F.col("mode") == "cha", "MAY_ENUMERATED")
        .when(F.col("always"), "MUST").otherwise("MAY_ENUMERATED")
    )
    c = calls.select("caller", F.when(F.col("top"), TOP).otherwise(F.col("callee")).alias("callee"), "site", kind.alias("kind"))
    return c.groupBy("caller", "callee", "site").agg(F.min("kind").alias("kind"))


def _kind_table(spark, kinds: dict[str, tuple[str, ...]], key: str) -> DataFrame:
    rows = [(name, kind, i) for i, (kind, names) in enumerate(kinds.items()) for name in names]
    return F.broadcast(spark.createDataFrame(rows, f"{key} string, kind string, priority int"))


def classify_callees(names: DataFrame) -> DataFrame:
    """(name, value_kind) of distinct names that match a table whole or by their last two segments; the first table wins."""
    n = names.select("name").where("name is not null").distinct()
    forms = n.withColumn("form", F.explode(F.array_distinct(F.array("name", last_segments(F.col("name"), 2)))))
    hit = forms.join(_kind_table(names.sparkSession, CALLEE_KINDS, "form"), "form")
    return hit.groupBy("name").agg(F.min_by("kind", "priority").alias("value_kind"))


def classify_go(calls: DataFrame) -> DataFrame:
    """``calls`` (id, name, receiver, method) with value_kind: by whole name, else by receiver suffix and method."""
    rule = F.lit(None).cast("string")
    for kind, suffixes, methods in reversed(GO_RECEIVERS):
        on, does = F.lit(False), F.lit(False)
        for s in suffixes:
            on = on | F.col("receiver").endswith(s)
        for m in methods:
            does = does | (F.col("method").startswith(m[:-1]) if m.endswith("*") else F.col("method") == m)
        rule = F.when(on & does, kind).otherwise(rule)
    c = calls.join(_kind_table(calls.sparkSession, GO_CALLEE_KINDS, "name"), "name", "left")
    return c.select("id", "name", F.coalesce("kind", rule).alias("value_kind")).where("value_kind is not null")


def is_exported(name: Column) -> Column:
    return ~name.startswith("_")


def merge_rows(document: DataFrame, workspace: DataFrame, order: str) -> DataFrame:
    """Rows by (file_path, name): the last document row, else the workspace row; other columns go together."""
    cols = [c for c in document.columns if c not in ("file_path", "name", order)]
    d = document.groupBy("file_path", "name").agg(F.max_by(F.struct(*cols), order).alias("d"))
    w = workspace.groupBy("file_path", "name").agg(F.max_by(F.struct(*cols), order).alias("w"))
    both = d.join(w, ["file_path", "name"], "full_outer")
    return both.select("file_path", "name", F.coalesce("d", "w").alias("x")).select("file_path", "name", "x.*")


# ---- post-dominance --------------------------------------------------------------------------------------------------

EXIT = -1


def always_blocks(edges: list[tuple[int, int]]) -> list[tuple[int, bool, bool]]:
    """(block, always, reachable) of one control-flow graph with entry 0 and exit -1.

    A block always runs if it is reachable and lies on every path from the entry to the exit. Without an exit that can be
    reached nothing is certain. One path to the exit holds all such blocks; they are found by sweeping along it: a block is
    on every path if nothing before it leads past it. Each edge is looked at twice, so time is linear in the graph.
    """
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    blocks = sorted({x for e in edges for x in e if x != EXIT})
    came: dict[int, int] = {0: 0}
    todo = [0]
    for n in todo:  # grows as it is walked
        for b in after.get(n, ()):
            if b not in came:
                came[b] = n
                if b != EXIT:
                    todo.append(b)
    if EXIT not in came:
        return [(b, False, b in came) for b in blocks]
    path = [EXIT]
    while path[-1] != 0:
        path.append(came[path[-1]])
    path.reverse()
    place = {n: i for i, n in enumerate(path)}
    far, seen, certain = 0, set(), set()
    for i, n in enumerate(path[:-1]):
        if far == i:
            certain.add(n)
        todo = [n]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b in place:
                    far = max(far, place[b])
                elif b not in seen:
                    seen.add(b)
                    todo.append(b)
    return [(b, b in certain, b in came) for b in blocks]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        graphs = b.column("edges")
        at = graphs.offsets.to_pylist()
        ends = list(zip(*(graphs.flatten().field(c).to_pylist() for c in ("src", "dst"))))
        rows, sizes = [], []
        for lo, hi in zip(at, at[1:]):
            own = always_blocks(ends[lo - at[0] : hi - at[0]])
            rows += own
            sizes.append(len(own))
        blocks, always, reachable = zip(*rows) if rows else ((), (), ())
        fn = b.column("fn").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([fn, pa.array(blocks, pa.int32()), pa.array(always, pa.bool_()), pa.array(reachable, pa.bool_())], names=["fn", "block", "always", "reachable"])


def cfg_edges(blocks: DataFrame) -> DataFrame:
    """(fn, src, dst) of block records (fn, block, last, skips, stops): where control can go from each block.

    A block falls through to the next one, may skip one, and leaves by the exit if it stops or is the last.
    """
    ends = F.col("stops") | (F.col("block") == F.col("last"))
    targets = F.array(
        F.when(~ends, F.col("block") + 1), F.when(F.col("skips") & ~F.col("stops") & (F.col("block") + 2 <= F.col("last")), F.col("block") + 2), F.when(ends, EXIT)
    )
    return blocks.select("fn", F.col("block").cast("int").alias("src"), F.explode(F.array_compact(targets).cast("array<int>")).alias("dst"))


def cfg_solve(edges: DataFrame) -> DataFrame:
    """(fn, block, always, reachable); ``edges`` has (fn, src, dst) with the exit as -1. One function's graph is one value."""
    g = edges.groupBy(F.col("fn").cast("bigint").alias("fn")).agg(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))).alias("edges"))
    return g.mapInArrow(_solve, "fn bigint, block int, always boolean, reachable boolean")


# ---- signatures ------------------------------------------------------------------------------------------------------

_LABEL = r"[a-z_][\w']*\s*:(?!:)"
_TOKEN = r"[(\[{]|[)\]}]|->|(?<![\w'.`])[A-Za-z_][\w'.]*"
_USED = "array<struct<part:int,type_name:string>>"


def signature_types(signature: Column) -> Column:
    """Array of (type_name, usage_role, position): constructors of each parameter and of the result, nested ones under the same role.

    The tokens of the signature, its labels left out, are folded with the depth in brackets and the number of arrows outside them.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("part"), F.array().cast(_USED).alias("used"))

    def step(at: Column, token: Column) -> Column:
        depth = at["depth"] + F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)
        part = at["part"] + F.when((token == "->") & (at["depth"] == 0), 1).otherwise(0)
        one = F.array(F.struct(at["part"].alias("part"), token.alias("type_name")))
        used = F.when(token.rlike("^[A-Za-z_]"), F.concat(at["used"], one)).otherwise(at["used"])
        return F.struct(depth.alias("depth"), part.alias("part"), used.alias("used"))

    def roles(at: Column) -> Column:
        def role(u: Column) -> Column:
            last = u["part"] == at["part"]
            return F.struct(u["type_name"].alias("type_name"), F.when(last, "return").otherwise("param").alias("usage_role"), F.when(~last, u["part"]).alias("position"))

        return F.transform(at["used"], role)

    return F.aggregate(F.regexp_extract_all(F.regexp_replace(signature, _LABEL, " "), F.lit(_TOKEN), F.lit(0)), start, step, roles)


def usage_of_signatures(functions: DataFrame) -> DataFrame:
    """(function_id, type_name, usage_role, position) of (id, signature); null signatures give no row."""
    s = functions.where("signature is not null").select(F.col("id").cast("bigint").alias("function_id"), signature_types(F.col("signature")).alias("used"))
    return s.select("function_id", F.inline("used"))
