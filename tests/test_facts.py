"""Loaders, sidecars, upserts, resolution, post-dominance, comments, scanners and diffs on literal fixtures."""

import json
import time

import pytest
from edgeloom.errors import LoadError
from edgeloom.functions import comments, scan, text
from edgeloom.operators import compare, resolve, store
from edgeloom.schemas import schema
from edgeloom.sources import files, lsp, ndjson, sidecar
from pyspark.sql import functions as F


def lines(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records, 1)], "line_no long, line string")


def call(a, b, kind="MUST", **more):
    return {"type": "call", "caller_name": a, "callee_name": b, "call_site": "x:1", "kind": kind, **more}


def test_load_callgraph(spark):
    src = lines(spark, call("a", "b"), {"type": "function", "name": "a", "file_path": "old.ml", "exported": False}, "", {"type": "function", "name": "a", "file_path": "a.ml", "exported": True},
                {"caller_name": "b", "callee_name": "*TOP*", "kind": "MAY_TOP", "caller_file": "b.ml"}, {"type": "function", "name": "*TOP*"})
    fn, calls, meta = ndjson.callgraph(src)
    assert sorted(tuple(r) for r in fn.collect()) == [("a", "a.ml", 1), ("b", None, 0)]
    assert calls.count() == 2 and {r.key: r.value for r in meta.collect()}["callgraph_contract"] == "v1"
    lib = ndjson.callgraph(src, mode="lib")[0]
    assert ("b", "b.ml", 0) in [tuple(r) for r in lib.collect()]


@pytest.mark.parametrize("bad", [call("a", "b", None), call("a", "b", "garbage"), call("", "b"), "{broken", "[1]", '{"type": "call"'])
def test_load_refuses(spark, bad):
    with pytest.raises(LoadError, match="line 2"):
        ndjson.callgraph(lines(spark, call("a", "b"), bad))


def test_load_empty(spark):
    only = lines(spark, {"type": "function", "name": "a"})
    with pytest.raises(LoadError):
        ndjson.callgraph(only)
    assert ndjson.callgraph(only, allow_empty=True)[0].count() == 1


def test_load_effects(spark):
    src = lines(spark, {"type": "effect", "function_name": "f", "value_kind": "HeapRef", "soundness": "sound", "producer": "p"}, {"function_name": "g", "value_kind": "Odd", "soundness": "?"}, {"other": 1})
    got = sorted(tuple(r) for r in ndjson.effects(src).select("function_name", "value_kind", "soundness", "producer").collect())
    assert got == [("f", "HeapRef", "sound", "p"), ("g", "UnknownMut", "candidate", "unknown")]
    with pytest.raises(LoadError):
        ndjson.effects(lines(spark, "{bad"))
    assert ndjson.effects(lines(spark, "{bad", {"function_name": "g", "value_kind": "HashTbl"}), allow_skip=True).count() == 1


SIDECAR = """# head
capabilities:
  - fn: Mod.debit   # inline
    actor_role: [user, "admin"]
    temporal_class: t1, t2
    gating: "flag # one"
    value_touched: [{"kind": "stake", "direction": "debit"}, {"kind": "x"}]
  - fn: other
attack_edges:
  - from: a
    to: b
    edge_type: sequence
    evidence: 'it''s'
  - from: a
    to: c
    edge_type: nonsense
  - from: a
"""


def test_sidecar(spark):
    p = sidecar.parse_sidecar(SIDECAR)
    assert p["caps"][0] == {"function_name": "Mod.debit", "file_path": None, "actor_role": "user,admin", "temporal_class": "t1,t2", "precondition": None, "gating": "flag # one",
                            "value_touched": '[{"kind":"stake","direction":"debit"}]'}
    assert [e["to_action"] for e in p["edges"]] == ["b"] and len(p["errors"]) == 2
    assert sidecar.parse_sidecar("# only\n\n")["errors"] == [] and len(sidecar.parse_sidecar("actions:\n  - id: x\n", "f")["errors"]) == 1
    df = sidecar.parse_sidecars(spark.createDataFrame([("p", SIDECAR), ("q", None)], "path string, text string"))
    assert {r.path: (len(r.caps), len(r.edges), len(r.errors)) for r in df.collect()} == {"p": (2, 1, 2), "q": (0, 0, 0)}


def test_upserts(spark):
    cols = "id long, function_id long, function_name string, file_path string, value_kind string, target string, is_direct int, soundness string, producer string, actor_role string, temporal_class string, gating string, value_touched string, precondition string"
    old = spark.createDataFrame([(1, 9, "debit", "a.ml", "HeapRef", None, 1, "sound", "p", "old", None, "g", None, None), (2, 9, "debit", "b.ml", "HeapRef", None, 1, "sound", "p", None, None, None, None, None)], cols)
    caps = spark.createDataFrame([("Mod.debit", "a.ml", "new", None, None, None, None), ("fresh", None, "r", None, "pre", None, None)], "function_name string, file_path string, actor_role string, temporal_class string, precondition string, gating string, value_touched string")
    got = {(r.function_name, r.file_path): (r.actor_role, r.gating, r.value_kind, r.is_direct, r.precondition) for r in store.upsert_capabilities(old, caps).collect()}
    assert got == {("debit", "a.ml"): ("new", "g", "HeapRef", 1, None), ("debit", "b.ml"): (None, None, "HeapRef", 1, None), ("fresh", None): ("r", None, "NoEffect", 0, "pre")}
    again = old.withColumn("at", F.col("id"))
    fn = spark.createDataFrame([(7, "new"), (5, "new")], "id long, name string")
    more = again.unionByName(again.withColumn("function_name", F.lit("new")))
    ins = store.insert_effects(old, more, fn, "at")
    assert sorted((r.function_name, r.file_path, r.function_id) for r in ins.collect()) == [("new", "a.ml", 5), ("new", "b.ml", 5)]
    assert store.insert_counts(more, ins).first().asDict() == {"inserted": 2, "skipped": 2}
    assert store.migrate(old, "function_effects").columns == store.migrate(store.migrate(old, "function_effects"), "function_effects").columns
    assert set(schema("function_effects").names) <= set(store.migrate(old, "function_effects").columns)


def test_edges_are_inserted_once(spark):
    e = spark.createDataFrame([(1, "a", "b", "sequence", None, None), (2, "a", "b", "sequence", "", ""), (3, "a", "b", "sequence", "p", None)], "id long, from_action string, to_action string, edge_type string, from_path string, to_path string")
    got = store.insert_edges(e.limit(0), e.withColumn("at", F.col("id")), "at")
    assert sorted(r.id for r in got.collect()) == [1, 3]
    assert store.insert_edges(got, e.withColumn("at", F.col("id")), "at").count() == 0


@pytest.mark.parametrize(
    "edges, always, unreachable",
    [
        ([(0, -1)], {0}, set()), ([(0, 1), (0, 2), (1, 3), (2, 3), (3, -1)], {0, 3}, set()), ([(0, 1), (1, 2), (2, 1), (1, 3), (3, -1)], {0, 1, 3}, set()),
        ([(0, 1), (1, 0)], set(), set()), ([(0, -1), (1, -1)], {0}, {1}), ([(0, 1), (0, 2), (1, -1), (2, -1), (3, -1)], {0}, {3}),
        ([(i, i + 1) for i in range(200)] + [(200, -1)], set(range(201)), set()),
    ],
)
def test_post_dominance(edges, always, unreachable):
    got = resolve.always_blocks(edges)
    assert {b for b, a, _ in got if a} == always and {b for b, _, r in got if not r} == unreachable


def test_signatures(spark):
    def types_of(signature):
        got = spark.createDataFrame([(signature,)], "s string").select(resolve.signature_types(F.col("s")).alias("u")).first().u
        return [tuple(u) for u in got]

    assert types_of("int list -> (a, b) t -> unit") == [("int", "param", 0), ("list", "param", 0), ("a", "param", 1), ("b", "param", 1), ("t", "param", 1), ("unit", "return", None)]
    assert types_of("(int -> bool) -> M.t") == [("int", "param", 0), ("bool", "param", 0), ("M.t", "return", None)]
    assert types_of("unit") == [("unit", "return", None)]


def one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "t string").select(*exprs).first()




@pytest.mark.parametrize(
    "value, index, lsp",
    [
        ("", 0, None), (None, 0, None), ("Only a summary.", 15, 15), ("S.\n{pre} p {post} q {violators} (none) {violates} x — y", 15 + 15 + 20 + 12 + 25, 15 + 15 + 20 + 12 + 20),
        ("S.\n@pre p\n@post q\n@tests t", 15, 15 + 15 + 20 + 5), ("{violators} none", 25, 12), ("{pre} (none)", 15, 15), ("{pre} a {pre} ", 15, 15), ("{unknown} x", 15, 15), ("@pre@post x", 15, 15),
    ],
)
def test_scores(spark, value, index, lsp):
    a, b = comments.parse_index(F.col("t")), comments.parse_lsp(F.col("t"))
    assert tuple(one(spark, value, comments.score_index(a), comments.score_lsp(b))) == (index, lsp)


def test_entries(spark):
    t = "A.b — too\n  slow\n(none)\n(x) — y\nC — d"
    assert [tuple(e) for e in one(spark, t, comments.violator_entries(F.col("t")))[0]] == [("A.b", "too slow"), ("C", "d")]
    assert json.loads(one(spark, "A.b — r1\nc - d-e\n— z", comments.violators_json(F.col("t")))[0]) == [{"name": "A.b", "reason": "r1"}, {"name": "c", "reason": "d-e"}, {"name": "— z", "reason": ""}]
    assert one(spark, "none", comments.violators_json(F.col("t")))[0] is None
    assert [tuple(e) for e in one(spark, 'a.ml: "one "two""\nb: x\nc', comments.test_entries(F.col("t")))[0]] == [("a.ml", 'one "two"')]


@pytest.mark.parametrize("source, n", [("", 0), ("let x = 1\n\n(* c (* n *)\n still *)\nlet y = 2", 2), ('let s = "a\nb\nc" in\n s', 3), ("{id|a\nb|id} x", 2), ("(* open", 0), ('"(*"\nlet', 2), ("{ a = 1 }", 1)])
def test_code_lines(source, n):
    assert scan.code_lines(source) == n


def test_doc_comments():
    assert scan.doc_comment("(** Adds\n    one. *)\n\nlet f x = x", 4, "a.ml") == "Adds\none."
    assert scan.doc_comment("/// one\n/// two\nfn f() {}", 3, "a.rs") == "one\ntwo"
    assert scan.doc_comment("let a = 1\nlet f x = x", 2, "a.ml") is None and scan.doc_comment(None, 2, "a.ml") is None


def test_bodies_and_moves(spark):
    src = "let a x =\n  x\n\n  + 1\nlet rec b(y) = y\ntype t = int\n"
    got = {r.id: r.body for r in compare.extract_bodies(spark.createDataFrame([(1, src, "a"), (2, src, "b"), (3, src, "ab"), (4, src, "t")], "id int, source string, fn string")).collect()}
    assert got == {1: "let a x =\nx\n+ 1", 2: "let rec b(y) = y", 3: None, 4: None}
    v = {r.k: (r.verdict, r.copies) for r in compare.body_verdicts(spark.createDataFrame([("i", " a\n\nb "), ("i", "a\nb"), ("d", "a"), ("d", "b"), ("n", None)], "k string, body string"), "k").collect()}
    assert v == {"i": ("Identical", 2), "d": ("Differs", 2), "n": ("Not_found", 0)}
    diff = "--- a/x.ml\n+++ b/x.ml\n-let f a = a\n-let _ = 1\n--- a/y.ml\n+++ b/y.ml\n+let rec f a = a\n+let g = 1\n--- /dev/null\n+++ b/z.ml\n+let f = 2"
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(diff.split("\n"))], "diff_id int, line_no int, line string")
    assert [tuple(r) for r in compare.diff_moves(d).collect()] == [(1, "f", "x.ml", "y.ml")]


def test_callgraph_diff_rules(spark):
    cols = "caller_name string, callee_name string, call_site string, kind string"
    old = spark.createDataFrame([("f", "*TOP*", "s1", "MAY_TOP"), ("g", "loc", "s2", "MUST"), ("g", "M.q", "s2", "MUST"), ("h", "k", "s3", "MUST")], cols)
    new = spark.createDataFrame([("f", "f.<fun:1:2>", "s9", "MUST"), ("g", "g.<fun:3:4>", "s2", "MUST"), ("h", "k", "s3", "MAY_TOP")], cols)
    got = sorted((r.status, r.caller, r.callee) for r in compare.callgraph_diff(old, new).collect())
    assert got == [("added", "f", "f"), ("added", "g", "g"), ("dropped", "g", "M.q"), ("replaced", "f", "*TOP*"), ("replaced", "g", "loc")]
    assert [tuple(r) for r in compare.kind_movements(old, new).collect()] == [("MUST", "MAY_TOP", 1)]


def test_values_and_paths(spark):
    r = one(spark, '[{"kind": "k", "direction": "d"}, {"kind": "x"}, {}]', text.encode_value_touched(text.parse_value_touched(F.col("t"))), text.encode_value_touched(text.parse_value_touched(F.lit(None).cast("string"))))
    assert tuple(r) == ('[{"kind":"k","direction":"d"}]', None)
    r = one(spark, "src/a_b/my_mod.test.ml", text.module_of(F.col("t")), text.dir_name(F.col("t")), text.relative_to(F.col("t"), "src"), text.strip(F.lit(" \t\nx\f")))
    assert tuple(r) == ("My_mod.test", "src/a_b", "a_b/my_mod.test.ml", "x")


def test_files_and_symbols(spark):
    p = spark.createDataFrame([("a/x.ts",), ("a/x.d.ts",), ("node_modules/y.ts",), ("b/z.py",), ("b/m.cmt",), ("b/dune__m.cmti",)], "path string")
    assert sorted(tuple(r) for r in files.source_files(p).collect()) == [("python", "b/z.py"), ("typescript", "a/x.ts")]
    assert [r.path for r in files.compiled(p).collect()] == ["b/m.cmt"]
    d = spark.createDataFrame([("r", "Cargo.toml"), ("r", "sub/package.json"), ("r", "a/b/c/d/e/go.mod"), ("q", "x/setup.py")], "root string, path string")
    assert {r.root: (r.language, r.languages) for r in files.detect_languages(d).collect()} == {"r": ("rust", "typescript,rust"), "q": (None, "python")}
    tree = [{"name": "C", "kind": 5, "children": [{"name": "_m", "kind": 6, "range": {"start": {"line": 1}, "end": {"line": 3}}}]}, {"name": "v", "kind": 13, "location": {"uri": "file:///w/q.py"}}, 7]
    s = lsp.symbols(spark.createDataFrame([("file:///w/p.py", json.dumps(tree)), ("u", "{"), ("u", None)], "uri string, response string"), "/w")
    assert sorted((r.name, r.file_path, r.line_start, r.exported) for r in s.collect()) == [("_m", "p.py", 2, 0), ("v", "q.py", None, 1)]


def test_stream_of_calls(spark, tmp_path):
    from edgeloom.streaming import ingest

    (tmp_path / "in").mkdir()
    rows = [call("a", "b"), call("a", "b"), call("a", "c", "odd"), "{bad", {"type": "function", "name": "z"}, call("d", "e", "MAY_TOP")]
    (tmp_path / "in" / "1.ndjson").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    good, bad = ingest.call_stream(ingest.stream_lines(spark, str(tmp_path / "in")))
    for name, df in (("good", good), ("bad", bad)):
        q = ingest.write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}.cp"))
        q.awaitTermination(120)
    assert sorted((r.caller_name, r.callee_name) for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [("a", "b"), ("d", "e")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_sorted_records_are_written(spark, tmp_path):
    fn = spark.createDataFrame([("b", "f", 1), ("a", None, 0)], "name string, file_path string, exported int")
    calls = spark.createDataFrame([("b", None, "a", None, "s", "MUST")], "caller_name string, caller_file string, callee_name string, callee_file string, call_site string, kind string")
    store.write_ndjson(fn, calls, str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 3
    f2, c2, _ = ndjson.callgraph(ndjson.read_lines(spark, str(tmp_path / "out")))
    assert f2.count() == 2 and c2.count() == 1
    assert "name" in store.boxed(fn)


def test_post_dominance_of_a_long_function():
    """2,000 branches in a row: joins always run, arms never do, in one descending pass."""
    edges = [e for i in range(2000) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))] + [(6000, -1)]
    began = time.perf_counter()
    got = resolve.always_blocks(edges)
    assert time.perf_counter() - began < 2
    assert {b for b, a, _ in got if a} == set(range(0, 6001, 3)) and all(r for _, _, r in got)


def test_equal_places_and_ranks(spark):
    from edgeloom.cluster import global_rank

    df = spark.createDataFrame([(f"p{i:04}",) for i in range(500)], "path string").repartition(7)
    assert {r.path: r.id for r in global_rank(df, "path", "id").collect()} == {f"p{i:04}": i + 1 for i in range(500)}
    assert global_rank(df.limit(0), "path", "id").count() == 0


def test_lines_are_numbered_within_files_across_splits(spark, tmp_path):
    """Files cut into many splits, and several files: the numbers are those of the lines."""
    want = {}
    for name, n in (("a.ndjson", 300), ("b.ndjson", 7), ("c.ndjson", 0)):
        rows = [f"{name} {i} {'x' * (i % 40)}" for i in range(1, n + 1)]
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
        want |= {r: i for i, r in enumerate(rows, 1)}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {r.line: r.line_no for r in ndjson.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == want


def test_the_last_record_of_a_name_wins_over_splits(spark, tmp_path):
    rows = [f'{{"type":"function","name":"f{i % 5}","file_path":"p{i}","exported":{str(i % 2 == 0).lower()}}}' for i in range(200)]
    rows.append('{"caller_name":"f0","callee_name":"g","kind":"MUST"}')
    (tmp_path / "r.ndjson").write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        fn = ndjson.callgraph(ndjson.read_lines(spark, str(tmp_path)))[0].collect()
        (tmp_path / "r.ndjson").write_text("\n".join([*rows, '{"broken"']))
        with pytest.raises(LoadError, match="line 202:"):
            ndjson.callgraph(ndjson.read_lines(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.name, r.file_path) for r in fn} == {("f0", "p195"), ("f1", "p196"), ("f2", "p197"), ("f3", "p198"), ("f4", "p199"), ("g", None)}


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(3), spark.range(10, 15)
    assert store.replace_table(one, path).count() == 3
    got = store.replace_table(two, path)
    assert sorted(r.id for r in got.collect()) == [10, 11, 12, 13, 14] and not (tmp_path / "t.tmp").exists()
    assert store.replace_table(got.limit(0), path + "2").count() == 0


def test_box(spark):
    df = spark.createDataFrame([("a\nb", 1), (None, 23)], "name string, n int")
    assert store.boxed(df).split("\n") == ["┌──────┬────┐", "│ name │ n  │", "├──────┼────┤", "│ a b  │ 1  │", "│      │ 23 │", "└──────┴────┘"]
    assert store.boxed(df.limit(0)).count("\n") == 3 and store.boxed(df, 1).count("\n") == 4


def test_post_dominance_against_removal():
    """A block always runs if the exit cannot be reached without it."""
    import random

    r = random.Random(4)
    for _ in range(400):
        n = r.randrange(1, 9)
        edges = [(r.randrange(n), r.choice([-1, *range(n)])) for _ in range(r.randrange(1, 3 * n))]

        def reached(without=None):
            seen, todo = {0} - {without}, [0] if without != 0 else []
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b not in seen and b != without:
                        seen.add(b)
                        todo.append(b)
            return seen

        want = [(b, b in reached() and -1 in reached() and -1 not in reached(b), b in reached()) for b in sorted({x for e in edges for x in e} - {-1})]
        assert resolve.always_blocks(edges) == want


def test_moves_over_stretches_and_many_files(spark, monkeypatch):
    """Against a walk line by line, with diffs longer than a stretch and names that leave and enter several files."""
    import random

    monkeypatch.setattr(compare, "STRETCH", 7)
    r = random.Random(6)
    rows, at = [], 0
    for d in (1, 2, 3):
        for n in range(60):
            at += 1
            line = r.choice([f"--- a/f{r.randrange(4)}", f"+++ b/f{r.randrange(4)}", "+++ /dev/null", "--- /dev/null", " context", f"-let g{r.randrange(3)} x", f"+let rec g{r.randrange(3)} =", "+let _ = 1"])
            rows.append((d, at, line))
    want = {}
    for d in (1, 2, 3):
        a = b = ""
        out, into = [], []
        for _, _, line in [x for x in rows if x[0] == d]:
            if line.startswith("--- "):
                a = line[4:].removeprefix("a/")
            elif line.startswith("+++ "):
                b = line[4:].removeprefix("b/")
            elif line.startswith("-let ") and a != "/dev/null":
                out.append((line.split()[1], a))
            elif line.startswith("+let rec ") and b != "/dev/null":
                into.append((line.split()[2], b))
        for n, f in out:
            for m, t in into:
                if n == m and f != t:
                    want[d, n] = min(want.get((d, n), (f, t)), (f, t))
    got = compare.diff_moves(spark.createDataFrame(rows, "diff_id int, line_no int, line string")).collect()
    assert {(x.diff_id, x.fn_name): (x.from_file, x.to_file) for x in got} == want and want


def test_migration_scripts(spark):
    script = "-- a; b\nALTER TABLE t ADD COLUMN x TEXT DEFAULT 'it''s; -- no comment'; ;\nalter table t add y integer -- last; one\n;CREATE VIEW v AS SELECT '--' - 1"
    assert store.statements(script) == ["ALTER TABLE t ADD COLUMN x TEXT DEFAULT 'it''s; -- no comment'", "alter table t add y integer", "CREATE VIEW v AS SELECT '--' - 1"]
    assert store.statements("") == [] and store.statements("-- only") == []
    t = {"t": spark.range(2)}
    once = store.run_migration(t, script)["t"]
    assert once.dtypes == [("id", "bigint"), ("x", "string"), ("y", "bigint")] and store.run_migration({"t": once}, script)["t"].dtypes == once.dtypes
    with pytest.raises(LoadError):
        store.run_migration({}, script)
