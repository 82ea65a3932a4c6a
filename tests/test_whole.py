"""Queries do the whole job: every line, step, row and definition."""

import pytest
from edgeloom.functions import comments, scan, text
from edgeloom.operators import drift
from edgeloom.plans import api, etl, registry, verbs
from edgeloom.sources import sidecar
from pyspark.sql import functions as F


def test_every_line_is_stripped(spark):
    source = 'a: 1  # x\nb: "q # r" # s\n\n# all\nc: \'it # open\nd: e#f\r'
    got = etl.stripped_lines(spark.createDataFrame([(1, source), (2, "")], "doc_id long, text string")).collect()
    want = [(1, i, sidecar.without_comment(x)) for i, x in enumerate(source.split("\n"), 1)] + [(2, 1, "")]
    assert sorted(tuple(r) for r in got) == want


def test_neighborhood_has_the_default_depth(spark):
    from types import SimpleNamespace

    edges = [("h", "a"), ("h", "b"), ("c", "a"), ("b", "d"), ("d", "e"), ("h", "x")]
    graph = spark.createDataFrame([(*e, "s", "MUST") for e in edges], "caller_name string, callee_name string, call_site string, kind string")
    functions = spark.createDataFrame([(n,) for n in "habcde"], "name string")
    s = SimpleNamespace(spark=spark, graph=graph, functions=functions)
    assert api.DEPTH == 2 and {"api_neighborhood_default", "api_neighborhood_edges_default"} <= set(registry.QUERIES)
    assert {r.n: r.depth for r in api.indexed_neighbors(s, api.DEPTH).collect()} == {"h": 0, "a": 1, "b": 1, "c": 2, "d": 2}
    assert sorted((r.caller_name, r.callee_name) for r in api.edges_between(s, api.DEPTH).collect()) == [("b", "d"), ("c", "a"), ("h", "a"), ("h", "b")]


@pytest.mark.parametrize(
    "value, items",
    [
        ("[a,\n b]", ["a", "b"]), ('[""]', []), ("[\"a\", 'b', \"c]", ["a", "b", '"c']), ('"a, b"', ["a", "b"]), ("a,, b\nc", ["a", "b\nc"]), ("[", ["["]), ("[]", []), ("", []), (None, []), ('a, "b"', ["a", '"b"']),
        ('[" a "]', [" a "]),
    ],
)
def test_list_items(spark, value, items):
    assert spark.createDataFrame([(value,)], "t string").select(text.list_items(F.col("t"))).first()[0] == items
    if value is not None and value != '[" a "]':
        assert sidecar.listed(value) == ",".join(items)


def test_all_sections_and_warnings(spark):
    source = "S {odd}\n{post} (none)\n{pre} p {post} again {quint-module} m {x{inv} i {pre}{a\nb}"
    sections, warnings = spark.createDataFrame([(source,)], "t string").select(comments.parse_index(F.col("t")), comments.index_warnings(F.col("t"))).first()
    want = {"summary": ("present", "S {odd}"), "post": ("none", None), "pre": ("present", "p"), "quint_module": ("present", "m {x"), "inv": ("present", "i")}
    assert {k: tuple(v) for k, v in sections.asDict().items() if v.state != "absent"} == want
    assert warnings == ["Unknown tag: {odd}", "Duplicate section: {post} — using first occurrence", "Duplicate section: {pre} — using first occurrence"]


def test_documents_without_sections_stay(spark, sf_dir):
    got = registry.QUERIES["f_parse_cmt_sections"](spark, sf_dir)
    assert got.columns == ["doc_id", "summary", "pre", "post", "violators", "violates", "inv", "tests", "quint", "quint_module", "warnings"]
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").count()


def test_main_verbs_walk_calls_without_a_kind(spark):
    rows = [("main", "mid", None), ("mid", "leaf", "MUST"), ("odd", "leaf", "must"), ("top", "x", "MAY_TOP"), ("nul", "gone", None), ("calm", "nul", "MUST")]
    calls = spark.createDataFrame([(a, b, k, k if k in ("MUST", "MAY_TOP") else "MAY_TOP") for a, b, k in rows], "caller_name string, callee_name string, raw_kind string, kind string")
    fn = spark.createDataFrame([(n, "flat.ml", 1) for n in ("main", "mid", "leaf", "odd", "top", "nul", "calm")], "name string, file_path string, module_id int")
    modules = spark.createDataFrame([(1, "mod.ml")], "id int, path string")
    fx = spark.createDataFrame([("leaf", None, "HashTbl", "t", 1, "sound")], "function_name string, file_path string, value_kind string, target string, is_direct int, soundness string")
    got = {r.function_name: (r.file_path, r.how) for r in verbs.mutators_of_main(calls, fn, modules, fx, "HashTbl").collect()}
    assert got == {"leaf": ("mod.ml", "direct"), "mid": ("mod.ml", "transitive"), "main": ("mod.ml", "transitive")}
    assert {r.function_name for r in verbs.mutators_of(calls, fn, fx, "HashTbl").collect()} == {"leaf", "mid"}
    assert [r.mutating_fn for r in verbs.effects_of_main(calls, fx, "main").collect()] == ["leaf"] and verbs.effects_of(calls, fx, "main").count() == 0
    assert sorted(tuple(r) for r in verbs.pure_fns_main(calls, fn, modules, fx).collect()) == [("calm", "mod.ml"), ("nul", "mod.ml")]
    assert {"mutators_of_main", "effects_of_main", "pure_fns_main"} <= set(registry.QUERIES)


def test_every_definition_has_its_comment_and_body(spark):
    ml = "(** One. *)\nlet a x =\n  x\n\n(* Two. *)\nlet rec b = 2\nlet a = 3\n" + "\n" * 30 + "let c' = 4\n(** End. *)\nlast"
    go = "/// Puts.\nfunc (s *T) Put(x int) {\n}\n/// Gets.\nexport async function get(k) {"
    t = spark.createDataFrame([(1, "m.ml", ml), (2, "m.go", go), (3, "m.ml", "no code")], "doc_id long, module_path string, text string")
    got = {(r.doc_id, r.line_no, r.fn): r.comment for r in etl.doc_comments(t).collect()}
    assert got == {(1, 2, "a"): "One.", (1, 6, "b"): "Two.", (1, 7, "a"): None, (1, 38, "c'"): None, (2, 2, "Put"): "Puts.", (2, 5, "get"): "Gets."}
    assert all(c == scan.doc_comment(ml if d == 1 else go, n, "m.ml" if d == 1 else "m.go") for (d, n, _), c in got.items())
    b = sorted(tuple(r) for r in etl.bodies(t).collect())
    assert b == [(1, 2, "a", "let a x =\nx\n(* Two. *)"), (1, 6, "b", "let rec b = 2"), (1, 7, "a", "let a = 3"), (1, 38, "c'", "let c' = 4")]


def test_records_without_an_id_stay_apart(spark):
    payloads = ['{"a":1,"b":2}', '{"b":2,"a":1}', '{"a":1,"b":3}', "{}", '{"id":1,"a":1}', '{"id":1,"a":1,"c":null}']
    lines = spark.createDataFrame([("s", "call", 1, i, p) for i, p in enumerate(payloads)], "stream_id string, record_type string, file_seq bigint, line_no int, payload string")
    got = drift.unified_records(lines).collect()
    records = {}
    for r in got:
        records.setdefault(r.record, []).append((r.field, r.canonical))
    want = [[("a", "1"), ("b", "2")], [("a", "1"), ("b", "3")], [(None, None)], [("a", "1"), ("id", "1")], [("a", "1"), ("c", None), ("id", "1")]]
    assert sorted(map(str, (sorted(x) for x in records.values()))) == sorted(map(str, want))


def test_hops_of_paths_longer_than_six(spark):
    from types import SimpleNamespace

    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("n01", "n03"), ("n05", "n02")]
    graph = spark.createDataFrame([(a, b, "s", "MUST") for a, b in edges], "caller_name string, callee_name string, call_site string, kind string")
    functions = spark.createDataFrame([(f"n{i:02}",) for i in range(13)], "name string")

    def hops(a, b):
        seen, level, n = {a}, {a}, 0
        while level and b not in level:
            level = {y for x, y in edges if x in level} - seen
            seen, n = seen | level, n + 1
        return n if level else None

    got = {(r.a, r.b): (r.verdict, r.hops) for r in api.api_reaches(SimpleNamespace(spark=spark, graph=graph, functions=functions)).collect()}
    assert got == {(a, b): ("PATH_EXISTS" if hops(a, b) is not None else "NO_MUST_PATH", hops(a, b)) for a, b in got}
    assert max(n or 0 for _, n in got.values()) > 6
