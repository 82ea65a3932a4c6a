"""Problems 1 to 5 against brute force and on degenerate input."""

import collections
import datetime as dt
import itertools
import json
import string

import pytest
from edgeloom.operators import drift, multivalue, orphans, reconcile, skewagg
from edgeloom.plans import quality

T = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# ---- 1: orphans ----------------------------------------------------------------------------------------------------

REF = "id long, k long, n string, created_at timestamp_ntz, loaded_at timestamp_ntz, tag string, h string, salt string"


def refs_of(spark, data):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], REF)
    return [orphans.Reference("t", df, "k", "id"), orphans.Reference("t", df, "n", "name")]


def brute_orphans(data, ids, names, exempt):
    out = set()
    for i, k, n, c, at in data:
        for field, key, lives in (("k", k, ids), ("n", n, names)):
            if key is None or key in exempt:
                continue
            if at is None or not any(x == key and s is not None and s <= at and (e is None or at < e) for x, s, e in lives):
                out.add(("t", c and c.strftime("%Y-%m"), i, field))
    return sorted(out, key=repr)


def check_orphans(spark, data, ids, names, exempt, slot=131072, **sizes):
    got = orphans.find_orphans(
        refs_of(spark, data),
        spark.createDataFrame(ids, "kid long, start timestamp_ntz, stop timestamp_ntz"),
        spark.createDataFrame(names, "kname string, start timestamp_ntz, stop timestamp_ntz"),
        spark.createDataFrame([(e,) for e in exempt], "kname string"),
        rows_per_slot=slot,
        **sizes,
    )
    assert rows(got, "src_table", "period", "row_id", "ref_field") == brute_orphans(data, ids, names, exempt)


def test_orphans_random_with_hot_key(spark):
    import random

    r = random.Random(7)
    ids = [(k, T + r.randrange(9) * DAY, r.choice([None, T + r.randrange(5, 20) * DAY])) for k in range(40) for _ in range(r.randrange(1, 4))]
    names = [(f"n{k}", s, e) for k, s, e in ids]
    data = [
        (i, r.choice([None, 1, 1, 1, r.randrange(60)]), r.choice([None, "n1", "n1", f"n{r.randrange(60)}", "ext", ""]), r.choice([T + r.randrange(60) * DAY, None]), r.choice([T + r.randrange(20) * DAY] * 9 + [None]))
        for i in range(600)
    ]
    check_orphans(spark, data + data[:50], ids, names, ["ext", None], slot=32)


def test_orphans_many_exempt_names_give_the_same_rows(spark):
    data = [(1, None, "ext", T, None), (2, None, "ext", T, T), (3, None, "n", T, None), (4, None, "n", None, T), (5, 1, "both", T, None), (6, 1, "both", T, T)]
    for rows_ in (200_000, 0):
        check_orphans(spark, data, [(1, T, None)], [("n", T, None), ("both", T + DAY, None)], ["ext", "both", None], broadcast_rows=rows_)


def test_orphans_hot_parent_is_cut_along_time(spark):
    """One name and one id with many intervals, overlapping, disjoint, open and repeated ones."""
    import random

    r = random.Random(11)
    many = [(T + r.randrange(3000) * DAY, r.choice([1, 1, 2, 3, 40])) for _ in range(400)]
    lives = [(s, s + n * DAY) for s, n in many] + [(T + 2990 * DAY, None)]
    ids = [(1, s, e) for s, e in lives] + [(2, T, None), (3, None, None)]
    names = [("hot", s, e) for s, e in lives + lives[:20]] + [("cold", T, T + 5 * DAY)]
    data = [(i, r.choice([1, 1, 2, 3, None]), r.choice(["hot", "hot", "cold", "ext", None]), T, r.choice([None] + [T + r.randrange(-3, 3200) * DAY] * 20)) for i in range(500)]
    for rows_ in (200_000, 0):
        check_orphans(spark, data, ids, names, ["ext"], slot=64, broadcast_rows=rows_, intervals_per_slice=16)
    check_orphans(spark, data, ids, names, ["ext", "hot"], slot=64, broadcast_rows=0, intervals_per_slice=16)


def test_orphans_bounds_and_empty(spark):
    data = [(1, 5, "a", T, T), (2, 5, "a", T, T + DAY), (3, 5, None, T, T - DAY), (4, None, "", None, T)]
    check_orphans(spark, data, [(5, T, T + DAY)], [("a", T, T + DAY)], [])
    check_orphans(spark, data, [], [], [])
    check_orphans(spark, [], [(5, T, None)], [], ["a"])
    check_orphans(spark, data, [(5, None, None)], [("a", T, None), ("a", T - DAY, T)], [])


# ---- 2: reconcile --------------------------------------------------------------------------------------------------

SIDE = "id long, f string, g string, leaf long, side int, key string"


def brute_diff(a, b):
    out = set()
    for k in {r[0] for r in a} | {r[0] for r in b}:
        x, y = {r[1:] for r in a if r[0] == k}, {r[1:] for r in b if r[0] == k}
        if not x or not y:
            out.add((k, "l_only" if x else "r_only"))
        else:
            out |= {(k, f) for i, f in enumerate("fg") if {r[i] for r in x} != {r[i] for r in y}}
    return sorted(out, key=repr)


def check_diff(spark, a, b, leaf=16):
    x, y = (spark.createDataFrame([(*r, 1, 2, "c") for r in s], SIDE) for s in (a, b))
    assert rows(reconcile.reconcile(x, y, "id", ["f", "g"], ("l", "r"), leaf), "key", "diff") == brute_diff(a, b)


def test_reconcile_random(spark):
    import random

    r = random.Random(3)
    a = [(i, r.choice(["x", "y", None]), r.choice(["", "q", None])) for i in range(-50, 900)]
    b = [(i, f if r.random() > 0.03 else r.choice(["x", None, "é"]), g if r.random() > 0.03 else "q") for i, f, g in a if r.random() > 0.02]
    b += [(5000 + i, "n", None) for i in range(5)] + b[:40] + [(7, "conflict", None)]
    check_diff(spark, a + a[100:130], b)
    check_diff(spark, a, b, leaf=1)


def test_reconcile_edges(spark):
    check_diff(spark, [], [])
    check_diff(spark, [(1, None, None)], [])
    check_diff(spark, [(None, "a", "b"), (1, "a", None)], [(None, "a", "c"), (1, None, "a")])
    check_diff(spark, [(1, "x", "x")] * 3, [(1, "x", "x")])
    check_diff(spark, [(1, "x", "x")] * 2, [(1, "y", "x")] * 2)


def test_reconcile_rows_without_a_key(spark):
    import random

    r = random.Random(8)
    for _ in range(6):
        a, b = ([(r.choice([None, None, 1]), r.choice("xy"), r.choice(["p", None])) for _ in range(r.randrange(0, 5))] for _ in range(2))
        check_diff(spark, a, b)
    check_diff(spark, [(None, "x", "p")], [])
    check_diff(spark, [(None, "x", "p"), (None, "y", None)], [(None, "y", "p"), (None, "x", None)])


def test_bisect_follows_only_mismatches():
    import pyarrow as pa

    n = 1000
    t = pa.table({"leaf": list(range(n)), "lo": [7 if i in (3, 998) else 0 for i in range(n)], "hi": [-7 if i == 500 else 0 for i in range(n)], "n": [0] * n})
    assert sorted(reconcile._bisect(t)["leaf"].to_pylist()) == [3, 500, 998]
    assert reconcile._bisect(t.slice(10, 20)).num_rows == 0


# ---- 3: several values in a field -----------------------------------------------------------------------------------

def brute_values(text, style):
    """A character-by-character scanner of the grammar, with every foreign character as a separator."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        depth = 0
        for i, ch in enumerate(t):
            depth += ch in "[({"
            depth -= ch in "])}"
            if not depth:
                break
        if style == "word" or i == len(t) - 1:
            t = t[1:-1]
    quotes = "\"'" if style == "word" else '"'
    allowed = set(string.ascii_letters + string.digits + ("_-.:" if style == "word" else "_.': "))
    out, cur, i = [], "", 0
    while i < len(t):
        ch = t[i]
        if ch in quotes and not cur.strip():
            j, val = i + 1, ""
            while True:
                if t[j] == ch and t[j + 1 : j + 2] == ch:
                    val += ch
                    j += 2
                elif t[j] == ch:
                    break
                else:
                    val += t[j]
                    j += 1
            out.append(val.strip())
            cur, i = "", j + 1
        elif style == "type" and ch in "([{":
            depth, j = 0, i
            while True:
                depth += t[j] in "([{"
                depth -= t[j] in ")]}"
                j += 1
                if not depth:
                    break
            cur += t[i:j]
            i = j
        elif ch not in allowed or (style == "type" and t[i : i + 2] == "  "):
            out.append(cur.strip())
            cur, i = "", i + 1
        else:
            cur, i = cur + ch, i + 1
    out.append(cur.strip())
    return [x for x in out if x]


def test_values_match_scanner(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        got = set(rows(quality.p3_found(spark, d), "src_table", "row_id", "field", "pos", "item"))
        want = set()
        for t, f, style in (("function_effects", "actor_role", "word"), ("function_effects", "temporal_class", "word"), ("type_constructors", "arg_types", "type")):
            for i, v in spark.read.parquet(f"{d}/{t}.parquet").select("id", f).collect():
                want |= {(t, i, f, p, x) for p, x in enumerate(brute_values(v or "", style))}
        assert got == want


@pytest.mark.parametrize(
    "text, style, want",
    [
        ('"a, b",c', "word", ("a, b", "c")), ("'x''s' ; y", "word", ("x's", "y")), ('"say ""hi"""', "word", ('say "hi"',)),
        ("[a, , b]", "word", ("a", "b")), ("[]", "word", ()), (" ; ", "word", ()), ('""', "word", ()), ("team:x", "word", ("team:x",)),
        ("(int * 'a) list, l: 'b", "type", ("(int * 'a) list", "l: 'b")), ('"(a, b) t";c', "type", ("(a, b) t", "c")),
        ("[ `Low | `High ]", "type", ("[ `Low | `High ]",)), ("[int, [ `Low | `High ]]", "type", ("int", "[ `Low | `High ]")),
        ("[ `A ] * [ `B ]", "type", ("[ `A ]", "[ `B ]")), ("{ a: int; b: (x, y) t }, z", "type", ("{ a: int; b: (x, y) t }", "z")),
    ],
)
def test_split_one(text, style, want):
    assert multivalue.split(text, style, (",", ";", "*", "|", "\n", " " if style == "word" else "  ")) == want


@pytest.mark.parametrize("style, alphabet", [("word", "ab1é_-.:,,;;|/ \t\n\"'[]()，"), ("type", "ab1é_.':: ,,;|  \t\n()()[]{}`*，x")])
def test_batches_read_as_single_texts(style, alphabet):
    """The kernel over a batch finds the separators and values that the reader of one text finds."""
    import random

    import numpy as np
    import pyarrow as pa

    r, g = random.Random(5), multivalue.GRAMMARS[style]
    rules = [(), (",",), (" ", ";"), ("\n", "\t", "|"), ("  ", ",", "，"), (",", ";", "|", "/", "*", "\n", " " if style == "word" else "  ")]
    easy = 0
    for start in (0, 1, 7):
        texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20]))) for _ in range(3000)]
        texts += [f"[{t}]" for t in texts[:600]] + ["", "[]", " ", "[ ]", "[[a],b]", "[a] , [b]", "(a) b: c", "a : b, c", "a: b: c", "a:", "é, x", "[;][é*]"]
        scan = multivalue._Scan(pa.array(["zz"] * start + texts, pa.string()).slice(start), g)
        seps, pieces, regular = scan.layouts()
        of = np.array([r.randrange(len(rules)) for _ in texts])
        got = collections.defaultdict(list)
        for row, pos, item in zip(*scan.pieces(of, rules)):
            got[row].append((pos, item.as_py()))
        for i, t in enumerate(texts):
            if scan.hard[i]:
                assert i not in got
                continue
            easy += 1
            assert (seps[i].as_py(), pieces[i], regular[i]) == multivalue.layout(t, style), t
            assert got[i] == list(enumerate(multivalue.split(t, style, rules[of[i]]))), t
    assert easy > 2000


def test_letters_of_any_script_are_no_separators(spark):
    data = [(1, "café,thé"), (2, "über, naïve"), (3, "ключ，é")]
    got = rows(multivalue.split_values([multivalue.Packed("t", spark.createDataFrame(data, "id long, f string"), "id", "f", None, "word")]), "row_id", "pos", "item")
    assert {x[2] for x in got if x[0] < 3} <= {"café", "thé", "über", "naïve", "café,thé", "über, naïve"} and "caf" not in {x[2] for x in got}
    plain = [(i, "ab,cd") for i in range(9)] + [(10, "café,thé"), (11, "x·y"), (12, "p+q")]
    df = spark.createDataFrame(plain, "id long, f string")
    got = rows(multivalue.split_values([multivalue.Packed("t", df, "id", "f", None, "word")]), "row_id", "item")
    assert [x[1] for x in got if x[0] == 10] == ["café", "thé"] and [x[1] for x in got if x[0] == 11] == ["x", "y"]
    kept = multivalue.Grammar("\"'", False, "_-.:+", "A-Za-z0-9")
    got = rows(multivalue.split_values([multivalue.Packed("t", df, "id", "f", None, kept)]), "row_id", "item")
    assert [x[1] for x in got if x[0] == 12] == ["p+q"]


def test_values_degenerate(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    data = [(1, None, "p"), (2, "", "p"), (3, "  ", None), (4, "[]", "p"), (5, "a", None), (5, "a", None), (6, long, "p"), (7, "x;y", None), (8, '"open', "p"), (None, "k,l", "p")]
    df = spark.createDataFrame(data, "id long, f string, who string").selectExpr("*", "1 as pos", "2 as item", "3 as style")
    got = multivalue.split_values([multivalue.Packed("t", df, "id", "f", "who", "word")]).collect()
    by = collections.Counter(r.row_id for r in got)
    assert by == {5: 1, 6: 20_000, 7: 2, 8: 1, None: 2}
    assert {r.item for r in got if r.row_id == 8} == {'"open'}
    none = multivalue.split_values([multivalue.Packed("t", df.limit(0), "id", "f", None, "type")])
    assert none.count() == 0 and none.columns == ["src_table", "row_id", "field", "pos", "item"]


# ---- 4: drift ------------------------------------------------------------------------------------------------------

def brute_changes(lines):
    files = collections.defaultdict(lambda: collections.defaultdict(list))
    for s, q, p in lines:
        files[s][q]
        try:
            o = json.loads(p)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            files[s][q].append(o)
    name = {str: "string", int: "integer", bool: "boolean", dict: "object", list: "array", float: "number"}
    out = set()
    for s, fs in files.items():
        for a, b in itertools.pairwise(sorted(fs)):
            old, new = ({k: {name[type(o[k])] for o in fs[q] if o.get(k) is not None} for k in {k for o in fs[q] for k in o}} for q in (a, b))
            gone, came, used = set(old) - set(new), set(new) - set(old), set()
            pairs = [(x, y) for x in fs[a] for y in fs[b] if x.get("id") is not None and json.dumps(x["id"]) == json.dumps(y.get("id"))]
            for g, c in itertools.product(gone, came):
                vals = [(json.dumps(x.get(g), sort_keys=True), json.dumps(y.get(c), sort_keys=True)) for x, y in pairs]
                if all(u == v for u, v in vals) and any(u != "null" for u, _ in vals):
                    out.add((s, b, "renamed", f"{g}>{c}"))
                    used |= {("g", g), ("c", c)}
            out |= {(s, b, "removed", g) for g in gone if ("g", g) not in used} | {(s, b, "added", c) for c in came if ("c", c) not in used}
            out |= {(s, b, "type_changed", k) for k in set(old) & set(new) if old[k] and new[k] and old[k] != new[k]}
    return sorted(out, key=repr)


LINE = "stream_id string, record_type string, file_seq long, file_name string, line_no int, payload string, arrived_at timestamp_ntz, rid string, fields string"


def lines_df(spark, data):
    return spark.createDataFrame([(s, "call", q, "f", i, p, T, "r", "x") for i, (s, q, p) in enumerate(data)], LINE)


def test_changes_match_brute_force(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        src = spark.read.parquet(f"{d}/extract_lines.parquet")
        want = brute_changes([tuple(r) for r in src.select("stream_id", "file_seq", "payload").collect()])
        assert rows(quality.p4_found(spark, d), "stream_id", "file_seq", "change", "field") == want and want


def test_changes_on_hand_made_files(spark):
    j = json.dumps
    data = [("a", 1, j({"id": 1, "x": 1, "y": None})), ("a", 1, j({"id": 2, "x": None})), ("a", 1, ""), ("a", 1, None), ("a", 1, '{"id": 9'),
            ("a", 4, j({"id": 1, "z": 1, "y": "s"})), ("a", 4, j({"id": 2})), ("a", 4, j({"id": 2})), ("a", 4, "[1]"), ("a", 4, '{"id":1} {"w":2}'),
            ("a", 5, j({"id": 1, "z": "1", "y": "s"})), ("a", 6, "# nothing"), ("a", 7, j({"id": 1, "z": 1.5})), ("b", 1, j({"id": 1, "Q": [1]})),
            ("b", 2, j({"id": "1", "q": [1]})), ("b", 3, j({"id": "1", "Q": [1]})), ("b", 4, '{"id": NaN, "Q": 1}'), (None, 1, j({"k": 1}))]
    got = rows(drift.schema_changes(lines_df(spark, data)), "stream_id", "file_seq", "change", "field")
    want = brute_changes([(s, q, p) for s, q, p in data if not (p and "NaN" in p)] + [("b", 4, "x")])
    assert got == want
    assert ("a", 4, "renamed", "x>z") in got and ("b", 3, "renamed", "q>Q") in got and ("b", 2, "removed", "Q") in got
    assert drift.schema_changes(lines_df(spark, [])).count() == 0


def test_records_keep_branches_and_first_names(spark):
    j = json.dumps
    data = [("a", 1, j({"id": 1, "exposed": True})), ("a", 2, j({"id": 1, "exported": True, "m": {"b": 1, "a": 2}})), ("a", 3, j({"id": 1, "exported": "true"})), ("a", 3, j({"id": 1, "exported": "true"}))]
    got = rows(drift.unified_records(lines_df(spark, data)).where("field = 'exposed'"), "file_seq", "written_as", "tag", "as_string", "as_boolean", "as_flag")
    assert got == [(1, "exposed", "boolean", None, True, 1), (2, "exported", "boolean", None, True, 1), (3, "exported", "string", "true", None, 1)]
    assert rows(drift.unified_records(lines_df(spark, data)).where("field = 'm'"), "as_json") == [('{"a":2,"b":1}',)]
    assert ("a", "exported", "string", 3, 1) in rows(drift.fused_schema(lines_df(spark, data)))


def test_records_are_followed_into_objects_and_arrays(spark):
    data = [
        ("a", 1, '{"id":1,"m":{"x":1,"l":[{"y":null},"s",2.50]},"n":1.0}'), ("a", 2, '{"id":1,"k":{"x":"1","l":[{"y":null},"s",2.50]},"n":12345678901234567890}'),
        ("a", 2, '{"id":2,"k":{},"n":[]}'), ("a", 2, '{"id":3} {"id":4}'), ("a", 2, '{"id":5}]'), ("a", 2, "[1]"), ("a", 2, '{"id":6,"id":7}'),
    ]
    got = rows(drift.unified_records(lines_df(spark, data)).where("file_seq = 1"), "field", "tag", "as_string", "as_integer", "as_number")
    assert [g for g in got if g[1] not in ("object", "array")] == [
        ("id", "integer", None, 1, None), ("m.l[]", "number", None, None, 2.5), ("m.l[]", "string", "s", None, None), ("m.l[].y", None, None, None, None), ("m.x", "integer", None, 1, None), ("n", "number", None, None, 1.0),
    ]
    assert rows(drift.unified_records(lines_df(spark, data)).where("file_seq = 2 and field = 'n' and tag = 'integer'"), "as_integer") == [(12345678901234567890,)]
    assert rows(drift.unified_records(lines_df(spark, data)).where("file_seq = 2 and field = 'id'"), "rid") == [("1",), ("2",), ("7",)]
    schema = rows(drift.fused_schema(lines_df(spark, data)), "field", "type", "first_file")
    assert {x for x in schema if x[0] in ("m.x", "k.x", "n", "k.l[].y", "k")} == {
        ("m.x", "integer", 1), ("k.x", "string", 2), ("n", "number", 1), ("n", "integer", 2), ("n", "array", 2), ("k.l[].y", "null", 2), ("k", "object", 2)
    }


# ---- 5: skew -------------------------------------------------------------------------------------------------------

def test_salted_stats(spark):
    import random

    r = random.Random(1)
    data = [(r.choice(["hot"] * 5 + [None, "", f"k{r.randrange(200)}"]), r.choice([None, r.randrange(90)]), r.choice(["A", "B", "other", None]), "x") for _ in range(4000)]
    df = spark.createDataFrame(data, "k string, d long, kind string, salt string")
    want = []
    for k in {x[0] for x in data}:
        mine = [x for x in data if x[0] == k]
        c = collections.Counter(x[2] for x in mine)
        want.append((k, len(mine), len({x[1] for x in mine} - {None}), c["A"], c["B"], len(mine) - c["A"] - c["B"]))
    got = skewagg.salted_stats(df, "k", "d", "kind", ["A", "B"], heavy_share=0.05, salts=8)
    assert rows(got) == sorted(want, key=repr)
    assert rows(skewagg.keys_of_share(got, "k", 0.05)) == [("",), ("hot",)] or rows(skewagg.keys_of_share(got, "k", 0.05)) == [("hot",)]
    assert skewagg.salted_stats(df.limit(0), "k", "d", "kind", ["A"]).count() == 0


@pytest.mark.parametrize("name", [n for n in quality.QUERIES if n in quality.SQL])
def test_against_sql(spark, duck, sf_dir, name):
    df = quality.QUERIES[name](spark, sf_dir)
    cur = duck.execute(quality.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df, *cols) == sorted(cur.fetchall(), key=repr)
