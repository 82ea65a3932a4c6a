"""What the HTTP endpoints and the browser client compute, as DataFrames with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import global_rank
from edgeloom.operators.graph import edge_set, neighborhood, shortest_paths
from edgeloom.plans.substrate import Store
from edgeloom.plans.verb_queries import HUB, PAIRS, hub, pairs
from edgeloom.plans.views import QUERIES as _VIEW_QUERIES
from edgeloom.plans.views import SQL as _VIEW_SQL
from edgeloom.plans.views import view

_BEFORE = set(_VIEW_QUERIES)
CAP = 2000


@view("SELECT dense_rank() OVER (ORDER BY file_path) AS id, file_path AS path FROM (SELECT DISTINCT file_path FROM fn WHERE file_path IS NOT NULL)")
def api_modules(s: Store) -> DataFrame:
    """Files numbered in order of their paths."""
    files = s.functions.where("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return global_rank(files, "path", "id").select("id", "path")


def functions_in(functions: DataFrame, file_path: str | None = None, exposed: bool | None = None, min_score: int | None = None) -> DataFrame:
    """Functions that pass the present filters; a null score is 0."""
    f = functions
    if file_path is not None:
        f = f.where(F.col("file_path") == file_path)
    if exposed is not None:
        f = f.where(F.coalesce("exposed", F.lit(0)) == int(exposed))
    if min_score is not None:
        f = f.where(F.coalesce("score", F.lit(0)) >= min_score)
    return f.select("id", "name", "file_path", (F.coalesce("exposed", F.lit(0)) == 1).alias("exposed"), F.coalesce("score", F.lit(0)).alias("score"))


@view("SELECT id, name, file_path, coalesce(exposed, 0) = 1 AS exposed, coalesce(score, 0) AS score FROM fn WHERE coalesce(exposed, 0) = 1 AND coalesce(score, 0) >= 30")
def api_functions(s: Store) -> DataFrame:
    return functions_in(s.functions, exposed=True, min_score=30)


def _nb(depth: int) -> dict[str, str]:
    return {
        "r__n, depth_end": f"SELECT {HUB}, 0 UNION SELECT u.b, r.depth + 1 FROM r JOIN (SELECT caller_name AS a, callee_name AS b FROM fc UNION SELECT callee_name, caller_name FROM fc) u ON u.a = r.n WHERE r.depth < {depth}",
        "nb": f"SELECT n, min(depth) AS depth FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT {CAP}",
    }


_NB = _nb(1)
#: The depth of a request that gives none.
DEPTH = 2


def neighbors(s: Store, depth: int) -> DataFrame:
    start = s.spark.createDataFrame([(hub(s),)], "n string")
    edges = s.graph.select(F.col("caller_name").alias("src"), F.col("callee_name").alias("dst")).where("src is not null and dst is not null")
    return neighborhood(edges, start, depth, CAP)  # which makes them distinct and writes them, once


_NEAR = "SELECT n AS name, depth FROM nb WHERE n IN (SELECT name FROM fn)"
_NEAR_EDGES = """SELECT caller_name, callee_name, call_site FROM (SELECT caller_name, callee_name, min(call_site) AS call_site FROM fc WHERE caller_name IN (SELECT n FROM nb) AND callee_name IN (SELECT n FROM nb)
 AND callee_name IN (SELECT name FROM fn) GROUP BY 1, 2)"""


def indexed_neighbors(s: Store, depth: int) -> DataFrame:
    names = s.functions.select(F.col("name").alias("n")).where("n is not null").distinct()
    return neighbors(s, depth).join(names, "n", "left_semi")


def edges_between(s: Store, depth: int) -> DataFrame:
    near = indexed_neighbors(s, depth).select("n")
    e = s.graph.join(near.withColumnRenamed("n", "caller_name"), "caller_name", "left_semi").join(near.withColumnRenamed("n", "callee_name"), "callee_name", "left_semi")
    return e.groupBy("caller_name", "callee_name").agg(F.min("call_site").alias("call_site"))


@view(_NEAR, **_NB)
def api_neighborhood(s: Store) -> DataFrame:
    """Indexed functions within one step of the hub in either direction, nearest first, at most 2000."""
    return indexed_neighbors(s, 1).select(F.col("n").alias("name"), "depth")


@view(_NEAR_EDGES, **_NB)
def api_neighborhood_edges(s: Store) -> DataFrame:
    """Edges between indexed neighbours, one per pair with its least site; certainty is not given here."""
    return edges_between(s, 1)


@view(_NEAR, **_nb(DEPTH))
def api_neighborhood_default(s: Store) -> DataFrame:
    """As ``api_neighborhood`` within the default depth."""
    return indexed_neighbors(s, DEPTH).select(F.col("n").alias("name"), "depth")


@view(_NEAR_EDGES, **_nb(DEPTH))
def api_neighborhood_edges_default(s: Store) -> DataFrame:
    """As ``api_neighborhood_edges`` within the default depth."""
    return edges_between(s, DEPTH)


#: The largest depth of a request.
DEEPEST = 5


@view(_NEAR, **_nb(DEEPEST))
def api_neighborhood_deepest(s: Store) -> DataFrame:
    """As ``api_neighborhood`` within the largest depth, which meets the cap on all but small graphs."""
    return indexed_neighbors(s, DEEPEST).select(F.col("n").alias("name"), "depth")


_FILE = "(SELECT file_path FROM fn WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@view(f"SELECT c.caller_name, c.callee_name, c.call_site, c.kind FROM fc c JOIN fn g ON g.name = c.callee_name AND g.file_path = c.caller_file WHERE c.caller_file = {_FILE}")
def api_module_graph(s: Store) -> DataFrame:
    """Edges of the largest file whose both ends are functions of it."""
    top = s.functions.where("file_path is not null").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(1).select(F.col("file_path").alias("caller_file"))
    inside = s.functions.select(F.col("name").alias("callee_name"), F.col("file_path").alias("caller_file"))
    c = s.flat_calls.drop("callee_file").join(F.broadcast(top), "caller_file").join(inside, ["callee_name", "caller_file"])
    return c.select("caller_name", "callee_name", "call_site", "kind")


def reach_paths(s: Store, must_only: bool = True) -> DataFrame:
    """(a, b, verdict, path): a shortest path over MUST edges, or over all edges if asked."""
    e = edge_set(s.graph, "caller_name", "callee_name", ("MUST",) if must_only else None)
    p = pairs(s)
    found = shortest_paths(e, p.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b"), "path")
    return p.join(found, ["a", "b"], "left").withColumn("verdict", F.when(F.col("path").isNotNull(), "PATH_EXISTS").otherwise("NO_MUST_PATH"))


def _hops(kind: str) -> dict[str, str]:
    return {
        "pr": PAIRS, "d": f"SELECT DISTINCT caller_name AS a, callee_name AS b FROM fc WHERE {kind}",
        # Every (root, n) is kept with the depth at which it was met first, however deep that is.
        "r__root, n, depth, path_end USING KEY (root, n)": """SELECT DISTINCT a, a, 0, [a] FROM pr UNION SELECT root, b, min(depth) + 1, list_append(arg_min(path, n), b) FROM (SELECT r.root, d.b, r.depth, r.n, r.path FROM r JOIN d ON d.a = r.n
 WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.root = r.root AND x.n = d.b)) GROUP BY root, b""",
    }


_REACHED = "SELECT p.a, p.b, CASE WHEN r.depth IS NULL THEN 'NO_MUST_PATH' ELSE 'PATH_EXISTS' END AS verdict, r.depth AS hops FROM pr p LEFT JOIN r ON r.root = p.a AND r.n = p.b"


@view(_REACHED, **_hops("true"))
def api_reaches(s: Store) -> DataFrame:
    """Number of hops of a shortest path over all edges."""
    return _hop_count(reach_paths(s, must_only=False))


def _hop_count(paths: DataFrame) -> DataFrame:
    return paths.select("a", "b", "verdict", F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("hops"))


@view(_REACHED, **_hops("kind = 'MUST'"))
def api_reaches_must(s: Store) -> DataFrame:
    """As ``api_reaches`` over MUST edges only, which is what a request that says nothing else gets."""
    return _hop_count(reach_paths(s))


@view("SELECT p.a, p.b, r.path, CASE WHEN r.path IS NULL THEN 'NO_MUST_PATH' ELSE 'PATH_EXISTS' END AS verdict FROM pr p LEFT JOIN r ON r.root = p.a AND r.n = p.b", **_hops("true"))
def api_reaches_path(s: Store) -> DataFrame:
    """The shortest paths themselves, over all edges; of several the one by the least predecessors."""
    return reach_paths(s, must_only=False)


# ---- browser client --------------------------------------------------------------------------------------------------

SEARCH = "store"


@view(f"SELECT name, file_path, exposed FROM fn WHERE lower(name) LIKE '%{SEARCH}%' ORDER BY CASE WHEN starts_with(lower(name), '{SEARCH}') THEN 0 ELSE 1 END, length(name), coalesce(exposed, 0) DESC, name, id LIMIT 10")
def ui_search_rank(s: Store) -> DataFrame:
    low = F.lower("name")
    hit = s.functions.where(low.contains(SEARCH))
    order = (F.when(low.startswith(SEARCH), 0).otherwise(1), F.char_length("name"), F.coalesce("exposed", F.lit(0)).desc(), F.col("name"), F.col("id"))
    return hit.orderBy(*order).limit(10).select("name", "file_path", "exposed")


@view("SELECT name, score FROM fn WHERE exposed = 1 AND score IS NOT NULL ORDER BY score DESC, name, id LIMIT 3")
def ui_hint_top3(s: Store) -> DataFrame:
    return s.functions.where("exposed = 1 and score is not null").orderBy(F.desc("score"), "name", "id").limit(3).select("name", "score")


@view("SELECT caller_name, callee_name, kind, max(id) AS id FROM fc GROUP BY 1, 2, 3")
def ui_edge_dedup(s: Store) -> DataFrame:
    """One edge per (caller, callee, kind), the last by id."""
    return s.flat_calls.groupBy("caller_name", "callee_name", "kind").agg(F.max("id").alias("id"))


@view("SELECT DISTINCT a.caller_name, a.callee_name, a.kind FROM fc a WHERE EXISTS (SELECT 1 FROM fc b WHERE b.caller_name = a.callee_name AND b.callee_name = a.caller_name AND b.kind = a.kind)")
def ui_reciprocal(s: Store) -> DataFrame:
    e = s.flat_calls.select("caller_name", "callee_name", "kind").distinct()
    back = e.select(F.col("callee_name").alias("caller_name"), F.col("caller_name").alias("callee_name"), "kind")
    return e.join(back, ["caller_name", "callee_name", "kind"], "left_semi")


@view(f"SELECT callee_name AS name FROM fc WHERE caller_name = {HUB} UNION SELECT caller_name FROM fc WHERE callee_name = {HUB}")
def ui_adjacent(s: Store) -> DataFrame:
    h = hub(s)
    out = s.graph.where(F.col("caller_name") == h).select(F.col("callee_name").alias("name"))
    return out.union(s.graph.where(F.col("callee_name") == h).select("caller_name")).distinct()


@view("SELECT coalesce(raw_kind, 'MUST') AS kind, count(*) AS edges FROM fc WHERE coalesce(raw_kind, 'MUST') IN ('MUST', 'MAY_ENUMERATED') GROUP BY 1")
def ui_kind_filter(s: Store) -> DataFrame:
    """Edges of the kinds that are switched on; an edge without a kind shows as MUST."""
    k = F.coalesce("raw_kind", F.lit("MUST"))
    return s.flat_calls.where(k.isin("MUST", "MAY_ENUMERATED")).groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@view(f"""SELECT * FROM (SELECT 'out' AS side, callee_name AS name, call_site FROM fc WHERE caller_name = {HUB} ORDER BY callee_name, call_site NULLS FIRST, id LIMIT 12)
 UNION ALL SELECT * FROM (SELECT 'in', caller_name, call_site FROM fc WHERE callee_name = {HUB} ORDER BY caller_name, call_site NULLS FIRST, id LIMIT 12)""")
def ui_panel_edges(s: Store) -> DataFrame:
    h = hub(s)

    def side(label: str, own: str, other: str) -> DataFrame:
        e = s.graph.where(F.col(own) == h).orderBy(other, F.asc_nulls_first("call_site"), "id").limit(12)
        return e.select(F.lit(label).alias("side"), F.col(other).alias("name"), "call_site")

    return side("out", "caller_name", "callee_name").union(side("in", "callee_name", "caller_name"))


@view("SELECT id, name FROM fn WHERE name IS NOT NULL ORDER BY name, id LIMIT 100 OFFSET 100")
def ui_page(s: Store) -> DataFrame:
    """The second page of 100 rows."""
    return s.functions.where("name is not null").orderBy("name", "id").offset(100).limit(100).select("id", "name")


@view("SELECT id, 6 + coalesce(score, 0) / 75.0::DOUBLE * 8 AS radius FROM fn")
def ui_score_scale(s: Store) -> DataFrame:
    return s.functions.select("id", (F.lit(6) + F.coalesce("score", F.lit(0)) / F.lit(75.0) * F.lit(8)).alias("radius"))


def layers(edges: list[tuple[str, str]], nodes: list[str]) -> dict[str, int]:
    """Longest-path layers of one file's graph once the edges that close a cycle (depth-first, names in order) are gone."""
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in sorted(set(edges)):
        if a in after and b in after and a != b:
            after[a].append(b)
    state: dict[str, int] = {}
    kept: dict[str, list[str]] = {n: [] for n in nodes}
    order: list[str] = []
    for start in sorted(nodes):
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(after[start]))]
        while stack:
            n, it = stack[-1]
            for b in it:
                if state.get(b) != 1:
                    kept[n].append(b)
                    if b not in state:
                        state[b] = 1
                        stack.append((b, iter(after[b])))
                        break
            else:
                state[n] = 2
                order.append(n)
                stack.pop()
    layer = dict.fromkeys(nodes, 0)
    for n in reversed(order):
        for b in kept[n]:
            layer[b] = max(layer[b], layer[n] + 1)
    return layer


LAYER_HEIGHT, NODE_WIDTH = 90, 130


def _layered(pdf):
    import pandas as pd

    nodes = sorted(set(pdf["caller_name"]) | set(pdf["callee_name"].dropna()))
    got = layers([(a, b) for a, b in zip(pdf["caller_name"], pdf["callee_name"]) if isinstance(b, str)], nodes)
    return pd.DataFrame({"file_path": str(pdf["file_path"].iloc[0]), "name": nodes, "layer": [got[n] for n in nodes]})


def module_layers(s: Store) -> DataFrame:
    """(file_path, name, layer) of each file's inner graph; a file's functions are one group, bounded by the file."""
    names = s.functions.where("name is not null").select(F.col("name").alias("callee_name"), F.col("file_path").alias("in_file"))
    e = s.flat_calls.select(F.col("caller_file").alias("file_path"), "caller_name", "callee_name").where("file_path is not null").distinct()
    inner = e.join(names, (e.callee_name == names.callee_name) & (e.file_path == names.in_file), "left").select("file_path", "caller_name", names.callee_name.alias("callee_name"))
    return inner.distinct().groupBy("file_path").applyInPandas(_layered, "file_path string, name string, layer int")


def module_layout(s: Store) -> DataFrame:
    """Positions: layers from top to bottom, names in order within a layer."""
    i = F.row_number().over(Window.partitionBy("file_path", "layer").orderBy("name")) - 1
    return module_layers(s).select("file_path", "name", (i * NODE_WIDTH).alias("x"), (F.col("layer") * LAYER_HEIGHT).alias("y"))


QUERIES = {k: v for k, v in _VIEW_QUERIES.items() if k not in _BEFORE} | {
    "ui_layers": lambda spark, d: module_layers(Store(spark, d)), "ui_layout": lambda spark, d: module_layout(Store(spark, d)),
}
SQL = {k: v for k, v in _VIEW_SQL.items() if k in QUERIES}
