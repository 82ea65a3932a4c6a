"""Comparisons over source text and call graphs: duplicate bodies, moved functions, edge populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.text import body_digest, lambda_root, lines, strip
from edgeloom.schemas import TOP


def body_verdicts(bodies: DataFrame, key: str) -> DataFrame:
    """(key, verdict, copies, versions): ``Identical``, ``Differs``, or ``Not_found`` where no body is there."""
    d = bodies.select(F.col(key).alias("key"), body_digest(F.col("body")).alias("digest"))
    each = d.groupBy("key", "digest").agg(F.count("digest").alias("n"))
    g = each.groupBy("key").agg(F.sum("n").alias("copies"), F.count("digest").alias("versions"))
    verdict = F.when(F.col("versions") == 0, "Not_found").when(F.col("versions") == 1, "Identical").otherwise("Differs")
    return g.select(F.col("key").alias(key), verdict.alias("verdict"), "copies", "versions")


#: What begins a new definition at the start of a line, and what may follow a function's name.
_NEXT = ("let ", "and ", "type ", "module ", "open ", "include ", "exception ", "(* ==", "(* --", "(**")
_AFTER_NAME = ("", " ", "(", "=", ":")


def extract_bodies(sources: DataFrame) -> DataFrame:
    """(id, body): from ``let [rec] fn`` at a line's start to the next definition, trimmed lines without blanks.

    ``sources`` has (id, source, fn); the body is null if the function is not there.
    """
    def begins(line: Column) -> Column:
        hit = F.lit(False)
        for prefix in ("let rec ", "let "):
            head = F.concat(F.lit(prefix), F.col("fn"))
            hit = hit | (line.startswith(head) & F.substr(line, F.char_length(head) + 1, F.lit(1)).isin(*_AFTER_NAME))
        return hit

    def defines(line: Column) -> Column:
        hit = F.lit(False)
        for prefix in _NEXT:
            hit = hit | line.startswith(prefix)
        return hit

    at = F.array_position(F.transform("ls", begins), True)
    s = sources.select("id", "fn", lines(F.col("source")).alias("ls")).withColumn("at", F.coalesce(at.cast("int"), F.lit(0)))
    s = s.withColumn("rest", F.when(F.col("at") > 0, F.slice("ls", F.col("at") + 1, F.size("ls"))))
    n = F.array_position(F.transform("rest", defines), True).cast("int")
    taken = F.concat(F.array(F.element_at("ls", F.col("at"))), F.slice("rest", F.lit(1), F.when(n > 0, n - 1).otherwise(F.size("rest"))))
    kept = F.array_join(F.filter(F.transform(taken, strip), lambda x: x != ""), "\n")
    return s.select("id", F.when(F.col("at") > 0, kept).alias("body"))


#: Lines of one diff that one task walks; what a longer diff carries over is one row per such stretch.
STRETCH = 65_536


def _carried(rows: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with each null of the columns replaced by the last value before it, in order, within the key."""
    stretch = rows.withColumn("stretch", F.expr(f"{order} div {STRETCH}"))
    last = stretch.groupBy(key, "stretch").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(key, "stretch", *(F.last(c, True).over(before).alias(f"from_{c}") for c in columns))
    within = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = stretch.select(*(F.last(c, True).over(within).alias(c) if c in columns else F.col(c) for c in stretch.columns))
    both = own.join(starts, [key, "stretch"])
    return both.select(*(F.coalesce(c, f"from_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def diff_moves(diff: DataFrame) -> DataFrame:
    """(diff_id, fn_name, from_file, to_file): functions removed from one file and added to another, one move per name.

    ``diff`` has (diff_id, line_no, line) of unified diffs; a diff is walked in order of its lines, by stretches. Of several
    moves of one name the least by files is given; the two least files of each side are enough to tell it, so files are
    not paired.
    """
    def header(mark: str, side: str) -> Column:
        path = F.substring("line", 5, 2_000_000_000)
        return F.when(F.col("line").startswith(mark), F.regexp_replace(path, f"^{side}/", ""))

    rows = diff.select("diff_id", "line_no", "line", header("--- ", "a").alias("a"), header("+++ ", "b").alias("b"))
    seen = _carried(rows, "diff_id", "line_no", ("a", "b"))
    name = F.regexp_extract("line", r"^[-+]let (?:rec )?([^ (=:\r]*)", 1)

    def side(mark: str, file: str) -> DataFrame:
        at = F.coalesce(file, F.lit(""))
        named = seen.where(F.col("line").startswith(f"{mark}let ") & (at != "/dev/null")).select("diff_id", name.alias("fn_name"), at.alias("file"))
        place = F.row_number().over(Window.partitionBy("diff_id", "fn_name").orderBy("file"))
        two = named.where(~F.col("fn_name").isin("", "_")).distinct().withColumn("place", place).where("place <= 2")
        return two.groupBy("diff_id", "fn_name").agg(*(F.max(F.when(F.col("place") == i, F.col("file"))).alias(f"{file}{i}") for i in (1, 2)))

    both = side("-", "a").join(side("+", "b"), ["diff_id", "fn_name"])
    same, only = F.col("a1") == F.col("b1"), F.col("b2").isNull()
    return both.select(
        "diff_id", "fn_name", F.when(same & only, F.col("a2")).otherwise(F.col("a1")).alias("from_file"), F.when(same & ~only, F.col("b2")).otherwise(F.col("b1")).alias("to_file")
    ).where("from_file is not null")


def _population(calls: DataFrame) -> DataFrame:
    return calls.select(lambda_root(F.col("caller_name")).alias("caller"), lambda_root(F.col("callee_name")).alias("callee"), "call_site").distinct()


def callgraph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, caller, callee, call_site): edges dropped, added or replaced in a sanctioned way between two graphs.

    Lambda chains count as their root. A dropped edge to the unknown is replaced if its root caller now has an edge to a
    lambda; a dropped bare local name is replaced if the same caller and site now have one.
    """
    a, b = _population(old), _population(new)
    key = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("caller", "callee", "call_site")]
    gone = a.alias("x").join(b.alias("y"), key, "left_anti")
    come = b.alias("x").join(a.alias("y"), key, "left_anti")
    lam = new.where(F.col("callee_name").contains("<fun:")).select(lambda_root(F.col("caller_name")).alias("caller"), "call_site")
    by_caller = lam.select("caller").distinct().withColumn("any_lambda", F.lit(True))
    by_site = lam.where("call_site is not null").distinct().withColumn("here_lambda", F.lit(True))
    g = gone.join(by_caller, "caller", "left").join(by_site, ["caller", "call_site"], "left")
    local = (F.col("callee") != TOP) & ~F.col("callee").contains(".")
    replaced = ((F.col("callee") == TOP) & F.col("any_lambda")) | (local & F.col("here_lambda"))
    g = g.select(F.when(replaced, "replaced").otherwise("dropped").alias("status"), "caller", "callee", "call_site")
    return g.unionByName(come.select(F.lit("added").alias("status"), "caller", "callee", "call_site"))


def kind_movements(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_kind, new_kind, edges): distinct shared edges whose kind moved."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("caller_name", "callee_name", "call_site", F.col("kind").alias(name)).where("call_site is not null").distinct()

    both = side(old, "old_kind").join(side(new, "new_kind"), ["caller_name", "callee_name", "call_site"]).where("old_kind <> new_kind")
    return both.groupBy("old_kind", "new_kind").agg(F.count(F.lit(1)).alias("edges"))
