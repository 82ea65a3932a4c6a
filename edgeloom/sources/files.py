"""File listings: compiled artefacts and sources per language, and the language of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import base_name

#: Per language the file extensions, the endings left out, and the folders never entered.
LANGUAGES = {
    "typescript": ((".ts", ".tsx"), (".d.ts",), ("node_modules", "dist", "build", ".git")),
    "ocaml": ((".ml",), (), ("_build", "_opam", ".git")),
    "rust": ((".rs",), (), ("target", ".git")),
    "go": ((".go",), (), ("vendor", ".git")),
    "python": ((".py",), (), ("__pycache__", ".venv", "venv", ".git")),
}
#: Manifests in order of priority; the first one present names the project's language.
MANIFESTS = (
    ("typescript", r"(^|/)(tsconfig\.json|package\.json)$"), ("ocaml", r"(^|/)(dune-project|[^/]+\.opam)$"), ("rust", r"(^|/)Cargo\.toml$"),
    ("go", r"(^|/)go\.mod$"), ("python", r"(^|/)(pyproject\.toml|setup\.py)$"), ("c", r"(^|/)(CMakeLists\.txt|compile_commands\.json)$"), ("java", r"(^|/)(pom\.xml|build\.gradle)$"),
)
MAX_DEPTH = 4


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) below a folder; only the listing is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return f.select("path")


def compiled(paths: DataFrame) -> DataFrame:
    """Compiled OCaml units without the build system's own, in order of their paths."""
    b = base_name(F.col("path"))
    return paths.where((b.endswith(".cmt") | b.endswith(".cmti")) & ~b.startswith("dune__"))


def in_language(language: str, path: Column) -> Column:
    ends, not_ends, skipped = LANGUAGES[language]
    hit = F.lit(False)
    for e in ends:
        hit = hit | path.endswith(e)
    for e in not_ends:
        hit = hit & ~path.endswith(e)
    for d in skipped:
        hit = hit & ~F.concat(F.lit("/"), path).contains(f"/{d}/")
    return hit


def source_files(paths: DataFrame) -> DataFrame:
    """(language, path) of the files each language's scan takes."""
    langs = F.array_compact(F.array(*(F.when(in_language(x, F.col("path")), x) for x in LANGUAGES)))
    return paths.select(F.explode(langs).alias("language"), "path")


def detect_languages(paths: DataFrame) -> DataFrame:
    """(root, language, languages): the first by priority and all in fixed order, from manifests at most four folders deep.

    ``paths`` has (root, path) with the path below the root; the first language looks at the root folder only.
    """
    depth = F.size(F.split("path", "/")) - 1
    near = paths.where(depth <= MAX_DEPTH)

    def found(pattern: str, top: bool) -> Column:
        return F.max(F.when(F.col("path").rlike(pattern) & ((depth == 0) | F.lit(not top)), True))

    g = near.groupBy("root").agg(*(found(p, True).alias(f"t{i}") for i, (_, p) in enumerate(MANIFESTS)), *(found(p, False).alias(f"a{i}") for i, (_, p) in enumerate(MANIFESTS)))
    first = F.coalesce(*(F.when(F.col(f"t{i}"), n) for i, (n, _) in enumerate(MANIFESTS[:5])))
    every = F.array_compact(F.array(*(F.when(F.col(f"a{i}"), n) for i, (n, _) in enumerate(MANIFESTS))))
    return g.select("root", first.alias("language"), F.concat_ws(",", every).alias("languages"))
