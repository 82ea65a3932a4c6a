"""Queries p6 to p8. Tokenization, bin packing and code-point composition have no SQL; tests hold them to brute force.

What a packing must keep, whatever it does, has: ``p7_conserved``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import table
from edgeloom.llm import lookalike, packing, tokenize


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs, sizes = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    by_tokenizer: dict[str, dict[int, int]] = {}
    for r in sizes.where(F.col("capacity_tokens").isNotNull()).collect():  # a fixed table of container sizes
        by_tokenizer.setdefault(r.tokenizer, {})[r.size_id] = r.capacity_tokens
    parts = [packing.pack(tokenize.count_tokens(docs, tokenizer=t), caps, "doc_id", "n_tokens") for t, caps in sorted(by_tokenizer.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("size_id", F.col("item").alias("doc_id"), "piece", F.col("container").alias("container_id"), "tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = table(spark, d, "pack_sizes").select("size_id", F.col("capacity_tokens").alias("capacity"))
    return packing.fill(p7_containers(spark, d).withColumnRenamed("container_id", "container"), caps)


def p7_conserved(spark: SparkSession, d: str) -> DataFrame:
    """Per container size: the documents placed, those of them with a token too many or too few, and the containers over their capacity."""
    docs, sizes = table(spark, d, "documents"), table(spark, d, "pack_sizes").where(F.col("capacity_tokens").isNotNull())
    placed = p7_containers(spark, d)
    caps = F.broadcast(sizes.select("size_id", "tokenizer", "capacity_tokens"))  # a fixed table
    own = placed.groupBy("size_id", "doc_id").agg(F.sum("tokens").alias("placed")).join(caps, "size_id")
    counted = None
    for r in sizes.select("tokenizer").distinct().collect():
        one = tokenize.count_tokens(docs, tokenizer=r.tokenizer).select("doc_id", F.lit(r.tokenizer).alias("tokenizer"), "n_tokens")
        counted = one if counted is None else counted.unionByName(one)
    wanted = counted.join(caps, "tokenizer").select("size_id", "doc_id", "n_tokens")
    per_doc = wanted.join(own.select("size_id", "doc_id", "placed"), ["size_id", "doc_id"], "full_outer").groupBy("size_id").agg(
        F.count("placed").alias("documents"), F.count_if(~F.col("n_tokens").eqNullSafe(F.col("placed"))).alias("changed")
    )
    load = placed.groupBy("size_id", "container_id").agg(F.sum("tokens").alias("load")).join(caps, "size_id")
    return per_doc.join(load.groupBy("size_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("over")), "size_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.agreeing_pairs(table(spark, d, "documents"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.agreeing_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_containers, p7_fill, p7_conserved, p8_found, p8_canonical, p8_classes)}
SQL = {"p7_conserved": "SELECT size_id, (SELECT count(*) FROM documents) AS documents, 0 AS changed, 0 AS over FROM pack_sizes WHERE capacity_tokens IS NOT NULL"}
