"""Session-level helpers: shared checkpoint folder, size-checked broadcasts, key hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.errors import RefusedError

#: A side is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Only a local master may go without one; on a cluster its absence is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master or "").startswith("local"):
        raise RefusedError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named if named else tempfile.mkdtemp(prefix="edgeloom-"))


def on_disk(spark: SparkSession, path: str):
    """(file system, path) of a folder, for what the DataFrame API cannot do: removing it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    fs, where = on_disk(spark, path)
    fs.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove what was written there, before the application ends."""
    fs, where = on_disk(spark, path)
    fs.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from it: no lineage, and no loss with an executor.

    One job writes it, its rows are counted from file footers, and later reads take only the columns they need.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the table that ``cut`` wrote for ``df``; nothing may read it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("cut-"):
            drop_path(df.sparkSession, folder)


#: Rows of one bucket of a bucketed table.
BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 50_000


class Bucketed:
    """A table in the shared folder whose rows lie in buckets by ``keys``, so that a join on exactly these does not move it.

    Spark knows buckets only of tables in its catalog, so the table has a name there until it is closed or dropped.
    ``rows`` is about how many there will be.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], rows: int) -> None:
        self.spark, self.keys, self.schema = df.sparkSession, tuple(keys), df.schema
        wanted = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        self.buckets = min(wanted, MAX_BUCKETS)
        self.path = shared_path(self.spark, "buckets")
        self.name = f"edgeloom_{uuid.uuid4().hex}"
        self._writer(df.repartition(self.buckets, *self.keys)).option("path", self.path).saveAsTable(self.name)

    def _writer(self, df: DataFrame):
        return df.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)

    def append(self, df: DataFrame) -> None:
        """Further rows, which come spread by the keys, as from an aggregation by them."""
        self._writer(df).mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The rows as plain files; the name is gone."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        drop_path(self.spark, self.path)


def global_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of the distinct values of ``order``, without one task seeing all rows.

    Rows are range-partitioned and cut; ranks count within a part, after the sizes of the parts before it.
    """
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(before, "_part").withColumn(name, (within + F.col("_before")).cast("bigint")).drop("_part", "_before")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; beyond ``limit`` the join stays a shuffle join.

    ``df`` is cut first, so counting it does not compute it twice.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def null_safe_hash(*cols: str | Column) -> Column:
    """64-bit hash that tells a null from an absent neighbour: Spark's xxhash64 skips nulls."""
    parts: list[Column] = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
