"""Relational helpers: ladders of relations, stable choice of a row, upsert without MERGE, versioned snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the one setting that the library's plans need.

    Spark 4.1 lets a join or an aggregation rely on the partitioning of a union; where adaptive execution then merges the
    partitions of one of its inputs and not of another, the stage fails ("can't zip RDDs"). Without it such a plan has
    an exchange of its own.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def coalesce_relations(keys: Sequence[str], *tiers: DataFrame) -> DataFrame:
    """For each key the rows of the first relation that has any."""
    out = tiers[0].withColumn("_tier", F.lit(0))
    for n, tier in enumerate(tiers[1:], 1):
        out = out.unionByName(tier.withColumn("_tier", F.lit(n)), allowMissingColumns=True)
    return first_tier(out, keys, "_tier").drop("_tier")


def seeded(seed: int, *names: str) -> Column:
    """A hash of columns that another engine can work out, for orders that tell nothing and repeat for a seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(n).cast("string") for n in names)))


def first_tier(rows: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    """For each key the rows of its lowest tier."""
    return rows.withColumn("_lowest", F.min(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("_lowest")).drop("_lowest")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], protect: Column | None = None) -> DataFrame:
    """old with new rows in place of those of the same keys, but for old rows that are protected."""
    kept = old.where(protect) if protect is not None else old.limit(0)
    fresh = new.join(kept.select(*keys), list(keys), "left_anti") if protect is not None else new
    rest = old.where(~protect) if protect is not None else old
    return kept.unionByName(fresh).unionByName(rest.join(fresh.select(*keys).distinct(), list(keys), "left_anti"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


class Snapshot:
    """A table as a sequence of immutable versions below one path; readers see the last one that was finished."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _list(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(hadoop_path(p, "_SUCCESS")))

    def version(self) -> int:
        return max(self._list(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}")

    def write(self, df: DataFrame) -> int:
        """Write the next version; the table being read is never overwritten."""
        v = self.version() + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v={v}")
        return v


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one in spark.checkpoint.dir, which driver and executors share; a local session may go without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read back: later steps share it, whatever plans they have."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files for each partition that rows are dealt over: some 200,000 short rows.
DEAL_BYTES = 4 << 20


def partitions_for(*rows: DataFrame) -> int:
    """Partitions to deal rows over: as many as the session sets, more where the files that they come from are large."""
    session = rows[0].sparkSession
    context = session.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    at = [path(f) for f in sorted({f for r in rows for f in r.inputFiles()})]
    size = sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in at)
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), min(-(-size // DEAL_BYTES), 20_000))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys ahead of costly work: a short file is one task, however much each of its rows asks for."""
    return rows.repartition(partitions_for(rows), *keys)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """rows with their number from 1 among those of the same by (without nulls), in the given order; no key's rows meet in one task.

    A range sort is written with the partition and place of each row, as these hold for one run of the sort alone. How many rows of a
    key stand in earlier partitions is a sum over counts, one for each partition and key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    placed = written(in_order.withColumns({"_at": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = placed.groupBy("_at", *by).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_at", *by, (before - F.col("_first") + 1).alias("_start"))
    return placed.join(starts, ["_at", *by]).withColumn(column, F.col("_start") + F.col("_i")).select(*rows.columns, column)
