"""What the operators of this subpackage share: shared-folder tables, text columns, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of letters and digits: runs of ASCII letters, ASCII digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between such words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/concord/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches in rows and bytes, as texts may be long, for the plans that start inside; the session's settings come back."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in limits}
    try:
        for key, most in limits.items():
            if not (before[key].isdigit() and 0 < int(before[key]) <= most):
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: The tables written so far in the finished() function that is under way.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def finished(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """make, with its result written to the shared folder and the tables that it wrote on the way deleted."""

    @wraps(make)
    def run(*args, **named) -> DataFrame:
        written: list[str] = []
        around = _WRITTEN.set(written)
        try:
            out = make(*args, **named)
            kept = materialize(out, make.__name__)
        finally:
            _WRITTEN.reset(around)
        if (outer := _WRITTEN.get()) is not None:
            outer.append(written[-1])
        for path in written[:-1]:
            delete(out.sparkSession, path)
        return kept

    return run


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    A codec needs memory outside the heap for every file, so tables of a few numbers a row go without.
    """
    path = fresh_path(df.sparkSession, name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    with bounded_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input, as its plan estimates them, for each partition of a sort.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions to sort df over: as many as the session sets, more for an input too large for these."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PARTITION_BYTES), 100_000))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row even where use puts it inside a function of each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of two numbers that are sent to all executors at most: 32 MB.
FEW_KEYS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows whose (doc_id, hash of the text) is in gone (doc_id, text_hash); sent to all executors if few, else a shuffled join."""
    gone = materialize(gone.distinct(), "gone").withColumnsRenamed({"doc_id": "__gone_id", "text_hash": "__gone_hash"})
    if gone.count() <= FEW_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__gone_id")) & (F.xxhash64(whole_text(docs["text"])) == F.col("__gone_hash")), "left_anti")
