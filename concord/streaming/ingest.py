"""Incremental ingest as Structured Streaming: each item once, failures kept apart, progress as rows.

State lives in the sink tables and the checkpoint, so a stopped run goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.functions import text as T

LOG_CAPACITY = 4000


def once_per_key(stream: DataFrame, key: str, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """The stream without later rows of a key; with an event time, state older than the watermark is dropped."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, seen: Callable[[], DataFrame], sink: str, checkpoint: str, key: str = "video_id", name: str | None = None) -> StreamingQuery:
    """Append rows whose key is not in seen() and hasn't come before; runs over what there is and stops.

    Keys that have come are the query's state, by key in the checkpoint, so a micro-batch looks up its own keys and reads nothing of
    what earlier ones wrote (set the RocksDB state store for many keys). A batch that is delivered again replaces its own folder,
    so each row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.join(seen().select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = once_per_key(stream, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def read_sink(spark: SparkSession, sink: str, like: DataFrame) -> DataFrame:
    """Rows of all batches in the sink."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    folders = [f"{sink}/{n}" for n in names if n.startswith("batch=")]
    return spark.read.schema(like.schema).parquet(*folders) if folders else spark.createDataFrame([], like.schema)


def try_step(rows: DataFrame, step: dict[str, Column], error: Column) -> DataFrame:
    """rows with the step's columns and error; a row whose error is set has none of them."""
    failed = error.isNotNull()
    return rows.withColumns({k: F.when(~failed, c) for k, c in step.items()}).withColumn("error", F.substring(error, 1, 500))


def log_since(log: DataFrame, cursor: int) -> DataFrame:
    """Lines (seq, level, text) after a cursor, of the last LOG_CAPACITY, texts cut to 500 characters."""
    last = log.agg(F.max("seq").alias("last"))  # one row
    kept = log.crossJoin(F.broadcast(last)).where((F.col("seq") > cursor) & (F.col("seq") > F.col("last") - LOG_CAPACITY))
    return kept.select("seq", "level", F.substring(T.text("text"), 1, 500).alias("text"))


def counters(stream: DataFrame) -> DataFrame:
    """Running counts of outcomes."""
    return stream.groupBy("outcome").agg(F.count("*").alias("n"))


#: Lines that a ring holds: text cut to so many characters.
LINE = 500


def ring(stream: DataFrame, key: str, capacity: int = LOG_CAPACITY) -> DataFrame:
    """(key, seq, level, text) of the lines that each log still holds after a micro-batch, where it took new ones.

    stream: key, seq, level, text. A log keeps its lines of the highest seq, a number each once: a line that comes again changes
    nothing, however the stream is cut into batches, and what is blank is no line. State is the ring of each key.
    """
    kind = stream.schema[key].dataType.simpleString()

    def take(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {seq: (level, text) for seq, level, text in zip(*state.get, strict=True)} if state.exists else {}
        for rows in batches:
            for seq, level, text in zip(rows["seq"], rows["level"], rows["text"], strict=True):
                if isinstance(text, str) and text.strip():
                    held.setdefault(int(seq), (level, text.rstrip()[:LINE]))
            if len(held) > 2 * capacity:
                held = dict(sorted(held.items())[-capacity:])
        lines = sorted(held.items())[-capacity:]
        seqs, levels, texts = [s for s, _ in lines], [x[0] for _, x in lines], [x[1] for _, x in lines]
        state.update((seqs, levels, texts))
        yield pd.DataFrame({key: [of[0]] * len(lines), "seq": seqs, "level": levels, "text": texts})

    return stream.select(key, "seq", "level", "text").groupBy(key).applyInPandasWithState(
        take, f"{key} {kind}, seq long, level string, text string", "seqs array<long>, levels array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )


def tail(held: DataFrame, cursor: int) -> DataFrame:
    """Lines after a cursor of what ring() gave last for each log."""
    return held.where(F.col("seq") > cursor)


def watched(stream: DataFrame, name: str, error: str = "error") -> DataFrame:
    """The stream with counts of its rows and of those with an error, taken in passing under a name."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count(F.col(error)).alias("failed"))


class Progress(StreamingQueryListener):
    """Running counts of watched() streams by name, while they run; add with spark.streams.addListener. A batch counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, str, int], tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  (Spark's names)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for name, row in p.observedMetrics.items():
            self.batches[name, str(p.id), p.batchId] = (row["rows"], row["failed"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def counts(self, name: str) -> dict[str, int]:
        of = [v for (n, _, _), v in list(self.batches.items()) if n == name]
        return {"rows": sum(r for r, _ in of), "failed": sum(f for _, f in of), "batches": len(of)}
