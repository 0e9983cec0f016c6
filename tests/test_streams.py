"""Streams: state across runs, progress while they run, the ring of log lines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from concord.streaming import ingest


def feed(spark, folder, batches, schema):
    """Each batch in a folder of its own; the stream takes one file at a time in order of its change."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n:03}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_each_key_once_and_no_batch_reads_another(spark, tmp_path):
    base = f"file://{tmp_path}"
    seen = spark.createDataFrame([("a7",), ("b3",)], "video_id string")
    batches = [[(f"a{i}",) for i in range(10)], [(f"a{i}",) for i in range(5, 15)], [(f"b{i}",) for i in range(5)] + [("a1",)]]
    stream = feed(spark, f"{base}/in", batches[:2], "video_id string")
    ingest.ingest(stream, lambda: seen, f"{base}/sink", f"{base}/cp").awaitTermination()
    stream = feed(spark, f"{base}/in/later", batches[2:], "video_id string")
    stream = spark.readStream.schema("video_id string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    query = ingest.ingest(stream, lambda: seen, f"{base}/sink", f"{base}/cp")
    query.awaitTermination()
    got = ingest.read_sink(spark, f"{base}/sink", seen)
    assert sorted(r.video_id for r in got.collect()) == sorted(({f"a{i}" for i in range(15)} | {f"b{i}" for i in range(5)}) - {"a7", "b3"})
    assert query.lastProgress.stateOperators[0].numRowsTotal == 20 and query.lastProgress.numInputRows <= 10


def test_listener_counts_what_the_table_holds(spark, tmp_path):
    base = f"file://{tmp_path}"
    stream = feed(spark, f"{base}/in", [[(i + 10 * b,) for i in range(4 + b)] for b in range(3)], "id long")
    stepped = ingest.try_step(stream, {"done": F.col("id") * 2}, F.when(F.col("id") % 3 == 0, F.lit("no")))
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    try:
        query = ingest.watched(stepped, "steps").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        out = spark.read.parquet(f"{base}/out")
        want = {"rows": out.count(), "failed": out.where("error IS NOT NULL").count(), "batches": 3}
        for _ in range(100):
            if progress.counts("steps") == want:
                break
            time.sleep(0.1)
        assert progress.counts("steps") == want == {"rows": 15, "failed": 5, "batches": 3}
    finally:
        spark.streams.removeListener(progress)


@pytest.mark.parametrize("cuts", [(), (13,), (1, 2, 40, 41)])
def test_ring_holds_the_last_lines_however_the_stream_is_cut(spark, tmp_path, cuts):
    rng = random.Random(1)
    lines = [(rng.choice("xy"), i, "info", rng.choice(["", " ", "line " * 200, f"l{i}  "])) for i in range(60)]
    lines += rng.sample(lines, 10)
    at = [0, *cuts, len(lines)]
    base = f"file://{tmp_path}"
    stream = feed(spark, f"{base}/in", [lines[a:b] for a, b in zip(at, at[1:])], "log string, seq long, level string, text string")
    write = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{base}/out")
    ingest.ring(stream, "log", capacity=7).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    held = out.join(out.groupBy("log").agg(F.max("n").alias("n")), ["log", "n"]).select("log", "seq", "level", "text")
    want = []
    for log in "xy":
        kept = sorted({(log, i, level, text.rstrip()[:500]) for k, i, level, text in lines if k == log and text.strip()})
        want += kept[-7:]
    assert sorted(map(tuple, held.collect())) == want
    assert ingest.tail(held, 50).count() == sum(i > 50 for _, i, _, _ in want)
