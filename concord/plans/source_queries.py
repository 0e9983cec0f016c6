"""Link lists, predictions, caches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators.relations import shared_folder
from concord.sources import catalogues
from concord.streaming import ingest

def url_lists(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit(" ,\n"), "url", F.lit(" http://x/"), F.col("page_id") % 3).alias("urls"))
    return catalogues.split_urls(rows, "urls", ["page_id"])


def top_predictions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("G"), F.col("l_suppkey") % 5, F.lit("---S"), F.col("l_linenumber")).alias("label"), F.col("l_quantity").alias("activation"))
    return catalogues.top_predictions(rows, ["id"]).select("id", "label", "rank", "genre", "style")


def cached_requests(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("response"))
    hits, misses = catalogues.from_cache(o.select("key"), o.where("response <> 'O'"))
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("response", F.lit(None).cast("string")).withColumn("hit", F.lit(False)))


def streamed_ingest(spark, sf_dir):
    """Items that arrive in two micro-batches, the second with all of the first again: each item once, none that is in the archive."""
    base = shared_folder(spark, "ingest")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("video_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("video_id"))
    for part, rows in (("1", events), ("2", events.unionByName(orders))):
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in-{part}")
    archive = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("video_id"))
    for part in ("1", "2"):  # the second run goes on where the first stopped
        stream = spark.readStream.schema("video_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in-[1{part}]")
        ingest.ingest(stream, lambda: archive, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return ingest.read_sink(spark, f"{base}/sink", archive)


def log_tail(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("level"), F.col("props").alias("text"))
    return ingest.log_since(rows, 100)


QUERIES = {f.__name__: f for f in (url_lists, top_predictions, cached_requests, streamed_ingest, log_tail)}
ORACLE = {
    "url_lists": "SELECT page_id, url, 0 AS position FROM pages UNION ALL SELECT page_id, 'http://x/' || (page_id % 3), 2 FROM pages",
    "top_predictions": """WITH m AS (SELECT l_orderkey AS id, 'G' || (l_suppkey % 5) || '---S' || l_linenumber AS label, avg(l_quantity) AS a FROM lineitem GROUP BY ALL)
SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY a DESC, label) AS rank, split_part(label, '---', 1) AS genre, split_part(label, '---', 2) AS style FROM m QUALIFY rank <= 3""",
    "cached_requests": "SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS response, o_orderstatus <> 'O' AS hit FROM orders",
    "streamed_ingest": "SELECT event_id AS video_id FROM events WHERE event_id NOT IN (SELECT c_custkey FROM customer) UNION SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)",
    "log_tail": "SELECT event_id AS seq, event_type AS level, left(props, 500) AS text FROM events WHERE event_id > 100 AND event_id > (SELECT max(event_id) FROM events) - 4000",
}
