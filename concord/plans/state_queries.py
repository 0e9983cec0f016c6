"""Stored tables that change, runs over them, files and caches, over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from concord.operators.relations import partitions_for, shared_folder
from concord.operators.runner import run_all
from concord.operators.state import Table
from concord.plans import bindings as B
from concord.sources import catalogues, files

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS total FROM orders), n AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT t.k, CASE WHEN status <> 'F' AND n.k IS NOT NULL THEN 'returned' ELSE status END AS status, total FROM t LEFT JOIN n USING (k))
SELECT k, CASE WHEN total > 300000 THEN 'large' ELSE status END AS status, total FROM u WHERE k NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')""")
def stored_changes(spark, sf_dir):
    """Orders as a stored table: an upsert that leaves finished ones alone, a conditional update, and a delete."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))
    table = Table(spark, shared_folder(spark, "orders"), "k long, status string, total double", "k", 16)
    table.upsert(rows)
    returned = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("long").alias("k")).distinct()
    table.upsert(rows.join(returned, "k").withColumn("status", F.lit("returned")), protect=F.col("status") == "F")
    table.update(F.col("total") > 300000, {"status": F.lit("large")})
    building = read("customer").where("c_mktsegment = 'BUILDING'")
    table.delete(read("orders").join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").cast("long").alias("k")))
    return table.read()


_FAILS = "track_id % 5 = 0"


@query(f"""WITH l AS ({B.duck(B.LIBRARY)}), w AS (SELECT *, stage IN ('acquired', 'normalised') AND status NOT IN ('failed', 'skipped') AS runs FROM l)
SELECT track_id, CASE WHEN NOT runs THEN stage WHEN {_FAILS} THEN stage ELSE 'classified' END AS stage, CASE WHEN runs AND {_FAILS} THEN 'failed' ELSE status END AS status, CASE WHEN runs AND {_FAILS} THEN repeat('e', 500) END AS error FROM w""")
def staged_runs(spark, sf_dir):
    """Two stages over the stored library, stopped after the first and started again; each fails for a fifth of its tracks."""
    rows = B.relation(spark, sf_dir, B.LIBRARY).select("track_id", "stage", "status", F.lit(None).cast("string").alias("error"))
    table = Table(spark, shared_folder(spark, "tracks"), "track_id long, stage string, status string, error string", "track_id", 16)
    table.upsert(rows)
    handler = lambda waiting: waiting.select("track_id", F.when(F.expr(_FAILS), F.repeat(F.lit("e"), 600)).alias("error"))
    for stop in ("acquired", None):
        run_all(table, {"acquired": handler, "normalised": handler}, "run", stop_after=stop)
    return table.read()


@query("SELECT o_orderkey::VARCHAR AS key, 'answer ' || o_orderkey AS response, o_orderstatus <> 'O' AS hit FROM orders")
def cached_twice(spark, sf_dir):
    """Requests against a stored cache: what the first run put is found by the second, whose misses are fetched and put."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    requests = orders.select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_orderstatus") != "O").alias("early"))
    cache = catalogues.cache(spark, shared_folder(spark, "cache"))
    fetch = lambda missing: missing.select("key", F.lit("orders").alias("source"), F.concat(F.lit("answer "), "key").alias("response"))
    catalogues.through_cache(requests.where("early").select("key"), cache, fetch)
    answers, hits = catalogues.through_cache(requests.select("key"), cache, fetch)
    return answers.join(hits, "key").select("key", "response", "hit")


@query("""WITH f AS (SELECT doc_id // 16 AS part, string_agg(translate(coalesce(text, ''), chr(10) || chr(13), '  ') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
SELECT 'part=' || part AS folder, sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS length, CASE WHEN starts_with(content, '{') THEN 'json' ELSE 'text' END AS kind FROM f""")
def local_files(spark, sf_dir):
    """Files below a folder, sixteen documents each: hashed and looked into in one reading."""
    base = shared_folder(spark, "files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 16).alias("part"), "doc_id", "text")
    line = reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit(" ")), "\n\r", F.coalesce("text", F.lit("")))  # after the exchange, as a short file of documents is one task
    name = F.concat(F.lit("part="), F.coalesce(F.col("part").cast("string"), F.lit("null")))
    files.put_lines(docs.repartition(partitions_for(docs), "part").sortWithinPartitions("part", "doc_id").select(name.alias("name"), line.alias("line")), base)
    found = files.local(spark, base, suffixes=(".txt",))
    return found.select(F.regexp_extract("path", r"(part=\d+)/[^/]*$", 1).alias("folder"), "sha256", "length", "kind")
