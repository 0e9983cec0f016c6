"""The given tables as relations of the record model; one SQL text that Spark and DuckDB both run.

Names are decorated by key arithmetic, so that every text rule has cases. ord, the order of arrival, is numbered
within a track.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from concord.operators.relations import partitions_for, prepare

FAMILY = "CASE p_partkey % 6 WHEN 0 THEN 'electronic' WHEN 1 THEN 'hip-hop' WHEN 2 THEN 'pop' WHEN 3 THEN 'r&b-soul' WHEN 4 THEN 'world' ELSE 'other' END"
SOURCE = "CASE l_suppkey % 7 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'itunes' WHEN 2 THEN 'spotify' WHEN 3 THEN 'discogs' WHEN 4 THEN 'beatport' WHEN 5 THEN 'derived' ELSE 'fileshare' END"

TRACKS = f"""
SELECT p_partkey AS track_id, {FAMILY} AS genre_family,
       p_brand || CASE p_partkey % 8 WHEN 0 THEN 'VEVO' WHEN 1 THEN ' - Topic' WHEN 2 THEN '; Other' WHEN 3 THEN ' & Other, Third' WHEN 4 THEN ' - Official' WHEN 5 THEN ' x Other' WHEN 6 THEN ' and Other' ELSE '' END AS raw_artist,
       CASE p_partkey % 13 WHEN 0 THEN p_name || ' (Official Video)' WHEN 1 THEN p_brand || ' - ' || p_name WHEN 2 THEN p_name || ' (feat. Bar Baz)' WHEN 3 THEN p_name || ' - Foo Remix'
         WHEN 4 THEN p_name || ' [Extended Mix]' WHEN 5 THEN p_name || ' (Remastered 2011)' WHEN 6 THEN replace(p_name, ' ', '_') || '_Official_Video' WHEN 7 THEN p_name || ' ft. Bar & Qux'
         WHEN 8 THEN p_name || ' (Title Track) [From "Film One"]' WHEN 9 THEN p_name || ' (2019 Edit)' WHEN 10 THEN p_name || ' (Taylor''S Version)' WHEN 11 THEN p_name || ' (Tom Santa Remix) (feat. Bar)' ELSE p_name || ' | bonus track' END AS raw_title
FROM {{part}}
"""

FIELD = "CASE l_linenumber % 7 WHEN 1 THEN 'title' WHEN 2 THEN CASE WHEN l_orderkey % 11 = 0 THEN 'featured_artists' ELSE 'artist' END WHEN 3 THEN 'album' WHEN 4 THEN 'genre' WHEN 5 THEN 'label' WHEN 6 THEN 'release_date' ELSE CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'album_artist' ELSE 'artwork_url' END END"
VALUE = """CASE l_linenumber % 7
  WHEN 1 THEN CASE WHEN l_orderkey % 5 = 0 THEN upper(p_name) ELSE p_name END || CASE l_orderkey % 6 WHEN 0 THEN ' (Foo Remix)' WHEN 1 THEN ' (feat. Bar)' WHEN 3 THEN ' - Extended Mix' WHEN 4 THEN ' [Live]' ELSE '' END
  WHEN 2 THEN CASE WHEN l_orderkey % 11 = 0 THEN 'Bar, Guest' ELSE p_brand || CASE l_orderkey % 5 WHEN 0 THEN ' & Other' WHEN 1 THEN ', Third' ELSE '' END END
  WHEN 3 THEN p_name || CASE l_orderkey % 7 WHEN 0 THEN ' (Deluxe Edition)' WHEN 1 THEN ' - Single' WHEN 2 THEN ' 2.0' WHEN 3 THEN ' Ultimate' WHEN 4 THEN ' Vol ' || CAST(l_suppkey % 3 AS STRING) ELSE '' END
  WHEN 4 THEN CASE l_orderkey % 4 WHEN 0 THEN 'Pop' WHEN 1 THEN 'Deep House' WHEN 2 THEN 'Rock' ELSE 'Bollywood' END
  WHEN 5 THEN CASE l_orderkey % 5 WHEN 0 THEN 'Not On Label (X)' WHEN 1 THEN 'Unknown' ELSE 'Label ' || CAST(l_suppkey % 3 AS STRING) END
  WHEN 6 THEN substr(CAST(l_shipdate AS STRING), 1, CASE l_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END)
  ELSE CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'Various Artists' ELSE p_brand END ELSE 'http://img.example/' || CAST(l_suppkey % 9 AS STRING) || '/100x100bb.jpg' END END"""

CANDIDATES = f"""
SELECT l_partkey AS track_id, {FAMILY} AS family, {FIELD} AS field, {VALUE} AS value, {SOURCE} AS source,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS BIGINT) AS ord
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

RESOLVED = """
SELECT p_partkey AS track_id, f.field AS field, CASE f.field WHEN 'title' THEN p_name WHEN 'artist' THEN p_brand ELSE p_type END AS value, 'spotify' AS source,
       CASE p_partkey % 17 WHEN 0 THEN 'manual' WHEN 1 THEN 'url_override' ELSE 'precedence' END AS decided_by
FROM {part} CROSS JOIN (SELECT 'title' AS field UNION ALL SELECT 'artist' UNION ALL SELECT 'comment' UNION ALL SELECT 'isrc' UNION ALL SELECT 'catalog_number') f
"""

OBSERVATIONS = """
SELECT event_id AS id, user_id AS track_id, CASE user_id % 6 WHEN 0 THEN 'electronic' WHEN 1 THEN 'hip-hop' WHEN 2 THEN 'pop' WHEN 3 THEN 'r&b-soul' WHEN 4 THEN 'world' ELSE 'other' END AS family,
       CASE user_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'artist' WHEN 2 THEN 'genre' ELSE 'label' END AS field,
       CASE event_id % 4 WHEN 0 THEN 'spotify' WHEN 1 THEN 'itunes' WHEN 2 THEN 'fileshare,itunes' ELSE '' END AS chosen, 'fileshare,itunes,spotify' AS offered
FROM {events}
"""

LIBRARY = """
SELECT o_orderkey AS track_id, o_custkey AS source_file_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'acquired' WHEN 1 THEN 'normalised' WHEN 2 THEN 'classified' WHEN 3 THEN 'resolved' WHEN 4 THEN 'arbitrated' WHEN 5 THEN 'transcoded' WHEN 6 THEN 'tagged' ELSE 'published' END AS stage,
       CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'review' END END AS status,
       CASE o_custkey % 6 WHEN 0 THEN 'electronic' WHEN 1 THEN 'hip-hop' WHEN 2 THEN 'pop' WHEN 3 THEN 'r&b-soul' WHEN 4 THEN 'world' ELSE 'other' END AS genre_family,
       CAST(NULL AS STRING) AS error, 'old/' || CAST(o_orderkey AS STRING) AS published_path, CAST(0.5 AS DOUBLE) AS identity_confidence
FROM {orders}
"""

FILES = """
SELECT o_orderkey AS file_id, 'v' || CAST(CAST(floor(o_orderkey / 16.0) AS BIGINT) AS STRING) AS video_id, CAST(180 + (o_orderkey * 7 % 32) * 0.75 AS DOUBLE) AS duration_s, 'a' || CAST(o_custkey AS STRING) AS acoustid,
       CASE o_custkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 128 WHEN 2 THEN 255 ELSE 256 + o_custkey % 64 END AS bitrate, 'f' || CAST(o_orderkey % 5 AS STRING) AS itag, o_orderpriority LIKE '1%' AS is_art_track
FROM {orders}
"""

MATCHES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'url_override' WHEN 1 THEN 'isrc' WHEN 2 THEN 'acoustid' WHEN 3 THEN 'text' ELSE 'none' END AS evidence,
       CAST(l_quantity * 2 AS INT) AS search_score, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_discount * 100 - 5 END AS duration_delta_s,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_linenumber - 1 END AS rival_gap, 0.5 + l_quantity / 100 AS acoustid_score,
       l_orderkey % 13 = 0 AS variant_mismatch, l_orderkey % 17 = 0 AS artist_unrelated, l_orderkey % 3 = 0 AS corroborated
FROM {lineitem}
"""

#: A run of the resolver: what was downloaded, what the catalogues answered, what the classifier heard.
DOWNLOADS = """
SELECT p_partkey AS track_id, p_brand AS channel, p_name || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 1 THEN ' (Foo Remix)' ELSE '' END AS raw_title,
       CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 183 END AS DOUBLE) AS duration_s, CASE WHEN p_partkey % 23 = 0 THEN 'GBX' || CAST(p_partkey AS STRING) ELSE '' END AS isrc
FROM {part}
"""
ANSWERS = """
SELECT *, 'r' || CAST(track_id AS STRING) || '-' || CAST(position AS STRING) AS recording_id FROM (
SELECT l_partkey AS track_id, CASE WHEN l_partkey % 23 = 0 AND l_suppkey % 2 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN 2 ELSE 1 END AS tier,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS BIGINT) AS position,
       p_brand AS artist, p_name || CASE l_suppkey % 5 WHEN 0 THEN ' (Live)' ELSE '' END AS title, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 180 + l_orderkey % 9 END AS length,
       CAST(l_quantity * 2 AS INT) AS score, l_linenumber AS n_releases, l_linenumber % 3 = 1 AS has_album, CAST(l_orderkey % 5 AS STRING) AS album
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = l_partkey)) numbered
"""
ENRICHMENT = """
SELECT p_partkey AS track_id, e.field AS field,
       CASE e.field WHEN 'artist' THEN p_brand WHEN 'title' THEN p_name || CASE WHEN e.source = 'spotify' AND p_partkey % 3 = 2 THEN ' Other' ELSE '' END
         WHEN 'genre' THEN CASE p_partkey % 6 WHEN 0 THEN 'Bollywood' WHEN 1 THEN 'Dance' ELSE 'Rock' END ELSE CASE p_partkey % 9 WHEN 0 THEN 'T-Series' ELSE 'Virgin' END END AS value,
       e.source AS source, CAST(e.ord AS BIGINT) AS ord
FROM {part} CROSS JOIN (SELECT 'itunes' AS source, 'title' AS field, 0 AS ord UNION ALL SELECT 'itunes', 'artist', 1 UNION ALL SELECT 'itunes', 'genre', 2 UNION ALL SELECT 'spotify', 'title', 100
  UNION ALL SELECT 'spotify', 'artist', 101 UNION ALL SELECT 'discogs', 'label', 200 UNION ALL SELECT 'discogs', 'genre', 201) e
WHERE NOT (e.source = 'spotify' AND p_partkey % 3 = 1)
"""
PREDICTIONS = """
SELECT p_partkey AS track_id, CASE p_partkey % 4 WHEN 1 THEN 'Electronic' WHEN 2 THEN 'Hip Hop' ELSE 'Jazz' END AS genre, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'Style ' || CAST(p_partkey % 5 AS STRING) END AS style
FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = p_partkey AND c_acctbal < 0)
"""

RECORDINGS = """
SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS BIGINT) AS position,
       'r' || CAST(l_partkey AS STRING) AS recording_id, 'Title ' || CAST(l_partkey % 3 AS STRING) AS title, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 180 + l_partkey % 9 END AS length,
       183 AS target, CAST(l_quantity * 2 AS INT) AS score, l_linenumber AS n_releases, p_brand AS artist,
       CASE l_suppkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' & Other' WHEN 2 THEN 'Various Artists' ELSE '' END AS album_artist,
       CASE l_linenumber % 3 WHEN 0 THEN 'Single' ELSE 'Album' END AS primary_type, CASE l_suppkey % 5 WHEN 0 THEN 'Live' ELSE '' END AS secondary_type,
       CAST(l_quantity AS INT) AS track_count, substr(CAST(l_shipdate AS STRING), 1, CASE l_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS date,
       CASE l_suppkey % 6 WHEN 0 THEN 'unknown' ELSE substr(CAST(l_shipdate AS STRING), 1, 4) END AS year
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Same-named tables in DuckDB.
TABLES = ("part", "lineitem", "orders", "events", "documents", "pages", "customer", "supplier")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    prepare(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if key := re.search(r"PARTITION BY (l_\w+)", sql):  # rows of a key are numbered, and what follows goes by it, too: dealt once, in parts that stay small
        tables["lineitem"] = tables["lineitem"].repartition(partitions_for(*tables.values()), key[1])
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """The same text for DuckDB, where tables go by their names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def with_ctes(body: str, **relations: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({duck(sql)})" for name, sql in relations.items()) + "\n" + body
