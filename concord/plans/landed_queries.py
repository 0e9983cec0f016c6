"""Answers of the recording catalogue and of fingerprint lookups, links, and verdicts on names, over whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators.relations import partitions_for, shared_folder
from concord.plans import sql_text as S
from concord.sources import catalogues
from concord.streaming import ingest

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_LINKED = "array<struct<id:string,title:string,artists:array<struct<name:string>>>>"
#: A release for each line of an order, in columns that both engines work out alike.
_RELEASES = """
SELECT l_orderkey AS k, l_linenumber AS line, 'x' || l_orderkey || '-' || l_linenumber AS id, 'g' || l_suppkey AS group_id, 'Release ' || l_suppkey AS title,
  CASE WHEN l_linenumber <> 4 THEN substr(CAST(l_shipdate AS STRING), 1, CASE l_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) END AS date,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Various Artists' ELSE 'Act' || (l_orderkey % 7) END AS credit,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Single' ELSE 'Album' END AS kind, CASE WHEN l_suppkey % 5 = 0 THEN 'Live' END AS second, CAST(l_quantity AS INT) AS tracks,
  l_suppkey % 4 = 0 AS own_cover, l_suppkey % 3 = 0 AS group_cover
FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_suppkey) OVER w AS l_suppkey, first_value(l_shipdate) OVER w AS l_shipdate, first_value(l_quantity) OVER w AS l_quantity
  FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity)) one
"""
_FIELDS = {
    "title": "'Song ' || k || CASE WHEN k % 4 = 0 THEN ' (feat. Guest)' ELSE '' END", "artist": "'Act' || (k % 7)", "featured_artists": "CASE WHEN k % 4 = 0 THEN 'Guest' END", "mb_recording_id": "'m' || k",
    "album": "title", "album_artist": "credit", "track_number": "line::VARCHAR", "disc_number": "'1'",
    "artwork_url": "CASE WHEN own_cover THEN 'http://cover/' || id WHEN group_cover THEN 'http://cover/' || group_id END", "release_date": "day", "year": "left(day, 4)",
}


@query(f"""WITH x AS ({_RELEASES.format(lineitem="lineitem")}), y AS (SELECT *, credit = 'Act' || (k % 7) AS own, kind = 'Album' AND second IS NULL AS album FROM x),
best AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN own AND album THEN 0 WHEN own THEN 1 WHEN album THEN 2 ELSE 3 END, tracks DESC, line) = 1),
days AS (SELECT k, coalesce(date, '1999-05-04') AS day, line FROM x),
first_day AS (SELECT k, day FROM days QUALIFY row_number() OVER (PARTITION BY k ORDER BY rpad(day, 10, '-01-01')::VARCHAR, length(day) DESC, line) = 1)
{" UNION ALL ".join(f"SELECT k AS id, '{f}' AS field, {v} AS value FROM best JOIN first_day USING (k) WHERE {v} IS NOT NULL" for f, v in _FIELDS.items())}""")
def landed_recordings(spark, sf_dir):
    """A full recording for every order, with a release for each of its lines, and covers of some releases and groups."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.repartition(partitions_for(lines), "l_orderkey").createOrReplaceTempView("landed_lineitem")  # dealt once, for lines and orders
    x = spark.sql(_RELEASES.format(lineitem="landed_lineitem"))
    c = F.col
    release = F.struct(
        "line", "id", "title", "date", F.array(F.struct(c("credit").alias("name"))).alias("artist-credit"),
        F.struct(c("group_id").alias("id"), c("kind").alias("primary-type"), F.when(c("second").isNotNull(), F.array("second")).alias("secondary-types"), F.lit("1999-05-04").alias("first-release-date")).alias("release-group"),
        F.array(F.struct(c("tracks").alias("track-count"), F.lit(1).alias("position"), F.array(F.struct(c("line").cast("string").alias("number"))).alias("tracks"))).alias("media"),
    )
    guest = F.when(c("k") % 4 == 0, F.array(F.struct(F.lit("Guest").alias("name"), F.lit("").alias("joinphrase")))).otherwise(F.array().cast("array<struct<name:string,joinphrase:string>>"))
    credit = F.concat(F.array(F.struct(F.concat(F.lit("Act"), c("k") % 7).alias("name"), F.when(c("k") % 4 == 0, " feat. ").otherwise("").alias("joinphrase"))), guest)
    whole = x.groupBy("k").agg(F.array_sort(F.collect_list(release)).alias("releases"))
    payload = F.to_json(F.struct(F.concat(F.lit("m"), "k").alias("id"), F.concat(F.lit("Song "), "k").alias("title"), credit.alias("artist-credit"), "releases"))
    rows = whole.select(c("k").alias("id"), payload.alias("payload")).select("id", F.from_json("payload", catalogues.MUSICBRAINZ).alias("recording"))
    covers = x.where("own_cover").select(c("id").alias("cover_id")).union(x.where("group_cover").select("group_id").distinct())
    return catalogues.musicbrainz(rows, ["id"], covers.withColumn("url", F.concat(F.lit("http://cover/"), "cover_id"))).select("id", "field", "value")


@query("""WITH p AS (SELECT * FROM part WHERE p_partkey % 11 <> 0), m AS (
SELECT p_partkey AS id, 0 AS j, 'a' || p_partkey AS acoustid, (p_partkey % 10) / 10.0 AS score, 'r' || p_partkey || ',s' || p_partkey AS recordings, p_name AS title, p_brand AS artist FROM p
UNION ALL SELECT p_partkey, 1, 'b' || p_partkey, 0.5, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 't' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'T' END, '' FROM p
UNION ALL SELECT p_partkey, 2, 'c' || p_partkey, 0.0, '', '', '' FROM p)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, j) - 1)::INTEGER AS position, acoustid, score::DOUBLE AS score, recordings, title, artist FROM m""")
def landed_fingerprints(spark, sf_dir):
    """A lookup's answer for every part, with repeated and missing recordings; some lookups failed."""
    k = F.col("p_partkey")
    linked = lambda name, title=None, artist=None: F.struct(F.concat(F.lit(name), k).alias("id"), (F.lit(None).cast("string") if title is None else title).alias("title"), F.array(F.struct(artist.alias("name"))) .alias("artists") if artist is not None else F.array().cast("array<struct<name:string>>").alias("artists"))
    match = lambda name, score, recordings: F.struct(F.concat(F.lit(name), k).alias("id"), score.cast("double").alias("score"), recordings.alias("recordings"))
    full = F.array(linked("r", F.col("p_name"), F.col("p_brand")), linked("r"), linked("s"))
    results = F.array(match("a", (k % 10) / 10, full), match("b", F.lit(0.5), F.when(k % 3 != 0, F.array(linked("t", F.lit("T"))))), match("c", F.lit(None), F.array().cast(_LINKED)))
    payload = F.to_json(F.struct(F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), results.alias("results")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), payload.alias("payload"))
    return catalogues.acoustid(rows, "payload", ["id"]).select("id", F.col("position").cast("int").alias("position"), "acoustid", "score", F.array_join("recording_ids", ",").alias("recordings"), "title", "artist")


_URL = """CASE c_custkey % 9 WHEN 0 THEN 'https://open.spotify.com/intl-de/track/' || lpad(CAST(c_custkey AS STRING), 22, 'a') || '?si=1' WHEN 1 THEN ' https://open.spotify.com/album/' || lpad(CAST(c_custkey AS STRING), 22, 'B')
 WHEN 2 THEN 'spotify:track:' || lpad(CAST(c_custkey AS STRING), 22, '0') WHEN 3 THEN 'https://musicbrainz.org/recording/01234567-89ab-cdef-0123-' || lpad(CAST(c_custkey AS STRING), 12, '0')
 WHEN 4 THEN 'https://musicbrainz.org/release/01234567-89ab-cdef-0123-' || lpad(CAST(c_custkey AS STRING), 12, 'f') WHEN 5 THEN 'https://www.discogs.com/release/' || c_custkey || '-Name'
 WHEN 6 THEN 'https://www.discogs.com/master/' || c_custkey WHEN 7 THEN 'https://www.beatport.com/track/some-name/' || c_custkey ELSE c_name END"""


@query(f"""WITH u AS (SELECT c_custkey AS id, c_custkey % 9 AS r, {_URL.replace("CAST(c_custkey AS STRING)", "c_custkey::VARCHAR")} AS url FROM customer)
SELECT id, CASE WHEN r < 3 THEN 'spotify' WHEN r < 5 THEN 'musicbrainz' WHEN r < 7 THEN 'discogs' WHEN r = 7 THEN 'beatport' END AS provider,
CASE r WHEN 0 THEN 'track' WHEN 1 THEN 'album' WHEN 2 THEN 'track' WHEN 3 THEN 'recording' WHEN 4 THEN 'release' WHEN 5 THEN 'release' WHEN 6 THEN 'master' WHEN 7 THEN 'track' END AS kind,
CASE r WHEN 0 THEN lpad(id::VARCHAR, 22, 'a') WHEN 1 THEN lpad(id::VARCHAR, 22, 'B') WHEN 2 THEN lpad(id::VARCHAR, 22, '0') WHEN 3 THEN '01234567-89ab-cdef-0123-' || lpad(id::VARCHAR, 12, '0') WHEN 4 THEN '01234567-89ab-cdef-0123-' || lpad(id::VARCHAR, 12, 'f')
  WHEN 8 THEN NULL ELSE id::VARCHAR END AS identifier FROM u""")
def parsed_links(spark, sf_dir):
    """A link for every customer; those that name no catalogue give nulls."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("id"), T.parse_link(F.expr(_URL)).alias("r")).select("id", "r.provider", "r.kind", "r.identifier")


_WORDS = S.squeeze(S.sub("lower(p_name)", r"[^\p{L}\p{N}_\s]", " "))


@query(f"""WITH x AS (SELECT p_partkey AS id, p_partkey % 4 AS r, length({_WORDS})::DOUBLE AS n, 1 + p_partkey % 60 AS extra FROM part),
y AS (SELECT id, CASE r WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 2 * n / (2 * n + 1 + extra) END AS alike, CASE r WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 ELSE 1.0 END AS credit FROM x)
SELECT id, 0.7 * alike + 0.3 * credit >= {vocab.PLAUSIBLE} AS plausible, credit = 0 AS artist_unrelated FROM y""")
def judged_names(spark, sf_dir):
    """Results for every part's name: itself, nothing alike, itself with more behind it, and that by another act.

    What stands behind is of digits that names lack, so its share of matching characters is known.
    """
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("r"), F.lit("The Act").alias("query_artist"), F.col("p_name").alias("query_title"))
    more = F.concat("query_title", F.lit(" "), F.repeat(F.lit("7"), (1 + F.col("id") % 60).cast("int")))
    rows = rows.withColumn("title", F.when(F.col("r") == 0, F.col("query_title")).when(F.col("r") == 1, F.repeat(F.lit("7"), 9)).otherwise(more)).withColumn("artist", F.when(F.col("r") % 2 == 1, "7777").otherwise("The Act"))
    rows = similarity.plausible(rows, "query_artist", "query_title", "artist", "title")
    return similarity.artist_is_unrelated(rows, "query_artist", "artist").select("id", "plausible", "artist_unrelated")


@query("""SELECT event_type AS log, event_id AS seq, 'info' AS level, left(rtrim(props), 500) AS text FROM events WHERE trim(props) <> ''
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200""")
def log_rings(spark, sf_dir):
    """The last lines of each kind of event, as a stream keeps them."""
    base = shared_folder(spark, "rings")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select(F.col("event_type").alias("log"), F.col("event_id").alias("seq"), F.lit("info").alias("level"), F.col("props").alias("text"))
    write = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{base}/out")
    ingest.ring(stream, "log", 200).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.join(out.groupBy("log").agg(F.max("n").alias("n")), ["log", "n"]).select("log", "seq", "level", "text")
