"""The resolver's ladder and composite, accepting, registering, answering, and streams, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import api, vocab
from concord.functions import text as T
from concord.operators import calibrate, resolve, store
from concord.operators.relations import shared_folder, written
from concord.plans import bindings as B
from concord.plans import record_queries as R
from concord.plans import sql_text as S
from concord.plans.fuse_queries import BUILT_IN, decisions_sql
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


# --- the resolver

_VALUES = (("title", "title"), ("artist", "artist"), ("album", "'Album ' || album"), ("isrc", "CASE album WHEN '0' THEN 'INS' ELSE 'USX' END || album"))

#: Relations of a run by text, in order: asked, match (with confidence), cand (all candidates), fam (family).
_RUN = f"""
d AS ({B.duck(B.DOWNLOADS)}), a AS ({B.duck(B.ANSWERS)}), e AS ({B.duck(B.ENRICHMENT)}), p AS ({B.duck(B.PREDICTIONS)}),
asked AS (SELECT track_id, raw_title AS title, nullif(duration_s, 0) AS target, isrc FROM d),
able AS (SELECT a.*, k.title AS query_title, target, k.isrc AS code FROM a JOIN asked k USING (track_id) WHERE tier > 0 OR k.isrc <> ''),
tiers AS (SELECT track_id, min(tier) AS tier FROM able GROUP BY 1),
nearest AS (SELECT able.*, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN length IS NULL OR target IS NULL THEN 'Infinity'::DOUBLE ELSE abs(length - target) END, score DESC, n_releases DESC, position) AS rank FROM able JOIN tiers USING (track_id, tier)),
first_answer AS (SELECT * FROM nearest WHERE rank = 1),
gaps AS (SELECT k.track_id, arg_min(t.score - k.score, k.rank) AS gap FROM nearest k JOIN first_answer t USING (track_id) WHERE k.rank > 1 AND NOT (k.title = t.title AND coalesce(abs(k.length - t.length) <= 3, false)) GROUP BY 1),
with_album AS (SELECT DISTINCT track_id, recording_id FROM a WHERE has_album),
best_answer AS (SELECT k.track_id, k.recording_id FROM nearest k LEFT JOIN with_album b USING (track_id, recording_id) WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY k.track_id ORDER BY CASE WHEN b.track_id IS NULL THEN 1 ELSE 0 END, rank) = 1),
matched AS (SELECT asked.track_id, CASE WHEN t.track_id IS NULL THEN 'none' WHEN asked.isrc <> '' THEN 'isrc' ELSE 'text' END AS evidence, t.score AS search_score, t.length - asked.target AS delta,
  CASE WHEN t.track_id IS NOT NULL THEN coalesce(g.gap, 99) END AS rival_gap, coalesce(contains(lower(t.title), 'live') AND NOT contains(lower(asked.title), 'live'), false) AS variant, c.recording_id, asked.track_id % 3 = 0 AS agreed
  FROM asked LEFT JOIN first_answer t USING (track_id) LEFT JOIN gaps g USING (track_id) LEFT JOIN best_answer c USING (track_id)),
scored AS (SELECT *, CASE evidence WHEN 'none' THEN 0 WHEN 'isrc' THEN 0.98 ELSE CASE WHEN search_score >= 90 AND coalesce(abs(delta) <= 3, false) AND NOT rival_gap < 2 THEN 0.85 ELSE 0.5 END END AS first FROM matched),
match AS (SELECT *, evidence <> 'none' AND agreed AND CASE WHEN variant THEN least(first, 0.5) ELSE first END < 0.8 AS corroborated,
  CASE WHEN evidence = 'none' THEN 0.0 WHEN variant THEN least(first, 0.5) WHEN agreed AND first < 0.8 THEN greatest(first, 0.9) ELSE first END::DOUBLE AS confidence FROM scored),
own AS (SELECT track_id, 'mix_name' AS field, 'Foo Remix' AS value, 'derived' AS source, 2 * 4294967296 AS ord FROM d WHERE contains(raw_title, 'Remix') UNION ALL SELECT track_id, 'remixer', 'Foo', 'derived', 2 * 4294967296 + 1 FROM d WHERE contains(raw_title, 'Remix')
  UNION ALL SELECT track_id, 'genre', style, 'essentia', 3 * 4294967296 FROM p WHERE style <> '' UNION ALL SELECT track_id, 'classifier_genre', genre, 'essentia', 3 * 4294967296 + 1 FROM p),
cand AS ({" UNION ALL ".join(f"SELECT m.track_id, '{f}' AS field, {v} AS value, 'musicbrainz' AS source, {n} AS ord FROM match m JOIN (SELECT DISTINCT recording_id, title, artist, album FROM a) x USING (recording_id)" for n, (f, v) in enumerate(_VALUES))}
  UNION ALL SELECT track_id, field, value, source, ord + 4294967296 FROM e WHERE track_id IN (SELECT track_id FROM match WHERE evidence <> 'none') UNION ALL SELECT * FROM own),
facts AS (SELECT track_id, arg_max(value, ord) FILTER (field = 'isrc') AS isrc, arg_max(value, ord) FILTER (field = 'label') AS label, arg_min(value, (CASE source WHEN 'itunes' THEN 0 ELSE 1 END, ord)) FILTER (field = 'genre') AS genre FROM cand WHERE source <> 'essentia' GROUP BY 1),
fam AS (SELECT asked.track_id, CASE WHEN coalesce(left(f.isrc, 2) = 'IN', false) OR coalesce(f.genre = 'Bollywood', false) OR coalesce(f.label = 'T-Series', false) THEN 'world' ELSE CASE p.genre WHEN 'Electronic' THEN 'electronic' WHEN 'Hip Hop' THEN 'hip-hop' ELSE 'other' END END AS family
  FROM asked LEFT JOIN facts f USING (track_id) LEFT JOIN p USING (track_id))"""


def _queries(spark, sf_dir):
    downloads = B.relation(spark, sf_dir, B.DOWNLOADS)
    return downloads, resolve.cleaned(downloads).join(downloads.select("track_id", "isrc"), "track_id")


def _answers(spark, sf_dir):
    return _of_answers(B.relation(spark, sf_dir, B.ANSWERS))


def _of_answers(answers):
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(v).alias("value")) for f, v in _VALUES])
    values = answers.select("recording_id", F.posexplode(pairs).alias("ord", "p")).select("recording_id", "p.field", "p.value", F.lit("musicbrainz").alias("source"), F.col("ord").cast("long").alias("ord"))
    return answers, answers.where("has_album").select("track_id", "recording_id"), values.distinct()


def _by_text(spark, sf_dir):
    _, queries = _queries(spark, sf_dir)
    answers, albums, _ = _answers(spark, sf_dir)
    return resolve.evaluate(queries, answers, albums)


@query(f"WITH {_RUN} SELECT track_id, evidence, coalesce(search_score, -1) AS search_score, delta::DOUBLE AS duration_delta_s, coalesce(rival_gap, -1) AS rival_gap, variant AS variant_mismatch, recording_id FROM matched")
def evaluated_queries(spark, sf_dir):
    found = _by_text(spark, sf_dir)
    return found.select("track_id", "evidence", F.coalesce("search_score", F.lit(-1)).alias("search_score"), "duration_delta_s", F.coalesce("rival_gap", F.lit(-1)).alias("rival_gap"), F.coalesce("variant_mismatch", F.lit(False)).alias("variant_mismatch"), "recording_id")


def _run(spark, sf_dir):
    """The whole path over landed tables, which are stored as the sources' answers would be."""
    landed = {k: written(B.relation(spark, sf_dir, v), k) for k, v in (("downloads", B.DOWNLOADS), ("answers", B.ANSWERS), ("predictions", B.PREDICTIONS))}
    queries = written(resolve.cleaned(landed["downloads"]).join(landed["downloads"].select("track_id", "isrc"), "track_id"), "asked")
    answers, albums, values = _of_answers(landed["answers"])
    empty = spark.createDataFrame([], "track_id bigint, reason string")
    return resolve.resolve_and_arbitrate(
        landed["downloads"], resolve.evaluate(queries, answers, albums), None, values, B.relation(spark, sf_dir, B.ENRICHMENT), landed["predictions"],
        vocab.default_ranking(spark), B.relation(spark, sf_dir, B.RESOLVED), empty,
    )


@query(f"""WITH {_RUN} SELECT track_id, title AS norm_title, family AS genre_family, confidence AS identity_confidence, CASE WHEN confidence >= 0.8 THEN 'pending' ELSE 'review' END AS status,
CASE WHEN confidence < 0.8 THEN CASE evidence WHEN 'none' THEN 'no_match' ELSE 'low_confidence' END END AS reason FROM asked JOIN match USING (track_id) JOIN fam USING (track_id)""")
def resolved_tracks(spark, sf_dir):
    """Every download after the whole path, with what it waits for if it isn't sure."""
    out = _run(spark, sf_dir)
    return out.tracks.join(out.queue, "track_id", "left").select("track_id", "norm_title", "genre_family", "identity_confidence", "status", "reason")


@query(f"WITH {_RUN} SELECT track_id, field, value, source, row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1 AS ord FROM cand")
def stored_candidates(spark, sf_dir):
    return _run(spark, sf_dir).candidates.select("track_id", "field", "value", "source", "ord")


_SURE = f"SELECT track_id, family, field, value, source, ord FROM cand JOIN fam USING (track_id) JOIN match USING (track_id) WHERE confidence >= 0.8"


@query(f"""WITH {_RUN}, {decisions_sql(_SURE)},
before AS ({B.duck(B.RESOLVED)}), kept AS (SELECT * FROM before WHERE decided_by IN ('manual', 'url_override')),
fresh AS (SELECT track_id, field, value, source, decided_by FROM decisions x WHERE NOT EXISTS (SELECT 1 FROM kept y WHERE y.track_id = x.track_id AND y.field = x.field))
SELECT * FROM kept UNION ALL SELECT * FROM fresh UNION ALL SELECT * FROM before o WHERE decided_by NOT IN ('manual', 'url_override') AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.track_id = o.track_id AND f.field = o.field)""")
def resolved_fields(spark, sf_dir):
    return _run(spark, sf_dir).resolved


@query()
def fingerprint_resolutions(spark, sf_dir):
    """The ladder with fingerprints first; no SQL gives the ratio that judges the linked recordings."""
    _, queries = _queries(spark, sf_dir)
    answers, _, values = _answers(spark, sf_dir)
    prints = answers.select("track_id", F.concat(F.lit("a"), "position").alias("acoustid"), (F.lit(1.0) - F.col("position") / 100).alias("score"), "position", F.array("recording_id").alias("recording_ids"))
    linked = answers.select("recording_id", F.when(F.col("n_releases") == 1, "Somebody Else").otherwise(F.col("artist")).alias("artist"), F.when(F.col("n_releases") == 1, "Nothing Alike").otherwise(F.col("title")).alias("title"), "length", F.lit(False).alias("has_release")).dropDuplicates(["recording_id"])
    by_print = resolve.evaluate_fingerprints(queries, prints, linked)
    matches, _ = resolve.resolve(queries, _by_text(spark, sf_dir), by_print, values, B.relation(spark, sf_dir, B.ENRICHMENT))
    return matches.select("track_id", "evidence", "acoustid", "recording_id", "duration_delta_s", "confidence")


@query(f"""WITH derived AS ({R.ORACLE["derived_ranking"]}), built AS ({BUILT_IN}),
{decisions_sql(B.duck(B.CANDIDATES), "SELECT family, field, rank, source FROM derived UNION ALL SELECT * FROM built WHERE (family, field) NOT IN (SELECT family, field FROM derived)")} SELECT track_id, field, value, source, decided_by FROM decisions""")
def fuse_calibrated(spark, sf_dir):
    """Decisions under the ranking that recorded choices give."""
    precedence = api.calibrate(B.relation(spark, sf_dir, B.OBSERVATIONS))
    return api.arbitrate(B.relation(spark, sf_dir, B.CANDIDATES), precedence)


# --- accepting, registering, reading

_ACCEPTED = "l.track_id % 3 = 0"


def _library(spark, sf_dir):
    tracks = B.relation(spark, sf_dir, B.LIBRARY)
    fields = B.relation(spark, sf_dir, B.RESOLVED).where("field IN ('title', 'artist')")
    offers = B.relation(spark, sf_dir, B.ENRICHMENT).where("track_id % 2 = 0")
    path = F.when(F.col("track_id") % 2 == 0, F.col("published_path"))
    return tracks.withColumn("published_path", path), fields.where("track_id % 5 <> 0"), offers


_FUSED = decisions_sql(f"SELECT e.track_id, l.genre_family AS family, field, value, source, ord FROM e JOIN l USING (track_id) WHERE {_ACCEPTED}")
_LIB = f"""e AS (SELECT * FROM ({B.duck(B.ENRICHMENT)}) WHERE track_id % 2 = 0), l AS (SELECT * REPLACE (CASE WHEN track_id % 2 = 0 THEN published_path END AS published_path) FROM ({B.duck(B.LIBRARY)})),
before AS (SELECT * FROM ({B.duck(B.RESOLVED)}) WHERE field IN ('title', 'artist') AND track_id % 5 <> 0)"""
_AFTER = f"""{_LIB}, {_FUSED}, kept AS (SELECT * FROM before WHERE decided_by IN ('manual', 'url_override')),
fresh AS (SELECT track_id, field, value, source, decided_by FROM decisions x WHERE NOT EXISTS (SELECT 1 FROM kept y WHERE y.track_id = x.track_id AND y.field = x.field)),
after AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh UNION ALL SELECT * FROM before o WHERE decided_by NOT IN ('manual', 'url_override') AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.track_id = o.track_id AND f.field = o.field))"""


@query(f"""WITH {_AFTER}, n AS (SELECT l.track_id, l.published_path, max(value) FILTER (field = 'artist') AS artist, max(value) FILTER (field = 'title') AS title FROM l LEFT JOIN after USING (track_id) WHERE {_ACCEPTED} GROUP BY ALL),
s AS (SELECT *, {S.safe("artist")} || ' - ' || {S.safe("title")} AS stem, published_path IS NULL AS new, published_path IS NOT NULL AND artist <> '' AND title <> '' AS moves FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY stem, new, moves ORDER BY track_id) + CASE WHEN new AND bool_or(moves) OVER (PARTITION BY stem) THEN 1 ELSE 0 END AS k FROM s),
w AS (SELECT track_id, CASE WHEN NOT new THEN CASE WHEN moves AND k = 1 THEN stem || '.aiff' ELSE published_path END WHEN artist IS NULL AND title IS NULL THEN NULL ELSE stem || CASE k WHEN 1 THEN '' ELSE ' (' || k || ')' END || '.aiff' END AS path FROM m)
SELECT l.track_id, CASE WHEN {_ACCEPTED} THEN CASE WHEN w.path IS NULL THEN 'failed' ELSE 'published' END ELSE status END AS status, CASE WHEN {_ACCEPTED} AND w.path IS NULL THEN 'no artist and no title' END AS error,
CASE WHEN {_ACCEPTED} THEN w.path ELSE l.published_path END AS published_path FROM l LEFT JOIN w USING (track_id)""")
def accepted_tracks(spark, sf_dir):
    """A third of the library accepted: some decided by hand, some without candidates or any field."""
    tracks, fields, offers = _library(spark, sf_dir)
    ids = tracks.where("track_id % 3 = 0")
    return store.accept(tracks, fields, tracks.select("track_id", F.lit("no_match").alias("reason")), offers, vocab.default_ranking(spark), ids)[0].select("track_id", "status", "error", "published_path")


@query(f"WITH {_AFTER} SELECT track_id, field, value, source, decided_by FROM after")
def accepted_fields(spark, sf_dir):
    tracks, fields, offers = _library(spark, sf_dir)
    return store.accept(tracks, fields, tracks.select("track_id", F.lit("no_match").alias("reason")), offers, vocab.default_ranking(spark), tracks.where("track_id % 3 = 0"))[1]


@query(f"""WITH {_AFTER}, f AS ({B.duck(B.FILES)}) SELECT l.track_id, f.duration_s, (SELECT count(*) FROM e WHERE e.track_id = l.track_id) AS n_candidates,
(SELECT string_agg(field || '=' || value, '|' ORDER BY field) FROM before b WHERE b.track_id = l.track_id) AS shown, (SELECT string_agg(field || '=' || value, '|' ORDER BY field) FROM decisions x WHERE x.track_id = l.track_id) AS preview
FROM l JOIN f ON f.file_id = l.source_file_id WHERE {_ACCEPTED}""")
def track_details(spark, sf_dir):
    tracks, fields, offers = _library(spark, sf_dir)
    found = store.track_detail(tracks, B.relation(spark, sf_dir, B.FILES), offers, fields, vocab.default_ranking(spark), tracks.where("track_id % 3 = 0"))
    pairs = lambda c, v: F.nullif(F.array_join(F.transform(c, lambda x: F.concat(x["field"], F.lit("="), x[v])), "|"), F.lit(""))
    return found.select("track_id", "duration_s", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("n_candidates"), pairs("resolved", "display").alias("shown"), pairs("preview", "value").alias("preview"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 3 <> 0)
SELECT CAST(k + (SELECT max(s_suppkey) FROM supplier) AS BIGINT) AS file_id, 'v' || p_partkey AS video_id, CAST(k + (SELECT max(c_custkey) FROM customer) AS BIGINT) AS track_id, 'acquired' AS stage FROM n""")
def registered_files(spark, sf_dir):
    """Probed files, each delivered twice, a third of them known before."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    known = read("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("v"), "p_partkey").alias("video_id"))
    old = read("supplier").select(F.col("s_suppkey").cast("long").alias("file_id"), F.lit(None).cast("string").alias("video_id"))
    old = old.unionByName(known.withColumn("file_id", F.lit(0).cast("long")))
    tracks = read("customer").select(F.col("c_custkey").cast("long").alias("track_id"), F.lit(0).cast("long").alias("source_file_id"), F.lit("published").alias("stage"), F.lit("published").alias("status"))
    probes = read("part").select(F.concat(F.lit("v"), "p_partkey").alias("video_id"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("staging_path"))
    files, after = store.register_files(old, tracks, probes.unionByName(probes))
    return after.where("stage = 'acquired'").join(files.where("staging_path IS NOT NULL").select("file_id", "video_id"), F.col("source_file_id") == F.col("file_id")).select("file_id", "video_id", "track_id", "stage")


@query(f"""WITH e AS ({B.duck(B.ENRICHMENT)}), s AS (SELECT track_id, count(*) AS n FROM e WHERE source = 'itunes' GROUP BY 1)
SELECT track_id, field, value, source, ord FROM e WHERE source = 'itunes' UNION ALL SELECT track_id, field, value, source, coalesce(n, 0) + row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1 FROM e LEFT JOIN s USING (track_id) WHERE source <> 'itunes'""")
def appended_candidates(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.ENRICHMENT)
    return store.append_candidates(rows.where("source = 'itunes'"), rows.where("source <> 'itunes'"))


@query(f"WITH l AS ({B.duck(B.LIBRARY)}) SELECT track_id, NULL::VARCHAR AS artwork_url FROM l")
def migrated_tracks(spark, sf_dir):
    return store.migrated(store.migrated(B.relation(spark, sf_dir, B.LIBRARY), 2), 4).select("track_id", "artwork_url")


# --- catalogues over whole tables


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey"))


def _unless(n, c):
    return F.when(F.col("k") % n != 0, c)


def _fields(**values) -> str:
    return " UNION ALL ".join(f"SELECT id, {S.q(f)} AS field, CAST({v} AS VARCHAR) AS value FROM x" for f, v in values.items())


@query(f"""WITH x AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size FROM part WHERE p_partkey % 13 <> 0), y AS ({_fields(
    title="p_name", artist="CASE WHEN id % 3 <> 0 THEN p_brand END", album="CASE WHEN id % 4 <> 0 THEN p_type ELSE '' END", genre="'Pop'", track_number="nullif(p_size % 5, 0)",
    release_date="CASE WHEN id % 5 <> 0 THEN '2001-02-03' END", year="CASE WHEN id % 5 <> 0 THEN '2001' END", artwork_url="CASE WHEN id % 7 <> 0 THEN 'http://a/' || id || '/1200x1200bb.jpg' END",
)}) SELECT id, field, value FROM y WHERE coalesce(value, '') <> ''""")
def landed_itunes(spark, sf_dir):
    """A search response for every part; some empty, some with missing parts."""
    c = F.col
    result = F.struct(
        c("p_name").alias("trackName"), _unless(3, c("p_brand")).alias("artistName"), F.when(c("k") % 4 != 0, c("p_type")).otherwise("").alias("collectionName"), F.lit("Pop").alias("primaryGenreName"),
        (c("p_size") % 5).alias("trackNumber"), _unless(5, F.lit("2001-02-03T08:00:00Z")).alias("releaseDate"), _unless(7, F.concat(F.lit("http://a/"), c("k"), F.lit("/100x100bb.jpg"))).alias("artworkUrl100"),
    )
    rows = _part(spark, sf_dir).select(c("k").alias("id"), F.when(c("k") % 13 != 0, _json(results=F.array(result))).otherwise('{"results":[]}').alias("payload"))
    return catalogues.enrich({"itunes": rows}, ["id"], {}).select("id", "field", "value")


@query(f"""WITH x AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size FROM part WHERE p_partkey % 13 <> 0), y AS ({_fields(
    title="p_name", artist="CASE WHEN id % 3 <> 0 THEN p_brand END", album="CASE WHEN id % 4 <> 0 THEN p_type END", release_date="CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN '2011-05' END", year="CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN '2011' END",
    disc_number="1", isrc="CASE WHEN id % 6 <> 0 THEN 'US' || id END", artwork_url="CASE WHEN id % 4 <> 0 AND id % 7 <> 0 THEN 'http://i/' || id END",
)}) SELECT id, field, value FROM y WHERE coalesce(value, '') <> ''""")
def landed_spotify(spark, sf_dir):
    c = F.col
    album = F.struct(c("p_type").alias("name"), _unless(5, F.lit("2011-05")).alias("release_date"), F.when(c("k") % 7 != 0, F.array(F.struct(F.concat(F.lit("http://i/"), c("k")).alias("url")))).alias("images"))
    result = F.struct(
        c("p_name").alias("name"), F.when(c("k") % 3 != 0, F.array(F.struct(c("p_brand").alias("name")))).alias("artists"), _unless(4, album).alias("album"), F.lit(1).alias("disc_number"),
        F.struct(_unless(6, F.concat(F.lit("US"), c("k"))).alias("isrc")).alias("external_ids"),
    )
    rows = _part(spark, sf_dir).select(c("k").alias("id"), F.when(c("k") % 13 != 0, _json(results=F.array(result))).otherwise("not json").alias("payload"))
    return catalogues.enrich({"spotify": rows}, ["id"], {"SPOTIFY_CLIENT_ID": "x", "SPOTIFY_CLIENT_SECRET": "y"}).select("id", "field", "value")


@query(f"""WITH x AS (SELECT p_partkey AS id, p_type FROM part), y AS ({_fields(
    genre="CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 <> 0 THEN p_type END WHEN id % 5 = 0 AND id % 2 <> 0 THEN p_type WHEN id % 5 = 0 THEN 'Stage & Screen' ELSE 'Electronic' END", genre_style="CASE WHEN id % 2 <> 0 THEN p_type END", label="CASE WHEN id % 4 <> 0 THEN 'Virgin' END", year="'19' || (id % 90 + 10)",
)}) SELECT id, field, value FROM y WHERE coalesce(value, '') <> ''""")
def landed_discogs(spark, sf_dir):
    c = F.col
    genre = F.when(c("k") % 3 == 0, F.array().cast("array<string>")).when(c("k") % 5 == 0, F.array(F.lit("Stage & Screen"))).otherwise(F.array(F.lit(""), F.lit("Electronic")))
    result = F.struct(F.when(c("k") % 2 != 0, F.array("p_type")).alias("style"), genre.alias("genre"), F.when(c("k") % 4 != 0, F.array(F.lit("Virgin"))).alias("label"), F.concat(F.lit("19"), c("k") % 90 + 10).alias("year"))
    rows = _part(spark, sf_dir).select(c("k").alias("id"), _json(results=F.array(result, F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("style", "array<string>"), ("genre", "array<string>"), ("label", "array<string>"), ("year", "string"))]))).alias("payload"))
    return catalogues.enrich({"discogs": rows}, ["id"], {"DISCOGS_TOKEN": "x"}).select("id", "field", "value")


@query(f"""WITH x AS (SELECT p_partkey AS id, p_name, p_brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN 'X' || p_partkey ELSE 'A' || p_partkey END AS isrc FROM part), y AS ({_fields(
    title="CASE WHEN id % 4 = 0 THEN p_type ELSE p_name END", isrc="isrc", key="CASE WHEN id % 2 = 0 THEN (id % 12 + 1) || 'A' ELSE 'F min' END",
)}) SELECT id, field, value FROM y WHERE coalesce(value, '') <> ''""")
def beatport_by_code(spark, sf_dir):
    """Two results for each part; the second has the asked code for a quarter of them, else the first result counts."""
    c = F.col
    key = F.struct(F.lit("F min").alias("name"), F.when(c("k") % 2 == 0, c("k") % 12 + 1).alias("camelot_number"), F.lit("A").alias("camelot_letter"))
    result = lambda title, prefix: F.struct(title.alias("name"), F.concat(F.lit(prefix), c("k")).alias("isrc"), key.alias("key"))
    rows = _part(spark, sf_dir).select(c("k").alias("id"), F.when(c("k") % 4 == 0, F.concat(F.lit("x"), c("k"))).alias("isrc"), _json(results=F.array(result(c("p_name"), "A"), result(c("p_type"), "X"))).alias("payload"))
    found = catalogues.with_isrc_first(catalogues.results_of(rows, "payload", catalogues.BEATPORT, ["id", "isrc"]), ["id"])
    first = found.groupBy("id").agg(F.min_by("result", "position").alias("result"))
    return catalogues.beatport(first, ["id"]).select("id", "field", "value")


@query("""SELECT p_partkey AS id, 'composer' AS field, CASE p_partkey % 3 WHEN 0 THEN p_brand || ', ' || p_type ELSE p_name END AS value FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 < 2
UNION ALL SELECT p_partkey, 'lyricist', p_type FROM part WHERE p_partkey % 5 <> 0""")
def writer_credits(spark, sf_dir):
    """Works of three kinds: composers and a writer, a writer alone, neither; every fifth recording has no work."""
    c, none = F.col, F.lit(None).cast("string")
    rel = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.struct(name.alias("name")).alias("artist"))
    part = _part(spark, sf_dir)
    composer = lambda name: F.when(c("k") % 3 == 0, name)
    relations = F.array(rel("Composer", composer(c("p_brand"))), rel("writer", F.when(c("k") % 3 < 2, c("p_name"))), rel("composer", composer(c("p_type"))), rel("lyricist", c("p_type")), rel("arranger", c("p_name")))
    works = part.select(F.concat(F.lit("w"), "k").alias("work_id"), _json(relations=relations).alias("payload"))
    link = F.struct(F.lit("performance").alias("type"), F.struct(F.when(c("k") % 5 != 0, F.concat(F.lit("w"), "k")).otherwise(none).alias("id")).alias("work"))
    return catalogues.credits(part.select(c("k").alias("id"), _json(relations=F.array(link)).alias("payload")), works, ["id"]).select("id", "field", "value")


@query("SELECT doc_id AS id, doc_id / 2.0::DOUBLE AS duration_s, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS codec, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (doc_id * 10)::INT END AS bitrate, 44100 AS sample_rate, 0 AS channels, source AS title, 1 AS n_tags FROM documents WHERE doc_id % 7 <> 0")
def landed_probes(spark, sf_dir):
    """A probe for every document; a seventh has no audio stream."""
    c = F.col
    audio = F.struct(F.lit("audio").alias("codec_type"), F.when(c("doc_id") % 3 != 0, c("lang")).alias("codec_name"), F.when(c("doc_id") % 5 == 0, "n/a").otherwise((c("doc_id") * 10).cast("string")).alias("bit_rate"), F.lit("44100").alias("sample_rate"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit("1").alias("bit_rate"), F.lit(None).cast("string").alias("sample_rate"))
    form = F.struct((c("doc_id") / 2).cast("string").alias("duration"), F.create_map(F.lit("TITLE"), c("source"), F.lit("Encoder"), F.lit("x")).alias("tags"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(c("doc_id").alias("id"), _json(streams=F.when(c("doc_id") % 7 == 0, F.array(video)).otherwise(F.array(video, audio)), format=form).alias("payload"))
    return catalogues.probe(rows, "payload", ["id"]).select("id", "duration_s", "codec", "bitrate", "sample_rate", "channels", F.col("tags")["title"].alias("title"), F.size("tags").alias("n_tags"))


@query("""SELECT conv_id, 't' || turn AS video_id, coalesce(role, '') AS title FROM conversations WHERE turn % 3 <> 0""")
def landed_playlists(spark, sf_dir):
    """A conversation's turns as a listing's entries, a third of them without an id."""
    entry = F.struct("turn", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("t"), "turn")).alias("id"), F.col("role").alias("title"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(_json(id=F.lit("p"), entries=F.sort_array(F.collect_list(entry))).alias("payload"))
    return catalogues.playlist(rows, "payload", ["conv_id"]).select("conv_id", "video_id", "title")


# --- single rules, answers and streams


@query("""SELECT p_partkey AS id, f AS field, CASE f WHEN 'title' THEN p_name || ' (ft. Bar)' WHEN 'label' THEN 'It’s' ELSE p_brand || '''s "B"' END AS value FROM part, (VALUES ('title'), ('artist'), ('album'), ('album_artist'), ('label')) v(f)""")
def house_styles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", F.explode(F.array(*map(F.lit, ("title", "artist", "album", "album_artist", "label")))).alias("field"))
    value = F.when(F.col("field") == "title", F.concat("p_name", F.lit(" feat. Bar"))).when(F.col("field") == "label", "It’s").otherwise(F.concat("p_brand", F.lit("’s “B”")))
    return rows.select("id", "field", store.house_style(F.col("field"), value).alias("value"))


@query("SELECT event_id, left(rtrim(event_type || ' failed: ' || repeat('x', (event_id % 400)::INT)), 300) AS error FROM events")
def cleaned_errors(spark, sf_dir):
    raw = F.concat(F.lit("\x1b[0;31mERROR:\x1b[0m  "), "event_type", F.lit("  failed:\n "), F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.clean_error(raw).alias("error"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'fileshare,itunes' WHEN 2 THEN 'spotify' ELSE '' END AS chosen, 'fileshare,itunes,spotify' AS offered FROM events WHERE event_id % 4 <> 3""")
def recorded_answers(spark, sf_dir):
    """Answers by index as rows of the elicitation table; -1 is no difference, 2 is out of range and not recorded."""
    options = F.array(F.array(F.lit("itunes"), F.lit("fileshare")), F.array(F.lit("spotify")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", options.alias("options"), (F.col("event_id") % 4 - 1).cast("int").alias("choice"))
    return calibrate.record(calibrate.answer(rows)).select("event_id", "chosen", "offered")


@query(f"""WITH derived AS ({R.ORACLE["derived_ranking"]}), built AS ({BUILT_IN}) SELECT * FROM derived UNION ALL SELECT family, field, rank, source FROM built WHERE (family, field) NOT IN (SELECT family, field FROM derived)""")
def applied_ranking(spark, sf_dir):
    return api.calibrate(B.relation(spark, sf_dir, B.OBSERVATIONS), vocab.default_ranking(spark))


@query("SELECT p_partkey AS id, p_partkey % 3 > 0 AND (p_partkey % 2 > 0 OR p_partkey % 5 = 0) AS refresh FROM part")
def artwork_refreshes(spark, sf_dir):
    k = F.col("p_partkey")
    wanted = F.when(k % 3 > 0, F.concat(F.lit("u"), k))
    embedded = F.when(k % 5 != 0, F.when(k % 2 == 0, F.concat(F.lit("u"), k)).otherwise("other"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), store.artwork_refresh(wanted, embedded).alias("refresh"))


@query("""SELECT event_type AS stage, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) AS advanced, count(*) FILTER (event_id % 3 = 0) AS failed, count(*) FILTER (event_id % 5 = 0) AS skipped FROM events GROUP BY 1""")
def run_reports(spark, sf_dir):
    k = F.col("event_id")
    return store.run_report(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.when(k % 3 == 0, "x").alias("error"), (k % 5 == 0).alias("skipped")))


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN upper(event_type) END AS done, CASE WHEN event_id % 7 = 0 THEN repeat('e', 500) END AS error FROM events""")
def stepped_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return ingest.try_step(rows, {"done": F.upper("event_type")}, F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("e"), 600))).select("event_id", "done", "error")


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def streamed_counters(spark, sf_dir):
    """Counts of outcomes as a stream keeps them: the last state written."""
    base = shared_folder(spark, "counters")
    counts = ingest.counters(_events(spark, sf_dir).select(F.col("event_type").alias("outcome")))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{base}/state")  # noqa: E731  (complete mode: each batch has all counts)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/state")


@query("SELECT DISTINCT user_id FROM events")
def streamed_once(spark, sf_dir):
    base = shared_folder(spark, "once")
    once = ingest.once_per_key(_events(spark, sf_dir).select("user_id"), "user_id")
    once.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")
