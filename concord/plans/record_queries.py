"""Identity, calibration, state, reports and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators import calibrate, identity, report, store
from concord.operators.relations import coalesce_relations, spread, upsert, written
from concord.plans import bindings as B
from concord.plans import sql_text as S
from concord.plans.fuse_queries import _values as _rank_values
from concord.sources import catalogues

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_M, _R, _L, _F, _C, _RES, _O, _T = (B.duck(x) for x in (B.MATCHES, B.RECORDINGS, B.LIBRARY, B.FILES, B.CANDIDATES, B.RESOLVED, B.OBSERVATIONS, B.TRACKS))

# --- identity


@query(f"""WITH m AS ({_M}), b AS (SELECT *, coalesce(abs(duration_delta_s) <= 3, false) AS close, variant_mismatch OR artist_unrelated AS veto FROM m),
s AS (SELECT *, CASE evidence WHEN 'url_override' THEN 1.0 WHEN 'isrc' THEN 0.98 WHEN 'acoustid' THEN CASE WHEN acoustid_score >= 0.9 AND close THEN 0.95 ELSE 0.5 END
  ELSE CASE WHEN search_score >= 90 AND close AND NOT coalesce(rival_gap < 2, false) THEN 0.85 ELSE 0.5 END END AS base FROM b),
c AS (SELECT *, CASE WHEN evidence = 'none' THEN 0.0 WHEN veto THEN least(base, 0.5) WHEN corroborated THEN greatest(base, 0.9) ELSE base END AS confidence FROM s)
SELECT evidence, CAST(confidence AS DOUBLE) AS confidence, confidence >= 0.8 AS auto, CASE WHEN confidence < 0.8 THEN CASE WHEN evidence = 'none' THEN 'no_match' ELSE 'low_confidence' END END AS reason, count(*) AS n FROM c GROUP BY ALL""")
def confidence_scores(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.MATCHES)
    scored = rows.withColumn("confidence", identity.confidence({c: F.col(c) for c in rows.columns}))
    scored = scored.withColumn("auto", identity.auto_accepts(F.col("confidence"))).withColumn("reason", identity.review_reason(F.col("confidence"), F.col("evidence")))
    return scored.groupBy("evidence", "confidence", "auto", "reason").agg(F.count("*").alias("n"))


_RANKED = f"""r AS ({_R}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN length IS NULL THEN 'Infinity'::DOUBLE ELSE abs(length - target) END, score DESC, n_releases DESC, position) AS rank FROM r)"""


@query(f"WITH {_RANKED} SELECT query_id, recording_id, position, rank FROM k")
def ranked_recordings(spark, sf_dir):
    return identity.rank_recordings(B.relation(spark, sf_dir, B.RECORDINGS), ["query_id"]).select("query_id", "recording_id", "position", "rank")


@query(f"""WITH {_RANKED}, t AS (SELECT query_id, title, length, score FROM k WHERE rank = 1),
d AS (SELECT k.query_id, t.score - k.score AS gap, rank FROM k JOIN t USING (query_id) WHERE rank > 1 AND NOT (k.title = t.title AND coalesce(abs(k.length - t.length) <= 3, false)))
SELECT t.query_id, coalesce(g.gap, 99) AS rival_gap FROM t LEFT JOIN (SELECT query_id, arg_min(gap, rank) AS gap FROM d GROUP BY 1) g USING (query_id)""")
def rival_gaps(spark, sf_dir):
    return identity.rival_gap(identity.rank_recordings(B.relation(spark, sf_dir, B.RECORDINGS), ["query_id"]), ["query_id"])


def _releases(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.RECORDINGS).withColumn("secondary_types", F.when(F.col("secondary_type") == "", F.array().cast("array<string>")).otherwise(F.array("secondary_type")))
    return rows.withColumn("artist", F.first("artist").over(Window.partitionBy("query_id").orderBy("position")))


@query(f"""WITH r AS ({_R}), a AS (SELECT *, first_value(artist) OVER (PARTITION BY query_id ORDER BY position) AS act FROM r),
b AS (SELECT *, primary_type = 'Album' AND secondary_type NOT IN ('Compilation', 'Live', 'Remix', 'DJ-mix', 'Mixtape/Street') AS album, album_artist <> '' AND (starts_with(lower(album_artist), lower(act)) OR starts_with(lower(act), lower(album_artist))) AS own FROM a)
SELECT query_id, recording_id, position, track_count FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN own AND album THEN 0 WHEN own THEN 1 WHEN album THEN 2 ELSE 3 END, track_count DESC, position) = 1""")
def selected_releases(spark, sf_dir):
    return identity.select_release(_releases(spark, sf_dir), ["query_id"]).select("query_id", "recording_id", "position", "track_count")


@query(f"""WITH r AS ({_R}), d AS (SELECT query_id, position, date, CASE length(date) WHEN 4 THEN date || '-01-01' WHEN 7 THEN date || '-01' ELSE date END AS day FROM r)
SELECT query_id, date FROM d WHERE day <= '1997-12-31' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY day, length(date) DESC, position) = 1""")
def earliest_dates(spark, sf_dir):
    return identity.earliest_date(B.relation(spark, sf_dir, B.RECORDINGS), ["query_id"], "1997-12-31")


@query(f"""WITH r AS ({_R}) SELECT query_id, recording_id, year FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(try_cast(year AS BIGINT), 99999), position) = 1""")
def earliest_pressings(spark, sf_dir):
    return identity.earliest_pressing(B.relation(spark, sf_dir, B.RECORDINGS), ["query_id"]).select("query_id", "recording_id", "year")


@query(f"""WITH {_RANKED}, h AS (SELECT DISTINCT query_id, recording_id FROM k WHERE primary_type = 'Album')
SELECT k.query_id, k.recording_id, k.rank FROM k LEFT JOIN h USING (query_id, recording_id) WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY CASE WHEN h.query_id IS NULL THEN 1 ELSE 0 END, rank) = 1""")
def best_recordings(spark, sf_dir):
    ranked = identity.rank_recordings(B.relation(spark, sf_dir, B.RECORDINGS), ["query_id"])
    albums = ranked.where("primary_type = 'Album'").select("query_id", "recording_id").distinct()
    return identity.best_recording(ranked.select("query_id", "recording_id", "rank"), albums, ["query_id"]).select("query_id", "recording_id", "rank")


@query(f"""WITH r AS ({_R}), a AS (SELECT query_id, recording_id, position FROM r WHERE score >= 90), b AS (SELECT query_id, recording_id, position FROM r WHERE score BETWEEN 50 AND 89),
c AS (SELECT query_id, recording_id, position FROM r WHERE score < 50)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a) UNION ALL SELECT * FROM c WHERE query_id NOT IN (SELECT query_id FROM a UNION ALL SELECT query_id FROM b)""")
def searched_recordings(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.RECORDINGS).select("query_id", "recording_id", "position", "score")
    return identity.search_recordings(rows.where("score >= 90"), rows.where("score between 50 and 89"), rows.where("score < 50"), ["query_id"]).drop("score")


@query()
def match_scores(spark, sf_dir):
    """Scores of every candidate title for its track, the best result as rank 1; no SQL gives the ratio."""
    tracks = spread(B.relation(spark, sf_dir, B.TRACKS), "track_id").withColumn("n", T.normalise(F.col("raw_artist"), F.col("raw_title"))).select("track_id", F.col("n.artist").alias("query_artist"), F.col("n.title").alias("query_title"))
    c = B.relation(spark, sf_dir, B.CANDIDATES).where("field = 'title'").select("track_id", F.col("value").alias("title"), F.lit("").alias("artist"), "source", "ord")
    scored = similarity.match_score(c.join(tracks, "track_id"), "query_artist", "query_title", "artist", "title")
    return identity.rank_results(scored.select("track_id", "source", "ord", "title", F.round("match_score", 9).alias("match_score")), ["track_id"], "match_score", "ord")


@query()
def corroborated_tracks(spark, sf_dir):
    tracks = B.relation(spark, sf_dir, B.TRACKS).select("track_id", F.split("raw_artist", "VEVO| - |;| &| x| and")[0].alias("query_artist"), F.col("raw_title").alias("query_title"))
    return identity.corroborated(B.relation(spark, sf_dir, B.CANDIDATES), tracks)


@query(f"""WITH t AS ({_T}) SELECT track_id, CASE WHEN raw_artist LIKE '% - Topic' OR track_id % 19 = 0 THEN 'art_track' WHEN regexp_matches(translate(raw_title, '_', ' '), '(?i)\\bofficial\\s*(music\\s*)?video\\b') OR track_id % 9 > 5 THEN 'video_rip' ELSE 'unknown' END AS verdict FROM t""")
def source_verdicts(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.TRACKS)
    signals = {
        "channel": F.col("raw_artist"), "title": F.translate("raw_title", "_", " "), "description": F.when(F.col("track_id") % 19 == 0, "Provided to YouTube by X").otherwise(""),
        "artist_tag": F.lit(""), "duration_s": F.lit(180.0) + F.col("track_id") % 9, "catalog_duration_s": F.lit(180.0),
    }
    return rows.select("track_id", identity.classify_source(signals)["verdict"].alias("verdict"))


@query(f"""WITH f AS ({_F}), near AS (
SELECT f.file_id, g.file_id AS other, g.bitrate, g.is_art_track FROM f JOIN f g ON f.video_id = g.video_id AND abs(f.duration_s - g.duration_s) <= 2
UNION SELECT f.file_id, g.file_id, g.bitrate, g.is_art_track FROM f JOIN f g ON f.acoustid = g.acoustid AND abs(f.duration_s - g.duration_s) <= 2),
best AS (SELECT file_id, arg_max(other, (bitrate, is_art_track, -other)) AS best FROM near GROUP BY 1), stays AS (SELECT file_id FROM best WHERE best = file_id)
SELECT n.file_id AS track_id, arg_max(other, (bitrate, is_art_track, -other)) AS duplicate_of FROM near n JOIN stays s ON n.other = s.file_id WHERE n.file_id NOT IN (SELECT file_id FROM stays) GROUP BY 1""")
def duplicate_files(spark, sf_dir):
    return identity.duplicates(B.relation(spark, sf_dir, B.FILES).withColumnRenamed("file_id", "track_id"), ["video_id", "acoustid"])


# --- calibration

_OBS = f"o AS ({_O}), ch AS (SELECT *, list_filter(string_split(chosen, ','), lambda x: x <> '') AS cl, string_split(offered, ',') AS ol FROM o)"
_TALLY = f"{_OBS}, t AS (SELECT family, field, source, sum(seen) AS seen, sum(wins) AS wins FROM (SELECT family, field, unnest(ol) AS source, 1 AS seen, 0 AS wins FROM ch UNION ALL SELECT family, field, unnest(cl), 0, 1 FROM ch) GROUP BY ALL)"


def _obs(spark, sf_dir):
    return calibrate.observations(B.relation(spark, sf_dir, B.OBSERVATIONS))


@query(f"WITH {_TALLY} SELECT family, field, source, seen::BIGINT AS seen, wins::BIGINT AS wins FROM t")
def choice_tally(spark, sf_dir):
    return calibrate.tally(_obs(spark, sf_dir)).drop("first")


@query(f"""WITH {_TALLY}, rk(family, field, rank, source) AS (VALUES {_rank_values(vocab.ranking_rows())}), e AS (SELECT family, field FROM t GROUP BY ALL HAVING max(seen) >= 5),
n AS (SELECT family, field, count(*) AS n FROM rk GROUP BY ALL),
u AS (SELECT e.family, e.field, coalesce(r.source, t.source) AS source, r.rank AS dr, coalesce(t.seen, 0) AS seen, coalesce(t.wins, 0) AS wins FROM (SELECT rk.* FROM rk JOIN e USING (family, field)) r FULL JOIN t ON t.family = r.family AND t.field = r.field AND t.source = r.source JOIN e ON e.family = coalesce(r.family, t.family) AND e.field = coalesce(r.field, t.field)),
s AS (SELECT u.*, round((wins + 3.0 * CASE WHEN dr IS NULL THEN 0 ELSE 1 - dr / (n.n + 1.0)::DOUBLE END) / (seen + 3.0), 12) AS score FROM u JOIN n USING (family, field))
SELECT family, field, (row_number() OVER (PARTITION BY family, field ORDER BY score DESC, dr NULLS LAST, source) - 1)::INT AS rank, source FROM s""")
def derived_ranking(spark, sf_dir):
    return calibrate.derive(_obs(spark, sf_dir), vocab.default_ranking(spark))


@query(f"WITH {_OBS} SELECT family, field, count(*) AS n FROM ch GROUP BY ALL")
def cell_counts(spark, sf_dir):
    return calibrate.cell_counts(_obs(spark, sf_dir))


_PAIRS = f"c AS ({_C}), p AS (SELECT track_id, family, field FROM c WHERE field IN ('title', 'artist', 'album', 'genre', 'label', 'artwork_url') GROUP BY ALL HAVING count(DISTINCT source) >= 2)"


@query(f"WITH {_OBS}, {_PAIRS} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.track_id = p.track_id AND o.field = p.field)")
def disputed_fields(spark, sf_dir):
    return calibrate.disputed(B.relation(spark, sf_dir, B.CANDIDATES), _obs(spark, sf_dir))


@query(f"""WITH {_OBS}, {_PAIRS}, d AS (SELECT family, field, count(*) AS pairs FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.track_id = p.track_id AND o.field = p.field) GROUP BY ALL),
n AS (SELECT family, field, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT coalesce(n.n, 0) AS n, coalesce(d.pairs, 0) AS pairs FROM n FULL JOIN d USING (family, field))
SELECT sum(n)::BIGINT AS answered, count(*) FILTER (n >= 8) AS cells_done, count(*) FILTER (n > 0) AS cells_started, sum(least(greatest(8 - n, 0), pairs))::BIGINT AS remaining FROM x""")
def calibration_progress(spark, sf_dir):
    return calibrate.progress(B.relation(spark, sf_dir, B.CANDIDATES), _obs(spark, sf_dir))


_OPTIONS = f"""c AS ({_C}), l AS (SELECT track_id, source, field, arg_max(value, ord) AS value FROM c WHERE field IN ('title', 'artist', 'genre', 'label', 'artwork_url') GROUP BY ALL),
f AS (SELECT track_id, source, min(ord) AS first FROM c GROUP BY ALL), g AS (SELECT track_id, field, {S.squeeze('lower(value)')} AS k, arg_min(value, first) AS value, list_sort(list(DISTINCT source)) AS s FROM l JOIN f USING (track_id, source) GROUP BY ALL)"""


@query(f"""WITH {_OPTIONS}
SELECT track_id, field, value, array_to_string(s, ',') AS sources FROM g QUALIFY count(*) OVER (PARTITION BY track_id, field) >= 2""")
def question_options(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.CANDIDATES)
    return calibrate.build_options(rows).where("field <> 'album'").select("track_id", "field", "value", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {_OPTIONS}, n AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY track_id, field) >= 2)
SELECT track_id, field, value, row_number() OVER (PARTITION BY track_id, field ORDER BY md5('7|' || track_id || '|' || field || '|' || k), k) - 1 AS position FROM n""")
def shuffled_options(spark, sf_dir):
    options = calibrate.build_options(B.relation(spark, sf_dir, B.CANDIDATES)).where("field <> 'album'")
    return calibrate.shuffled(options, seed=7).select("track_id", "field", "value", F.col("position").cast("long").alias("position"))


@query()
def next_question(spark, sf_dir):
    return calibrate.next_question(B.relation(spark, sf_dir, B.CANDIDATES), _obs(spark, sf_dir), seed=7)


# --- state and sinks


@query(f"""WITH l AS ({_L}) SELECT track_id, CASE WHEN track_id % 5 = 0 THEN stage ELSE CASE stage WHEN 'acquired' THEN 'normalised' WHEN 'normalised' THEN 'classified' WHEN 'classified' THEN 'resolved' WHEN 'resolved' THEN 'arbitrated' WHEN 'arbitrated' THEN 'transcoded' WHEN 'transcoded' THEN 'tagged' ELSE 'published' END END AS stage,
CASE WHEN track_id % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN track_id % 5 = 0 THEN repeat('e', 500) END AS error FROM l""")
def advanced_tracks(spark, sf_dir):
    tracks = B.relation(spark, sf_dir, B.LIBRARY)
    outcomes = tracks.select("track_id", F.when(F.col("track_id") % 5 == 0, F.repeat(F.lit("e"), 600)).alias("error"))
    return store.advance(tracks, outcomes).select("track_id", "stage", "status", "error")


@query(f"WITH l AS ({_L}) SELECT track_id FROM l WHERE stage = 'resolved' AND status NOT IN ('failed', 'skipped')")
def pending_tracks(spark, sf_dir):
    return store.pending(B.relation(spark, sf_dir, B.LIBRARY), "resolved").select("track_id")


@query(f"WITH f AS ({_F}) SELECT DISTINCT 'v' || event_id AS video_id FROM events WHERE NOT EXISTS (SELECT 1 FROM f WHERE video_id = 'v' || event_id)")
def unseen_videos(spark, sf_dir):
    refs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("video_id")).distinct()
    return store.unseen(refs, B.relation(spark, sf_dir, B.FILES))


@query(f"""WITH l AS ({_L}), q AS (SELECT track_id, 'video_rip' AS reason FROM l WHERE track_id % 7 = 0), n AS (SELECT track_id, 'low_confidence' AS reason FROM l WHERE track_id % 3 = 0)
SELECT * FROM q WHERE track_id % 2 = 1 UNION ALL SELECT * FROM n WHERE track_id % 2 = 1 AND track_id NOT IN (SELECT track_id FROM q)""")
def review_queue(spark, sf_dir):
    ids = B.relation(spark, sf_dir, B.LIBRARY).select("track_id")
    queue = store.enqueue(ids.where("track_id % 7 = 0").withColumn("reason", F.lit("video_rip")), ids.where("track_id % 3 = 0").withColumn("reason", F.lit("low_confidence")))
    return store.dequeue(queue, ids.where("track_id % 2 = 0"))


@query(f"""WITH r AS ({_RES}) SELECT track_id, field, CASE WHEN field = 'title' AND track_id % 3 = 0 THEN 'Edited' ELSE value END AS value, CASE WHEN field = 'title' AND track_id % 3 = 0 THEN 'manual' ELSE source END AS source,
CASE WHEN field = 'title' AND track_id % 3 = 0 THEN 'manual' ELSE decided_by END AS decided_by FROM r""")
def manual_edits(spark, sf_dir):
    resolved = B.relation(spark, sf_dir, B.RESOLVED)
    return store.edit(resolved, resolved.where("field = 'title' and track_id % 3 = 0").select("track_id", "field", F.lit("Edited").alias("value")))


@query(f"""WITH r AS ({_RES}), c AS ({_C}), w AS (SELECT track_id, field, value FROM c WHERE field = 'title' AND source = 'itunes' QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ord) = 1)
SELECT r.track_id, r.field, coalesce(w.value, r.value) AS value, CASE WHEN w.value IS NULL THEN r.source ELSE 'itunes' END AS source, CASE WHEN w.value IS NULL THEN r.decided_by ELSE 'manual' END AS decided_by FROM r LEFT JOIN w USING (track_id, field)""")
def adopted_values(spark, sf_dir):
    resolved = B.relation(spark, sf_dir, B.RESOLVED)
    wishes = resolved.where("field = 'title'").select("track_id", "field", F.lit("itunes").alias("source"))
    return store.adopt(resolved, wishes, B.relation(spark, sf_dir, B.CANDIDATES))


@query(f"""WITH r AS ({_RES}), t AS (SELECT p_partkey AS track_id FROM part WHERE p_partkey % 10 = 0)
SELECT r.track_id, field, CASE WHEN field = 'title' AND t.track_id IS NOT NULL THEN 'Linked' ELSE value END AS value, CASE WHEN field = 'title' AND t.track_id IS NOT NULL THEN 'url_override' ELSE decided_by END AS decided_by FROM r LEFT JOIN t USING (track_id)
UNION ALL SELECT track_id, 'override_url', 'spotify:track:' || lpad(track_id::VARCHAR, 22, '0'), 'url_override' FROM t""")
def link_overrides(spark, sf_dir):
    resolved, tracks = B.relation(spark, sf_dir, B.RESOLVED), B.relation(spark, sf_dir, B.LIBRARY)
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("track_id"), F.lpad(F.col("p_partkey").cast("string"), 22, "0").alias("id"))
    links = ids.select("track_id", F.concat(F.lit("spotify:track:"), "id").alias("url"))
    entities = ids.select(F.lit("spotify").alias("provider"), F.col("id").alias("identifier"), F.lit("title").alias("field"), F.lit("Linked").alias("value"))
    queue = tracks.select("track_id", F.lit("no_match").alias("reason"))
    return store.override(resolved, tracks, queue, links, entities)[0].drop("source")


@query(f"WITH l AS ({_L}) SELECT track_id, CASE WHEN track_id % 4 = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN track_id % 4 <> 0 THEN published_path END AS published_path FROM l")
def rejected_tracks(spark, sf_dir):
    tracks = B.relation(spark, sf_dir, B.LIBRARY)
    return store.reject(tracks, tracks.select("track_id"), tracks.where("track_id % 4 = 0"))[0].select("track_id", "status", "published_path")


_PATHS = f"t AS ({_T}), {S.house_title('t', 'raw_title', 'track_id, raw_artist')}, f AS (SELECT track_id, {S.safe('raw_artist')} || ' - ' || {S.safe('house')} AS stem FROM t4)"


@query(f"WITH {_PATHS}, k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY track_id) AS n FROM f) SELECT track_id, stem || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END || '.aiff' AS path FROM k")
def publish_paths(spark, sf_dir):
    tracks = B.relation(spark, sf_dir, B.TRACKS).select("track_id", F.col("raw_artist").alias("artist"), F.col("raw_title").alias("title"))
    return store.publish_paths(tracks).select("track_id", "path")


def _named(spark, sf_dir):
    """Tracks with the name of their file, worked out once."""
    tracks = B.relation(spark, sf_dir, B.TRACKS).select("track_id", F.col("raw_artist").alias("artist"), F.col("raw_title").alias("title"))
    return written(spread(tracks, "track_id").withColumn("own", T.filename(F.col("artist"), F.col("title"))), "tracks")


_STEMS = f"{_PATHS}, g AS (SELECT track_id, stem, stem || '.aiff' AS own FROM f)"


@query(f"""WITH {_STEMS}, there AS (SELECT CASE track_id % 4 WHEN 0 THEN own WHEN 1 THEN stem || ' (3).aiff' ELSE stem || ' (02).aiff' END AS path FROM g WHERE track_id % 4 < 3),
n AS (SELECT track_id, stem, row_number() OVER (PARTITION BY stem ORDER BY track_id) AS k FROM (SELECT track_id, stem FROM g UNION ALL SELECT track_id + 1000000000, stem FROM g)),
free AS (SELECT stem, i, row_number() OVER (PARTITION BY stem ORDER BY i) AS k FROM (SELECT DISTINCT stem, i FROM g, range(1, 100) r(i)) s
  WHERE stem || CASE WHEN i = 1 THEN '' ELSE ' (' || i || ')' END || '.aiff' NOT IN (SELECT path FROM there))
SELECT track_id, stem || CASE WHEN i = 1 THEN '' ELSE ' (' || i || ')' END || '.aiff' AS path FROM n JOIN free USING (stem, k)""")
def published_beside(spark, sf_dir):
    """Every name twice, beside files that have the bare name, the third number, or a number in another form."""
    tracks, own = _named(spark, sf_dir), F.col("own")
    with_number = lambda n: F.concat(F.regexp_replace(own, r"\.aiff$", ""), F.lit(f" ({n}).aiff"))
    there = tracks.where("track_id % 4 < 3").select(F.when(F.col("track_id") % 4 == 0, own).when(F.col("track_id") % 4 == 1, with_number(3)).otherwise(with_number("02")).alias("path"))
    again = tracks.withColumn("track_id", F.col("track_id") + 1_000_000_000)
    return store.publish_paths(tracks.unionByName(again).drop("own"), there).select("track_id", "path")


#: By the rest of track_id and 7: its own name; two that hold each other's; three that free each other's in turn; a name that the one before it wants, too; no artist.
_HELD = "CASE track_id % 7 WHEN 0 THEN own WHEN 1 THEN coalesce(later, 'old') WHEN 2 THEN coalesce(earlier, 'old') WHEN 3 THEN coalesce(later, 'old') WHEN 4 THEN coalesce(later, 'old') ELSE 'old/' || track_id END"


@query(f"""WITH RECURSIVE {_STEMS}, h AS (SELECT g.track_id, g.own, x.own AS later, y.own AS earlier FROM g LEFT JOIN g x ON x.track_id = g.track_id + 1 LEFT JOIN g y ON y.track_id = g.track_id - 1),
o AS (SELECT track_id, {_HELD} AS held, CASE WHEN track_id % 14 = 6 THEN NULL WHEN track_id % 7 = 6 THEN coalesce(earlier, own) ELSE own END AS wanted FROM h),
holders AS (SELECT held AS path, min(track_id) AS holder, count(*) AS n FROM o GROUP BY 1),
claims AS (SELECT track_id, held, wanted, holder FROM o LEFT JOIN holders ON path = wanted WHERE wanted <> held AND (holder IS NULL OR n = 1 AND track_id > holder) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY track_id) = 1),
moved AS (SELECT track_id, held, wanted FROM claims WHERE holder IS NULL UNION ALL SELECT c.track_id, c.held, c.wanted FROM claims c JOIN moved m ON m.track_id = c.holder)
SELECT track_id, held AS old_path, wanted AS new_path FROM moved""")
def rename_plan(spark, sf_dir):
    tracks = _named(spark, sf_dir)
    near = lambda step, *named: tracks.select((F.col("track_id") + step).alias("track_id"), *named)
    named = tracks.join(near(-1, F.col("own").alias("later")), "track_id", "left").join(near(1, F.col("own").alias("earlier"), F.col("artist").alias("_artist"), F.col("title").alias("_title")), "track_id", "left")
    named = named.withColumn("published_path", F.expr(_HELD))
    same = (F.col("track_id") % 7 == 6) & F.col("earlier").isNotNull()
    named = named.withColumns({"artist": F.when(F.col("track_id") % 14 != 6, F.when(same, F.col("_artist")).otherwise(F.col("artist"))), "title": F.when(same, F.col("_title")).otherwise(F.col("title"))})
    return store.rename_plan(named.select("track_id", "published_path", "artist", "title"))


@query(f"""WITH r AS ({_RES}) SELECT track_id, max(value) FILTER (field = 'artist') AS artist, max(value) FILTER (field = 'title') AS title, max(value) FILTER (field = 'isrc') AS isrc, max(value) FILTER (field = 'comment') AS comment, 'catalog_number' AS skipped FROM r GROUP BY 1""")
def tag_sets(spark, sf_dir):
    tags = store.build_tags(B.relation(spark, sf_dir, B.RESOLVED))
    return tags.select("track_id", F.col("tags")["TPE1"].alias("artist"), F.col("tags")["TIT2"].alias("title"), F.col("tags")["TSRC"].alias("isrc"), "comment", F.array_join("skipped", ",").alias("skipped"))


@query("SELECT p_partkey AS id, 'TIT2=' || p_name || ',XXXX=' || p_brand AS frames FROM part")
def written_frames(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    frames = store.write_frames(F.create_map(F.lit("TIT2"), F.lit("old"), F.lit("XXXX"), F.col("p_brand")), F.create_map(F.lit("TIT2"), F.col("p_name"), F.lit("YYYY"), F.lit("no")))
    pairs = F.array_sort(F.transform(F.map_entries(frames), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select(F.col("p_partkey").alias("id"), F.array_join(pairs, ",").alias("frames"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 'an') OR contains(lower(coalesce(p_brand, '')), 'an') OR contains(lower(coalesce(p_type, '')), 'an')")
def library_search(spark, sf_dir):
    return store.search(spark.read.parquet(f"{sf_dir}/part.parquet"), "AN", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query(f"WITH c AS ({_C}), f AS (SELECT track_id, field, arg_min(value, ord) AS value FROM c GROUP BY ALL) SELECT track_id, string_agg(field || '=' || value, '|' ORDER BY field) AS fields FROM f GROUP BY 1")
def first_values(spark, sf_dir):
    entries = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return store.candidate_map(B.relation(spark, sf_dir, B.CANDIDATES)).select("track_id", F.array_join(entries, "|").alias("fields"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1")
def upserted(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return upsert(o.where("k % 2 = 0"), o.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("SELECT o_orderkey AS k, 'a' AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 2 = 1")
def ladder(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return coalesce_relations(["k"], o.where("k % 2 = 0").withColumn("v", F.lit("a")), o.withColumn("v", F.lit("b")))


# --- reports


@query(f"WITH l AS ({_L}) SELECT stage, status, count(*) AS n FROM l GROUP BY ALL")
def status_report(spark, sf_dir):
    return report.status(B.relation(spark, sf_dir, B.LIBRARY))


@query(f"WITH l AS ({_L}), r AS ({_RES}), f AS ({_F}) SELECT (SELECT count(*) FROM l WHERE status = 'published') AS published, (SELECT count(*) FROM r WHERE decided_by IN ('manual', 'url_override')) AS protected, (SELECT count(*) FROM f) AS files")
def destroy_counts(spark, sf_dir):
    return report.destroy_counts(B.relation(spark, sf_dir, B.LIBRARY), B.relation(spark, sf_dir, B.RESOLVED), B.relation(spark, sf_dir, B.FILES))


@query(f"WITH c AS ({_C}), t AS ({_T}) SELECT field, count(DISTINCT track_id) AS tracks, round(count(DISTINCT track_id) / (SELECT count(*) FROM t), 6) AS share FROM c GROUP BY 1")
def field_coverage(spark, sf_dir):
    return report.coverage(B.relation(spark, sf_dir, B.CANDIDATES), B.relation(spark, sf_dir, B.TRACKS))


@query(f"WITH c AS ({_C}) SELECT source, count(*) AS n FROM (SELECT track_id, field, arg_min(source, ord) AS source FROM c GROUP BY ALL) GROUP BY 1")
def first_contributions(spark, sf_dir):
    return report.first_contributions(B.relation(spark, sf_dir, B.CANDIDATES))


@query(f"""WITH m AS ({_M}), b AS (SELECT l_partkey % 3 AS genre_family, CASE WHEN l_orderkey % 23 = 0 THEN 'unusable' WHEN evidence = 'none' THEN 'no_match' WHEN l_discount_ok >= 0.8 THEN 'auto' ELSE 'review' END AS b FROM (SELECT *, acoustid_score AS l_discount_ok FROM m))
SELECT genre_family, count(*) FILTER (b = 'auto') AS auto, count(*) FILTER (b = 'review') AS review, count(*) FILTER (b = 'no_match') AS no_match, count(*) FILTER (b = 'unusable') AS unusable FROM b GROUP BY 1""")
def accuracy_buckets(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.MATCHES)
    return report.accuracy(rows.select((F.col("l_partkey") % 3).alias("genre_family"), "evidence", F.col("acoustid_score").alias("confidence"), (F.col("l_orderkey") % 23 != 0).alias("usable")))


@query(f"WITH t AS ({_T}), n AS (SELECT genre_family, count(*) AS n FROM t GROUP BY 1) SELECT arg_max(genre_family, (n, genre_family)) AS dominant, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.6 AS passes FROM n")
def routing_share(spark, sf_dir):
    return report.routing_share(B.relation(spark, sf_dir, B.TRACKS))


@query(f"WITH r AS ({_RES}) SELECT CASE field WHEN 'title' THEN 'TIT2' WHEN 'artist' THEN 'TPE1' ELSE 'TSRC' END AS frame, count(*) AS n FROM r WHERE field IN ('title', 'artist', 'isrc') GROUP BY 1")
def frame_coverage(spark, sf_dir):
    return report.frame_coverage(store.build_tags(B.relation(spark, sf_dir, B.RESOLVED)))


@query(f"WITH f AS ({_F}) SELECT min(bitrate) FILTER (bitrate <> 0) AS least, count(*) FILTER (bitrate <> 0 AND bitrate < 256 * 0.99) AS below, count(DISTINCT itag) AS formats, count(*) AS files FROM f")
def acquisition_audit(spark, sf_dir):
    return report.acquisition_audit(B.relation(spark, sf_dir, B.FILES))


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def run_counters(spark, sf_dir):
    return report.run_counters(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("outcome")))


@query(f"""WITH t AS ({_T}) SELECT track_id, genre_family FROM t QUALIFY row_number() OVER (PARTITION BY genre_family ORDER BY md5('42|' || track_id), track_id) <= 16""")
def stratified_sample(spark, sf_dir):
    return report.stratified_sample(B.relation(spark, sf_dir, B.TRACKS).select("track_id", "genre_family"), ["genre_family"], 16, 42, "track_id")


@query(f"WITH f AS ({_F}) SELECT file_id, NOT (bitrate <> 0 AND bitrate < 256) AS good FROM f")
def quality_gates(spark, sf_dir):
    return B.relation(spark, sf_dir, B.FILES).select("file_id", catalogues.quality_gate(F.col("bitrate")).alias("good"))


@query("SELECT p_partkey AS id, sha256('itunes|' || p_brand || '|' || p_name) AS key FROM part")
def cache_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), catalogues.cache_key(F.lit("itunes"), [F.col("p_brand"), F.col("p_name")]).alias("key"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return catalogues.content_hash(files).withColumnRenamed("path", "doc_id")


@query("SELECT event_id, 0.5 * power(2, event_id % 4) AS wait FROM events")
def backoff_waits(spark, sf_dir):
    """How long each event waits if it is its request's attempt of that number."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.get(catalogues.backoff(0.5), (F.col("event_id") % 4).cast("int")).alias("wait"))
