"""Identity: choosing among candidates, and how sure the choice is.

Selections are top-1 by a struct of keys that ends in the source's own order, so ties resolve alike on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators.relations import coalesce_relations, partitions_for, written


def duration_ok(delta: Column) -> Column:
    return F.coalesce(F.abs(delta) <= vocab.DURATION_TOLERANCE, F.lit(False))


def confidence(m: dict[str, Column]) -> Column:
    """0 to 1 from evidence, search_score, duration_delta_s, rival_gap, acoustid_score, variant_mismatch, artist_unrelated, corroborated."""
    close = duration_ok(m["duration_delta_s"])
    contested = F.coalesce(m["rival_gap"] < 2, F.lit(False))
    veto = F.coalesce(m["variant_mismatch"], F.lit(False)) | F.coalesce(m["artist_unrelated"], F.lit(False))
    base = (
        F.when(m["evidence"] == "url_override", 1.0)
        .when(m["evidence"] == "isrc", 0.98)
        .when(m["evidence"] == "acoustid", F.when((F.coalesce(m["acoustid_score"], F.lit(0.0)) >= 0.9) & close, 0.95).otherwise(0.5))
        .otherwise(F.when((F.coalesce(m["search_score"], F.lit(0)) >= 90) & close & ~contested, 0.85).otherwise(0.5))
    )
    raised = F.when(F.coalesce(m["corroborated"], F.lit(False)) & ~veto, F.greatest(base, F.lit(vocab.CORROBORATED))).otherwise(base)
    return F.when(m["evidence"] == "none", 0.0).otherwise(F.round(F.when(veto, F.least(raised, F.lit(0.5))).otherwise(raised), 2))


def auto_accepts(score: Column) -> Column:
    return score >= vocab.AUTO_ACCEPT


def review_reason(score: Column, evidence: Column) -> Column:
    return F.when(~auto_accepts(score), F.when(evidence == "none", "no_match").otherwise("low_confidence"))


def best_result(results: DataFrame, query: list[str], score: str, position: str) -> DataFrame:
    """The highest score of each query; of equal ones the first."""
    rest = [c for c in results.columns if c not in query]
    return results.groupBy(*query).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("w")).select(*query, "w.*")


def rank_results(results: DataFrame, query: list[str], score: str, position: str) -> DataFrame:
    """All results with rank from 1: highest score, of equal ones the first; best_result() is the one of rank 1."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(score), F.asc_nulls_last(position))))


def rank_recordings(recordings: DataFrame, query: list[str]) -> DataFrame:
    """recordings (length, target, score, n_releases, position) with rank from 1: nearest length, then score, then releases."""
    off = F.coalesce(F.abs(F.col("length") - F.col("target")).cast("double"), F.lit(float("inf")))
    return recordings.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(off, F.desc("score"), F.desc("n_releases"), "position")))


def beside_top(ranked: DataFrame, query: list[str]) -> DataFrame:
    """ranked with _top, the title, length and score of the first of its query, and _rival: whether this is another recording."""
    w = Window.partitionBy(*query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = ranked.withColumn("_top", F.first(F.struct("title", "length", "score")).over(w))
    same = (T.fold(F.col("title")) == T.fold(F.col("_top.title"))) & F.coalesce(F.abs(F.col("length") - F.col("_top.length")) <= vocab.DURATION_TOLERANCE, F.lit(False))
    return top.withColumn("_rival", (F.col("rank") > 1) & ~same)


def gap_to_rival() -> Column:
    """Aggregate over beside_top(): score of the first less that of the first rival after it; 99 without one."""
    gap = F.min_by(F.when(F.col("_rival"), F.col("_top.score") - F.col("score")), F.when(F.col("_rival"), F.col("rank")))
    return F.coalesce(gap, F.lit(99)).alias("rival_gap")


def rival_gap(ranked: DataFrame, query: list[str]) -> DataFrame:
    """Score of the first recording less that of the first different one after it; 99 without one. ranked: title, length, score, rank."""
    return beside_top(ranked, query).groupBy(*query).agg(gap_to_rival())


def is_album(primary_type: Column, secondary_types: Column) -> Column:
    none = F.lit(False)
    return F.coalesce(primary_type == "Album", none) & ~F.coalesce(F.arrays_overlap(secondary_types, F.array(*[F.lit(x) for x in vocab.NON_ALBUM_TYPES])), none)


def same_artist(credit: Column, artist: Column) -> Column:
    return is_prefix(T.fold(credit), T.fold(artist))


def is_prefix(a: Column, b: Column) -> Column:
    """One of two folded names begins the other; neither is empty."""
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def release_order(r: dict[str, Column]) -> Column:
    """What puts a query's releases in order, as select_release() says; title, album_artist and artist are folded."""
    album, own = is_album(r["primary_type"], r["secondary_types"]), is_prefix(r["album_artist"], r["artist"])
    tier = F.when(own & album, 0).when(own, 1).when(album, 2).otherwise(3)
    deluxe = reduce(lambda a, b: a | b, [F.contains(r["title"], F.lit(w)) for w in vocab.RELEASE_DELUXE_WORDS])
    return F.struct(tier.alias("tier"), (-F.coalesce(r["track_count"], F.lit(0))).alias("fewer"), (~deluxe).cast("int").alias("plain"), r["position"].alias("position"))


def select_release(releases: DataFrame, query: list[str]) -> DataFrame:
    """The fullest release of the best pool: albums by the artist, then anything by the artist, then albums, then all.

    releases: artist, album_artist, primary_type, secondary_types, title, track_count, position.
    """
    rest = [c for c in releases.columns if c not in query]
    order = release_order({c: T.fold(F.col(c)) if c in ("title", "album_artist", "artist") else F.col(c) for c in releases.columns})
    return releases.groupBy(*query).agg(F.min_by(F.struct(*rest), order).alias("w")).select(*query, "w.*")


def is_usable(day: Column, today: str) -> Column:
    return day.between(F.lit("1900-01-01").cast("date"), F.lit(today).cast("date"))


def earliest_date(dates: DataFrame, query: list[str], today: str, column: str = "date") -> DataFrame:
    """The earliest date from 1900 to a given day; of one day's, the most precise."""
    day = T.padded_date(F.col(column))
    usable = dates.where(is_usable(day, today))
    return usable.groupBy(*query).agg(F.min_by(column, F.struct(day, -F.length(column), F.col("position"))).alias(column))


def earliest_pressing(results: DataFrame, query: list[str]) -> DataFrame:
    """The result of the smallest all-digit year; without any, the first."""
    year = F.when(F.rlike("year", F.lit(r"^\d+$")), F.col("year").cast("long"))
    rest = [c for c in results.columns if c not in query]
    return results.groupBy(*query).agg(F.min_by(F.struct(*rest), F.struct(F.coalesce(year, F.lit((1 << 62))), F.col("position"))).alias("w")).select(*query, "w.*")


def best_recording(ranked: DataFrame, albums: DataFrame, query: list[str]) -> DataFrame:
    """Of the first few ranked, the first that has an album by the artist, else the first. albums: query and recording ids that have one."""
    few = ranked.where(F.col("rank") <= vocab.RECORDING_PROBE).join(albums.withColumn("_has", F.lit(0)), [*query, "recording_id"], "left")
    rest = [c for c in ranked.columns if c not in query]
    return few.groupBy(*query).agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("_has", F.lit(1)), F.col("rank"))).alias("w")).select(*query, "w.*")


def search_recordings(by_isrc: DataFrame, by_primary: DataFrame, by_full: DataFrame, query: list[str]) -> DataFrame:
    """Recordings by exact code; without any by the primary artist; without any by the full credit."""
    return coalesce_relations(query, by_isrc, by_primary, by_full)


def by_fingerprint(matches: DataFrame, recordings: DataFrame, query: list[str]) -> DataFrame:
    """The best plausible recording of each query's top fingerprint match.

    matches: query, score, recording_ids, position; recordings: recording_id, artist, title, has_release; the
    query's own artist and title are query_artist and query_title of matches.
    """
    linked = matches.where(F.size("recording_ids") > 0)
    top = linked.groupBy(*query).agg(F.max_by(F.struct("score", "recording_ids", "query_artist", "query_title"), F.struct(F.col("score"), -F.col("position"))).alias("m"))
    probes = top.select(*query, F.col("m.score").alias("acoustid_score"), "m.query_artist", "m.query_title", F.posexplode(F.slice("m.recording_ids", 1, vocab.MBID_PROBE)).alias("idx", "recording_id"))
    scored = similarity.match_score(probes.join(recordings, "recording_id"), "query_artist", "query_title", "artist", "title", "_base")
    total = F.col("_base") + F.when(F.col("has_release"), vocab.RELEASE_BONUS).otherwise(0.0)
    best = best_result(scored.withColumn("total", total).drop("_base"), query, "total", "idx")
    return best.where(F.col("total") >= vocab.PLAUSIBLE)


def corroborated(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """track_id, corroborated: two sources name one recording and the first of them fits the query.

    candidates: track_id, field, value, source, ord; queries: track_id, query_artist, query_title.
    """
    here = candidates.where(F.col("field").isin("artist", "title") & (T.text("value") != ""))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord")))
    votes = here.groupBy("track_id", "source").agg(last("artist").alias("artist"), last("title").alias("title"), F.min("ord").alias("ord"))
    votes = votes.where(F.col("artist").isNotNull() & F.col("title").isNotNull())
    keyed = votes.withColumn("_a", T.ascii_key(F.col("artist"))).withColumn("_t", T.ascii_key(T.strip_version(F.col("title"))))
    groups = keyed.groupBy("track_id", "_a", "_t").agg(F.count_distinct("source").alias("n"), F.min_by(F.struct("artist", "title"), "ord").alias("v")).where("n >= 2")
    rows = groups.select("track_id", "v.*").join(queries, "track_id")
    rows = similarity.artist_is_unrelated(similarity.plausible(rows, "query_artist", "query_title", "artist", "title"), "query_artist", "artist")
    fits = F.col("plausible") & ~F.col("artist_unrelated")
    return queries.select("track_id").join(rows.groupBy("track_id").agg(F.max(fits).alias("corroborated")), "track_id", "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))


def classify_source(s: dict[str, Column]) -> Column:
    """Struct of verdict and reasons from channel, title, description, artist_tag, duration_s, catalog_duration_s."""
    named = lambda pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    delivered = named([("topic_channel", F.endswith(T.text(s["channel"]), F.lit(" - Topic"))), ("provided_to_youtube_by", F.contains(T.fold(s["description"]), F.lit("provided to youtube by")))])
    strong = named([("video_in_title", F.rlike(T.text(s["title"]), F.lit(T.VIDEO_WORDS))), ("longer_than_catalogue", F.coalesce(s["duration_s"] - s["catalog_duration_s"] > vocab.RIP_TOLERANCE, F.lit(False)))])
    spaced = lambda c: F.translate(T.fold(c), "_", " ")
    weak = named([("artist_is_channel", (T.text(s["artist_tag"]) != "") & (T.text(s["channel"]) != "") & (spaced(s["artist_tag"]) == spaced(s["channel"])))])
    return (
        F.when(F.size(delivered) > 0, F.struct(F.lit("art_track").alias("verdict"), delivered.alias("reasons")))
        .when(F.size(strong) > 0, F.struct(F.lit("video_rip").alias("verdict"), F.concat(strong, weak).alias("reasons")))
        .otherwise(F.struct(F.lit("unknown").alias("verdict"), weak.alias("reasons")))
    )


#: Strong keys are counted in so many buckets; a bucket of more rows than COMMON and than SHARE times the mean may hold a frequent key.
BUCKETS, COMMON, SHARE = 1 << 16, 20_000, 8


def duplicates(tracks: DataFrame, keys: list[str], seconds: float = 2.0) -> DataFrame:
    """track_id, duplicate_of: a strong key in common and durations within the given seconds of each other, to the millisecond.

    tracks: track_id, duration_s, bitrate, is_art_track and the keys. Better is the higher bitrate, then clean audio, then
    the smaller id. A file that is the best of all that are this near to it, by any key, stays; a file near to
    such a one is a duplicate of the best of them. So nothing goes for a file that goes itself, or that is near
    only by way of a third. Rows are dealt four times: by key, by file, and by both again for those that stay or may go.

    Rows of a key meet in one window. Keys are counted in buckets first; those of large buckets meet otherwise, with the same result: one
    row for each millisecond of a key, in windows that hold what is near a span of durations, so a frequent key is spread over many.
    """
    near_ms, span, parts = int(seconds * 1000), max(int(seconds * 32_000), 1000), partitions_for(tracks)
    strong = F.array(*[F.when(F.col(k).isNotNull() & (F.col(k).cast("string") != ""), F.struct(F.lit(n).alias("name"), F.col(k).cast("string").alias("value"))) for n, k in enumerate(keys)])
    rows = tracks.where(F.col("duration_s").isNotNull()).select("track_id", F.round(F.col("duration_s") * 1000).cast("long").alias("at"), F.struct("bitrate", "is_art_track", (-F.col("track_id")).alias("older")).alias("worth"), F.explode(strong).alias("key")).where("key IS NOT NULL")
    rows = rows.select("track_id", "at", "worth", F.xxhash64("key").alias("hash"), "key.*")  # the hash spreads and sorts well, the key itself decides
    key, bucket = ["hash", "name", "value"], F.pmod("hash", F.lit(BUCKETS))
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    counted = counts.agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("n") > COMMON, F.struct("bucket", "n"))).alias("large")).first()
    common = [b.bucket for b in counted.large if b.n * BUCKETS > SHARE * counted.total]
    part = lambda c: F.floor(c / span)

    def near(*by: str) -> Window:
        return Window.partitionBy(*by).orderBy("at").rangeBetween(-near_ms, near_ms)

    def best_near(rows: DataFrame, worth: Column) -> DataFrame:
        """rows with best, the most of worth near them by their key, and company, how many are near."""
        dealt = (rows.where(~bucket.isin(common)) if common else rows).repartition(parts, "hash")
        seen = dealt.withColumns({"best": F.max(worth).over(near(*key)), "company": F.count("*").over(near(*key))})
        if not common:
            return seen
        often = rows.where(bucket.isin(common))
        spots = often.groupBy(*key, "at").agg(F.max(worth).alias("most"), F.count("*").alias("n"))
        spread = spots.withColumn("part", F.explode(F.sequence(part(F.col("at") - near_ms), part(F.col("at") + near_ms))))
        at_spots = spread.withColumns({"best": F.max("most").over(near(*key, "part")), "company": F.sum("n").over(near(*key, "part"))}).where(F.col("part") == part(F.col("at")))
        return seen.unionByName(often.join(at_spots.select(*key, "at", "best", "company"), [*key, "at"]))

    first = best_near(rows, F.col("worth")).where("company > 1").withColumn("leads", F.col("best") == F.col("worth")).drop("best", "company")
    judged = first.repartition(parts, "track_id").withColumn("stays", F.min("leads").over(Window.partitionBy("track_id")))
    left = judged.where("stays OR NOT leads").drop("leads")  # what leads by a key is near none that stays by it
    if common:
        left = written(left, "judged")
    gone = best_near(left, F.when(F.col("stays"), F.col("worth"))).where("NOT stays AND best IS NOT NULL").select("track_id", "best")
    return gone.repartition(parts, "track_id").groupBy("track_id").agg(F.max("best").alias("best")).select("track_id", (-F.col("best.older")).alias("duplicate_of"))
