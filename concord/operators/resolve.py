"""From raw names to stored decisions for whole tables of tracks: the resolver's ladder and what follows it.

Landed responses are relations; a source that gave nothing, or failed, has no rows and so contributes nothing.
Every step is a join or an aggregation on track_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators import fuse, identity, store
from concord.operators.relations import coalesce_relations, first_tier, spread, written

KEY = ["track_id"]
#: What is known of a match; identity.confidence() reads all but the ids.
MATCH = {
    "evidence": "string", "search_score": "int", "duration_delta_s": "double", "rival_gap": "int", "acoustid_score": "double",
    "variant_mismatch": "boolean", "artist_unrelated": "boolean", "corroborated": "boolean", "recording_id": "string", "acoustid": "string",
}
CANDIDATE = ["track_id", "field", "value", "source", "ord"]
#: Candidates are kept in the order of their origin: the recording, enrichment, the title's version, the classifier.
_STEP = 1 << 32


def _match(**known: Column) -> list[Column]:
    return [known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in MATCH.items()]


def _delta(length: Column, duration: Column) -> Column:
    return F.when((length != 0) & (duration != 0), length.cast("double") - duration)


def evaluate(queries: DataFrame, recordings: DataFrame, albums: DataFrame) -> DataFrame:
    """track_id and MATCH of every query by text: the first of the ranked recordings, judged against the next different one.

    queries: track_id, title, duration_s, isrc; recordings: track_id, tier (0 by code, 1 by primary artist, 2 by full
    credit), position, recording_id, title, length (seconds), score, n_releases; albums: track_id, recording_id that
    have an album by the artist. Values come from the first of the few that has one.
    """
    asked = queries.select("track_id", F.col("title").alias("query_title"), F.col("duration_s").cast("double").alias("target"), F.coalesce("isrc", F.lit("")).alias("isrc"))
    given = recordings.join(asked.select("track_id", "isrc", F.when(F.col("target") != 0, F.col("target")).alias("target")), "track_id").where((F.col("tier") > 0) | (F.col("isrc") != "")).drop("isrc")
    ranked = identity.rank_recordings(first_tier(given, KEY, "tier"), KEY)
    with_album = albums.select(*KEY, "recording_id").distinct().withColumn("_has", F.lit(0))
    first = lambda c: F.min_by(c, "rank").alias(f"top_{c}")
    few = F.collect_list(F.when(F.col("rank") <= vocab.RECORDING_PROBE, F.struct("rank", "recording_id"))).alias("few")
    top = identity.beside_top(ranked, KEY).groupBy(*KEY).agg(first("title"), first("length"), first("score"), identity.gap_to_rival(), few)
    probed = top.select(*[c for c in top.columns if c != "few"], F.inline("few")).join(with_album, [*KEY, "recording_id"], "left")  # the few that are probed, not all
    same = [F.first(c).alias(c) for c in top.columns if c not in (*KEY, "few")]
    best = probed.groupBy(*KEY).agg(*same, F.min_by("recording_id", F.struct(F.coalesce("_has", F.lit(1)), "rank")).alias("recording_id"))
    rows = asked.join(best, "track_id", "left")
    hit = F.col("top_title").isNotNull()
    return rows.select("track_id", *_match(
        evidence=F.when(~hit, "none").when(F.col("isrc") != "", "isrc").otherwise("text"), search_score=F.col("top_score"), duration_delta_s=_delta(F.col("top_length"), F.col("target")),
        rival_gap=F.when(hit, F.col("rival_gap")), variant_mismatch=T.variant_mismatch(F.col("query_title"), F.col("top_title")), recording_id=F.col("recording_id"),
    ))


def evaluate_fingerprints(queries: DataFrame, fingerprints: DataFrame, linked: DataFrame) -> DataFrame:
    """track_id and MATCH of the queries whose best fingerprint match links a plausible recording.

    fingerprints: track_id, acoustid, score, recording_ids, position; linked: recording_id, artist, title, length, has_release.
    Without a known length the audio itself stands for the duration.
    """
    names = queries.select("track_id", F.col("artist").alias("query_artist"), F.col("title").alias("query_title"), F.col("duration_s").cast("double").alias("target"))
    best = identity.by_fingerprint(fingerprints.join(names.drop("target"), "track_id"), linked, KEY)
    ids = fingerprints.where(F.size("recording_ids") > 0).groupBy("track_id").agg(F.max_by("acoustid", F.struct("score", -F.col("position"))).alias("acoustid"))
    rows = similarity.artist_is_unrelated(best.join(names.select("track_id", "target"), "track_id").join(ids, "track_id"), "query_artist", "artist")
    return rows.select("track_id", *_match(
        evidence=F.lit("acoustid"), acoustid_score=F.col("acoustid_score"), duration_delta_s=F.coalesce(_delta(F.col("length"), F.col("target")), F.lit(0.0)),
        variant_mismatch=T.variant_mismatch(F.col("query_title"), F.col("title")), artist_unrelated=F.col("artist_unrelated"), recording_id=F.col("recording_id"), acoustid=F.col("acoustid"),
    ))


def with_confidence(matches: DataFrame) -> DataFrame:
    return matches.withColumn("confidence", identity.confidence({c: F.col(c) for c in MATCH}))


def resolve(queries: DataFrame, by_text: DataFrame, by_fingerprint: DataFrame | None, recording_values: DataFrame, enrichment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track_id, MATCH and confidence; CANDIDATE rows) of every query.

    by_text, by_fingerprint: from the two evaluations; a fingerprint's recording goes before a text's.
    recording_values: recording_id, field, value, source, ord; enrichment: CANDIDATE rows of the other catalogues, which
    count only for tracks with some evidence. Where they agree on the query, a doubtful match is corroborated. What was
    found and the candidates are written to the shared folder, so that all that is asked of them later shares one computation.
    """
    found = written(by_text if by_fingerprint is None else coalesce_relations(KEY, by_fingerprint, by_text), "found")
    known = found.where(F.col("evidence") != "none")
    extra = enrichment.join(known.select("track_id"), "track_id", "left_semi").select(*CANDIDATE)
    values = known.select("track_id", "recording_id").join(recording_values, "recording_id").select(*CANDIDATE)
    candidates = written(values.unionByName(extra.withColumn("ord", F.col("ord") + _STEP)), "found-candidates")
    votes = identity.corroborated(candidates.where(F.col("ord") >= _STEP), queries.select("track_id", F.col("artist").alias("query_artist"), F.col("title").alias("query_title"))).withColumnRenamed("corroborated", "_agreed")
    doubtful = ~identity.auto_accepts(F.col("confidence"))
    judged = with_confidence(found).join(votes, "track_id", "left").withColumn("corroborated", doubtful & (F.col("evidence") != "none") & F.coalesce("_agreed", F.lit(False)))
    return with_confidence(judged.drop("_agreed", "confidence")), candidates


def own_candidates(downloads: DataFrame, predictions: DataFrame) -> DataFrame:
    """CANDIDATE rows that need no catalogue: mix name and remixer of the raw title, then style and genre of the classifier.

    downloads: track_id, raw_title; predictions: track_id, genre, style.
    """
    version = downloads.select("track_id", T.extract_version(F.col("raw_title")).alias("v"))
    said = version.select("track_id", F.lit("derived").alias("source"), F.posexplode(_pairs(mix_name=F.col("v.mix_name"), remixer=F.col("v.remixer"))).alias("ord", "p"))
    heard = predictions.select("track_id", F.lit("essentia").alias("source"), F.posexplode(_pairs(genre=F.col("style"), classifier_genre=F.col("genre"))).alias("ord", "p"))
    rows = said.withColumn("ord", F.col("ord") + 2 * _STEP).unionByName(heard.withColumn("ord", F.col("ord") + 3 * _STEP))
    return rows.select("track_id", "p.field", "p.value", "source", "ord").where(F.col("value") != "")


def _pairs(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("field"), T.text(v).alias("value")) for k, v in values.items()])


def families(tracks: DataFrame, candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """track_id, family: by the classifier's genre, but for what a catalogue's code, genre or label places in a region."""
    catalogue = candidates.where(F.col("source") != "essentia")
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord")))
    is_genre = F.col("field") == "genre"
    first = F.min_by(F.when(is_genre, F.col("value")), F.when(is_genre, F.struct((F.col("source") != "itunes").alias("other"), "ord")))
    facts = catalogue.groupBy("track_id").agg(last("isrc").alias("isrc"), last("label").alias("label"), first.alias("catalogue_genre"))
    rows = tracks.select("track_id").join(facts, "track_id", "left").join(predictions.select("track_id", "genre"), "track_id", "left")
    return rows.select("track_id", T.family_for_identity(F.col("genre"), F.col("isrc"), F.col("catalogue_genre"), F.col("label")).alias("family"))


@dataclass(frozen=True)
class Outcome:
    """Relations after a run; each is the new version of what went in."""

    tracks: DataFrame
    candidates: DataFrame
    resolved: DataFrame
    queue: DataFrame


def resolve_and_arbitrate(
    downloads: DataFrame, by_text: DataFrame, by_fingerprint: DataFrame | None, recording_values: DataFrame, enrichment: DataFrame,
    predictions: DataFrame, ranking: DataFrame, resolved: DataFrame, queue: DataFrame,
) -> Outcome:
    """Resolve every download, store all candidates, decide the fields of those that are sure enough and queue the others.

    Each step is written to the shared folder, and the next ones and all four outputs read it there: none is computed twice.
    downloads: track_id, channel, raw_title, duration_s. The tracks returned have names as cleaned, family, confidence, ids
    and status: pending where the run goes on, review where it waits.
    """
    queries = written(cleaned(downloads), "queries")
    matches, found = resolve(queries, by_text, by_fingerprint, recording_values, enrichment)
    candidates = found.unionByName(own_candidates(downloads, predictions))
    tracks = written(queries.join(matches, "track_id").join(families(queries, candidates, predictions), "track_id"), "tracks")
    sure = identity.auto_accepts(F.col("confidence"))
    accepted = tracks.where(sure).select("track_id", "family")
    decisions = written(fuse.arbitrate(candidates.join(accepted, "track_id"), ranking), "decisions")
    waiting = tracks.where(~sure).select("track_id", identity.review_reason(F.col("confidence"), F.col("evidence")).alias("reason"))
    done = tracks.select(
        "track_id", F.col("artist").alias("norm_artist"), F.col("title").alias("norm_title"), F.col("family").alias("genre_family"), F.col("confidence").alias("identity_confidence"),
        "acoustid", F.when(F.col("evidence") == "acoustid", F.col("recording_id")).alias("mb_recording_id"), F.when(sure, "pending").otherwise("review").alias("status"),
    )
    return Outcome(done, store.append_candidates(None, candidates), fuse.persist(resolved, decisions), store.enqueue(queue, waiting))


def cleaned(downloads: DataFrame) -> DataFrame:
    """track_id, artist, title, artist_full, duration_s of downloads: what the catalogues are asked for."""
    names = spread(downloads, "track_id").select("track_id", T.normalise(F.col("channel"), F.col("raw_title")).alias("n"), F.when(F.col("duration_s") != 0, F.col("duration_s")).alias("duration_s"))
    return names.select("track_id", "n.artist", "n.title", "n.artist_full", "duration_s")
