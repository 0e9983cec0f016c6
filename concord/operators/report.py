"""Reports over the library: status, coverage, accuracy, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.operators.relations import seeded


def status(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("stage", "status").agg(F.count("*").alias("n"))


def destroy_counts(tracks: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """One row: published tracks, protected fields and files that a reset would lose."""
    a = tracks.agg(F.count(F.when(F.col("status") == "published", 1)).alias("published"))
    b = resolved.agg(F.count(F.when(F.col("decided_by").isin(*vocab.PROTECTED), 1)).alias("protected"))
    return a.crossJoin(b).crossJoin(files.agg(F.count("*").alias("files")))  # one row each


def coverage(candidates: DataFrame, tracks: DataFrame) -> DataFrame:
    """field, tracks, share: tracks with a candidate for it."""
    total = tracks.agg(F.count("*").alias("total"))
    per_field = candidates.where(T.text("value") != "").groupBy("field").agg(F.count_distinct("track_id").alias("tracks"))
    return per_field.crossJoin(F.broadcast(total)).select("field", "tracks", F.round(F.col("tracks") / F.col("total"), 6).alias("share"))  # one row


def first_contributions(candidates: DataFrame) -> DataFrame:
    """source, n: how many fields it was the first to fill."""
    first = candidates.where(T.text("value") != "").groupBy("track_id", "field").agg(F.min_by("source", "ord").alias("source"))
    return first.groupBy("source").agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """genre_family, auto, review, no_match, unusable. scored: genre_family, evidence, confidence, usable."""
    bucket = F.when(~F.col("usable"), "unusable").when(F.col("evidence") == "none", "no_match").when(F.col("confidence") >= vocab.AUTO_ACCEPT, "auto").otherwise("review")
    counts = {b: F.count(F.when(bucket == b, 1)).alias(b) for b in ("auto", "review", "no_match", "unusable")}
    return scored.groupBy("genre_family").agg(*counts.values())


def routing_share(tracks: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: the commonest family, its share, and whether it passes the gate."""
    n = tracks.groupBy("genre_family").agg(F.count("*").alias("n"))
    top = n.agg(F.max_by("genre_family", F.struct("n", "genre_family")).alias("dominant"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))
    return top.withColumn("passes", F.col("share") >= least)


def frame_coverage(tags: DataFrame) -> DataFrame:
    """frame, n: published files that carry it."""
    return tags.select(F.explode("tags").alias("frame", "value")).groupBy("frame").agg(F.count("*").alias("n"))


def acquisition_audit(files: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: least bitrate, files below the floor (less a tolerance), distinct formats, rows."""
    known = F.col("bitrate") != 0
    return files.agg(
        F.min(F.when(known, F.col("bitrate"))).alias("least"), F.count(F.when(known & (F.col("bitrate") < vocab.MIN_BITRATE * (1 - tolerance)), 1)).alias("below"),
        F.count_distinct("itag").alias("formats"), F.count("*").alias("files"),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """outcome, n of a run."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, strata: list[str], per: int, seed: int, key: str) -> DataFrame:
    """Exactly per rows of each stratum (all, if fewer), by a seeded hash of the key."""
    order = Window.partitionBy(*strata).orderBy(seeded(seed, key), key)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per).drop("_k")
