"""What a user calls first, over DataFrames. Rows and columns are those of the operators that each function names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators import calibrate as calibration
from concord.operators import fuse, report, store
from concord.operators import resolve as resolver
from concord.operators.relations import prepare



def resolve(queries: DataFrame, *landed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Matches and candidates of queries; see operators.resolve.resolve."""
    prepare(queries.sparkSession)
    return resolver.resolve(queries, *landed)


def resolve_and_arbitrate(downloads: DataFrame, *landed: DataFrame | None) -> resolver.Outcome:
    """The whole run over a table of downloads; see operators.resolve.resolve_and_arbitrate."""
    prepare(downloads.sparkSession)
    return resolver.resolve_and_arbitrate(downloads, *landed)


def ranking(spark: SparkSession, precedence: DataFrame | None = None) -> DataFrame:
    """The ranking in force: calibrated cells in place of built-in ones."""
    return fuse.resolved_ranking(vocab.default_ranking(prepare(spark)), precedence)


def normalise(rows: DataFrame, artist: str = "artist", title: str = "title") -> DataFrame:
    """rows with clean_artist, clean_title, featured and artist_full of raw names."""
    n = T.normalise(F.col(artist), F.col(title))
    out = rows.withColumn("_n", n)
    return out.select(*rows.columns, F.col("_n.artist").alias("clean_artist"), F.col("_n.title").alias("clean_title"), "_n.featured", "_n.artist_full")


def score(rows: DataFrame, query_artist: str, query_title: str, artist: str, title: str) -> DataFrame:
    """rows with match_score, 0 to 1, of a result for a query."""
    return similarity.match_score(rows, query_artist, query_title, artist, title)


def arbitrate(candidates: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """One decision for each field of each track; see fuse.arbitrate."""
    return fuse.arbitrate(candidates, ranking(candidates.sparkSession, precedence))


def rearbitrate(candidates: DataFrame, resolved: DataFrame, precedence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved after deciding anew, what is no longer decided being dropped; track_id and how many fields changed)."""
    in_force = ranking(candidates.sparkSession, precedence)
    return fuse.persist(resolved, fuse.arbitrate(candidates, in_force), replace=True), fuse.rearbitrate(candidates, in_force, resolved)


def calibrate(elicitation: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """The precedence table after the recorded answers: calibrated cells in place of their old rows."""
    derived = calibration.derive(calibration.observations(elicitation), vocab.default_ranking(elicitation.sparkSession))
    return derived if precedence is None else calibration.apply(precedence, derived)


def project_tags(resolved: DataFrame) -> DataFrame:
    """track_id, tags, comment, skipped, as written to files."""
    return store.build_tags(resolved)


def search(library: DataFrame, query: str, columns: list[str], status: str | None = None) -> DataFrame:
    return store.search(library, query, columns, status)


def status(tracks: DataFrame) -> DataFrame:
    return report.status(tracks)


def coverage(candidates: DataFrame, tracks: DataFrame) -> DataFrame:
    return report.coverage(candidates, tracks)
