"""All stages of a run over a stored table of tracks, with what has been done kept beside the rows.

The version that a stage makes bears the run's name and the stage's report, so rows and record come into being together: a run that
was stopped anywhere goes on at the first stage without a version, and no stage that has one is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord import vocab
from concord.operators import store
from concord.operators.relations import written
from concord.operators.state import Table

#: Gives track_id and error (null for success) of every pending track.
Handler = Callable[[DataFrame], DataFrame]


def done(tracks: Table, run: str) -> dict[str, dict]:
    """The reports of the stages that a run has finished."""
    notes = (tracks.note(v) for v in tracks.versions())
    return {n["stage"]: n["report"] for n in notes if n and n.get("run") == run}


def run_all(tracks: Table, handlers: dict[str, Handler], run: str, stages: Sequence[str] = vocab.STAGES, stop_after: str | None = None) -> dict[str, dict]:
    """Every stage that has a handler, in order; the report of each, also of those finished before.

    A stage takes all tracks that wait for it. Where a handler fails for a track the track is marked, and the run goes on.
    """
    reports = done(tracks, run)
    for stage in stages:
        if stage not in handlers or stage in reports:
            continue
        base = tracks.version()
        waiting = store.pending(tracks.read(base), stage)
        outcomes = written(handlers[stage](waiting).select("track_id", "error"), f"outcomes-{stage}")
        counts = outcomes.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("advanced"), F.count("error").alias("failed")).first()
        reports[stage] = counts.asDict()
        after = store.advance(waiting, outcomes).join(outcomes.select("track_id"), "track_id", "left_semi")
        tracks.upsert(after, base=base, note={"run": run, "stage": stage, "report": reports[stage]})
        if stage == stop_after:
            break
    return reports
