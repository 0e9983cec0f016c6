"""State of a run as relations: stages, the review queue, edits, publishing. Every function returns the new relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.operators import fuse
from concord.operators.relations import insert_or_ignore, ranked, spread, upsert, written

SCHEMA_VERSION = 4


def next_stage(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for a, b in zip(vocab.STAGES, vocab.STAGES[1:], strict=False) for x in (a, b)])
    return F.try_element_at(table, stage)


def pending(tracks: DataFrame, stage: str) -> DataFrame:
    return tracks.where((F.col("stage") == stage) & ~F.col("status").isin("failed", "skipped"))


def advance(tracks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """tracks after a stage: an outcome without error moves a track on, one with an error fails it and keeps 500 characters.

    outcomes: track_id, error (null for success).
    """
    o = outcomes.select("track_id", F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    ran, failed = F.coalesce("_ran", F.lit(False)), F.col("_error").isNotNull()
    joined = tracks.join(o, "track_id", "left")
    out = {
        "stage": F.when(ran & ~failed, F.coalesce(next_stage(F.col("stage")), F.col("stage"))).otherwise(F.col("stage")),
        "status": F.when(ran & failed, "failed").otherwise(F.col("status")),
        "error": F.when(ran & failed, F.substring("_error", 1, 500)).when(ran, F.lit(None)).otherwise(F.col("error")),
    }
    return joined.withColumns(out).select(*tracks.columns)


def run_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("stage").agg(
        F.count(F.when(F.col("error").isNull() & ~F.col("skipped"), 1)).alias("advanced"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"), F.count(F.when(F.col("skipped"), 1)).alias("skipped")
    )


def register_files(files: DataFrame, tracks: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, tracks) with the probed files that aren't there yet, and a track at the first stage for each new one.

    probes: origin, video_id, local_path, staging_path, sha256, duration_s, codec, bitrate, sample_rate, itag, channel,
    description, raw_tags. A video is registered once; ids follow the largest there is, in order of the path.
    """
    known = files.where(F.col("video_id").isNotNull()).select("video_id")
    once = probes.withColumn("_n", F.row_number().over(Window.partitionBy(F.coalesce("video_id", "staging_path")).orderBy("staging_path"))).where("_n = 1").drop("_n")
    fresh = numbered(once.join(known, "video_id", "left_anti"), "staging_path", files, "file_id")
    last = lambda table, key: table.agg(F.coalesce(F.max(key), F.lit(0)).alias(f"_last_{key}"))
    made = fresh.select("file_id").crossJoin(last(files, "file_id")).crossJoin(last(tracks, "track_id"))  # one row each
    made = made.select((F.col("_last_track_id") + F.col("file_id") - F.col("_last_file_id")).alias("track_id"), F.col("file_id").alias("source_file_id"), F.lit(vocab.STAGES[0]).alias("stage"), F.lit("pending").alias("status"))
    return files.unionByName(fresh, allowMissingColumns=True), tracks.unionByName(made, allowMissingColumns=True)


def numbered(rows: DataFrame, order: str, table: DataFrame, key: str) -> DataFrame:
    """rows with a key that goes on from the largest of table without gaps, in order of a column."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    return ranked(rows, [], [order], "_nth").crossJoin(last).withColumn(key, F.col("_last") + F.col("_nth")).drop("_last", "_nth")


def append_candidates(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Every value every source offered; what was stored stays. ord goes on within a track from the largest that is stored."""
    rows = new.withColumn("ord", F.row_number().over(Window.partitionBy("track_id").orderBy("ord", "source", "field", "value")).cast("long") - 1)
    if stored is None:
        return rows
    after = stored.groupBy("track_id").agg(F.max("ord").alias("_last"))
    rows = rows.join(after, "track_id", "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    return stored.unionByName(rows.select(*stored.columns))


def unseen(refs: DataFrame, source_files: DataFrame) -> DataFrame:
    """refs not downloaded before; rejected ones count as seen."""
    return refs.join(source_files.where(F.col("video_id").isNotNull()).select("video_id"), "video_id", "left_anti")


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new tracks; a track that is queued keeps its reason."""
    return insert_or_ignore(queue, new, ["track_id"])


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("track_id"), "track_id", "left_anti")


def edit(resolved: DataFrame, edits: DataFrame, how: str = "manual") -> DataFrame:
    """resolved with edited fields (track_id, field, value), whatever decided them before."""
    rows = edits.select("track_id", "field", "value", F.lit(how).alias("source"), F.lit(how).alias("decided_by"))
    return upsert(resolved, rows, ["track_id", "field"])


def override(resolved: DataFrame, tracks: DataFrame, queue: DataFrame, links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, tracks, queue) after links were pasted.

    links: track_id, url; entities: provider, identifier, field, value of landed tracks and recordings. A link's
    values replace all others of their fields, an edit's too.
    """
    parsed = links.withColumn("r", T.parse_link(F.col("url"))).where(F.col("r").isNotNull())
    fetchable = (F.struct("r.provider", "r.kind") == F.struct(F.lit("spotify"), F.lit("track"))) | (F.struct("r.provider", "r.kind") == F.struct(F.lit("musicbrainz"), F.lit("recording")))
    found = parsed.where(fetchable).select("track_id", "url", F.col("r.provider").alias("provider"), F.col("r.identifier").alias("identifier")).join(entities, ["provider", "identifier"])
    values = found.where(T.text("value") != "").select("track_id", "field", "value", F.col("provider").alias("source"), F.lit("url_override").alias("decided_by"))
    marker = found.select("track_id", F.lit("override_url").alias("field"), F.col("url").alias("value"), F.col("provider").alias("source"), F.lit("url_override").alias("decided_by")).distinct()
    done = found.select("track_id").distinct()
    sure = tracks.join(done.withColumn("_done", F.lit(True)), "track_id", "left").withColumn("identity_confidence", F.when(F.col("_done"), 1.0).otherwise(F.col("identity_confidence"))).select(*tracks.columns)
    return upsert(resolved, values.unionByName(marker), ["track_id", "field"]), sure, dequeue(queue, done)


def adopt(resolved: DataFrame, wishes: DataFrame, candidates: DataFrame) -> DataFrame:
    """resolved with the value that the wished source gives (track_id, field, source); unknown wishes change nothing."""
    rows = wishes.join(candidates, ["track_id", "field", "source"]).groupBy("track_id", "field").agg(F.min_by(F.struct("value", "source"), "ord").alias("w"))
    return upsert(resolved, rows.select("track_id", "field", "w.*", F.lit("manual").alias("decided_by")), ["track_id", "field"])


def accept(tracks: DataFrame, resolved: DataFrame, queue: DataFrame, candidates: DataFrame, ranking: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, resolved, queue) after the given ids were approved: decided where there are candidates, dequeued, published.

    Decisions by hand stay. A track that was published before moves as rename_plan() says, before new ones get their
    paths; a track that can't be named, as it has neither artist nor title, has failed.
    """
    ids = ids.select("track_id").distinct()
    here = tracks.join(ids, "track_id", "left_semi").select("track_id", F.coalesce("genre_family", F.lit("other")).alias("family"), "published_path")
    decisions = fuse.arbitrate(candidates.join(here.select("track_id", "family"), "track_id"), ranking)
    after = fuse.persist(resolved, decisions)
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    named = here.join(after.groupBy("track_id").agg(of("artist"), of("title")), "track_id", "left")
    known = (T.text("artist") != "") | (T.text("title") != "")
    moves = rename_plan(tracks.select("track_id", "published_path").join(named.select("track_id", "artist", "title"), "track_id", "left"))
    taken = tracks.select(F.col("published_path").alias("path")).union(moves.select("new_path"))
    fresh = publish_paths(named.where(F.col("published_path").isNull() & known), taken).select("track_id", F.col("path").alias("_path"))
    again = named.where(F.col("published_path").isNotNull()).join(moves, "track_id", "left").select("track_id", F.coalesce("new_path", "published_path").alias("_path"))
    marked = tracks.join(ids.withColumn("_ok", F.lit(True)), "track_id", "left").join(fresh.unionByName(again), "track_id", "left")
    ok = F.coalesce("_ok", F.lit(False))
    out = {
        "status": F.when(ok, F.when(F.col("_path").isNull(), "failed").otherwise("published")).otherwise(F.col("status")),
        "error": F.when(ok, F.when(F.col("_path").isNull(), "no artist and no title")).otherwise(F.col("error")),
        "published_path": F.when(ok, F.col("_path")).otherwise(F.col("published_path")),
    }
    return marked.withColumns(out).select(*tracks.columns), after, dequeue(queue, ids)


def track_detail(tracks: DataFrame, files: DataFrame, candidates: DataFrame, resolved: DataFrame, ranking: DataFrame, ids: DataFrame) -> DataFrame:
    """The given tracks with their file's columns, candidates by field and source, decisions as shown in files, and a preview of what accepting would decide."""
    ids = ids.select("track_id").distinct()
    head = tracks.join(ids, "track_id", "left_semi").join(files.withColumnRenamed("file_id", "source_file_id"), "source_file_id")
    offered = candidates.join(ids, "track_id", "left_semi")
    shown = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    listed = offered.groupBy("track_id").agg(shown("field", "source", "ord", "value").alias("candidates"))
    decided = resolved.join(ids, "track_id", "left_semi").withColumn("display", house_style(F.col("field"), F.col("value")))
    decided = decided.groupBy("track_id").agg(shown("field", "value", "source", "decided_by", "display").alias("resolved"))
    family = head.select("track_id", F.coalesce("genre_family", F.lit("other")).alias("family"))
    preview = fuse.arbitrate(offered.join(family, "track_id"), ranking).groupBy("track_id").agg(shown("field", "value", "source", "decided_by").alias("preview"))
    return head.join(listed, "track_id", "left").join(decided, "track_id", "left").join(preview, "track_id", "left")


def migrated(tracks: DataFrame, version: int) -> DataFrame:
    """Rows of an older schema version as SCHEMA_VERSION has them: version 4 added the cover that a published file holds, unknown before."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"schema version {version} is newer than {SCHEMA_VERSION}")
    return tracks if version >= 4 or "artwork_url" in tracks.columns else tracks.withColumn("artwork_url", F.lit(None).cast("string"))


def reject(tracks: DataFrame, queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, queue): rejected tracks are skipped and lose their paths; their source files stay, so they aren't fetched again."""
    gone = F.coalesce("_gone", F.lit(False))
    marked = tracks.join(ids.select("track_id").distinct().withColumn("_gone", F.lit(True)), "track_id", "left")
    out = marked.withColumns({"status": F.when(gone, "skipped").otherwise(F.col("status")), "published_path": F.when(~gone, F.col("published_path"))})
    return out.select(*tracks.columns), dequeue(queue, ids)


#: A path with the number that tells it from others of one name.
_NUMBERED = r"^(.*) \((\d+)\)\.aiff$"


def publish_paths(tracks: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """tracks (track_id, artist, title) with path, by their order: the first of a name has it bare, later ones with the next number from 2 that is free.

    taken: path of all files that are there. A number counts as taken, too, where it makes the name of another track.
    """
    placed = written(spread(tracks, "track_id").withColumn("_path", T.filename(F.col("artist"), F.col("title"))), "names")  # a range sort reads its rows twice
    named = ranked(placed, ["_path"], ["track_id"], "_k")
    there = taken.select("path").where(F.col("path").isNotNull()).distinct() if taken is not None else tracks.sparkSession.createDataFrame([], "path string")
    names = named.select("_path").distinct()
    split = there.union(names).distinct().select(F.concat(F.regexp_extract("path", _NUMBERED, 1), F.lit(".aiff")).alias("_path"), F.try_to_number(F.regexp_extract("path", _NUMBERED, 2), F.lit("9" * 18)).cast("long").alias("_used"), "path")
    exact = F.col("path") == F.concat(F.regexp_replace("_path", r"\.aiff$", ""), F.lit(" ("), F.col("_used").cast("string"), F.lit(").aiff"))
    used = split.where((F.col("_used") >= 2) & exact).select("_path", "_used").union(there.select(F.col("path").alias("_path"), F.lit(1).cast("long").alias("_used")))
    used = ranked(used.join(names, "_path", "left_semi"), ["_path"], ["_used"], "_j")
    runs = used.groupBy("_path", (F.col("_used") - F.col("_j")).alias("_free")).agg(F.count("*").alias("_size"))  # numbers taken in a row, after so many free ones
    skipped = named.select("track_id", "_path", "_k").join(runs, "_path").where(F.col("_free") < F.col("_k")).groupBy("track_id").agg(F.sum("_size").alias("_skipped"))
    nth = F.col("_k") + F.coalesce("_skipped", F.lit(0))
    suffixed = F.concat(F.regexp_replace("_path", r"\.aiff$", ""), F.lit(" ("), nth.cast("string"), F.lit(").aiff"))
    return named.join(skipped, "track_id", "left").withColumn("path", F.when(nth == 1, F.col("_path")).otherwise(suffixed)).drop("_path", "_k", "_skipped")


def rename_plan(tracks: DataFrame) -> DataFrame:
    """track_id, old_path, new_path of the published files that move. tracks: track_id, published_path, artist, title; track_id once.

    As if files were looked at one by one in order of track_id: a file moves to the path of its artist and title, if it has
    both and no file is there at that moment; its old path is free from then on. So of a path's claimants only one can
    have it: the first, or where a file holds it, the first after that file, and then only if that file moves. These
    form chains without branches, which are followed in steps of doubled length. A path that several tracks hold stays taken.
    """
    known = (T.text("artist") != "") & (T.text("title") != "")
    named = F.when(known, T.filename(F.col("artist"), F.col("title")))
    published = written(spread(tracks.where(F.col("published_path").isNotNull()), "track_id").select("track_id", "published_path", named.alias("new_path")), "named")  # read twice
    holders = published.groupBy("published_path").agg(F.min("track_id").alias("_holder"), F.count("*").alias("_held")).withColumnRenamed("published_path", "new_path")
    claims = published.where(F.col("new_path") != F.col("published_path")).join(holders, "new_path", "left")
    able = F.col("_holder").isNull() | ((F.col("_held") == 1) & (F.col("track_id") > F.col("_holder")))
    first = claims.where(able).groupBy("new_path").agg(F.min(F.struct("track_id", "published_path", "_holder")).alias("c"))
    plan = written(first.select("c.track_id", F.col("c.published_path").alias("old_path"), "new_path", F.col("c._holder").alias("_after")), "claims")
    while plan.where(F.col("_after").isNotNull()).limit(1).count():
        ahead = plan.select(F.col("track_id").alias("_after"), F.col("_after").alias("_next"))
        waiting = plan.where(F.col("_after").isNotNull()).join(ahead, "_after").select("track_id", "old_path", "new_path", F.col("_next").alias("_after"))
        plan = written(plan.where(F.col("_after").isNull()).unionByName(waiting), "claims")
    return plan.drop("_after")


def artwork_refresh(wanted: Column, embedded: Column) -> Column:
    return (T.text(wanted) != "") & ~wanted.eqNullSafe(embedded)


def build_tags(resolved: DataFrame) -> DataFrame:
    """track_id, tags (frame -> value), comment, skipped: fields of a file; the title in house style."""
    rows = resolved.where(T.text("value") != "")
    frames = F.create_map(*[F.lit(x) for kv in vocab.FRAMES.items() for x in kv])
    frame = F.when(~F.col("field").isin(*vocab.NON_TAG_FIELDS), F.try_element_at(frames, F.col("field")))
    value = F.when(F.col("field") == "title", T.canonical_title(F.col("value"))).otherwise(F.col("value"))
    rows = rows.select("track_id", "field", frame.alias("frame"), value.alias("value"))
    pair = F.when(F.col("frame").isNotNull(), F.struct("frame", "value"))
    return rows.groupBy("track_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("tags"), F.max(F.when(F.col("field") == "comment", F.col("value"))).alias("comment"),
        F.array_sort(F.collect_list(F.when(F.col("frame").isNull() & (F.col("field") != "comment"), F.col("field")))).alias("skipped"),
    )


def write_frames(old: Column, new: Column) -> Column:
    """Frames of a file after writing: those of other tools stay, ours are replaced."""
    owned = F.array(*[F.lit(x) for x in vocab.FRAMES.values()])
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(owned, k)), F.map_filter(new, lambda k, v: F.array_contains(owned, k)))


def house_style(field: Column, value: Column) -> Column:
    return F.when(field == "title", T.canonical_title(value)).when(field.isin("artist", "album", "album_artist"), T.asciify_quotes(value)).otherwise(value)


def candidate_map(candidates: DataFrame) -> DataFrame:
    """track_id, fields: the first value of each field."""
    first = candidates.where(T.text("value") != "").groupBy("track_id", "field").agg(F.min_by("value", "ord").alias("value"))
    return first.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def search(library: DataFrame, query: str, columns: list[str], status: str | None = None) -> DataFrame:
    """Rows that hold the query in any of the columns, without regard to case, newest first."""
    q = F.lower(F.lit(query))
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(T.text(c)), q) for c in columns])
    rows = library.where(hit) if query else library
    return rows if status is None else rows.where(F.col("status") == status)
