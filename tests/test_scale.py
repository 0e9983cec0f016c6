"""Costly work is dealt over tasks, however its input is cut into files."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from concord import registry, vocab
from concord.operators import fuse, identity, relations, resolve, store
from concord.sources import catalogues, files


@pytest.fixture
def one_file(spark, tmp_path):
    path = f"file://{tmp_path}/tracks"
    spark.range(40).select(F.col("id").alias("track_id"), F.lit("A").alias("artist"), F.concat(F.lit("T"), F.col("id") % 9).alias("title"), F.concat(F.lit("old"), "id").alias("published_path")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert rows.rdd.getNumPartitions() == 1
    return rows


@pytest.fixture
def kept(monkeypatch):
    """Partitions of what the store writes on the way, by name."""
    seen = {}

    def written(df, name):
        seen.setdefault(name, df.rdd.getNumPartitions())
        return relations.written(df, name)

    monkeypatch.setattr(store, "written", written)
    return seen


def test_names_of_one_file_are_made_in_many_tasks(one_file, kept):
    assert store.publish_paths(one_file).select("path").distinct().count() == 40
    assert kept["names"] > 1


def test_moves_of_one_file_are_planned_in_many_tasks(one_file, kept):
    assert store.rename_plan(one_file).count() == 9
    assert kept["named"] > 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_recordings_release_and_date_are_chosen_within_its_row(spark):
    rows = spark.range(3).select("id", F.from_json(F.lit('{"id":"m","title":"T"}'), catalogues.MUSICBRAINZ).alias("recording"))
    got = catalogues.musicbrainz(rows, ["id"])
    assert "Exchange" not in plan(got) and got.where("field = 'title'").count() == 3


@pytest.mark.parametrize(("name", "key"), [("rival_gaps", "l_orderkey"), ("best_recordings", "l_orderkey"), ("evaluated_queries", "l_partkey")])
def test_partitions_follow_the_input(spark, sf, monkeypatch, name, key):
    monkeypatch.setattr(relations, "DEAL_BYTES", 5_000)
    assert relations.partitions_for(spark.read.parquet(f"{sf}/lineitem.parquet")) > 10
    made = plan(registry.queries()[name](spark, sf))
    assert max(int(x) for x in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", made)) > 10
    assert name != "best_recordings" or "album_artist" not in made  # only what is returned


def test_downloads_of_one_file_are_cleaned_in_many_tasks(spark):
    downloads = spark.createDataFrame([(1, "A", "T", 1.0)], "track_id long, channel string, raw_title string, duration_s double").coalesce(1)
    assert resolve.cleaned(downloads).rdd.getNumPartitions() > 1


def test_small_files_are_one_entry_each(spark, tmp_path, monkeypatch):
    from concord.plans import state_queries

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("a\rb\nc"), "id")).alias("text"))
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(state_queries, "shared_folder", lambda spark, name: f"file://{tmp_path}/shared/{name}")
    found = {r.folder: r for r in state_queries.local_files(spark, f"file://{tmp_path}").collect()}
    entries = [p.relative_to(tmp_path / "shared/files") for p in (tmp_path / "shared/files").rglob("*") if p.is_file()]
    assert len(entries) == len(found) == 7  # no checksums beside them, each of which cost a process
    first = "".join((f"a b c{i}" if i % 7 else "") + "\n" for i in range(16)).encode()
    assert (found["part=0"].sha256, found["part=0"].length) == (hashlib.sha256(first).hexdigest(), len(first))


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"part={k}").mkdir()
        (tmp_path / f"part={k}" / "a.txt").write_bytes(b"x")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listed", "")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert files.local(spark, f"file://{tmp_path}", suffixes=(".txt",)).count() == 60
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism < 60
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_no_documents_are_no_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert files.put_lines(spark.createDataFrame([], "name string, line string"), folder) == 0
    assert files.local(spark, folder, suffixes=(".txt",)).count() == 0


def test_decisions_meet_old_ones_in_parts_that_follow_the_input(spark, sf, monkeypatch):
    monkeypatch.setattr(relations, "DEAL_BYTES", 5_000)
    made = plan(registry.queries()["fuse_rearbitrate"](spark, sf))
    parts = [int(x) for x in re.findall(r"hashpartitioning\(track_id#\d+L?, field#\d+, (\d+)\)", made)]
    assert len(parts) >= 2 and min(parts) > 10


def test_of_a_field_that_goes_by_place_one_candidate_is_kept(spark):
    rows = [(1, "pop", "title", "A - B (Foo Mix)", "spotify", 0), (1, "pop", "title", "A - B", "itunes", 1), (1, "pop", "title", "A – B [Bar Edit]", "discogs", 2), (1, "pop", "genre", "Rock", "itunes", 3), (1, "pop", "genre", "Pop", "discogs", 4), (1, "pop", "album", "X", "itunes", 5), (1, "pop", "album", "Y", "discogs", 6)]
    kept = fuse.with_albums(spark.createDataFrame(rows, "track_id long, family string, field string, value string, source string, ord long"), vocab.default_ranking(spark))
    assert sorted((r.field, r.value) for r in kept.collect()) == [("album", "X"), ("album", "Y"), ("genre", "Rock"), ("title", "A - B (Foo Mix)")]


def test_files_are_dealt_four_times_to_find_duplicates(spark, sf, monkeypatch):
    monkeypatch.setattr(relations, "DEAL_BYTES", 5_000)
    made = plan(registry.queries()["duplicate_files"](spark, sf))
    parts = [int(x) for x in re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", made)]
    assert made.count("Exchange ") == 4 == len(parts) and min(parts) > 4  # the session's


def test_a_frequent_key_meets_in_many_windows(spark, monkeypatch):
    monkeypatch.setattr(identity, "COMMON", 100)
    files = spark.range(1000).selectExpr("id AS track_id", "id / 10.0D AS duration_s", "1 AS bitrate", "false AS is_art_track", "IF(id < 900, 'A', 'B' || id) AS acoustid")
    made = identity.duplicates(files, ["acoustid"])
    assert re.search(r"hashpartitioning\([^)]*part#", plan(made)) and made.count() > 0
    monkeypatch.setattr(identity, "COMMON", 1000)
    assert "part#" not in plan(identity.duplicates(files, ["acoustid"]))
