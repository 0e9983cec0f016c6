"""Keys, paths and stored state: properties that the given tables don't show."""

import random

import pytest
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators import store
from concord.operators.relations import ranked


def test_keys_of_wide_rows_are_dense_in_order(spark):
    """A million wide rows: partitions of the sort differ in bytes, and adaptive execution is on."""
    n = 1_000_000
    wide = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("staging_path"), F.repeat(F.sha2(F.lit("x"), 256), 1 + (F.col("id") % 7).cast("int")).alias("raw_tags"))
    table = spark.createDataFrame([(41,), (7,)], "file_id long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        got = store.numbered(wide, "staging_path", table, "file_id")
        assert got.agg(F.count("*"), F.countDistinct("file_id"), F.min("file_id"), F.max("file_id"), F.countDistinct("staging_path")).first()[:] == (n, n, 42, 41 + n, n)
        later = got.select("staging_path", "file_id").where("file_id % 1000 < 2").orderBy("file_id").collect()
        assert [r.staging_path for r in later] == sorted(r.staging_path for r in later)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_rank_within_a_key_that_spans_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "k string, i int").repartition(7), ["k"], ["i"], "n").collect()
    want = {}
    for k, i in sorted(rows):
        want.setdefault(k, []).append(i)
    assert sorted((r.k, r.n, r.i) for r in got) == sorted((k, n, i) for k, v in want.items() for n, i in enumerate(v, 1))


def test_registered_ids_follow_each_other(spark):
    files = spark.createDataFrame([(5, "old")], "file_id long, video_id string")
    tracks = spark.createDataFrame([(90, 5, "published", "published")], "track_id long, source_file_id long, stage string, status string")
    probes = spark.createDataFrame([(f"v{i % 60}", f"p{i:03}") for i in range(80)] + [("old", "p")], "video_id string, staging_path string")
    a, b = store.register_files(files, tracks, probes)
    assert sorted(r.file_id for r in a.collect()) == list(range(5, 66))
    assert sorted((r.track_id, r.source_file_id) for r in b.collect())[1:] == [(91 + i, 6 + i) for i in range(60)]


def one_by_one(tracks):
    """What looking at the files in order does."""
    held = {}
    for _, path, _, _ in tracks:
        held[path] = held.get(path, 0) + 1
    moves = []
    for track_id, path, artist, title in sorted(tracks):
        wanted = f"{artist} - {title}.aiff"
        if path is None or not artist or not title or wanted == path or held.get(wanted):
            continue
        held[path] -= 1
        held[wanted] = 1
        moves.append((track_id, path, wanted))
    return sorted(moves)


@pytest.mark.parametrize("seed", range(6))
def test_renames_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(12)]
    tracks = [(i, rng.choice([None, "lost.aiff", *(f"A - {n}.aiff" for n in names)]), rng.choice(["A", "A", "A", "", None]), rng.choice([*names, None])) for i in range(14)]
    if seed % 2:  # each path held once
        tracks = [(i, f"A - {p}.aiff", a, t) for (i, _, a, t), p in zip(tracks, rng.sample(names, 12))]
    got = store.rename_plan(spark.createDataFrame(tracks, "track_id long, published_path string, artist string, title string"))
    assert sorted(map(tuple, got.collect())) == one_by_one([(i, p, a, t) for i, p, a, t in tracks if p is not None])


def test_long_chain_and_swap(spark):
    chain = [(i, f"A - T{i + 1}.aiff", "A", f"T{i}") for i in range(40)]
    swap = [(100, "A - Y.aiff", "A", "X"), (101, "A - X.aiff", "A", "Y"), (102, "B.aiff", "A", "Z"), (103, "C.aiff", "A", "Z")]
    got = store.rename_plan(spark.createDataFrame(chain + swap, "track_id long, published_path string, artist string, title string"))
    assert sorted(map(tuple, got.collect())) == one_by_one(chain + swap)
    assert len(one_by_one(chain + swap)) == 41


def test_paths_skip_taken_numbers_and_other_names(spark):
    tracks = [(i, "", "") for i in range(9)] + [(20, "A", "B"), (21, "A", "B"), (22, "A", "B (2)"), (23, "A", "C")]
    rows = spark.createDataFrame(tracks, "track_id long, artist string, title string")
    bare = {r.track_id: r.p for r in rows.select("track_id", T.filename(F.col("artist"), F.col("title")).alias("p")).collect()}
    stem = bare[0].removesuffix(".aiff")
    there = [bare[0], f"{stem} (3).aiff", f"{stem} (4).aiff", f"{stem} (07).aiff", f"{stem} (9).aiff", None, "x"]
    got = {r.track_id: r.path for r in store.publish_paths(rows, spark.createDataFrame([(p,) for p in there], "path string")).collect()}
    assert [got[i] for i in range(9)] == [f"{stem} ({n}).aiff" for n in (2, 5, 6, 7, 8, 10, 11, 12, 13)]
    assert (got[20], got[21], got[22], got[23]) == (bare[20], bare[20].replace(".aiff", " (3).aiff"), bare[22], bare[23])
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(there)


def test_whole_run_reads_and_shuffles_each_step_once(spark, sf, monkeypatch):
    """Scans and exchanges of all steps and all four outputs of a run together."""
    from concord.operators import relations, resolve
    from concord.plans import run_queries

    plans = []
    keep = relations.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    for module in (relations, resolve, store, run_queries):
        monkeypatch.setattr(module, "written", seen)
    out = run_queries._run(spark, sf)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (out.tracks, out.candidates, out.resolved, out.queue)]
    text = "\n".join(plans)
    scans, exchanges = text.count("FileScan parquet"), sum(line.lstrip(" :+-").startswith("Exchange ") for line in text.splitlines())
    assert scans <= 37 and exchanges <= 16, (scans, exchanges)


def table(spark, tmp_path, rows, buckets=8):
    from concord.operators.state import Table

    t = Table(spark, f"file://{tmp_path}/t", "k long, v string, kept boolean", "k", buckets)
    if rows:
        t.upsert(spark.createDataFrame(rows, "k long, v string, kept boolean"))
    return t


def stored(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    rows = [(i, f"v{i}", i % 3 == 0) for i in range(100)]
    t = table(spark, tmp_path, rows)
    before = t.folders()
    new = spark.createDataFrame([(3, "new", False), (4, "new", False), (500, "new", False)], "k long, v string, kept boolean")
    touched = t.touched(new)
    assert t.upsert(new, protect=F.col("kept")) == 2
    want = {k: (k, v, p) for k, v, p in rows} | {4: (4, "new", False), 500: (500, "new", False)}
    assert stored(t) == sorted(want.values()) and stored(t, 1) == sorted(rows)
    after = t.folders()
    assert len(touched) < 8 and all((after[b] == before.get(b)) == (b not in touched) for b in after)
    assert t.put_if_absent(spark.createDataFrame([(4, "other", True), (501, "x", True)], "k long, v string, kept boolean")) == 3
    t.update(F.col("k") == 7, {"v": F.concat("v", F.lit("!"))})
    t.delete(spark.createDataFrame([(8,), (9,), (900,)], "k long"))
    want |= {501: (501, "x", True), 7: (7, "v7!", False)}
    assert stored(t) == sorted(v for k, v in want.items() if k not in (8, 9))
    assert t.update(F.lit(None).cast("boolean"), {"v": F.lit("no")}) == 6 and stored(t) == stored(t, 5)
    t.delete(spark.range(1000).withColumnRenamed("id", "k"))
    assert stored(t) == [] and t.folders() == {}


def test_second_writer_from_one_version_fails(spark, tmp_path):
    from concord.operators.state import Conflict, Table

    first = table(spark, tmp_path, [(1, "a", False), (2, "b", False)])
    second = Table(spark, first.path, "k long, v string, kept boolean", "k", 99)
    assert second.buckets == 8
    base = first.version()
    row = lambda v: spark.createDataFrame([(1, v, False)], "k long, v string, kept boolean")
    first.upsert(row("first"), base=base)
    with pytest.raises(Conflict):
        second.upsert(row("second"), base=base)
    assert stored(second) == [(1, "first", False), (2, "b", False)]
    second.upsert(row("third"))
    assert stored(first)[0] == (1, "third", False)


def test_lookup_reads_its_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "v", False) for i in range(200)])
    keys = spark.createDataFrame([(5,), (6,), (999,)], "k long")
    found = t.lookup(keys)
    read = {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert sorted(r.k for r in found.collect()) == [5, 6] and read <= {str(b) for b in t.touched(keys)} and len(read) < 8


STAGED = "track_id long, stage string, status string, error string"


def handlers(calls, fail=3):
    def of(stage):
        def run(waiting):
            calls.append(stage)
            return waiting.select("track_id", F.when((F.col("track_id") + len(stage)) % fail == 0, F.repeat(F.lit("e"), 600)).alias("error"))

        return run

    return {s: of(s) for s in ("acquired", "normalised", "classified", "resolved")}


def test_run_goes_on_where_it_was_stopped(spark, tmp_path):
    from concord.operators.runner import run_all
    from concord.operators.state import Table

    def made(name):
        t = Table(spark, f"file://{tmp_path}/{name}", STAGED, "track_id", 4)
        t.upsert(spark.createDataFrame([(i, "acquired" if i % 2 else "classified", "pending", None) for i in range(40)], STAGED))
        return t

    whole, calls = made("whole"), []
    reports = run_all(whole, handlers(calls), "r")
    assert calls == ["acquired", "normalised", "classified", "resolved"] == list(reports)
    assert sum(r["failed"] for r in reports.values()) == whole.read().where("status = 'failed'").count() > 0
    assert whole.read().where("length(error) > 500").count() == 0
    for last in calls[:-1]:
        parts, again = made(f"stopped-{last}"), []
        run_all(parts, handlers(again), "r", stop_after=last)
        assert run_all(parts, handlers(again), "r") == reports
        assert again == calls and sorted(map(tuple, parts.read().collect()), key=str) == sorted(map(tuple, whole.read().collect()), key=str)
    assert run_all(whole, handlers(calls), "r") == reports and len(calls) == 4


def test_stage_that_breaks_off_is_run_again(spark, tmp_path):
    from concord.operators.runner import run_all
    from concord.operators.state import Table

    t = Table(spark, f"file://{tmp_path}/t", STAGED, "track_id", 4)
    t.upsert(spark.createDataFrame([(i, "acquired", "pending", None) for i in range(9)], STAGED))
    calls = []
    broken = handlers(calls) | {"normalised": lambda waiting: 1 / 0}
    with pytest.raises(ZeroDivisionError):
        run_all(t, broken, "r")
    run_all(t, handlers(calls), "r")
    assert calls == ["acquired", "normalised", "classified", "resolved"]
