"""Files and caches as sources: properties that the given tables don't show."""

import hashlib
import os
import wave

from pyspark.sql import functions as F

from concord.operators import store
from concord.sources import catalogues, files


def test_local_files_are_hashed_and_probed(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with wave.open(str(tmp_path / "deep" / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(44100), w.writeframes(bytes(4 * 44100 * 3))
    (tmp_path / "b.aiff").write_bytes(b"FORM\0\0\0\0AIFF" + bytes(9))
    (tmp_path / "empty.mp3").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no")
    rows = {os.path.basename(r.path): r for r in files.local(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == ["a.wav", "b.aiff"]
    assert all(r.sha256 == hashlib.sha256(next(tmp_path.rglob(n)).read_bytes()).hexdigest() for n, r in rows.items())
    assert rows["a.wav"].wav.asDict() == {"channels": 2, "sample_rate": 44100, "bits": 16, "duration_s": 3.0}
    assert (rows["a.wav"].kind, rows["b.aiff"].kind, rows["b.aiff"].wav) == ("wav", "aiff", None)
    probes = files.probes(files.local(spark, f"file://{tmp_path}"))
    none = spark.createDataFrame([], "file_id long, video_id string")
    registered, tracks = store.register_files(none, spark.createDataFrame([], "track_id long, source_file_id long, stage string, status string"), probes)
    assert registered.count() == tracks.count() == 2 and registered.where("bitrate = 1411200").count() == 1


def test_files_unchanged_since_are_not_opened(spark, tmp_path):
    for name, changed in (("old.wav", 1_000_000_000), ("new.wav", 1_700_000_000)):
        (tmp_path / name).write_bytes(name.encode())
        os.utime(tmp_path / name, (changed, changed))
    found = files.local(spark, f"file://{tmp_path}", since="2020-01-01T00:00:00")
    assert [os.path.basename(p) for p in found.inputFiles()] == ["new.wav"] and found.count() == 1


def test_second_run_through_a_cache_misses_nothing(spark, tmp_path):
    cache, asked = catalogues.cache(spark, f"file://{tmp_path}/c", 4), []

    def fetch(missing):
        asked.append(missing.count())
        return missing.select("key", F.lit("s").alias("source"), F.concat(F.lit("r"), "key").alias("response"))

    requests = spark.createDataFrame([(str(i % 30),) for i in range(60)], "key string")
    for want in (30, 0):
        answers, hits = catalogues.through_cache(requests, cache, fetch)
        assert sorted((r.key, r.response) for r in answers.collect()) == sorted((str(i), f"r{i}") for i in range(30))
        assert asked[-1] == want and hits.where("NOT hit").count() == want
    one = cache.lookup(spark.createDataFrame([("7",)], "key string"))
    assert len({f.split("_bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1 and one.first().response == "r7"
