"""Files below a folder as rows: content address and what their first bytes say, in one reading; and rows as small files."""

from __future__ import annotations

import itertools
import operator
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a file of a kind has at an offset; the first that fits. Fixed values of the formats.
MAGIC = (
    ("wav", 8, "57415645"), ("aiff", 8, "41494646"), ("aiff", 8, "41494643"), ("flac", 0, "664C6143"), ("ogg", 0, "4F676753"),
    ("mp3", 0, "494433"), ("mp4", 4, "66747970"), ("webm", 0, "1A45DFA3"), ("json", 0, "7B"),
)


def _bytes(content: Column, at: int, n: int) -> Column:
    return F.substring(content, at + 1, n)


def _little(content: Column, at: int, n: int) -> Column:
    """An unsigned number of n bytes, the lowest first."""
    pairs = [F.hex(_bytes(content, at + k, 1)) for k in reversed(range(n))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def kind_of(content: Column) -> Column:
    out = F.lit("text")
    for kind, at, magic in reversed(MAGIC):
        out = F.when(F.hex(_bytes(content, at, len(magic) // 2)) == magic, kind).otherwise(out)
    return out


def wav_header(content: Column) -> Column:
    """Struct of channels, sample_rate, bits and duration_s of a WAV file whose format comes first, as writers put it; else null."""
    plain = (kind_of(content) == "wav") & (F.hex(_bytes(content, 12, 4)) == "666D7420") & (F.length(content) >= 44)
    per_second = _little(content, 28, 4)
    size = F.length(content) - 28 - _little(content, 16, 4)  # what follows the header of the data
    return F.when(plain, F.struct(
        _little(content, 22, 2).cast("int").alias("channels"), _little(content, 24, 4).cast("int").alias("sample_rate"), _little(content, 34, 2).cast("int").alias("bits"),
        F.when(per_second > 0, F.round(size / per_second, 3)).alias("duration_s"),
    ))


def local(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".wav", ".aiff", ".flac", ".mp3", ".m4a"), since: str | None = None) -> DataFrame:
    """path, modified, length, sha256, kind, wav of the files below a folder with one of the suffixes.

    since (a time as text): files that were changed before aren't opened. A file is read once, for its hash and its header together;
    the content itself leaves no task. Files that vanish meanwhile fail the read, as a listing of files that are gone is no answer; the reader
    passes over empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    if since:
        reader = reader.option("modifiedAfter", since)
    content = F.col("content")
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"  # else a task for each folder, up to 10,000 of a millisecond's work
    tasks = spark.conf.get(listing)
    spark.conf.set(listing, str(min(int(tasks), 4 * spark.sparkContext.defaultParallelism)))
    try:
        found = reader.load(folder)
    finally:
        spark.conf.set(listing, tasks)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2(content, 256).alias("sha256"), kind_of(content).alias("kind"), wav_header(content).alias("wav"))


def _opened(uri: str):
    """(file system, path) of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put_lines(rows: DataFrame, folder: str) -> int:
    """Write rows (name, line) as files <folder>/<name>/lines.txt, and return how many; rows of a name come one after another in one partition.

    Tasks write their files themselves. Spark's writer takes a process of its own for the permissions of each local file and of its
    checksum, so many small files took it some 26 ms each. A file gets its name when it is whole, so a task that runs again
    leaves one of each; lines are written as they come, however many a file has.
    """
    fs, base = _opened(folder)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        lines, n = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())), 0
        for name, of_name in itertools.groupby(lines, operator.itemgetter(0)):
            fs.create_dir(f"{base}/{name}", recursive=True)
            unfinished = f"{base}/{name}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(unfinished) as out:
                for _, line in of_name:
                    out.write(line + b"\n")
            fs.move(unfinished, f"{base}/{name}/lines.txt")
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return rows.select("name", "line").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def probes(found: DataFrame) -> DataFrame:
    """Rows of local() as store.register_files() takes them: origin local, no video, the path for both paths."""
    return found.select(
        F.lit("local").alias("origin"), F.lit(None).cast("string").alias("video_id"), F.col("path").alias("local_path"), F.col("path").alias("staging_path"), "sha256",
        F.coalesce("wav.duration_s", F.lit(0.0)).alias("duration_s"), F.col("kind").alias("codec"), F.coalesce(F.col("wav.sample_rate") * F.col("wav.channels") * F.col("wav.bits"), F.lit(0)).alias("bitrate"), F.coalesce("wav.sample_rate", F.lit(0)).alias("sample_rate"),
    )
