"""A table that is changed in place: hash buckets of its key, versions, and commits that notice another writer.

A version is a manifest, a small file that names one folder for each bucket that holds rows. A change reads and writes the buckets
of the keys it touches; the other buckets' folders go over to the next manifest as they are. A manifest is made only
if none of its number is there, so of two writers that began from one version the second fails and leaves what the first has made;
its own folders are named nowhere. Readers see the version that they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.relations import insert_or_ignore, upsert


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


class Table:
    """Rows by key below one path. buckets is fixed when the table is made: some 100 MB of rows a bucket is a good size."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        made = self._manifest(self.version()) if self.version() else None
        self.buckets = made["buckets"] if made else buckets

    # --- versions

    def _fs(self, path: str) -> tuple[Any, Any]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifests")
        found = sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []
        if found and not self._text(f"{self.path}/manifests/{found[-1]}").endswith("\n"):
            found.pop()  # not yet written out
        return found

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(self._text(f"{self.path}/manifests/{version}")) if version else {"buckets": self.buckets, "folders": {}, "note": None}

    def note(self, version: int) -> Any:
        """What the writer of a version said of it."""
        return self._manifest(version)["note"]

    def folders(self, version: int | None = None) -> dict[int, str]:
        found = self._manifest(self.version() if version is None else version)["folders"]
        return {int(k): v for k, v in found.items()}

    def _commit(self, base: int, folders: dict[int, str], note: Any) -> int:
        fs, at = self._fs(f"{self.path}/manifests/{base + 1}")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as error:
            if fs.exists(at):
                raise Conflict(f"version {base + 1} of {self.path} is there already") from error
            raise
        stream.write((json.dumps({"buckets": self.buckets, "folders": folders, "note": note}) + "\n").encode())
        stream.close()
        return base + 1

    # --- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(version).values())

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that keys fall into: as many as the table has, at most."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; no other bucket is read."""
        folders = self.folders()
        here = self._read(folders[b] for b in self.touched(keys) if b in folders)
        return here.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def change(self, touched: list[int], make: Callable[[DataFrame], DataFrame], base: int | None = None, note: Any = None) -> int:
        """The next version, in which the touched buckets hold what make gives for their rows; Conflict if base isn't the last one."""
        base = self.version() if base is None else base
        folders = self.folders(base)
        name = f"data/{uuid.uuid4().hex}"
        if touched:
            rows = make(self._read(folders[b] for b in touched if b in folders)).select(*self.schema.names)
            rows.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            fs, at = self._fs(f"{self.path}/{name}")
            written = {int(s.getPath().getName().removeprefix("_bucket=")) for s in fs.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
            if not written <= set(touched):
                raise ValueError("rows outside the touched buckets")
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in written}
        return self._commit(base, folders, note)

    def upsert(self, new: DataFrame, protect: Column | None = None, base: int | None = None, note: Any = None) -> int:
        """New rows in place of those of their keys, but for rows that are protected; a key is in new once."""
        return self.change(self.touched(new), lambda old: upsert(old, new, [self.key], protect), base, note)

    def put_if_absent(self, new: DataFrame, base: int | None = None) -> int:
        """New rows whose keys aren't there; a key is in new once."""
        return self.change(self.touched(new), lambda old: insert_or_ignore(old, new, [self.key]), base)

    def update(self, where: Column, values: dict[str, Column], base: int | None = None) -> int:
        """Columns set in all rows that meet a condition; buckets without such rows stay."""
        base = self.version() if base is None else base
        hit = F.coalesce(where, F.lit(False))
        return self.change(self.touched(self.read(base).where(hit)), lambda old: old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        return self.change(self.touched(keys), lambda old: old.join(keys.select(self.key), self.key, "left_anti"), base)
