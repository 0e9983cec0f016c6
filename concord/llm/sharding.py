"""Sharding by fixed virtual slots (operator 1), DataFrame functions only.

A record's virtual slot is a hash of its doc_id and text, one of SLOTS for good. A job sums bytes and rows for each
slot; from these sums, as many as there are slots, the driver deals slots to shards, largest first to
the shard with the fewest bytes, and stores the map as a table with a version. Rebalancing edits the map:
it takes the fewest slots from shards that are too full and raises the version; records of all other
slots stay where they are. Adding a shard is an edit that moves slots to the new shard alone.

A slot whose bytes exceed 1 / HOT_PARTS of an average shard (one key with a large part of all rows) is dealt in
SALTS parts, whose records take turns in the order in which they were read; the turn is written with the record.

Equal texts are no group here: a record is placed by its doc_id and text, so copies of a text under other
doc_ids go to any shard, and a text that a third of all records hold doesn't make a shard larger.

A record's place in its shard counts from 0 without gaps: slots of a shard follow each other, records of
a slot follow by doc_id.

Law: "bytes", sizes near equal. Size: UTF-8 bytes of the text plus RECORD_BYTES.

Defined cases: a null text has no bytes and the checksum of an empty one; a null doc_id is a key like
any other; repeated rows each have a place; an empty table gives a map whose slots are all of no bytes and
no rows; other columns are carried along by place().
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common

SLOTS = 8192
SALTS = 16
HOT_PARTS = 8
RECORD_BYTES = 8

#: Columns of documents with these names give way.
OWN = ("text", "size", "text_crc32", "virtual_slot", "salt", "shard", "slot", "map_version", "version", "n", "before", "nth")
MAP = "slot int, salt int, shard int, bytes long, rows long, version int"


@dataclass(frozen=True)
class Unit:
    """What moves as one: a slot, or a part of a hot slot (salt from 0; -1: the whole slot)."""

    slot: int
    salt: int
    bytes: int
    rows: int


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32, virtual_slot and salt; the text goes."""
    binary = common.whole_text(F.col("text")).cast("binary")
    return docs.select(
        *[c for c in docs.columns if c not in OWN],
        (F.octet_length(binary) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), binary), F.lit(slots)).cast("int").alias("virtual_slot"),
        (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"),
    )


def units(rows: DataFrame, shards: int, slots: int = SLOTS) -> list[Unit]:
    """Bytes and rows of every slot, empty ones too; the list has slots * SALTS entries at most."""
    sums = rows.groupBy("virtual_slot", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    whole = Window.partitionBy("virtual_slot")
    hot = F.sum("bytes").over(whole) > total / shards / HOT_PARTS
    dealt = sums.withColumn("salt", F.when(hot, F.col("salt")).otherwise(-1)).groupBy("virtual_slot", "salt").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    found = [Unit(r.virtual_slot, r.salt, r.bytes, r.rows) for r in dealt.collect()]
    seen = {u.slot for u in found}
    return sorted(found + [Unit(s, -1, 0, 0) for s in range(slots) if s not in seen], key=lambda u: (u.slot, u.salt))


def deal(found: list[Unit], shards: int) -> dict[Unit, int]:
    """Largest unit first, each to the shard with the fewest bytes (then rows, then number)."""
    heap = [(0, 0, k) for k in range(shards)]
    out = {}
    for u in sorted(found, key=lambda u: (-u.bytes, -u.rows, u.slot, u.salt)):
        held, rows, k = heapq.heappop(heap)
        out[u] = k
        heapq.heappush(heap, (held + u.bytes, rows + u.rows + 1, k))
    return out


def rebalance(before: dict[tuple[int, int], int], found: list[Unit], shards: int, tolerance: float = 0.01) -> dict[Unit, int]:
    """The map edited for new sums or more shards: units leave shards above the mean by more than the tolerance.

    Units new to the map go where there is most room. As no unit goes to a shard that is above the mean,
    growing by a shard fills that one alone when the others were even.
    """
    held = [0] * shards
    out: dict[Unit, int] = {}
    for u in found:
        k = before.get((u.slot, u.salt), before.get((u.slot, -1)))
        if k is not None and k < shards:
            out[u] = k
            held[k] += u.bytes
    for u in sorted((u for u in found if u not in out), key=lambda u: (-u.bytes, u.slot, u.salt)):
        k = min(range(shards), key=lambda k: (held[k], k))
        out[u] = k
        held[k] += u.bytes
    mean = sum(held) / shards
    by_shard: dict[int, list[Unit]] = {k: [] for k in range(shards)}
    for u, k in out.items():
        by_shard[k].append(u)
    for k in range(shards):
        for u in sorted(by_shard[k], key=lambda u: (-u.bytes, u.slot, u.salt)):
            if held[k] <= mean * (1 + tolerance):
                break
            to = min(range(shards), key=lambda j: (held[j], j))
            if u.bytes and held[to] + u.bytes <= mean and held[k] - u.bytes >= mean * (1 - tolerance):
                out[u] = to
                held[k] -= u.bytes
                held[to] += u.bytes
    return out


def store(spark: SparkSession, dealt: dict[Unit, int], folder: str, version: int) -> DataFrame:
    """Write a version of the map beside the others and read it back."""
    rows = [(u.slot, u.salt, k, u.bytes, u.rows, version) for u, k in sorted(dealt.items(), key=lambda x: (x[0].slot, x[0].salt))]
    path = f"{folder}/version={version}"
    spark.createDataFrame(rows, MAP).drop("version").coalesce(1).write.parquet(path)
    return load(spark, folder, version)


def load(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP.rpartition(",")[0]).parquet(f"{folder}/version={version}").withColumn("version", F.lit(version))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows, from with_slots(), with shard, slot (place in the shard) and map_version.

    Records are numbered within a slot and salt, so no task holds a whole shard or hot slot; the
    numbers of slots and salts before are added from their counts.
    """
    here = Window.partitionBy("virtual_slot", "salt").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(here) - 1)
    counts = rows.groupBy("virtual_slot", "salt").agg(F.count("*").alias("n"))
    whole = slot_map.where(F.col("salt") == -1).select(F.col("slot").alias("virtual_slot"), "shard", "version")
    parts = slot_map.where(F.col("salt") >= 0).select(F.col("slot").alias("virtual_slot"), "salt", "shard", "version")
    dealt = counts.join(F.broadcast(whole), "virtual_slot").select("virtual_slot", "salt", "n", "shard", "version").unionByName(counts.join(F.broadcast(parts), ["virtual_slot", "salt"]))
    # At most slots * SALTS rows in all, so a shard's are few.
    before = Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("virtual_slot", "salt", "shard", "version", "before")
    out = ranked.join(F.broadcast(starts), ["virtual_slot", "salt"])
    return out.withColumn("slot", (F.col("before") + F.col("nth")).cast("long")).withColumnRenamed("version", "map_version").drop("before", "nth")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None, version: int = 1) -> DataFrame:
    """Deal all docs, store the map's version, and place every record."""
    spark = docs.sparkSession
    rows = common.materialize(with_slots(docs, slots), "slotted")
    slot_map = store(spark, deal(units(rows, shards, slots), shards), folder or common.fresh_path(spark, "slot-map"), version)
    return place(rows, slot_map)


def reshard(docs: DataFrame, shards: int, folder: str, version: int, tolerance: float = 0.01) -> DataFrame:
    """Place all docs, which may have changed, by the stored version of the map edited for their sums and the number of shards; the edited map is stored as the next version."""
    spark = docs.sparkSession
    before = load(spark, folder, version)
    slots = int(before.agg(F.max("slot")).first()[0]) + 1
    rows = common.materialize(with_slots(docs, slots), "slotted")
    held = {(r.slot, r.salt): r.shard for r in before.collect()}  # slots * SALTS rows at most
    return place(rows, store(spark, rebalance(held, units(rows, shards, slots), shards, tolerance), folder, version + 1))


@common.finished
def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(common.documents(spark, sf_dir).select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
