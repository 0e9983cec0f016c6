"""Benchmark decontamination by winnowing (operator 6), DataFrame functions only.

Of every K consecutive words a hash is taken; the least of SPAN - K + 1 consecutive hashes is the fingerprint
of the window of SPAN words that they span. Equal windows have equal fingerprints, so every window that a
document shares with an item starts at a place whose fingerprint is among the items': no shared span is missed.
Fingerprints of documents and items are joined, the windows at the places found are compared with the items'
windows word by word, and the words of equal ones are hit; neighbouring windows add up to the whole shared span.

A text's words are laid beside themselves, shifted by one to SPAN - 1 places, so each window is a row of its words
for a moment, and all hashing is generated code; only rows with a shared fingerprint leave the scan, and one for
each document. CHUNK words are laid out at a time, so a very long text needs no more memory for it.

Items of fewer than SPAN words are one window of their own length, whose hash is looked up at every place of
every document; that work arises only for lengths that occur.

The items' fingerprints are written first, so their number is known: up to FEW are sent to all executors. Beyond
that, documents that share any are found first, by a join on each document's distinct fingerprints. Windows are
joined with sets of items, each of which is listed once, so a passage of many items and many documents makes a
row for each document and window, not for each item too.

Defined cases: a null or empty text has no words and no hits; items without words are passed over;
repeated rows get equal results each; an empty table of items leaves all documents clean, an empty table of
documents gives no rows; other columns are carried along by flag() and ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm import common

SPAN = 10
K = 5
#: Fingerprints that are sent to all executors at most, about 32 MB.
FEW = 1_000_000
CHUNK = 4096
KEY = ("doc_id", "text_hash")


def words_of(text: Column) -> Column:
    text = common.whole_text(text)
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(common.ascii_lower(text))
    return F.array_remove(F.split(lower, common.BETWEEN_WORDS), "")


def fingerprint(words: list[Column], k: int) -> Column:
    """The least hash of k consecutive words in a window, or of all its words if they are fewer."""
    if len(words) <= k:
        return F.xxhash64(*words)
    grams = [F.xxhash64(*words[i : i + k]) for i in range(len(words) - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def windows(rows: DataFrame, n: int, k: int, *kept: str) -> DataFrame:
    """kept, n_words, place (from 0), hash, window (its words, joined) of every place of a text's words; rows has text.

    Where fewer than n words are left, hash and window are null; a text without words has one row, whose place is 0.
    """
    of_text = rows.select(*kept, words_of(F.col("text")).alias("__words")).withColumn("n_words", F.size("__words").cast("long"))
    chunks = of_text.withColumn("__first", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__words") - 1, F.lit(0)), F.lit(CHUNK))))
    shifted = [F.slice("__words", F.col("__first") + (i + 1), F.lit(CHUNK)).alias(f"w{i}") for i in range(n)]
    laid = chunks.select(*kept, "n_words", "__first", F.posexplode_outer(F.arrays_zip(*shifted)).alias("__at", "__w"))
    words = [F.col(f"__w.w{i}") for i in range(n)]
    place = F.col("__first") + F.coalesce("__at", F.lit(0))
    whole = place + n <= F.col("n_words")
    return laid.select(*kept, "n_words", place.alias("place"), F.when(whole, fingerprint(words, k)).alias("hash"), F.when(whole, F.concat_ws(" ", *words)).alias("window"))


def item_windows(items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(n, window, hash, set_id) of every window of any item, and (set_id, item_ids) of each set of items that a window is in."""
    found = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"), F.least(F.size(words_of(F.col("text"))), F.lit(span)).alias("n"))
    short = sorted(r.n for r in found.where(F.col("n").between(1, span - 1)).select("n").distinct().collect())  # at most span - 1
    each = [windows(found.where(F.col("n") == n), n, k, "item_id", "n").where(F.col("hash").isNotNull()) for n in [*short, span]]
    sets = reduce(DataFrame.unionByName, each).groupBy("n", "window", "hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    table = common.materialize(sets.withColumn("set_id", F.sha2(F.to_json("item_ids"), 256)), "item-windows")
    return table.select("n", "window", "hash", "set_id"), table.groupBy("set_id").agg(F.first("item_ids").alias("item_ids"))


def scan(docs: DataFrame, table: DataFrame, span: int, k: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, text_hash, n_words of every row of docs; KEY, n, start, set_id of every window of table found in docs)."""
    keyed = docs.withColumn("text_hash", F.xxhash64(common.whole_text(F.col("text"))))
    carried = F.struct(*[F.col(c) for c in kept])
    found, base = None, None
    for n in sorted({span, *(r.n for r in table.select("n").distinct().collect())}):
        of_length = table.where(F.col("n") == n).drop("n")
        wanted = common.materialize(of_length.select(F.col("hash").alias("wanted")).distinct(), "item-fingerprints")
        places, keep = keyed.select(*KEY, carried.alias("carried"), "text"), F.col("wanted").isNotNull()
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
            keep = keep | (F.col("place") == 0) if n == span else keep
        else:
            some = windows(places, n, k, *KEY).where(F.col("hash").isNotNull()).select(*KEY, "hash").distinct()
            some = common.materialize(some.join(wanted, F.col("hash") == F.col("wanted"), "left_semi").select(*KEY).distinct(), "shared-fingerprints")
            if n == span:
                base = places.select("carried", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
            places = join_key(places, some)
        rows = windows(places, n, k, *KEY, "carried").join(wanted, F.col("hash") == F.col("wanted"), "left").where(keep)
        first = F.col("place") == 0
        rows = rows.select(*KEY, F.when(first, F.col("carried")).alias("carried"), "n_words", (F.col("place") + 1).alias("start"), F.when(F.col("wanted").isNotNull(), F.col("window")).alias("window"))
        rows = common.materialize(rows, "shared-places")
        if n == span and base is None:
            base = rows.where("start = 1")
        here = rows.where("window IS NOT NULL").select(*KEY, "start", "window").join(of_length.drop("hash"), "window").select(*KEY, F.lit(n).alias("n"), "start", "set_id")
        found = here if found is None else found.unionByName(here)
    return base.select("carried.*", "text_hash", "n_words"), found


def join_key(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the other columns of found, of the same key; sent to all executors if few."""
    renamed = found.withColumnsRenamed({c: f"__{c}" for c in KEY})
    if found.count() <= common.FEW_KEYS // 10:
        renamed = F.broadcast(renamed)
    same = rows["doc_id"].eqNullSafe(F.col("__doc_id")) & (rows["text_hash"] == F.col("__text_hash"))
    return rows.join(renamed, same, how).drop("__doc_id", "__text_hash")


def _covered(spans: Column) -> Column:
    """Places inside any of the spans (start, n)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        (acc["total"] + F.greatest(s["start"] + s["n"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("total"),
    )
    return F.aggregate(F.array_sort(spans), zero, step)["total"]


def _of_documents(found: DataFrame, sets: DataFrame) -> DataFrame:
    """KEY, n_hit, item_ids (sorted) of the documents that hold a window of an item."""
    per_doc = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.collect_set("set_id")).alias("set_ids"))
    per_doc = common.materialize(per_doc.select(*KEY, _covered(F.col("spans")).alias("n_hit"), "set_ids"), "hit-sets")
    # Documents with the same passages have the same sets: their items are brought together once.
    mixed = per_doc.select("set_ids").distinct().select("set_ids", F.explode("set_ids").alias("set_id")).join(sets, "set_id")
    mixed = mixed.select("set_ids", F.explode("item_ids").alias("item_id")).groupBy("set_ids").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return per_doc.join(mixed, "set_ids").select(*KEY, "n_hit", "item_ids")


@common.finished
def flag(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """All columns of docs but text, with n_words, n_hit and item_ids in place of any of these names."""
    own = ("text", "text_hash", "n_words", "n_hit", "item_ids")
    kept = [c for c in docs.columns if c not in own]
    table, sets = item_windows(items, span, k)
    base, found = scan(docs, table, span, k, kept)
    hits = common.materialize(_of_documents(found, sets), "hits")
    rows = join_key(base, hits, "left")
    return rows.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    table, _ = item_windows(items, span, k)
    _, found = scan(docs.select("doc_id", "text"), table, span, k, ["doc_id"])
    return common.without(docs, found.select(*KEY))


def digest(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(flag(common.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(words) - least(len(words), 10) + 2)) u(i) WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, i AS start, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM d, lengths, unnest(range(1, len(words) - n + 2)) u(i) WHERE len(words) >= n),
m AS (SELECT doc_id, item_id, n, start FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, start FROM m), unnest(range(start, start + n)) v(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
