r"""Phrases whose words stand together more often than they stand apart, by bucket counts and Apriori (operator 13).

A pass over the texts for each length of phrase:
1. Pass 1 counts all words exactly and, in the same reading, the two-word phrases by bucket of their hash.
2. Pass k counts exactly those phrases of k words whose two parts of k - 1 words are frequent and whose own bucket is;
   in the same reading it counts phrases of k + 1 words by bucket, those whose two parts of k words are counted.
What is frequent goes to the workers as a bitmap: a bit for each bucket that holds the least count, and a bit for the
hash of each phrase known to be frequent. A bit never misses a frequent phrase, so the filters only save counting; a phrase that
passes by chance is counted and then dropped for its count. A bitmap has about a bit for eight bytes of text, so that rare phrases
leave most buckets below the least count at any size, and 2**MOST_BITS bits (128 MB) at most.

A worker counts a slice of words with numpy, over numbers that it gives to words; its vocabulary and its counts are
written and emptied when they grow beyond MOST_WORDS and MOST_PHRASES. Spark adds up the parts by (lang, phrase). A part's
buckets are three bytes each for those that hold anything, in blocks; blocks are added up in two steps, so no group
holds more than FOLD parts in the first step or one block of each of these.

Defined cases: a null or empty text has no words; a null lang is "und", together with rows that say so; a word is
whatever stands between the separators, control characters included; repeated rows count again; an empty table gives no
rows; ties in score and count go by the phrase in UTF-8 byte order; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common

LEAST = 10
#: In percent of a phrase's count: a longer candidate with as many stands for it.
ABSORBED = 50
TOP = 2000
LEAST_BITS, MOST_BITS = 20, 30
BYTES_PER_BIT = 8
#: Bits of one bitmap of Spark's functions, and buckets of a part of a block, whose places take two bytes.
BLOCK = 32768
#: Such parts in a block of buckets.
PARTS = 32
FOLD = 256
SLICE = 400_000
CHUNK_BYTES = 2 << 20
MOST_WORDS, MOST_PHRASES = 300_000, 600_000
#: Bits for a word's number in a phrase's key; a vocabulary has MOST_WORDS and a slice at most.
NUMBER_BITS = 21
BREAK = b"."
_FOLDED = bytes.maketrans(common.UPPER.encode() + b",;:!?\x0a\x0b\x0c\x0d\x09", common.LOWER.encode() + b"." * 9 + b" ")

COUNTED = "lang string, phrase string, n long, part int, block int, counts binary"
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])


class Vocabulary(dict):
    """Numbers for the words of a language; 0 is the break between pieces."""

    def __init__(self, lang: str) -> None:
        import xxhash

        self.digest = xxhash.xxh64_intdigest
        self.seed = self.digest(lang.encode(), 42)
        self.words, self.hashes = [BREAK], np.zeros(1, np.uint64)
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if new := self.words[len(self.hashes) :]:
            self.hashes = np.concatenate([self.hashes, np.array([self.digest(w, self.seed) for w in new], np.uint64)])
        return out


def slices(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words and breaks, how many of them are this slice's own); the overlap after these belongs to the next one."""
    waiting: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def cut() -> Iterator[tuple[str, list[bytes], int]]:
        for lang, texts in waiting.items():
            tokens = BREAK.join(texts).translate(_FOLDED).replace(BREAK, b" . ").split()
            for at in range(0, len(tokens), SLICE):
                yield lang, tokens[at : at + SLICE + overlap], min(SLICE, len(tokens) - at)
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            waiting[lang].append(text.encode())
            size += len(waiting[lang][-1])
            if size >= CHUNK_BYTES:
                yield from cut()
                size = 0
    yield from cut()


def _next_hash(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    return ((shorter << np.uint64(23)) | (shorter >> np.uint64(41))) ^ last


def hash_of(lang: Column, words: Column, k: int) -> Column:
    """The same hash of an array of k words, in Spark."""
    out = F.lit(None).cast("long")
    for i in range(k):
        one = F.xxhash64(lang, F.get(words, F.lit(i)))
        out = one if i == 0 else F.shiftleft(out, 23).bitwiseOR(F.shiftrightunsigned(out, 41)).bitwiseXOR(one)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bit of each hash; a bitmap has a power of two of bytes, the lowest bit of each first."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class Counts:
    """Counts of phrases of k words, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        keys, times = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, where, np.concatenate(self.times))
        self.keys, self.times, self.size = [keys], [times], len(keys)
        return keys, times

    def clear(self) -> None:
        self.keys, self.times, self.size = [], [], 0


def packed(buckets: np.ndarray, times: np.ndarray, most: int) -> tuple[list[int], list[bytes]]:
    """Blocks of ascending buckets with their counts, which stop at most: how many each part of the block has, then their places, then their counts."""
    parts, blocks = buckets // BLOCK, buckets // (BLOCK * PARTS)
    starts = np.flatnonzero(np.diff(blocks, prepend=-1))
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(buckets)], strict=True):
        sizes = np.bincount(parts[lo:hi] % PARTS, minlength=PARTS).astype("<u4")
        out.append(sizes.tobytes() + (buckets[lo:hi] % BLOCK).astype("<u2").tobytes() + np.minimum(times[lo:hi], most).astype("u1").tobytes())
    return blocks[starts].tolist(), out


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, counts)."""
    sizes = np.frombuffer(block, "<u4", PARTS)
    n = int(sizes.sum())
    places = np.frombuffer(block, "<u2", n, 4 * PARTS).astype(np.int64)
    return places + np.repeat(np.arange(PARTS) * BLOCK, sizes), np.frombuffer(block, "u1", n, 4 * PARTS + 2 * n)


def count(docs: DataFrame, k: int, bucket_next: bool, least: int, bits: int, frequent: np.ndarray | None = None, buckets: np.ndarray | None = None) -> DataFrame:
    """Parts of pass k, written to the shared folder: rows with phrase and n, and rows with block and counts of the next length's buckets.

    docs has lang and text without nulls. Counts of a bucket stop at the least count, as more makes no difference.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, buckets))  # bitmaps of bounded size
    mask = np.uint64((1 << bits) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frequent, buckets = sent.value
        vocabularies: dict[str, Vocabulary] = {}
        counts: dict[str, Counts] = defaultdict(Counts)
        in_buckets = Counts()

        def bucketed() -> Iterator[pa.RecordBatch]:
            if in_buckets.size:
                blocks, held = packed(*in_buckets.merge(), least)
                n = len(blocks)
                none = [pa.nulls(n, f.type) for f in _COUNTED][:3]
                yield from pa.table([*none, pa.array([part] * n, pa.int32()), pa.array(blocks, pa.int32()), pa.array(held, pa.binary())], schema=_COUNTED).to_batches(max_chunksize=16)
                in_buckets.clear()

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, of_lang in counts.items():
                keys, times = of_lang.merge()
                words = pa.array(vocabularies[lang].words, pa.binary()).cast(pa.string())
                parts = [words.take(pa.array((keys >> (NUMBER_BITS * (k - 1 - i))) & ((1 << NUMBER_BITS) - 1))) for i in range(k)]
                phrases = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                n, none = len(keys), pa.nulls
                whole = pa.table([pa.array([lang] * n, pa.string()), phrases, pa.array(times), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary())], schema=_COUNTED)
                yield from whole.to_batches(max_chunksize=50_000)
            counts.clear()

        for lang, tokens, own in slices(batches, k):
            vocabulary = vocabularies.setdefault(lang, Vocabulary(lang))
            numbers = vocabulary.numbers(tokens)
            hashes = vocabulary.hashes[numbers]
            word, n = numbers != 0, len(numbers)
            taken, key, hashed = word, numbers, hashes
            for i in range(1, k + 1):  # taken[j]: is a phrase of i words counted that begins at j?
                if i > 1:
                    m = n - i + 1
                    whole, shorter = word[: max(m, 0)].copy(), hashed
                    for j in range(1, i):
                        whole &= word[j : j + len(whole)]
                    key, hashed = (key[: len(whole)] << NUMBER_BITS) | numbers[i - 1 :][: len(whole)], _next_hash(hashed[: len(whole)], hashes[i - 1 :][: len(whole)])
                    taken = whole
                    if i == k:
                        taken = np.flatnonzero(whole)
                        taken = taken[_has(frequent, shorter[taken]) & _has(frequent, shorter[taken + 1])]
                        taken = taken[_has(buckets, hashed[taken])]
            starts = np.flatnonzero(taken) if k == 1 else taken
            counts[lang].add(key[starts[starts < own]])
            if bucket_next:
                both = starts[:-1][np.diff(starts) == 1]
                both = both[both < own]
                in_buckets.add((_next_hash(hashed[both], hashes[both + k]) & mask).astype(np.int64))
                if in_buckets.size > 4 * MOST_PHRASES:
                    in_buckets.merge()
                if in_buckets.size > 4 * MOST_PHRASES:
                    yield from bucketed()
            if counts[lang].size > MOST_PHRASES:
                counts[lang].merge()
            if sum(map(len, vocabularies.values())) > MOST_WORDS or sum(c.size for c in counts.values()) > MOST_PHRASES:
                yield from counted()
                vocabularies.clear()
        yield from counted()
        yield from bucketed()

    return common.materialize(docs.select("lang", "text").mapInArrow(scan, COUNTED), f"phrases-{k}")


def _added(least: int, bits: bool):
    """Blocks of a group added up, one at a time; as bits of what reaches the least count."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK * PARTS, np.uint8)
        block = None
        for batch in batches:
            block = batch.column("block")[0].as_py()
            for one in batch.column("counts"):
                places, times = unpacked(one.as_buffer())
                total[places] = np.minimum(total[places].astype(np.uint16) + times, least)
        if bits:
            out = np.packbits(total >= least, bitorder="little").tobytes()
        else:
            held = np.flatnonzero(total)
            out = packed(held, total[held], least)[1][0]
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([out], pa.binary())], names=["block", "held" if bits else "counts"])

    return fold


def bits_for(size: int) -> int:
    """Bits of the bitmaps for so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (max(size, 1) // BYTES_PER_BIT).bit_length()))


def _bitmap(rows: DataFrame, bits: int, each: int) -> np.ndarray:
    """Rows of block and held, each bits, as one bitmap of 2**bits bits on the driver."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        held = np.frombuffer(r.held, np.uint8)
        out[r.block * each // 8 :][: len(held)] = held[: len(out)]
    return out


def bucket_bitmap(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets that hold the least count: 2**bits of them, whatever the input."""
    blocks = counted.where(F.col("block").isNotNull()).select("block", "counts", F.floor(F.col("part") / FOLD).alias("fold"))
    once = blocks.groupBy("block", "fold").applyInArrow(_added(least, False), "block int, counts binary")
    return _bitmap(once.groupBy("block").applyInArrow(_added(least, True), "block int, held binary"), bits, BLOCK * PARTS)


def frequent_bitmap(phrases: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bits of the hashes of phrases (lang, phrase) of k words: 2**bits of them, whatever the input."""
    at = hash_of(F.col("lang"), F.split("phrase", " "), k).bitwiseAND(F.lit((1 << bits) - 1))
    rows = phrases.select(at.alias("at")).groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.bitmap_construct_agg((F.col("at") % BLOCK).cast("long")).alias("held"))
    return _bitmap(rows, bits, BLOCK)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = 3, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of one word, of two, ...], (lang, n)): phrases with f >= least, and all words of each language."""
    if not 2 <= longest <= 3:
        raise ValueError("phrases have two or three words")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), common.whole_text(F.col("text")).alias("text"))
    if bits is None:
        bits = bits_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    out, sizes, before, buckets = [], None, None, None
    in_bucket = min(least, 255)  # counts of buckets are bytes
    for k in range(1, longest + 1):
        parts = count(rows, k, k < longest, in_bucket, bits, before, buckets)
        phrases = parts.where(F.col("phrase").isNotNull())
        if k == 1:
            sizes = phrases.groupBy("lang").agg(F.sum("n").alias("n"))
        out.append(common.materialize(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"frequent-{k}"))
        if k < longest:
            before, buckets = frequent_bitmap(out[-1], k, bits), bucket_bitmap(parts, in_bucket, bits)
    return out, sizes


def _joined(words: Column, first: int, last: Column | int) -> Column:
    return F.array_join(F.slice(words, first, last), " ")


def _wide(c: str) -> Column:
    """A count as a decimal whose products stay exact."""
    return F.col(c).cast("decimal(15,0)")


def scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: that of the cut with the lowest score, the earliest of equal ones."""
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    cuts = []
    for k, candidates in enumerate(found[1:], 2):
        words = F.split("phrase", " ")
        at = [F.struct(F.lit(i).alias("at"), _joined(words, 1, i).alias("first"), _joined(words, i + 1, k - i).alias("rest")) for i in range(1, k)]
        cuts.append(candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*at)).alias("cut")).select("lang", "phrase", "a", "cut.*"))
    rows = cuts[0]
    for more in cuts[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    rows = rows.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    rows = rows.withColumns({"a15": _wide("a"), "l15": _wide("l"), "r15": _wide("r")})
    rows = rows.withColumn("score", F.expr("(a15 * a15 * 1000000BD) div (l15 * r15)"))
    least = F.min(F.struct("score", "at", "l", "r")).alias("least")
    return rows.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def unabsorbed(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """The candidates whose words don't stand inside a longer candidate (dropped or not) with so large a share of their count."""
    n = F.size(F.split("phrase", " "))
    longer = candidates.where(n > 2).select("lang", "a", F.split("phrase", " ").alias("words"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda at: F.array_join(F.slice("words", at, k), " "))))
    most = longer.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("of_longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("of_longer").isNull() | (F.lit(100) * F.col("of_longer") < F.lit(absorbed) * F.col("a"))).drop("of_longer")


@common.finished
def collocations(docs: DataFrame, least: int = LEAST, longest: int = 3, top: int = TOP, absorbed: int = ABSORBED, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, count and bytes."""
    found, sizes = frequent(docs, least, longest, bits)
    kept = unabsorbed(scored(found), absorbed)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), phrases AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks (k))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= {LEAST}
), sizes AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), cut_scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts AS c
  JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : c.cut], ' ')
  JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1 : c.k], ' ')
), scores AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, inner_phrase, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS inner_phrase FROM scores WHERE k = 3)
  GROUP BY ALL
), ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scores AS s LEFT JOIN longer AS x ON s.k = 2 AND x.lang = s.lang AND x.inner_phrase = s.phrase
  WHERE x.a IS NULL OR 100 * x.a < {ABSORBED} * s.a
)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}
"""
