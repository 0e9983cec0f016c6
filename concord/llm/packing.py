"""Packing documents into windows of tokens by non-negative least squares (operator 9).

1. Each document's ids, with the end id, are cut into full windows and a rest; pieces are written to
   the shared folder with their place among the pieces of the same length in the same part.
2. The histogram of piece lengths (as many rows as the window is long, at most) goes to the driver.
   Shallow combinations of lengths, two or three that fill a window exactly, are its candidate columns;
   non-negative least squares gives how often each is to repeat; counts are rounded and cut to what is left.
3. What remains is packed greedily, longest first, by patterns that repeat as often as the counts allow.
   Patterns that would leave more than SLACK of a window empty are not used: those pieces follow each
   other in one row of ids, cut at every window's end.
4. A piece's rank among those of its length names its sequence and offset, by a join with the plan.

Padding thus stays under SLACK of a window, but for the very last sequence.

Defined cases: a null or empty text is the end id alone; repeated rows and doc_ids are packed each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common, tokens

WINDOW = 4096
#: Largest empty part of a window that a greedy pattern may leave.
SLACK = 0.004
#: Lengths, the most frequent first, from which combinations of three are formed.
TRIPLE_LENGTHS = 96
NNLS_STEPS = 400

PIECE = "part int, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, rank_in_part long, ids binary"


def cut(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents, written to the shared folder; ids are little-endian unsigned 32-bit."""
    path = tokenizer_path or tokens.default_path()
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("part", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "rank_in_part", "ids")}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    n = len(piece) // 4
                    for k, v in zip(out, (part, doc_id, at // 4, n, len(ids) // 4, zlib.crc32(piece), seen[n], piece), strict=True):
                        out[k].append(v)
                    seen[n] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
        encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(F.col("text")).alias("text"))
    return common.materialize(rows.mapInArrow(encode, PIECE), "pieces")


def combinations(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill the window, and such triples of which two are frequent."""
    out = {(a, window - a) for a in counts if window - a in counts and a <= window - a}
    often = sorted(counts, key=lambda n: (-counts[n], n))[:TRIPLE_LENGTHS]
    for i, a in enumerate(often):
        for b in often[i:]:
            if (c := window - a - b) in counts:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def non_negative_least_squares(columns: list[tuple[int, ...]], counts: dict[int, int]) -> np.ndarray:
    """Repeats x >= 0 that bring the sum of the columns nearest to the counts, by accelerated projected gradients."""
    lengths = sorted(counts)
    place = {n: i for i, n in enumerate(lengths)}
    target = np.array([counts[n] for n in lengths], dtype=float)
    row = np.array([place[n] for c in columns for n in c])
    col = np.array([k for k, c in enumerate(columns) for _ in c])
    if not len(row):
        return np.zeros(len(columns))
    apply = lambda x: np.bincount(row, weights=x[col], minlength=len(lengths))
    back = lambda y: np.bincount(col, weights=y[row], minlength=len(columns))
    probe = np.ones(len(columns))
    for _ in range(20):
        probe = back(apply(probe))
        probe /= np.linalg.norm(probe)
    step = 0.9 / np.linalg.norm(back(apply(probe)))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(NNLS_STEPS):
        new = np.maximum(0.0, y - step * back(apply(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: float = SLACK) -> list[tuple]:
    """(length, lo, hi, sequence, repeats, offset, row_start): where the pieces of ranks lo to hi - 1 go.

    With row_start null, rank r goes to sequence + (r - lo) // repeats at offset + (r - lo) % repeats * length;
    else its ids begin at row_start + (r - lo) * length of the row of ids whose windows are numbered from sequence.
    """
    left = {n: c for n, c in histogram.items() if 0 < n < window and c > 0}
    taken: Counter = Counter()
    out: list[tuple] = []
    sequence = 0

    def place(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n, repeats in pattern:
            out.append((n, taken[n], taken[n] + times * repeats, sequence, repeats, offset, None))
            taken[n] += times * repeats
            left[n] -= times * repeats
            if not left[n]:
                del left[n]
            offset += n * repeats
        sequence += times

    if full := histogram.get(window, 0):
        out.append((window, 0, full, 0, 1, 0, None))
        sequence = full
    columns = combinations(left, window)
    repeats = non_negative_least_squares(columns, left)
    for k in np.argsort(-repeats, kind="stable"):
        pattern = sorted(Counter(columns[k]).items(), reverse=True)
        times = min(int(repeats[k] + 0.5), *(left.get(n, 0) // m for n, m in pattern))
        if times > 0:
            place(pattern, times)
    row: list[int] = []
    present = sorted(left)
    while present:
        longest = present[-1]
        pattern, room = [], window
        at = len(present)
        while at and room >= present[0]:
            at = min(at, bisect_right(present, room))
            if not at:
                break
            n = present[at - 1]
            pattern.append((n, min(room // n, left[n])))
            room -= n * pattern[-1][1]
            at -= 1
        if room <= slack * window:
            place(pattern, min(left[n] // m for n, m in pattern))
        else:
            row.append(longest)
            left_over = left.pop(longest)
            taken_before = taken[longest]
            taken[longest] += left_over
            row[-1] = (longest, taken_before, left_over)
        present = [n for n in present if n in left]
    start = 0
    for n, lo, count in row:
        out.append((n, lo, lo + count, sequence, 1, 0, start))
        start += n * count
    return out


PLAN = "length int, lo long, hi long, sequence long, repeats long, at long, row_start long"


def assign(pieces: DataFrame, window: int = WINDOW, slack: float = SLACK) -> DataFrame:
    """Columns of the pieces but ids, with sequence_id, offset, cut_start and cut_length of each place.

    A piece of the row of ids that crosses a window's end has two places; its ids_crc32 is null there.
    """
    spark: SparkSession = pieces.sparkSession
    narrow = pieces.drop("ids")
    counts = common.materialize(narrow.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length to the window's
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # A row for each use of a length: at most three for each of the combinations, whose number the window bounds
    # (half of it in pairs, TRIPLE_LENGTHS squared in triples), and a few for each length that is left: some 50,000 rows.
    table = spark.createDataFrame(plan(histogram, window, slack), PLAN)
    ranked = narrow.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= table["lo"]) & (F.col("rank") < table["hi"])).drop(table["length"])
    nth = F.col("rank") - F.col("lo")
    place = placed.withColumn("pos", F.col("row_start") + nth * F.col("length")).withColumn(
        "places",
        F.when(
            F.col("pos").isNull(),
            F.array(_place(F.lit(0), F.col("length"), F.col("sequence") + F.floor(nth / F.col("repeats")), F.col("at") + nth % F.col("repeats") * F.col("length"))),
        ).otherwise(_row_places(window)),
    )
    cuts = place.select(*narrow.columns, F.explode("places").alias("place"))
    return cuts.select(
        "part", "rank_in_part", "doc_id", "start", "length", "doc_tokens",
        F.when(F.col("place.cut_length") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"),
        "place.sequence_id", "place.offset", "place.cut_start", "place.cut_length",
    )


def _place(cut_start, cut_length, sequence, offset):
    return F.struct(cut_start.cast("long").alias("cut_start"), cut_length.cast("long").alias("cut_length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _row_places(window: int):
    """The one or two places of a piece that begins at pos of the row of ids."""
    pos, n, w = F.col("pos"), F.col("length").cast("long"), F.lit(window).cast("long")
    first = F.least(n, w - pos % w)
    here = F.col("sequence") + F.floor(pos / w)
    return F.when(first == n, F.array(_place(F.lit(0), n, here, pos % w))).otherwise(F.array(_place(F.lit(0), first, here, pos % w), _place(first, n - first, here + 1, F.lit(0))))


def pack(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, window: int = WINDOW, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """(places, pieces): see assign() and cut(); with_ids() puts the ids to the places."""
    pieces = cut(docs, end_id, tokenizer_path, window)
    return assign(pieces, window, slack), pieces


#: Places that are sent to all executors at most, some 150 bytes each.
FEW_PLACES = 100_000


def with_ids(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """The places with their ids as little-endian unsigned 32-bit bytes. Few places are sent to where the pieces are, so these are not shuffled."""
    if places.limit(FEW_PLACES + 1).count() <= FEW_PLACES:
        places = F.broadcast(places)
    joined = places.join(pieces.select("part", "length", "rank_in_part", "ids"), ["part", "length", "rank_in_part"])
    return joined.withColumn("ids", F.substring("ids", (4 * F.col("cut_start") + 1).cast("int"), (4 * F.col("cut_length")).cast("int")))


def digest(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row for each place; only cut pieces are read again for their checksum."""
    uncut = F.col("ids_crc32").isNotNull()
    again = with_ids(places.where(~uncut), pieces).withColumn("ids_crc32", F.crc32("ids")).select(places.columns)
    return places.where(uncut).union(again).select(
        "doc_id", (F.col("start") + F.col("cut_start")).alias("start"), F.col("cut_length").alias("length"),
        "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )


@common.finished
def packed(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """The digest of docs packed; the ids are not kept."""
    places, pieces = pack(docs, end_id, tokenizer_path, window)
    return digest(common.materialize(places, "places"), pieces)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir), end_id=2)
