"""Packing whole documents into few sequences by dominance and best fit (operator 11).

1. Each document's ids, with the end id, are one piece; only a longer document is cut, into full sequences and
   a rest. Pieces are written to the shared folder with their place among those of the same length in the same part.
2. The histogram of piece lengths (as many rows as a sequence is long, at most) goes to the driver.
   reduce() fixes sets of up to three pieces that dominate every other set with the same longest piece: whatever
   an optimal packing puts beside that piece can take the places of the set's others, so some optimal packing
   has the set. What is fixed leaves the instance, and the search goes on with what is left.
3. What remains is packed by best fit, longest first: each piece goes to the open sequence with the least
   room that it fits into. Sequences of equal room are taken as ranges, so the work is in lengths, not pieces.
4. A piece's rank among those of its length names its sequence and offset, by a join with the plan.

The plan has a bounded number of rows, whatever the input: a reduction uses up a length; a range of sequences that
takes pieces of length n keeps less than half of its room, so it is touched log2(size) times at most, and each
length makes at most four new ranges: 4 * 2048 * 11 rows, some 4 MB.

Defined cases: a null or empty text is the end id alone; repeated rows and doc_ids are packed each for itself; ties
between pieces of one length go by part and arrival; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common, packing

SIZE = 2048

PLAN = "length int, lo long, hi long, sequence long, repeats long, at long"


def _largest(lengths: list[int], left: Counter, most: int, used: Counter) -> int:
    """The largest length up to most of which a piece is left beside those used, else 0."""
    k = bisect_right(lengths, most)
    while k and left[lengths[k - 1]] <= used[lengths[k - 1]]:
        k -= 1
    return lengths[k - 1] if k else 0


def _smallest_sum(lengths: list[int], left: Counter, used: Counter, n: int) -> int | None:
    """The sum of the n shortest pieces beside those used; None if there are fewer."""
    total = 0
    for length in lengths:
        take = min(n, left[length] - used[length])
        total, n = total + take * length, n - take
        if not n:
            return total
    return None


def _pairs(lengths: list[int], left: Counter, used: Counter, room: int) -> tuple[int, int]:
    """Of all pairs of pieces that fit into room together: the largest sum, and the largest shorter piece; (0, 0) without any."""
    best, shorter, j = 0, 0, len(lengths) - 1
    for i, a in enumerate(lengths):
        while j >= 0 and a + lengths[j] > room:
            j -= 1
        k = j
        while k >= i and left[lengths[k]] - used[lengths[k]] <= (lengths[k] == a):
            k -= 1
        if left[a] > used[a] and k >= i:
            best, shorter = max(best, a + lengths[k]), a
        if j < i:
            break
    return best, shorter


def dominant(lengths: list[int], left: Counter, longest: int, size: int) -> tuple[int, ...] | None:
    """The others of a set with longest that dominates all sets with it; None where no set of up to three is proven to.

    Taking pieces away never makes a condition false while the set's own pieces last, so a set may be fixed as often as these allow.
    """
    room, used = size - longest, Counter({longest: 1})
    first = _largest(lengths, left, room, used)
    if not first:
        return ()
    if first == room:  # nothing else can take more
        return (first,)
    two = _smallest_sum(lengths, left, used, 2)
    if two is None or two > room:  # one other fits, so the largest one
        return (first,)
    three = _smallest_sum(lengths, left, used, 3)
    if three is not None and three <= room:
        return None
    best, shorter = _pairs(lengths, left, used, room)
    if best <= first:  # every pair fits into the place of first
        return (first,)
    second = _largest(lengths, left, room - first, used + Counter({first: 1}))
    return (first, second) if second and shorter <= second else None


def reduce(left: Counter, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(set of lengths, how often) of all sets fixed by dominance; left keeps the rest."""
    fixed, lengths = [], sorted(n for n in left if left[n])
    for longest in lengths[::-1]:
        while left[longest]:
            others = dominant(lengths, left, longest, size)
            if others is None:
                break
            one = Counter((longest, *others))
            times = min(left[n] // m for n, m in one.items())
            fixed.append(((longest, *others), times))
            for n, m in one.items():
                left[n] -= times * m
                if not left[n]:
                    del lengths[bisect_left(lengths, n)]
    for n in [n for n in left if not left[n]]:
        del left[n]
    return fixed


def lower_bound(histogram: dict[int, int], size: int = SIZE) -> int:
    """Sequences that any packing needs: those fixed by dominance, and for the rest the best of the bounds by large pieces and volume."""
    left = Counter(histogram)
    fixed = sum(times for _, times in reduce(left, size))
    if not left:
        return fixed
    best = 0
    lengths = sorted(left)
    for least in [0, *(n for n in lengths if n <= size // 2)]:
        large = sum(left[n] for n in lengths if n > size - least)
        middle = [n for n in lengths if size // 2 < n <= size - least]
        room = sum((size - n) * left[n] for n in middle)
        small = sum(n * left[n] for n in lengths if least <= n <= size // 2)
        best = max(best, large + sum(left[n] for n in middle) + max(0, -(-(small - room) // size)))
    return fixed + best


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, repeats, offset): ranks lo to hi - 1 of a length go to sequence + (rank - lo) // repeats at offset + (rank - lo) % repeats * length."""
    left = Counter({n: c for n, c in histogram.items() if n > 0 and c > 0})
    taken: Counter = Counter()
    out: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(length: int, count: int, first: int, repeats: int, offset: int) -> None:
        out.append((length, taken[length], taken[length] + count, first, repeats, offset))
        taken[length] += count

    for pieces, times in reduce(left, size):
        offset = 0
        for n, m in sorted(Counter(pieces).items(), reverse=True):
            place(n, times * m, sequence, m, offset)
            offset += n * m
        sequence += times
    rooms: list[int] = []  # in ascending order, those with open sequences
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)

    def opened(room: int, first: int, many: int) -> None:
        if room and many:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, many))

    for n in sorted(left, reverse=True):
        need, each = left[n], size // n
        while need:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                many = need // each
                first, more = sequence, (need % each > 0)
                sequence += many + more
                if many:
                    place(n, many * each, first, each, 0)
                    opened(size - each * n, first, many)
                if more:
                    place(n, need % each, first + many, need % each, 0)
                    opened(size - need % each * n, first + many, 1)
                break
            room = rooms[at]
            first, many = open_[room].pop()
            if not open_[room]:
                del rooms[at]
            fit = room // n
            full = min(many, need // fit)
            if full:
                place(n, full * fit, first, fit, size - room)
                opened(room - fit * n, first, full)
                need -= full * fit
            if full < many and need:  # the last, fewer than fit, go into one more
                place(n, need, first + full, need, size - room)
                opened(room - need * n, first + full, 1)
                need, full = 0, full + 1
            opened(room, first + full, many - full)
    return out


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Columns of the pieces but ids, with sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    narrow = pieces.drop("ids")
    counts = common.materialize(narrow.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    table = spark.createDataFrame(plan(histogram, size), PLAN).withColumnRenamed("length", "of_length")  # bounded, see above
    ranked = narrow.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    nth = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        *narrow.columns,
        (F.col("sequence") + F.floor(nth / F.col("repeats"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("repeats") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(places, pieces): see assign() and packing.cut(); with_ids() puts the ids to the places."""
    pieces = packing.cut(docs, end_id, tokenizer_path, size)
    return assign(pieces, size), pieces


def with_ids(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """The places with their ids as little-endian unsigned 32-bit bytes."""
    return places.join(pieces.select("part", "length", "rank_in_part", "ids"), ["part", "length", "rank_in_part"])


@common.finished
def packed(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, size: int = SIZE) -> DataFrame:
    """The digest of docs packed; the ids are not kept."""
    places, _ = pack(docs, end_id, tokenizer_path, size)
    return places.select("doc_id", F.floor(F.col("start") / size).cast("int").alias("piece"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir), end_id=0)
