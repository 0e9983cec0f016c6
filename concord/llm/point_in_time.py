"""Features of each sale as they were known at its moment, by square-root decomposition (operator 12).

A probe is a sale with its moment t. A click, sale or line is known from its arrival (a line from its shipping too) and
counts until a window's length after its time, so for a window it is an interval [lo, hi) of moments; a label is one as well.
1. A client's probes, in order of t, are dealt into blocks of equal count, the square root of how many the client has:
   a range partitioning by (client, t) and a number within each range, so no client is in one task.
2. Each interval finds the blocks that it touches by binary search in its client's list of blocks. The blocks it covers
   are a range; the first and the last one it touches may be covered in part.
3. Covering intervals of one range of blocks are added up before the range is laid out; then each block has one total.
   Rows that overlap a block in part join only that block, with its probes as one sorted list, and find in it between which of
   them they count; what begins and ends there is added up, so a probe's own share is a running sum within its block.
4. Items: a block's set is the union of the items of covering lines. Lines that overlap it in part are left out if their item is in
   the set, and the rest of an item's intervals are united, so each adds one to the probes inside it.
5. A probe's features are its block's totals and its own.

What a client has in one row is its list of blocks, the square root of its probes, and a block its probes; every other group is a
block's, or is added up on the way. Joins that meet a hot client or sale have no other step behind them in the same stage, so adaptive execution may split them.

Defined cases: sales without client or time are no probes and count nowhere; without an arrival they count as a probe and
for labels alone. A null sale_id has the moment of its sale, and no lines. Lines without sale, or without shipped_at, count nowhere; lines of a sale_id that
several sales have count for each of these. A null or not finite amount is 0 cents. Fully equal clicks are one, sales and lines as many as there are.
Repeated sales are probes each for itself. Empty tables give no rows, or zeros. Other columns are ignored, but in the comparison of clicks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common

SECOND = 1_000_000
DAY = 86_400 * SECOND
WINDOWS = (2, 14)
DELAY = 240 * 60 * SECOND
HORIZON = 7 * DAY
SPREAD = 259_200
#: Probes of a block: so many times the square root of the client's, and so many at least.
FACTOR, LEAST = 1, 16
CLICK, SALE, LINE, LABEL, ITEM = range(5)
#: The latest click is the largest number of time and id in this base; an id of null comes before all others.
BASE, ID_AT = "100000000000000000000BD", "9223372036854775809BD"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is UTC, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        days, second = F.unix_date(F.col(name).cast("date")).cast("long"), F.expr(f"cast(extract(SECOND FROM `{name}`) * 1000000 AS long)")
        return days * DAY + (F.hour(name).cast("long") * 3600 + F.minute(name) * 60) * SECOND + second
    return F.unix_micros(F.col(name).cast("timestamp"))


def cents(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e16), F.floor(F.lit(100) * x + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def moments(sales: DataFrame) -> DataFrame:
    """(client_id, sale_id, t, sold, known, cents) of all sales that are probes; known is null without an arrival."""
    shift = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % SPREAD, F.lit(0)) * SECOND
    rows = sales.where(F.col("client_id").isNotNull() & F.col("sold_at").isNotNull())
    sold = micros(sales, "sold_at")
    return rows.select("client_id", "sale_id", (sold + shift).alias("t"), sold.alias("sold"), F.greatest(sold, micros(sales, "arrived_at") + DELAY).alias("known"), F.col("arrived_at").isNotNull().alias("arrived"), cents("total").alias("cents"))


def blocks(probes: DataFrame, factor: float = FACTOR, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((client_id, block, nth, sale_id, t), (client_id, firsts, lasts, steps)) of a written table of moments(); both are written.

    nth counts a block's probes from 0. firsts and lasts are the first and last moments of a client's blocks in order; steps are the powers
    of two up to their number, downwards.
    """
    rows = probes.select("client_id", "sale_id", "t").withColumn("row", F.monotonically_increasing_id())
    sizes = rows.groupBy("client_id").agg(F.greatest(F.lit(least), F.ceil(F.sqrt(F.count("*")) * factor)).alias("width"))
    ranges = rows.join(common.materialize(sizes, "widths"), "client_id").repartitionByRange(common.partitions_for(probes), "client_id", "t", "sale_id", "row")
    ranges = common.materialize(ranges.select("client_id", "t", "sale_id", "width", "row", F.spark_partition_id().alias("range")), "ranges")
    at = F.row_number().over(Window.partitionBy("range", "client_id").orderBy("t", "row")) - 1
    dealt = ranges.withColumn("at", at).withColumns({"run": F.floor(F.col("at") / F.col("width")).cast("int"), "nth": (F.col("at") % F.col("width")).cast("int")})
    dealt = common.materialize(dealt.drop("at", "width", "row"), "dealt")
    spans = dealt.groupBy("client_id", "range", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    lists = spans.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "range", "run"))).alias("spans"))
    lists = common.materialize(lists, "block-lists")
    numbers = lists.select("client_id", F.posexplode("spans").alias("block", "span")).select("client_id", "block", "span.range", "span.run")
    numbered = common.materialize(dealt.join(numbers, ["client_id", "range", "run"]).select("client_id", "block", "nth", "sale_id", "t"), "probes")
    return numbered, lists.select("client_id", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"), _steps("spans").alias("steps"))


def _steps(of: str) -> Column:
    return F.filter(F.array(*(F.lit(1 << k) for k in range(29, -1, -1))), lambda p: p <= F.size(of))


def facts(rows: DataFrame, clicks: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(client_id, kind, lo, ends, n, purchases, cents, latest, item_id): all that counts, with its end for each window d; rows are of moments()."""
    in_time = rows.where("arrived")
    none = {"purchases": F.lit(0).cast("long"), "cents": F.lit(0).cast("long"), "latest": F.lit(None).cast("decimal(38,0)"), "item_id": F.lit(None).cast("long")}

    def kind(df: DataFrame, number: int, lo: str, ends: Column, **values: Column) -> DataFrame:
        shown = {"n": F.lit(1).cast("long")} | none | values
        return df.select("client_id", F.lit(number).alias("kind"), F.col(lo).alias("lo"), ends.alias("ends"), *(v.alias(k) for k, v in shown.items()))

    after = lambda c: F.array(*(F.struct(F.lit(d).alias("d"), (F.col(c) + d * DAY).alias("hi")) for d in windows))
    once = clicks.distinct().where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("arrived_at").isNotNull())
    at = micros(clicks, "ts")
    once = once.select(
        "client_id", at.alias("at"), F.greatest(at, micros(clicks, "arrived_at") + DELAY).alias("lo"), (F.coalesce(F.col("kind") == "purchase", F.lit(False))).cast("long").alias("purchases"), cents("value").alias("cents"), "click_id"
    )
    latest = F.expr(f"cast(at AS decimal(19,0)) * {BASE} + coalesce(cast(click_id AS decimal(20,0)) + {ID_AT}, 0BD)").cast("decimal(38,0)")
    grouped = lines.where(F.col("sale_id").isNotNull() & F.col("shipped_at").isNotNull()).select("sale_id", "item_id", micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("line_cents"))
    grouped = grouped.groupBy("sale_id", "item_id", "shipped").agg(F.count("*").alias("n"), F.sum("line_cents").alias("line_cents"))
    of_sales = grouped.join(in_time.select("sale_id", "client_id", "sold", "known"), "sale_id").withColumn("lo", F.greatest("known", "shipped"))
    coming = F.array(*(F.struct(F.lit(d).alias("d"), F.col("sold").alias("hi")) for d in windows))
    return reduce(DataFrame.unionByName, [
        kind(once, CLICK, "lo", after("at"), purchases=F.col("purchases"), cents=F.col("cents"), latest=latest),
        kind(in_time, SALE, "known", after("sold"), cents=F.col("cents")),
        kind(of_sales, LINE, "lo", after("sold"), n=F.col("n"), cents=F.col("line_cents"), item_id=F.col("item_id").cast("long")),
        kind(rows.withColumn("lo", F.col("sold") - HORIZON), LABEL, "lo", coming),
    ])


def _before(starts: str, x: str) -> str:
    """How many of the ascending starts are less than x, by binary search."""
    return f"aggregate(steps, 0, (n, p) -> if(n + p <= size({starts}) AND get({starts}, n + p - 1) < {x}, n + p, n))"


def located(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows with d, hi and a range of blocks from first_block to last_block: covered, or one block overlapped in part. Written."""
    found = rows.join(lists, "client_id").withColumn("i", F.expr(_before("lasts", "lo")))
    ends = "transform(filter(ends, e -> e.hi > lo), e -> named_struct('d', e.d, 'hi', e.hi, 'j', " + _before("firsts", "e.hi") + " - 1))"
    found = found.withColumn("touched", F.expr(f"filter({ends}, e -> e.j >= i)")).where(F.size("touched") > 0)
    sides = "transform(touched, e -> named_struct('d', e.d, 'hi', e.hi, 'j', e.j, 'left', int(NOT (lo <= get(firsts, i) AND e.hi > get(lasts, i))), 'right', int(e.j > i AND e.hi <= get(lasts, e.j))))"
    pieces = """flatten(transform(sides, e -> array(
        named_struct('d', e.d, 'hi', e.hi, 'first_block', i + e.left, 'last_block', e.j - e.right, 'part', false),
        if(e.left = 1, named_struct('d', e.d, 'hi', e.hi, 'first_block', i, 'last_block', i, 'part', true), null),
        if(e.right = 1, named_struct('d', e.d, 'hi', e.hi, 'first_block', e.j, 'last_block', e.j, 'part', true), null))))"""
    found = found.withColumn("sides", F.expr(sides)).select(*rows.drop("ends").columns, F.explode(F.expr(f"filter({pieces}, x -> x IS NOT NULL AND x.first_block <= x.last_block)")).alias("piece"))
    return common.materialize(found.select("client_id", "kind", "lo", "n", "purchases", "cents", "latest", "item_id", "piece.*"), "located")


MEASURES = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_labels", "n_items")


def _sums() -> list[Column]:
    """All measures of rows with kind, n, purchases, cents and latest, each times its sign."""
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col("sign") * F.col(c)).otherwise(F.lit(0)))
    values = (of(CLICK, "n"), F.sum(F.col("sign") * F.col("purchases")), of(CLICK, "cents"), of(SALE, "n"), of(SALE, "cents"), of(LINE, "n"), of(LINE, "cents"), of(LABEL, "n"), of(ITEM, "n"))
    return [*(v.alias(k) for k, v in zip(MEASURES, values, strict=True)), F.max("latest").alias("latest")]


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "kind").agg(F.sum("n").alias("n"), F.sum("purchases").alias("purchases"), F.sum("cents").alias("cents"), F.max("latest").alias("latest"))


def _laid_out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence("first_block", "last_block"))).drop("first_block", "last_block")


def _as_items(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"kind": F.lit(ITEM), "n": F.lit(1).cast("long"), "purchases": F.lit(0).cast("long"), "cents": F.lit(0).cast("long"), "latest": F.lit(None).cast("decimal(38,0)")})


def block_items(pieces: DataFrame) -> DataFrame:
    """(client_id, d, block, item_id): the items that count at every moment of a block. Written."""
    ranges = pieces.where(~F.col("part") & F.col("item_id").isNotNull()).select("client_id", "d", "first_block", "last_block", "item_id").distinct()
    return common.materialize(_laid_out(ranges).distinct(), "block-items")


def part_items(pieces: DataFrame, held: DataFrame) -> DataFrame:
    """(client_id, d, block, lo, hi): for each item that the block doesn't hold, the disjoint intervals in which it counts."""
    keys = ["client_id", "d", "block", "item_id"]
    rows = pieces.where(F.col("part") & F.col("item_id").isNotNull()).withColumnRenamed("first_block", "block")
    rows = rows.groupBy(*keys, "hi").agg(F.min("lo").alias("lo")).join(held, keys, "left_anti")
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("client_id", "d", "block", "lo", "hi")


def inside(pieces: DataFrame, probes: DataFrame) -> DataFrame:
    """(client_id, block, d, nth, measures): what rows that overlap a block in part add or take away from its nth probe on.

    Of the latest click nothing is taken away: an older one ends earlier, so where the latest has ended all have.
    """
    lists = probes.groupBy("client_id", "block").agg(F.sort_array(F.collect_list("t")).alias("times"))
    rows = pieces.join(common.materialize(lists.select("*", _steps("times").alias("steps")), "times"), ["client_id", "block"])
    rows = rows.withColumns({"since": F.expr(_before("times", "lo")), "until": F.expr(_before("times", "hi"))}).where("since < until")
    begin = F.struct(F.col("since").alias("nth"), F.lit(1).alias("sign"), F.col("latest").alias("latest"))
    end = F.when(F.col("until") < F.size("times"), F.struct(F.col("until").alias("nth"), F.lit(-1).alias("sign"), F.lit(None).cast("decimal(38,0)").alias("latest")))
    ends = rows.select("client_id", "block", "d", "kind", "n", "purchases", "cents", F.inline(F.filter(F.array(begin, end), lambda x: x.isNotNull())))
    return common.materialize(ends.groupBy("client_id", "block", "d", "nth").agg(*_sums()), "inside")


@common.finished
def features(sales: DataFrame, clicks: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, factor: float = FACTOR, least: int = LEAST) -> DataFrame:
    """(sale_id, d, t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents) of every probe and window."""
    rows = common.materialize(moments(sales), "moments")
    probes, lists = blocks(rows, factor, least)
    pieces = located(facts(rows, clicks, lines, windows), lists)
    held = block_items(pieces)

    covered = _laid_out(_added(pieces.where(~F.col("part")), "client_id", "d", "first_block", "last_block"))
    covered = covered.unionByName(_as_items(held.drop("item_id"))).withColumn("sign", F.lit(1))
    of_blocks = covered.groupBy("client_id", "d", "block").agg(*_sums()).withColumnsRenamed({c: f"block_{c}" for c in (*MEASURES, "latest")})

    partly = pieces.where("part").withColumnRenamed("first_block", "block").drop("last_block", "part", "item_id")
    own = inside(partly.unionByName(_as_items(part_items(pieces, held))), probes)

    out = probes.withColumn("d", F.explode(F.array(*map(F.lit, windows)))).join(own, ["client_id", "block", "d", "nth"], "left")
    so_far = Window.partitionBy("client_id", "d", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    out = out.select("client_id", "d", "block", "sale_id", "t", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in MEASURES), F.max("latest").over(so_far).alias("latest"))
    out = out.join(of_blocks, ["client_id", "d", "block"], "left")
    total = {c: F.col(c) + F.coalesce(F.col(f"block_{c}"), F.lit(0)) for c in MEASURES}
    out = out.withColumn("latest", F.greatest("latest", "block_latest"))
    at = F.expr(f"cast((latest - pmod(latest, {BASE})) / {BASE} AS long)")
    click = F.expr(f"cast(CASE WHEN pmod(latest, {BASE}) > 0 THEN pmod(latest, {BASE}) - {ID_AT} END AS long)")
    return out.select(
        "sale_id", "d", F.col("t").alias("t_us"), (total["n_labels"] > 0).alias("label"), *(total[c].alias(c) for c in ("n_clicks", "n_purchases", "click_cents")),
        F.when(at + F.col("d") * DAY > F.col("t"), click).alias("last_click_id"), *(total[c].alias(c) for c in ("n_sales", "sale_cents", "n_lines", "n_items", "line_cents")),
    )


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "clicks", "sale_lines")))


_CENTS = "CASE WHEN {0} IS NOT NULL AND isfinite({0}) THEN floor(100 * {0} + 0.5)::BIGINT ELSE 0 END"

SQL = f"""
WITH sale AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS sold, greatest(epoch_us(sold_at), epoch_us(arrived_at) + {DELAY}) AS known, arrived_at IS NOT NULL AS arrived, {_CENTS.format('total')} AS cents,
    row_number() OVER () AS probe,
    epoch_us(sold_at) + coalesce(xor(list_reduce(list_prepend(4294967295, range(8 * length(digits))), lambda c, i:
      xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(digits, i // 8 + 1, 1))) ELSE c END) >> 1,
          ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(digits, i // 8 + 1, 1))) ELSE c END) & 1) * 3988292384)), 4294967295) % {SPREAD}, 0) * {SECOND} AS t
  FROM (SELECT *, sale_id::VARCHAR AS digits FROM sales) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), probe AS (
  SELECT probe, sale_id, client_id, t, d, t - d * {DAY} AS since FROM sale, (VALUES (2), (14)) AS ds (d)
), click AS (
  SELECT DISTINCT * FROM clicks
), of_clicks AS (
  SELECT p.probe, p.d, count(*) AS n_clicks, count(*) FILTER (c.kind = 'purchase') AS n_purchases, sum({_CENTS.format('c.value')}) AS click_cents,
    first(c.click_id ORDER BY c.ts DESC, c.click_id DESC NULLS LAST) AS last_click_id
  FROM probe AS p JOIN click AS c ON c.client_id = p.client_id AND epoch_us(c.ts) > p.since AND epoch_us(c.ts) <= p.t AND epoch_us(c.arrived_at) + {DELAY} <= p.t GROUP BY ALL
), of_sales AS (
  SELECT p.probe, p.d, count(*) AS n_sales, sum(s.cents) AS sale_cents
  FROM probe AS p JOIN sale AS s ON s.client_id = p.client_id AND s.sold > p.since AND s.known <= p.t AND s.arrived GROUP BY ALL
), of_lines AS (
  SELECT p.probe, p.d, count(*) AS n_lines, count(DISTINCT l.item_id) AS n_items, sum({_CENTS.format('l.amount')}) AS line_cents
  FROM probe AS p JOIN sale AS s ON s.client_id = p.client_id AND s.sold > p.since AND s.known <= p.t AND s.arrived
  JOIN sale_lines AS l ON l.sale_id = s.sale_id AND epoch_us(l.shipped_at) <= p.t GROUP BY ALL
), labels AS (
  SELECT DISTINCT p.probe FROM sale AS p JOIN sale AS s ON s.client_id = p.client_id AND s.sold > p.t AND s.sold <= p.t + {HORIZON}
)
SELECT p.sale_id, p.d, p.t AS t_us, y.probe IS NOT NULL AS label, coalesce(n_clicks, 0)::BIGINT AS n_clicks, coalesce(n_purchases, 0)::BIGINT AS n_purchases, coalesce(click_cents, 0)::BIGINT AS click_cents,
  last_click_id, coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM probe AS p LEFT JOIN of_clicks USING (probe, d) LEFT JOIN of_sales USING (probe, d) LEFT JOIN of_lines USING (probe, d) LEFT JOIN labels AS y ON y.probe = p.probe
"""
