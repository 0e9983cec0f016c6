"""Features at a moment against a plain reading of the tables, with nulls, ties, repeated rows and blocks of few probes."""

import random
import zlib
from datetime import datetime, timedelta, timezone

import pytest

from concord.llm import common
from concord.llm import point_in_time as pit

START = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, total double, sold_at {0}, arrived_at {0}, t long, lo string"
CLICKS = "click_id long, ts {0}, arrived_at {0}, client_id long, kind string, value double, d int"
LINES = "sale_id long, item_id long, amount double, shipped_at {0}, n string"


def us(x):
    return None if x is None else round((x.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def in_cents(x):
    return 0 if x is None or x != x or abs(x) == float("inf") else int((100 * x + 0.5) // 1)


def brute(sales, clicks, lines, windows=(2, 14)):
    sold = [(s[0], s[1], us(s[3]), None if s[4] is None else max(us(s[3]), us(s[4]) + pit.DELAY), s[2]) for s in sales if s[1] is not None and s[3] is not None]
    out = []
    for sale_id, client, at, _, _ in sold:
        t = at + (0 if sale_id is None else zlib.crc32(str(sale_id).encode()) % 259200 * 10**6)
        for d in windows:
            seen = lambda x, known: x is not None and known is not None and t - d * pit.DAY < x <= t and known <= t  # noqa: B023, E731
            mine = [c for c in set(clicks) if c[3] == client and c[1] is not None and seen(us(c[1]), c[2] and us(c[2]) + pit.DELAY)]
            of = [s for s in sold if s[1] == client and seen(s[2], s[3])]
            bought = [x for s in of for x in lines if s[0] is not None and x[0] == s[0] and x[3] is not None and us(x[3]) <= t]
            last = max(mine, key=lambda c: (c[1], c[0] is not None, c[0] or 0), default=(None,))[0]
            label = any(s[1] == client and t < s[2] <= t + 7 * pit.DAY for s in sold)
            out.append((sale_id, d, t, label, len(mine), sum(c[4] == "purchase" for c in mine), sum(in_cents(c[5]) for c in mine), last, len(of), sum(in_cents(s[4]) for s in of), len(bought), len({x[1] for x in bought if x[1] is not None}), sum(in_cents(x[2]) for x in bought)))
    return sorted(out, key=str)


def tables(spark, sales, clicks, lines, kind):
    return [spark.createDataFrame(rows, schema.format(kind)) for rows, schema in ((sales, SALES), (clicks, CLICKS), (lines, LINES))]


def made(seed, n):
    rng = random.Random(seed)
    hour = lambda most: START + timedelta(hours=rng.randrange(24 * most), seconds=rng.choice([0, 0, 1, 3599]))
    maybe = lambda v: None if rng.random() < 0.06 else v
    client = lambda: maybe(7 if rng.random() < 0.5 else rng.randrange(4))
    late = lambda x: maybe(x and x + timedelta(minutes=rng.choice([0, 1, 300, 5000])))
    money = lambda: rng.choice([None, 1.005, 2.5, -3.335, float("nan"), float("inf"), 10.0])
    sales = [(maybe(i), client(), money(), at := maybe(hour(40)), late(at), 1, "x") for i in range(n)]
    sales += rng.sample(sales, n // 10)
    clicks = [(maybe(i), at := maybe(hour(40)), late(at), client(), rng.choice(["purchase", "view", None]), money(), 1) for i in range(3 * n)]
    clicks += rng.sample(clicks, n // 2)
    clicks += [(c[0] and c[0] + 10_000, *c[1:]) for c in clicks[:40]]  # ties in time
    lines = [(maybe(rng.randrange(n)), maybe(rng.randrange(9)), money(), maybe(hour(55).replace(hour=0, minute=0, second=0)), "x") for _ in range(4 * n)]
    lines += [(5, i % 30, 1.0, START + timedelta(days=i % 3), "x") for i in range(200)]
    return sales, clicks, lines


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("kind", "factor", "least"), [("timestamp_ntz", 0.5, 16), ("timestamp_ntz", 0.01, 1), ("timestamp_ntz", 0.3, 3)])
def test_equals_a_plain_reading(spark, kind, factor, least):
    rows = made(int(100 * factor), 150)
    assert ordered(pit.features(*tables(spark, *rows, kind), factor=factor, least=least)) == brute(*rows)


def test_moments_with_a_zone_and_other_windows(spark):
    rows = made(9, 40)
    with_zone = [[tuple(v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) else v for v in r) for r in t] for t in rows]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert ordered(pit.features(*tables(spark, *with_zone, "timestamp"), windows=(1, 5), least=2)) == brute(*rows, windows=(1, 5))
        assert ordered(pit.features(*tables(spark, *rows, "timestamp_ntz"), windows=(1, 5), least=2)) == brute(*rows, windows=(1, 5))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blocks_are_of_equal_count_and_in_order(spark):
    rows = [(i, 7 if i % 3 else 1, 1.0, START + timedelta(hours=i % 500), START, 0, "") for i in range(1500)]
    rows = common.materialize(pit.moments(tables(spark, rows, [], [], "timestamp_ntz")[0]), "moments")
    probes, lists = pit.blocks(rows, factor=1, least=1)
    width = 32  # of 1000 probes
    counts = {}
    for client, block, t in sorted((r.client_id, r.block, r.t) for r in probes.collect() if r.client_id == 7):
        counts.setdefault(block, []).append(t)
    assert sorted(counts) == list(range(len(counts))) and sum(map(len, counts.values())) == 1000
    assert max(map(len, counts.values())) == width and sum(len(v) == width for v in counts.values()) >= 1000 // width - 4
    spans = [(min(v), max(v)) for _, v in sorted(counts.items())]
    row = lists.where("client_id = 7").first()
    assert list(zip(row.firsts, row.lasts)) == spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark):
    sales, clicks, lines = made(3, 20)
    assert ordered(pit.features(*tables(spark, [], clicks, lines, "timestamp_ntz"))) == []
    assert ordered(pit.features(*tables(spark, sales, [], [], "timestamp_ntz"))) == brute(sales, [], [])
