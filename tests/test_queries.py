"""Every registered query of the library against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from concord import registry
from concord.plans import bindings as B

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def shown(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}".removesuffix(".000000")
    return str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got, want = rows_of(registry.queries()[name](spark, sf).toPandas()), rows_of(duck.sql(registry.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_every_candidate_title_has_its_score(spark, sf, duck):
    """One row for each title that DuckDB finds among the candidates, ranked within its track."""
    got = registry.queries()["match_scores"](spark, sf).collect()
    want = duck.sql(f"SELECT track_id, source, ord, value FROM ({B.duck(B.CANDIDATES)}) WHERE field = 'title'").fetchall()
    assert sorted((r.track_id, r.source, r.ord, r.title) for r in got) == sorted(want)
    tracks = {}
    for r in sorted(got, key=lambda r: (r.track_id, -r.match_score, r.ord)):
        tracks.setdefault(r.track_id, []).append(r.rank)
    assert len(tracks) < len(got) and all(ranks == list(range(1, len(ranks) + 1)) for ranks in tracks.values())
