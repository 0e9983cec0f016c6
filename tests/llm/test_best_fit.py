"""Packing by dominance and best fit: against exhaustive search, the library's encoding, and bounds."""

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import best_fit, tokens
from tests.llm.test_operators import ODD, documents


def fewest(lengths, size):
    """The least number of bins, by trying all placements."""

    @cache
    def more(rest, rooms):
        if not rest:
            return 0
        n, rest = rest[0], rest[1:]
        best = 1 + more(rest, tuple(sorted((*rooms, size - n))))
        for k, room in enumerate(rooms):
            if n <= room and rooms.index(room) == k:
                best = min(best, more(rest, tuple(sorted((*rooms[:k], room - n, *rooms[k + 1 :])))))
        return best

    return more(tuple(sorted(lengths, reverse=True)), ())


def bins(plan):
    out = defaultdict(list)
    for n, lo, hi, sequence, repeats, at in plan:
        for k in range(hi - lo):
            out[sequence + k // repeats].append((at + k % repeats * n, n))
    return out


def check_plan(histogram, size):
    got = bins(best_fit.plan(histogram, size))
    assert Counter(n for places in got.values() for _, n in places) == Counter({n: c for n, c in histogram.items() if c})
    assert sorted(got) == list(range(len(got)))
    for places in got.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= size
    return len(got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum_and_bound_holds(lengths):
    best = fewest(lengths, 20)
    left = Counter(lengths)
    fixed = best_fit.reduce(left, 20)
    assert sum(times for _, times in fixed) + fewest(tuple(left.elements()), 20) == best
    assert best_fit.lower_bound(Counter(lengths), 20) <= best <= check_plan(Counter(lengths), 20)


def test_three_piece_sets_are_fixed():
    left = Counter({50: 1, 26: 1, 23: 1, 22: 1})  # three others never fit; 26 and 23 beat all pairs
    assert best_fit.reduce(left, 100)[0] == ((50, 26, 23), 1)


@pytest.mark.parametrize("seed", range(4))
def test_many_lengths_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5 + seed / 3, 1, 40_000).astype(int)))
    histogram = dict(Counter(lengths.tolist()))
    assert len(best_fit.plan(histogram)) < 4 * 2048 * 11
    assert check_plan(histogram, 2048) <= best_fit.lower_bound(histogram) * 1.001 + 1


def test_only_long_documents_are_cut(spark):
    encoder = tokens.encoder(tokens.default_path())
    texts = [*ODD, "same text", "same text", "word " * 9000]
    rows = best_fit.packed(documents(spark, texts), end_id=0).collect()
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, text in enumerate(texts):
        ids = encoder._library([text or ""])[0] + b"\0\0\0\0"
        pieces = sorted(by[doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in pieces] == [(k, 2048 * k) for k in range(-(-len(ids) // 8192))]
        for p in pieces:
            assert zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
        assert sum(p.length for p in pieces) == len(ids) // 4 and all(p.length == 2048 for p in pieces[:-1])
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [at for at, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 2048


def test_ids_come_back(spark):
    docs = documents(spark, ["one two three", "", None])
    places, pieces = best_fit.pack(docs, end_id=0)
    encoder = tokens.encoder(tokens.default_path())
    got = {r.doc_id: bytes(r.ids) for r in best_fit.with_ids(places, pieces).collect()}
    assert got == {0: encoder._library(["one two three"])[0] + bytes(4), 1: bytes(4), 2: bytes(4)}


def test_no_documents(spark):
    assert best_fit.packed(documents(spark, []), end_id=0).count() == 0


def test_whole_table(spark, sf):
    from concord.llm.queries import queries

    rows = queries()["op11_best_fit_packing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    histogram = Counter(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= best_fit.lower_bound(histogram) * 1.01 + 1
