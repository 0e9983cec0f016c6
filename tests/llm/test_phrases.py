"""Collocations against a count of all phrases, at odd texts and small limits."""

import re
from collections import Counter, defaultdict

import pytest

from concord.llm import phrases

WORDS = "new york city hall big old town der die das 日本 É \x01x a".split(" ")


def brute(rows, least, longest, top, absorbed):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p for p in f if len(p) > 1 and f[p] >= least}
        for p in candidates:
            if any(len(q) > len(p) and 100 * f[q] >= absorbed * f[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in candidates):
                continue
            score, at = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:at]], f[p[at:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(spark, rows, **limits):
    docs = spark.createDataFrame([(lang, text, 1, "x", 2) for lang, text in rows], "lang string, text string, n int, phrase string, block int")
    return sorted(map(tuple, phrases.collocations(docs, **limits).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_count_of_all_phrases(spark, monkeypatch, small):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(WORDS).upper() + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "!"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, " \t"), ("en", "..."), ("en", "new york"), ("en", "New YORK") , ("fr", "la la la la " * 400), ("fr", "x" * 100_000)]
    limits = {"least": 10, "longest": 3, "top": 12, "absorbed": 50}
    if small:  # bitmaps in which most bits are set: no phrase may be lost
        limits |= {"least": 3, "absorbed": 70}
        monkeypatch.setattr(phrases, "FOLD", 1)
        got = found(spark, rows, bits=9, **limits)
    else:
        got = found(spark, rows, **limits)
    assert got == brute(rows, **limits)


def test_two_words_alone(spark):
    rows = [("en", "a b c. " * 12)]
    assert found(spark, rows, longest=2) == brute(rows, 10, 2, 2000, 50)


def test_slices_and_small_memory_change_nothing(spark, monkeypatch):
    rows = [("en", "a b c d. e a b " * 50), ("en", "b c d" * 99)]
    batch = __import__("pyarrow").record_batch({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(phrases, "SLICE", 7)
    got = Counter()
    for lang, tokens, own in phrases.slices(iter([batch]), 3):
        got.update((lang, *tokens[i : i + 3]) for i in range(own) if len(tokens) >= i + 3)
    monkeypatch.setattr(phrases, "SLICE", 10**6)
    (_, whole, _), = phrases.slices(iter([batch]), 3)
    assert got == Counter(("en", *whole[i : i + 3]) for i in range(len(whole) - 2))


def test_hashes_are_the_same_in_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    words = phrases.Vocabulary("de")
    numbers = words.numbers([b"a", "É".encode(), b"word-that-is-longer-than-thirty-two-bytes"])
    h = words.hashes[numbers]
    whole = phrases._next_hash(phrases._next_hash(h[:1], h[1:2]), h[2:])
    row = spark.createDataFrame([("de", "a É word-that-is-longer-than-thirty-two-bytes")], "lang string, phrase string")
    assert row.select(phrases.hash_of(F.col("lang"), F.split("phrase", " "), 3)).first()[0] == whole.astype(np.int64)[0]


def test_large_counts_stay_exact(spark):
    n = 3_000_000_000_000
    found = [spark.createDataFrame(rows, "lang string, phrase string, f long") for rows in ([("en", "a", n), ("en", "b", n + 1)], [("en", "a b", n - 7)])]
    row = phrases.scored(found).first()
    assert row.score == 10**6 * (n - 7) ** 2 // (n * (n + 1))


def test_no_documents(spark):
    assert found(spark, []) == []


def test_blocks_of_buckets_round_trip_and_stop_at_the_least():
    import numpy as np

    rng = np.random.default_rng(0)
    buckets = np.unique(rng.integers(0, 1 << 24, 5000))
    times = rng.integers(1, 900, len(buckets))
    blocks, held = phrases.packed(buckets, times, 10)
    back = [(b * phrases.BLOCK * phrases.PARTS + places, counts) for b, (places, counts) in zip(blocks, map(phrases.unpacked, held))]
    assert np.array_equal(np.concatenate([x for x, _ in back]), buckets) and np.array_equal(np.concatenate([c for _, c in back]), np.minimum(times, 10))


def test_bits_follow_the_text_and_are_bounded():
    assert [phrases.bits_for(n) for n in (0, 168 << 20, 840 << 20, 100 << 40)] == [20, 25, 27, 30]
