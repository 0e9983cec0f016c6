"""Sequence similarity: the one scalar function that no SQL expression gives.

ratio() is the share of characters in matching blocks, found longest first (Ratcliff-Obershelp). It is not
an edit distance. All comparisons of a row go to Python in one step, without a shuffle; a worker remembers
the pairs that it has seen, as the results for one query stand together and repeat.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from concord import vocab
from concord.functions import text as T

#: Pairs that a worker remembers.
MEMO = 50_000
_SEEN: dict[tuple[str, str], float] = {}


def _ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    found = _SEEN.get((a, b))
    if found is None:
        if len(_SEEN) >= MEMO:
            _SEEN.clear()
        found = _SEEN[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
    return found


@F.pandas_udf(DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_ratio(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


def _parts(query_artist: str, query_title: str, artist: str, title: str) -> tuple[dict[str, tuple[Column, Column]], Column]:
    """The pairs of strings that a score compares, and what it takes off for versions and variants."""
    qa, qt, a, t = (F.col(c) for c in (query_artist, query_title, artist, title))
    core_q, core_t = T.strip_version(qt), T.strip_version(t)
    version = F.when((core_t != T.text(t)) & (core_q == T.text(qt)), vocab.VERSION_PENALTY).otherwise(0.0)
    variant = F.when(T.variant_mismatch(qt, t), vocab.VARIANT_PENALTY).otherwise(0.0)
    pairs = {"_whole": (T.words_key(qt), T.words_key(t)), "_core": (T.words_key(core_q), T.words_key(core_t)), "_artist": (T.words_key(qa), T.words_key(a))}
    return pairs, version + variant


def _total(whole: Column, core: Column, artist: Column, off: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * (0.7 * whole + 0.3 * core) + 0.3 * artist - off))


def match_score(rows: DataFrame, query_artist: str, query_title: str, artist: str, title: str, name: str = "match_score") -> DataFrame:
    """rows with the score, 0 to 1, of a result for a query; the four arguments name columns."""
    pairs, off = _parts(query_artist, query_title, artist, title)
    scored = rows.withColumns({k: ratio(*pair) for k, pair in pairs.items()})
    return scored.withColumn(name, _total(*(F.col(k) for k in pairs), off)).drop(*pairs)


#: Two scores this near to each other are left to the exact one.
_CLOSE = 1e-9
#: From this length on the ratio passes over characters that are frequent, so a shared part may count less.
_LONG = 200


def most_alike(a: Column, b: Column) -> Column:
    """No less than the ratio: the characters in common, wherever they stand."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b)))


def least_alike(a: Column, b: Column) -> Column:
    """No more than the ratio: one string that is part of the other."""
    part = (F.contains(a, b) | F.contains(b, a)) & (F.length(a) < _LONG) & (F.length(b) < _LONG)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(part, 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))).otherwise(0.0)


def plausible(rows: DataFrame, query_artist: str, query_title: str, artist: str, title: str, name: str = "plausible") -> DataFrame:
    """rows with whether a result may be meant by a query: match_score() reaches the threshold.

    Bounds of the score decide most rows in the JVM; only of the rest do the strings go to Python.
    """
    pairs, off = _parts(query_artist, query_title, artist, title)
    keyed = rows.withColumns({f"{k}_{side}": F.coalesce(c, F.lit("")) for k, pair in pairs.items() for side, c in zip("ab", pair, strict=True)})
    both = {k: (F.col(f"{k}_a"), F.col(f"{k}_b")) for k in pairs}
    bounds = keyed.withColumns({"_most": _total(*(most_alike(*x) for x in both.values()), off), "_least": _total(*(least_alike(*x) for x in both.values()), off)})
    open_ = (F.col("_most") >= vocab.PLAUSIBLE - _CLOSE) & (F.col("_least") < vocab.PLAUSIBLE + _CLOSE)
    asked = bounds.withColumn("_open", open_).withColumns({k: ratio(F.when(F.col("_open"), a), F.when(F.col("_open"), b)) for k, (a, b) in both.items()})
    exact = _total(*(F.col(k) for k in pairs), off) >= vocab.PLAUSIBLE
    return asked.withColumn(name, F.when(F.col("_open"), exact).otherwise(F.col("_least") >= vocab.PLAUSIBLE)).select(*rows.columns, name)


def is_plausible(score: Column) -> Column:
    return score >= vocab.PLAUSIBLE


def artist_is_unrelated(rows: DataFrame, query_artist: str, artist: str, name: str = "artist_unrelated") -> DataFrame:
    """rows with whether two credits share nothing: neither contains the other and their ratio is low."""
    left, right = T.ascii_key(F.col(query_artist)), T.ascii_key(F.col(artist))
    known = (left != "") & (right != "")
    return rows.withColumn("_ratio", ratio(left, right)).withColumn(name, known & ~F.contains(left, right) & ~F.contains(right, left) & (F.col("_ratio") < vocab.UNRELATED_BELOW)).drop("_ratio")
