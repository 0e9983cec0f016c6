"""License scans (operator 5): Aho-Corasick finds notices and tags, a shunting-yard parser evaluates expressions.

scan() looks at each text twice with one automaton: over its words (phrases of notices, as in NOTICES and
BASE, found where a phrase's words stand consecutively) and over its lower-cased characters (the tags
that introduce a license expression). An expression after a tag is cut into identifiers, parentheses and
the operators WITH, AND, OR, which bind in this order; a shunting-yard parser turns it into postfix
and evaluates it over sets of licenses: OR gives the alternatives, AND joins one of each side, WITH
binds an exception to a license. Unreadable expressions yield the identifiers that were read.

Labels: those of phrases, and the identifiers of expressions in lower case. Score: 1 - 0.5 ** strength,
where an expression counts 2 and each distinct label of a phrase 1; 0 without findings.

Defined cases: a null text counts as empty; an empty text has no words, no labels and score 0; repeated
rows get equal results each; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common

#: Phrases of lower-case words and the labels that they stand for.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")

_OTHER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def tokenize(text: str) -> list[str]:
    """Tokens of an expression at the start of a line: up to the line's end or what can't be part of one."""
    out: list[str] = []
    depth, operand = 0, True
    at = 0
    while at < len(text):
        if text[at] in " \t":
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            break
        token = m[0]
        lower = token.lower()
        if operand:
            if token == "(":
                depth += 1
            elif token == ")" or lower in _BINDS:
                break
            else:
                operand = False
        elif token == ")" and depth:
            depth -= 1
        elif lower in _BINDS:
            operand = True
        else:
            break
        out.append(token)
        at = m.end()
    while out and (out[-1] == "(" or out[-1].lower() in _BINDS):
        out.pop()
    return out


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in order, operators after them; parentheses that are left open close at the end."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        lower = token.lower()
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif lower in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[lower]:
                out.append(held.pop())
            held.append(lower)
        else:
            out.append(token)
    out += [x for x in reversed(held) if x != "("]
    return out


def _group(alternatives: list[frozenset[str]]) -> frozenset[str]:
    """Alternatives as one set of what must be met: the only one itself, else a text in parentheses."""
    return alternatives[0] if len(alternatives) == 1 else frozenset([f"({_text(alternatives)})"])


def _text(alternatives: list[frozenset[str]]) -> str:
    return " or ".join(sorted(" and ".join(sorted(s)) for s in alternatives))


def evaluate(order: list[str]) -> tuple[list[frozenset[str]], list[str]]:
    """(alternatives, identifiers): each alternative is a set of licenses that must all be met.

    More than 64 alternatives are not multiplied out: they stay two groups in parentheses, both of which must be
    met, and what holds a group is not multiplied out either, so the text doesn't grow with the product.
    """
    stack: list[list[frozenset[str]]] = []
    names: list[str] = []
    for token in order:
        if token in _BINDS and len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if token == "or":
                both = list(dict.fromkeys(a + b))
            elif token == "and":
                grouped = any(x.startswith("(") for s in a + b for x in s)
                multiply = len(a) * len(b) <= (1 if grouped else 64)
                both = list(dict.fromkeys(x | y for x in a for y in b)) if multiply else [_group(a) | _group(b)]
            else:
                exception = "+".join(sorted(set().union(*b)))
                both = [frozenset(f"{x} with {exception}" for x in s) for s in a]
            stack.append(both)
        elif token not in _BINDS:
            names.append(token.lower())
            stack.append([frozenset([token.lower()])])
    return (stack[-1] if stack else []), names


@dataclass(frozen=True)
class Found:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: tuple[str, ...]
    labels: tuple[str, ...]
    score: float
    expressions: tuple[str, ...]


class Scanner:
    """One automaton for phrases, one for tags; built once in a Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES}:
            self.phrases.add_word(f" {phrase} ", phrase)
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> Found:
        raw = (text or "").encode()
        words = raw.translate(_OTHER).split()
        n_base, starts, base, labels, strength = 0, [], set(), set(), 0.0
        line = " " + b" ".join(words).decode() + " "
        for end, phrase in self.phrases.iter(line):
            if phrase in BASE:
                start = end - len(phrase) - 1
                n_base += 1
                starts.append(start)
                base.add(BASE[phrase])
            labels.add(BASE.get(phrase) or NOTICES[phrase])
        strength += len(labels)
        if starts:  # a word's number is the number of spaces before it
            starts = [line.count(" ", 0, s) for s in (min(starts), max(starts))]
        expressions = []
        lower = raw.lower().decode()
        if "license-" in lower:
            for end, _ in self.tags.iter(lower):
                stop = lower.find("\n", end)
                rest = lower[end + 1 : stop if stop >= 0 else len(lower)]
                alternatives, names = evaluate(postfix(tokenize(rest)))
                if names:
                    labels.update(names)
                    expressions.append(_text(alternatives))
        strength += 2 * len(expressions)
        return Found(len(words), n_base, starts[0] if starts else None, starts[-1] if starts else None, tuple(sorted(base)), tuple(sorted(labels)), 1 - 0.5**strength, tuple(expressions))


_SCANNER: list[Scanner] = []
FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))]
)
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, expressions array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """All columns of docs but text, with the fields of Found; columns of the same names give way."""
    names = [f.name for f in FOUND]
    keep = [c for c in docs.columns if c not in ("text", *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            found = [_SCANNER[0].scan(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([getattr(f, n) if not isinstance(getattr(f, n), tuple) else list(getattr(f, n)) for f in found], FOUND.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=keep + names)

    rows = docs.select(*keep, common.whole_text(F.col("text")).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + [_DDL])
    return common.materialize(rows.mapInArrow(run, schema), "licenses")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", ";").alias("expressions"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(common.documents(spark, sf_dir).select("doc_id", "text")))
