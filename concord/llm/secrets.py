"""Secret scans with a ledger of blobs (operator 8), DataFrame functions only.

A blob is a text under its content address (SHA-256 of its UTF-8 bytes). scan() takes the versions of
files (rows of path columns and text) and a ledger, scans every blob once for each rule version that
the ledger lacks, and returns the ledger's new entries; findings() joins spans back to every path and
version that holds the blob. Entries of blobs without findings are kept too, so that they are not
scanned again. A rule whose version is raised is scanned anew over all blobs, the others are not.

Spans are in code points, end exclusive; within a rule they are leftmost and don't overlap. Matches that
fail a rule's least length are dropped after matching.

Defined cases: a null text counts as empty and has a blob like any other; repeated rows share a blob and
all get its spans; an empty table gives an empty ledger; other columns are ignored or carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common


@dataclass(frozen=True)
class Rule:
    """A pattern; where least is set, the group's text must have so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    #: One of these must stand in the text, where given; a cheap test before the pattern.
    hints: tuple[str, ...] = ()


#: In the order in which kinds of one start are listed; the first three are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----BEGIN ",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)),
)
BASE = tuple(r.kind for r in RULES[:3])

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def blob_of(text: Column) -> Column:
    return F.sha2(common.whole_text(text).cast("binary"), 256)


def matches_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text, in order: the length of what stands before each since the last one, its own, and whether it is kept."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else matches
    parts = F.arrays_zip(between.alias("between"), matches.alias("match"), held.alias("held"))  # the last one is what follows all matches
    found = F.transform(F.filter(parts, lambda x: x["match"].isNotNull()), lambda x: F.struct(x["between"].alias("between"), x["match"].alias("match"), (x["held"] >= rule.least).alias("keep")))
    may = F.rlike(text, pattern)
    for k, hint in enumerate(rule.hints):
        here = F.contains(text, F.lit(hint))
        any_hint = here if not k else any_hint | here
    if rule.hints:
        may = any_hint & may
    return F.when(may, found).otherwise(F.array().cast("array<struct<between:int,match:int,keep:boolean>>"))


def placed(entries: DataFrame) -> DataFrame:
    """Entries of matches as entries of spans. Places are running sums over the matches of a blob, so their time grows as their number."""
    matches = entries.where(F.size("matches") > 0).select("blob", "kind", "rule_version", F.posexplode("matches").alias("nth", "m"))
    end = F.sum((F.col("m.between") + F.col("m.match")).cast("long")).over(Window.partitionBy("blob", "kind").orderBy("nth"))
    spans = matches.withColumn("end", end).withColumn("span", F.when(F.col("m.keep"), F.struct("kind", (F.col("end") - F.col("m.match")).alias("start"), "end")))
    found = spans.groupBy("blob", "kind", "rule_version").agg(F.array_sort(F.collect_list("span")).cast(f"array<{SPAN}>").alias("spans"))
    none = entries.where(F.size("matches") == 0).select("blob", "kind", "rule_version", F.array().cast(f"array<{SPAN}>").alias("spans"))
    return none.unionByName(found)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New entries of the ledger: one for each rule and blob of versions that it lacks."""
    blobs = versions.select(common.whole_text(F.col(text)).alias("text")).withColumn("blob", blob_of(F.col("text")))
    entry = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).cast("int").alias("rule_version"), matches_of(F.col("text"), r).alias("matches"))
    if ledger is None:
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        return placed(common.materialize(unseen.select("blob", F.inline(F.array(*map(entry, rules)))), "matches"))
    asked = versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")
    done = ledger.join(F.broadcast(asked), ["kind", "rule_version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("done"))
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(done, "blob", "left")
    missing = lambda r: ~F.coalesce(F.array_contains("done", r.kind), F.lit(False))
    entries = F.filter(F.array(*[F.when(missing(r), entry(r)) for r in rules]), lambda x: x.isNotNull())
    unseen = unseen.where(F.size(F.coalesce("done", F.array().cast("array<string>"))) < len(rules))
    return placed(common.materialize(unseen.select("blob", F.inline(entries)), "matches"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of versions but text, with blob and spans in place of any of these names: the rules' spans of its blob by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    wanted = None
    for r in rules:
        here = (F.col("kind") == r.kind) & (F.col("rule_version") == r.version)
        wanted = here if wanted is None else wanted | here
    found = ledger.where(wanted & (F.size("spans") > 0)).dropDuplicates(["blob", "kind"])
    sorted_spans = F.array_sort(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"], order[s["kind"]].alias("rank"), s["end"], s["kind"])))
    per_blob = found.groupBy("blob").agg(F.transform(sorted_spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    rows = versions.drop("spans").withColumn("blob", blob_of(F.col(text))).drop(text)
    return rows.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


#: Spans that are sent to all executors at most, about 10 MB.
FEW_SPANS = 100_000


def redact(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the ledger masked."""
    kinds = F.create_map(*[F.lit(x) for r in RULES for x in (r.kind, r.version)])
    found = ledger.where((F.size("spans") > 0) & (kinds[F.col("kind")] == F.col("rule_version"))).dropDuplicates(["blob", "kind"])
    found = merged(found.select("blob", F.inline("spans")))
    found = common.materialize(found.withColumnsRenamed({"blob": "__blob", "spans": "__spans"}), "blobs-with-secrets")
    if (found.agg(F.sum(F.size("__spans") + 1)).first()[0] or 0) <= FEW_SPANS:
        found = F.broadcast(found)
    rows = docs.withColumn("__blob", blob_of(F.col(text))).join(found, "__blob", "left")
    return rows.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(mask(F.col(text), F.col("__spans")))).select(docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: DataFrame) -> DataFrame:
    """(blob, spans): the spans (blob, start, end) of a blob by start, overlapping ones as one."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("apart", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = rows.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every one of the spans, sorted and apart, as [SECRET].

    To cut a text at a place takes time as the text is long, so it is cut into the cube root of the spans' number of chunks, these again, and the last ones at their spans.
    """
    end = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.get(spans, i)["end"]).cast("int")
    cut = lambda x, lo, hi: F.substring(x, lo + 1, hi - lo)

    def masked(x: Column, base: Column, first: Column, last: Column, depth: int) -> Column:
        """What stands from the end of the span before first to the end of last; x begins at base."""
        if not depth:
            return F.array_join(F.transform(F.sequence(first, last), lambda i: F.concat(cut(x, end(i - 1) - base, F.get(spans, i)["start"].cast("int") - base), F.lit("[SECRET]"))), "")
        n = last - first + 1
        step = F.ceil(F.pow(n, F.lit(depth / (depth + 1)))).cast("int")

        def chunk(c: Column) -> Column:
            lo, hi = first + c * step, F.least(first + (c + 1) * step - 1, last)
            return common.let(cut(x, end(lo - 1) - base, end(hi) - base), lambda y: masked(y, end(lo - 1), lo, hi, depth - 1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), chunk), "")

    last = F.size(spans) - 1
    return F.concat(masked(text, F.lit(0), F.lit(0), last, 2), cut(text, end(last), F.length(text)))


def digest(rows: DataFrame) -> DataFrame:
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@common.finished
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    ledger = common.materialize(scan(docs), "secret-ledger")
    return digest(findings(docs, ledger))


#: Patterns with two groups each, group 2 being the one that is measured; in DuckDB no flag folds ASCII letters alone.
SQL = r"""
WITH k(kind, rank, least, pattern) AS (VALUES
  ('assign', 0, 8, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 16, '()(AKIA[A-Z0-9]+)'),
  ('hex', 2, 32, '()([0-9a-f]+)'),
  ('private_key', 3, 0, '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)'),
  ('github', 4, 0, '()(gh[pousr]_[A-Za-z0-9]{36,})'),
  ('slack', 5, 0, '()(xox[abprs]-[A-Za-z0-9-]{10,})'),
  ('jwt', 6, 0, '()(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})')),
x AS (
  SELECT doc_id, kind, rank, least, list_transform(string_split_regex(coalesce(text, ''), pattern), lambda s: length(s)) AS gap,
         list_transform(regexp_extract_all(coalesce(text, ''), pattern, 0), lambda s: length(s)) AS n,
         list_transform(regexp_extract_all(coalesce(text, ''), pattern, 2), lambda s: length(s)) AS held
  FROM documents, k WHERE regexp_matches(coalesce(text, ''), pattern)),
y AS (
  SELECT doc_id, kind, rank, n[i] AS n, list_sum(gap[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS pos
  FROM x, unnest(range(1, len(n) + 1)) u(i) WHERE held[i] >= least),
z AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || pos::BIGINT || ':' || (pos + n)::BIGINT, ',' ORDER BY pos, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || pos::BIGINT || ':' || (pos + n)::BIGINT, ',' ORDER BY pos, rank) AS spans
  FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN z USING (doc_id)
"""
