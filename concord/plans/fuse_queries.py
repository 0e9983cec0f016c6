"""Fusion: the flagship and what hangs on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import vocab
from concord.operators import calibrate, fuse
from concord.plans import bindings as B
from concord.plans import sql_text as S


def _candidates(spark, sf_dir):
    return B.relation(spark, sf_dir, B.CANDIDATES)


def fuse_decisions(spark, sf_dir):
    return fuse.arbitrate(_candidates(spark, sf_dir), vocab.default_ranking(spark))


def ranked_sources(spark, sf_dir):
    """Every candidate with the rank of its source for its family and field."""
    ranked = fuse.rank_candidates(B.relation(spark, sf_dir, B.CANDIDATES), vocab.default_ranking(spark))
    return ranked.select("track_id", "ord", F.col("rank").cast("int").alias("rank"), "is_ranked")


def fuse_calibrated(spark, sf_dir):
    """Decisions under the ranking that recorded choices give."""
    default = vocab.default_ranking(spark)
    derived = calibrate.derive(calibrate.observations(B.relation(spark, sf_dir, B.OBSERVATIONS)), default)
    return fuse.arbitrate(_candidates(spark, sf_dir), fuse.resolved_ranking(default, derived))


def fuse_rearbitrate(spark, sf_dir):
    return fuse.rearbitrate(_candidates(spark, sf_dir), vocab.default_ranking(spark), B.relation(spark, sf_dir, B.RESOLVED))


def fuse_persist(spark, sf_dir):
    return fuse.persist(B.relation(spark, sf_dir, B.RESOLVED), fuse_decisions(spark, sf_dir))


def fuse_album_source(spark, sf_dir):
    rows = fuse.with_albums(_candidates(spark, sf_dir), vocab.default_ranking(spark))
    return rows.where("album_source is not null").select("track_id", "album_source").distinct()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(S.q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_DELUXE = " OR ".join(f"contains(lower(album), {S.q(w)})" for w in vocab.DELUXE_WORDS)
_CREDITS = ", ".join(map(S.q, vocab.COMPILATION_CREDITS))
_NON_LABELS = ", ".join(map(S.q, vocab.NON_LABELS))

BUILT_IN = f"SELECT * FROM (VALUES {_values(vocab.ranking_rows())}) v(family, field, rank, source)"


def decisions_sql(candidates: str, ranking: str = BUILT_IN) -> str:
    """Relations in order; the last, decisions, is the result. Both arguments are queries."""
    return f"c AS ({candidates}),\nranking AS ({ranking}),{_RULES}"


_RULES = f"""
sizes AS (SELECT family, field, count(*) AS n FROM ranking GROUP BY ALL),
r AS (SELECT c.*, coalesce(k.rank, s.n, 0) AS rk, k.rank IS NOT NULL AS ranked, field IN ('genre', 'artwork_url') OR (family = 'world' AND field = 'artist') AS skip
      FROM c LEFT JOIN ranking k USING (family, field, source) LEFT JOIN sizes s USING (family, field) WHERE value <> ''),
plain AS (SELECT * FROM r WHERE field NOT IN ('album', 'album_artist', 'track_number', 'disc_number', 'release_date', 'year', 'artwork_url')
          AND NOT (field = 'label' AND (trim(split_part(lower(value), '(', 1)) IN ({_NON_LABELS}) OR trim(split_part(lower(value), '(', 1)) = ''))),
keyed AS (SELECT *, 1 AS tier, {S.key('value')} AS k FROM plain WHERE NOT skip
          UNION ALL SELECT *, 2, {S.key(S.strip_version('value'))} FROM plain WHERE NOT skip
          UNION ALL SELECT *, 3, {S.core_key('field', 'value')} FROM plain WHERE NOT skip),
g AS (SELECT track_id, field, tier, k, count(DISTINCT source) AS n, min(rk) AS best, min(ord) AS first FROM keyed GROUP BY ALL),
top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY track_id, field, tier ORDER BY n DESC, best, first) = 1),
pick AS (SELECT track_id, field, coalesce(min(tier) FILTER (n >= 2), 1) AS tier FROM top GROUP BY ALL),
agreed AS (SELECT keyed.* FROM keyed JOIN pick USING (track_id, field, tier) JOIN top USING (track_id, field, tier, k)
           QUALIFY row_number() OVER (PARTITION BY track_id, field ORDER BY CASE WHEN tier = 3 THEN -length(value) ELSE 0 END, rk, ord) = 1),
ordered AS (SELECT * FROM plain WHERE skip QUALIFY row_number() OVER (PARTITION BY track_id, field ORDER BY ranked DESC, CASE WHEN ranked THEN rk ELSE 0 END, ord) = 1),
won AS (SELECT track_id, field, value, source, CASE WHEN ranked THEN 'precedence' ELSE 'fallback' END AS decided_by FROM agreed
        UNION ALL SELECT track_id, field, value, source, CASE WHEN ranked THEN 'precedence' ELSE 'fallback' END FROM ordered),
dates AS (SELECT track_id, field, value, source, 'precedence' AS decided_by FROM r WHERE field IN ('release_date', 'year')
          QUALIFY row_number() OVER (PARTITION BY track_id, field ORDER BY left(trim(value), 4), -length(trim(value)), trim(value), ord) = 1),
offers AS (SELECT track_id, family, source, min(ord) AS first, arg_min(value, ord) FILTER (field = 'album_artist') AS credit, arg_max(value, ord) FILTER (field = 'album') AS album, min(ord) FILTER (field = 'album') AS first_album
           FROM r WHERE field IN ('album', 'album_artist', 'track_number', 'disc_number') GROUP BY ALL),
judged AS (SELECT o.*, coalesce(k.rank, s.n, 0) AS rk, k.rank IS NOT NULL AS ranked, {S.key("coalesce(credit, '')")} AS ck, {S.key("coalesce(w.value, '')")} AS ak, coalesce(w.value, '') AS act
           FROM offers o LEFT JOIN (SELECT * FROM won WHERE field = 'artist') w USING (track_id)
           LEFT JOIN (SELECT * FROM ranking WHERE field = 'album') k ON k.family = o.family AND k.source = o.source LEFT JOIN (SELECT * FROM sizes WHERE field = 'album') s ON s.family = o.family),
pool AS (SELECT *, {S.album_key("coalesce(album, '')")} AS akey, bool_or(album IS NOT NULL) OVER (PARTITION BY track_id) AS titled FROM judged
         WHERE NOT (coalesce(credit, '') <> '' AND (lower(trim(credit)) IN ({_CREDITS}) OR (act <> '' AND family <> 'world' AND NOT (starts_with(ck, ak) OR starts_with(ak, ck)))))),
groups AS (SELECT track_id, akey, count(*) AS n, min(rk) AS best, min(first_album) AS first FROM pool WHERE album IS NOT NULL GROUP BY ALL),
best_group AS (SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, best, first) = 1),
chosen AS (
  SELECT track_id, source AS album_source FROM (SELECT p.*, {_DELUXE} AS deluxe, regexp_matches(album, '\\s+\\d+\\.\\d+\\s*$') AS numbered FROM pool p JOIN best_group b USING (track_id, akey) WHERE album IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY deluxe DESC, numbered DESC, rk, first_album) = 1
  UNION ALL
  SELECT track_id, source FROM pool WHERE NOT titled QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ranked DESC, CASE WHEN ranked THEN rk ELSE 0 END, first) = 1),
albums AS (SELECT r.track_id, field, value, source, 'precedence' AS decided_by FROM r JOIN chosen USING (track_id) WHERE source = album_source AND field IN ('album', 'album_artist', 'track_number', 'disc_number')
           QUALIFY row_number() OVER (PARTITION BY r.track_id, field ORDER BY ord) = 1),
last_album AS (SELECT track_id, source, arg_max(value, ord) AS own FROM r WHERE field = 'album' GROUP BY ALL),
covers AS (SELECT track_id, field, value, source, 'precedence' AS decided_by FROM (
    SELECT r.*, CASE WHEN coalesce(a.value, '') <> '' AND {S.album_key("coalesce(l.own, '')")} = {S.album_key("a.value")} THEN 0 WHEN r.source = ch.album_source THEN 1 ELSE 2 END AS tier
    FROM r LEFT JOIN last_album l ON l.track_id = r.track_id AND l.source = r.source LEFT JOIN chosen ch ON ch.track_id = r.track_id
    LEFT JOIN (SELECT * FROM albums WHERE field = 'album') a ON a.track_id = r.track_id WHERE r.field = 'artwork_url')
  QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY tier, CASE WHEN tier = 1 THEN 0 ELSE rk END, ord) = 1),
base AS (SELECT * FROM won UNION ALL SELECT * FROM dates UNION ALL SELECT * FROM albums UNION ALL SELECT * FROM covers),
guests AS (SELECT t.track_id, list_filter({S.names("f.value")}, lambda x: NOT contains({S.key("t.value")}, {S.key("x")}) AND NOT list_contains(list_transform({S.names("coalesce(a.value, '')")}, lambda y: {S.key("y")}), {S.key("x")})) AS missing
           FROM base t JOIN base f ON f.track_id = t.track_id AND f.field = 'featured_artists' LEFT JOIN base a ON a.track_id = t.track_id AND a.field = 'artist' WHERE t.field = 'title'),
decisions AS (SELECT track_id, field, CASE WHEN field = 'title' AND len(missing) > 0 THEN value || ' (feat. ' || CASE WHEN len(missing) = 1 THEN missing[1] ELSE array_to_string(missing[1:len(missing) - 1], ', ') || ' & ' || missing[len(missing)] END || ')' ELSE value END AS value, source, decided_by
              FROM base LEFT JOIN guests USING (track_id))
"""
_CTES = decisions_sql(B.duck(B.CANDIDATES))
_RESOLVED = f"resolved AS ({B.duck(B.RESOLVED)})"

QUERIES = {
    "fuse_decisions": fuse_decisions,
    "ranked_sources": ranked_sources,
    "fuse_calibrated": fuse_calibrated,
    "fuse_rearbitrate": fuse_rearbitrate,
    "fuse_persist": fuse_persist,
    "fuse_album_source": fuse_album_source,
}
ORACLE = {
    "fuse_decisions": f"WITH {_CTES} SELECT track_id, field, value, source, decided_by FROM decisions",
    "ranked_sources": f"""WITH c AS ({B.duck(B.CANDIDATES)}), b AS ({BUILT_IN}), n AS (SELECT family, field, count(*) AS n FROM b GROUP BY ALL)
SELECT track_id, ord, coalesce(b.rank, n.n, 0)::INTEGER AS rank, b.rank IS NOT NULL AS is_ranked FROM c LEFT JOIN b USING (family, field, source) LEFT JOIN n USING (family, field)""",
    "fuse_rearbitrate": f"""WITH {_CTES}, {_RESOLVED},
o AS (SELECT * FROM resolved WHERE decided_by NOT IN ('manual', 'url_override'))
SELECT coalesce(o.track_id, d.track_id) AS track_id, count(*) AS changed FROM o FULL JOIN decisions d ON o.track_id = d.track_id AND o.field = d.field
WHERE o.value IS DISTINCT FROM d.value GROUP BY 1""",
    "fuse_persist": f"""WITH {_CTES}, {_RESOLVED},
kept AS (SELECT * FROM resolved WHERE decided_by IN ('manual', 'url_override')),
fresh AS (SELECT * FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.track_id = d.track_id AND k.field = d.field))
SELECT * FROM kept UNION ALL SELECT track_id, field, value, source, decided_by FROM fresh
UNION ALL SELECT * FROM resolved o WHERE decided_by NOT IN ('manual', 'url_override') AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.track_id = o.track_id AND f.field = o.field)""",
    "fuse_album_source": f"WITH {_CTES} SELECT track_id, album_source FROM chosen",
}
