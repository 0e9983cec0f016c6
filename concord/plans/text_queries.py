"""Text rules over decorated names."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.plans import bindings as B
from concord.plans import sql_text as S

# --- rules over the given tables


def clean_names(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.TRACKS).withColumn("n", T.normalise(F.col("raw_artist"), F.col("raw_title")))
    return rows.select("track_id", "n.artist", "n.title", "n.artist_full", F.array_join("n.featured", "|").alias("featured"))


def house_titles(spark, sf_dir):
    return B.relation(spark, sf_dir, B.TRACKS).select("track_id", T.canonical_title(F.col("raw_title")).alias("house"))


def file_names(spark, sf_dir):
    return B.relation(spark, sf_dir, B.TRACKS).select("track_id", T.filename(F.col("raw_artist"), F.col("raw_title")).alias("file_name"))


def stripped_versions(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.TRACKS).withColumn("v", T.extract_version(F.col("raw_title")))
    return rows.select("track_id", T.strip_version(F.col("raw_title")).alias("bare"), "v.mix_name")


def comparison_keys(spark, sf_dir):
    v, f = F.col("value"), F.col("field")
    return B.relation(spark, sf_dir, B.CANDIDATES).select("field", "value").distinct().select(
        "field", "value", T.key(v).alias("key"), T.words_key(v).alias("words"), T.ascii_key(v).alias("ascii"), T.option_key(v).alias("option"),
        T.label_key(v).alias("label"), T.album_key(v).alias("album"), T.core_key(f, v).alias("core"), T.is_non_label(v).alias("non_label"),
    )


def artist_credits(spark, sf_dir):
    return B.relation(spark, sf_dir, B.TRACKS).select("track_id", T.format_artists(T.split_artists(F.col("raw_artist"))).alias("credit"))


def variant_flags(spark, sf_dir):
    return B.relation(spark, sf_dir, B.TRACKS).select("track_id", T.variant_mismatch(F.lit("live song"), F.concat("raw_title", F.lit(" (Acoustic Live Demo)"))).alias("mismatch"), T.same_text(F.col("raw_title"), F.upper("raw_title")).alias("same"))


def genre_routing(spark, sf_dir):
    rows = B.relation(spark, sf_dir, B.CANDIDATES).where("field in ('genre', 'label')").groupBy("track_id").agg(
        F.min_by(F.when(F.col("field") == "genre", F.col("value")), F.when(F.col("field") == "genre", F.col("ord"))).alias("genre"),
        F.max_by(F.when(F.col("field") == "label", F.col("value")), F.when(F.col("field") == "label", F.col("ord"))).alias("label"),
    )
    isrc = F.when(F.col("track_id") % 50 == 0, "INABC").otherwise("USABC")
    return rows.select("track_id", T.family_for_identity(F.when(F.col("genre") == "Deep House", "Electronic").otherwise(F.col("genre")), isrc, F.col("genre"), F.col("label")).alias("family"))


def artwork_sizes(spark, sf_dir):
    return B.relation(spark, sf_dir, B.CANDIDATES).where("field = 'artwork_url'").select("track_id", "ord", T.upscale_artwork(F.col("value")).alias("url"))


def padded_dates(spark, sf_dir):
    return B.relation(spark, sf_dir, B.CANDIDATES).where("field = 'release_date'").select("track_id", "ord", T.padded_date(F.col("value")).cast("string").alias("day"))


_TRACKS = f"tracks AS ({B.duck(B.TRACKS)})"
_C = f"c AS ({B.duck(B.CANDIDATES)})"
# The patterns of concord.functions.text, by which names are cleaned, in DuckDB's syntax.
_CREDIT_SPLIT = r"(?i)\s*(?:;|,|&| x | vs\.? | and )\s*"
_SUFFIXES = S.sub(S.sub(S.sub(S.tidy("raw_artist"), r"(?i)\s*-\s*Topic$"), r"(?i)\s*VEVO$"), r"(?i)\s*-\s*Official$")
_NOISE = r"(?i)[\(\[]\s*(?:official\s*(?:music\s*)?(?:video|audio|visuali[sz]er)?|music\s*video|lyrics?(?:\s*video)?|visuali[sz]er|m/?v|audio|hd|hq|4k|full\s*(?:album|song)|out\s*now|free\s*(?:dl|download)|premiere|explicit|clean|remaster(?:ed)?(?:\s*\d{4})?|bonus\s*track?)\s*[\)\]]"
_BARE = r"(?i)\s*[-|]?\s*(?:official\s*(?:music\s*)?video|official\s*audio|lyrics?\s*video|visuali[sz]er|out\s*now|bonus\s*track)\s*$"
_FEAT = r"(?i)\s*[\(\[]?\s*\b(?:feat\.?|featuring|ft\.?|with)\s+[^)\]]*[\)\]]?\s*"
_FEAT_END = r"(?i)[\(\[]?\s*\b(?:feat\.?|featuring|ft\.?)\s+([^)\]]+?)\s*[\)\]]?\s*$"
_DELUXE_LABELS = ", ".join(map(S.q, vocab.NON_LABELS))
_FAMILY_CASE = "CASE lower(trim(g)) " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in vocab.FAMILY_OF_GENRE.items()) + " ELSE 'other' END"

QUERIES = {
    f.__name__: f
    for f in (
        padded_dates, artwork_sizes, clean_names, house_titles, file_names, stripped_versions, comparison_keys, artist_credits, variant_flags, genre_routing,
    )
}
ORACLE = {
    "clean_names": f"""WITH {_TRACKS},
a AS (SELECT track_id, raw_title, {S.tidy(_SUFFIXES)} AS artist_full, {S.tidy(f"(regexp_split_to_array({_SUFFIXES}, {S.q(_CREDIT_SPLIT)}))[1]")} AS artist FROM tracks),
n AS (SELECT *, {S.sub(S.sub(S.tidy('raw_title'), _NOISE, ' '), _BARE)} AS t FROM a),
p AS (SELECT *, CASE WHEN contains(t, ' - ') AND artist <> '' AND contains(lower(split_part(t, ' - ', 1)), lower(artist)) AND length(split_part(t, ' - ', 1)) < 60 AND trim(substr(t, instr(t, ' - ') + 3)) <> '' THEN substr(t, instr(t, ' - ') + 3) ELSE t END AS u FROM n)
SELECT track_id, artist, {S.sub(S.tidy(S.sub('u', _FEAT, ' ')), r'^[ \-–:|]+|[ \-–:|]+$')} AS title, artist_full,
       array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract({S.tidy('raw_title')}, {S.q(_FEAT_END)}, 1), {S.q(_CREDIT_SPLIT)}), lambda x: trim(x)), lambda x: x <> ''), '|') AS featured FROM p""",
    "house_titles": f"WITH {_TRACKS}, {S.house_title('tracks', 'raw_title', 'track_id')} SELECT track_id, house FROM t4",
    "file_names": f"WITH {_TRACKS}, {S.house_title('tracks', 'raw_title', 'track_id, raw_artist')} SELECT track_id, {S.safe('raw_artist')} || ' - ' || {S.safe('house')} || '.aiff' AS file_name FROM t4",
    "stripped_versions": f"""WITH {_TRACKS} SELECT track_id, {S.strip_version('raw_title')} AS bare,
CASE WHEN regexp_matches({S.squeeze('raw_title')}, {S.q('(?i)' + S.MIX)}) THEN trim(regexp_extract({S.squeeze('raw_title')}, {S.q('(?i)' + S.MIX)}, 1)) ELSE trim(regexp_extract({S.squeeze('raw_title')}, {S.q('(?i)' + S.DASH)}, 1)) END AS mix_name FROM tracks""",
    "comparison_keys": f"""WITH {_C} SELECT DISTINCT field, value, {S.key('value')} AS key, {S.squeeze(S.sub('lower(value)', r'[^\p{L}\p{N}_\s]', ' '))} AS words, {S.sub('lower(value)', '[^a-z0-9]')} AS ascii, {S.squeeze('lower(value)')} AS option,
{S.squeeze("replace(lower(value), '.', ' ')")} AS label, {S.album_key('value')} AS album, {S.core_key('field', 'value')} AS core,
trim(split_part(lower(value), '(', 1)) IN ({_DELUXE_LABELS}) OR trim(split_part(lower(value), '(', 1)) = '' AS non_label FROM c""",
    "artist_credits": f"""WITH {_TRACKS}, n AS (SELECT track_id, {S.names('raw_artist')} AS a FROM tracks)
SELECT track_id, CASE WHEN len(a) = 0 THEN '' WHEN len(a) = 1 THEN a[1] ELSE array_to_string(a[1:len(a) - 1], ', ') || ' & ' || a[len(a)] END AS credit FROM n""",
    "variant_flags": f"""WITH {_TRACKS} SELECT track_id, ({' OR '.join(f"(contains(lower(raw_title || ' (Acoustic Live Demo)'), {S.q(w)}) AND NOT contains('live song', {S.q(w)}))" for w in vocab.VARIANT_WORDS)}) AS mismatch, true AS same FROM tracks""",
    "genre_routing": f"""WITH {_C}, r AS (SELECT track_id, arg_min(value, ord) FILTER (field = 'genre') AS genre, arg_max(value, ord) FILTER (field = 'label') AS label FROM c WHERE field IN ('genre', 'label') GROUP BY 1),
x AS (SELECT *, CASE WHEN genre = 'Deep House' THEN 'Electronic' ELSE coalesce(genre, '') END AS g FROM r)
SELECT track_id, CASE WHEN track_id % 50 = 0 OR lower(coalesce(genre, '')) = 'bollywood' THEN 'world' ELSE {_FAMILY_CASE} END AS family FROM x""",
    "artwork_sizes": f"WITH {_C} SELECT track_id, ord, replace(value, '100x100', '1200x1200') AS url FROM c WHERE field = 'artwork_url'",
    "padded_dates": f"WITH {_C} SELECT track_id, ord, CASE length(value) WHEN 4 THEN value || '-01-01' WHEN 7 THEN value || '-01' ELSE value END AS day FROM c WHERE field = 'release_date'",
}
