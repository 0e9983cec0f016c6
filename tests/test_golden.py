"""Golden rows of the rules and payloads: what each gives, stated plainly."""

import duckdb
import pytest
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.plans import sql_text as S
from concord.sources import catalogues
from tests.test_queries import rows_of

# --- golden rows: fixed values


NORMALISE = [
    ("LMFAOVEVO", "LMFAO - Party Rock Anthem ft. Lauren Bennett, GoonRock", "LMFAO", "Party Rock Anthem"),
    ("Calvin Harris", "Calvin Harris - I Need Your Love (Official Video) ft. Ellie Goulding", "Calvin Harris", "I Need Your Love"),
    ("DJ Khaled", "DJ Khaled - I'm The One ft. Justin Bieber, Quavo, Chance the Rapper", "DJ Khaled", "I'm The One"),
    ("Burnie, Phoenix Ho", "Make It", "Burnie", "Make It"),
    ("Rihanna", "Rihanna - Umbrella (Orange Version)", "Rihanna", "Umbrella (Orange Version)"),
    ("21 Savage; Metro Boomin", "Mr. Right Now (feat. Drake)", "21 Savage", "Mr. Right Now"),
    ("24kGoldn", "Mood (feat. iann dior)", "24kGoldn", "Mood"),
    ("Burnie - Topic", "Make It - H.K.G Mix", "Burnie", "Make It - H.K.G Mix"),
    ("Maroon_5", "Maroon_5_-_Sugar_Official_Music_Video", "Maroon 5", "Sugar"),
    ("Ultra Records", "OMI - Cheerleader (Felix Jaehn Remix) [Official Video]", "Ultra Records", "OMI - Cheerleader (Felix Jaehn Remix)"),
    ("Kesha", "Ke$ha - Blow (Official Video)", "Kesha", "Ke$ha - Blow"),
    ("Drake", "Hotline Bling [Official Music Video]", "Drake", "Hotline Bling"),
    ("Artist", "Song (Remastered 2011)", "Artist", "Song"),
    ("Fred again..", "Delilah (Tom Santa Remix)", "Fred again..", "Delilah (Tom Santa Remix)"),
    ("Khalid; LEFTI", "in plain sight (LEFTI REMIX)", "Khalid", "in plain sight (LEFTI REMIX)"),
    ("David Guetta", "I'm Good (Blue) - Brooks Remix", "David Guetta", "I'm Good (Blue) - Brooks Remix"),
    ("Selena Gomez", "Selena Gomez, Marshmello - Wolves", "Selena Gomez", "Wolves"),
    ("Lil Uzi Vert", "That Way - Bonus Track", "Lil Uzi Vert", "That Way"),
    ("Artist", "Song (Bonus Track)", "Artist", "Song"),
    ("Pitbull", "Time of Our Lives", "Pitbull", "Time of Our Lives"),
    ("", "LMFAO - Party Rock Anthem", "LMFAO", "Party Rock Anthem"),
]
TITLES = [
    ("Mood (feat. iann dior)", "Mood (ft. iann dior)"), ("Mood (ft. iann dior)", "Mood (ft. iann dior)"), ("Mood (Feat. iann dior)", "Mood (ft. iann dior)"), ("Mood featuring iann dior", "Mood (ft. iann dior)"),
    ("Delilah (Tom Santa Remix)", "Delilah [Tom Santa Remix]"), ("Delilah [Tom Santa Remix]", "Delilah [Tom Santa Remix]"), ("I'm Good (Blue) - Brooks Remix", "I'm Good (Blue) [Brooks Remix]"),
    ("Say Nothing - Extended Mix", "Say Nothing [Extended Mix]"), ("Everyday We Lit (Remix) (feat. Wiz Khalifa)", "Everyday We Lit (ft. Wiz Khalifa) [Remix]"),
    ('Hamari Adhuri Kahani (Title Track) [From "Hamari Adhuri Kahani"]', "Hamari Adhuri Kahani (Title Track)"), ("Lose Yourself (From the Motion Picture 8 Mile)", "Lose Yourself"),
    ("Title (From Another Angle)", "Title (From Another Angle)"), ("From Me To You", "From Me To You"), ("I'Ll Be There", "I'll Be There"),
]
VERSIONS = [
    ("Delilah [Tom Santa Remix]", "Tom Santa Remix", "Tom Santa"), ("Make It - H.K.G Mix", "H.K.G Mix", "H.K.G"), ("Say Nothing - Extended Mix", "Extended Mix", ""), ("I'm Not Alone (2019 Edit)", "2019 Edit", ""),
    ("Love Story (Taylor's Version)", "Taylor's Version", ""), ("Despacito (Major Lazer & MOSKA remix)", "Major Lazer & MOSKA remix", "Major Lazer & MOSKA"), ("Mood (ft. iann dior)", "", ""),
]
ARTISTS = [("Pitbull", "Pitbull"), ("A;;B", "A & B"), ("David Guetta;Bebe Rexha;Brooks", "David Guetta, Bebe Rexha & Brooks"), ("", "")]
COMPONENTS = [("AC/DC", "AC-DC"), ("Drake: The Album", "Drake- The Album"), ("...", "unknown"), ("Fred again..", "Fred again.."), ("x" * 500, "x" * 120)]
GENRES = [
    ("Electronic", "electronic"), ("Hip Hop", "hip-hop"), ("Pop", "pop"), ("Rock", "pop"), ("Funk / Soul", "r&b-soul"), ("Latin", "world"), ("Reggae", "world"),
    ("Folk, World, & Country", "world"), ("Stage & Screen", "world"), ("Jazz", "other"), ("Classical", "other"), ("", "other"), ("unknown", "other"),
]
_ID22, _ID36 = "4uLU6hMCjMI75M1A2tKUQC", "b1a9c0e9-d987-4042-ae91-78d6a3267d69"
LINKS = [
    (f"https://open.spotify.com/track/{_ID22}?si=x", "spotify", "track", _ID22), (f"https://open.spotify.com/intl-de/track/{_ID22}", "spotify", "track", _ID22), (f"https://open.spotify.com/album/{_ID22}", "spotify", "album", _ID22),
    (f"spotify:track:{_ID22}", "spotify", "track", _ID22), (f"see https://musicbrainz.org/recording/{_ID36} there", "musicbrainz", "recording", _ID36), (f"https://musicbrainz.org/release/{_ID36}", "musicbrainz", "release", _ID36),
    ("https://www.discogs.com/release/12345-Name", "discogs", "release", "12345"), ("https://www.discogs.com/master/99", "discogs", "master", "99"), ("https://www.beatport.com/track/name/77", "beatport", "track", "77"),
    ("https://example.com/track/1", None, None, None), ("", None, None, None), ("https://open.spotify.com/track/short", None, None, None),
]
PLAUSIBLE = [
    ("Morgan Wallen", "Last Night", "Metro Station", "California", False), ("Beyonce", "Halo", "Deborah Cox", "Nobody's Supposed to Be Here", False), ("Owl City", "Fireflies", "Vanilla Ice", "Ice Ice Baby", False),
    ("Avicii", "Waiting For Love", "Juice WRLD", "The Party Never Ends", False), ("jayseanworldwide", "Down", "Jay Sean", "Down", True), ("iyazlive", "Replay", "Iyaz", "Replay", True),
    ("push baby", "Me And My Broken Heart", "Rixton", "Me and My Broken Heart", True), ("Train", "Hey, Soul Sister", "Train", "Hey, Soul Sister (Country Mix)", True),
]
UNRELATED = [
    ("Avicii", "Die NotenDealer", True), ("Taylor Swift", "Luke Conard", True), ("Morgan Wallen", "Metro Station", True), ("Beyonce", "Deborah Cox", True), ("push baby", "Rixton", True),
    ("jayseanworldwide", "Jay Sean", False), ("Queen Official", "Queen", False), ("JAŸ-Z", "Jay‐Z", False), ("kesha", "Ke$ha", False), ("will i am", "will.i.am", False), ("MKTO Band", "MKTO", False),
]


def _table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)



def normalise_golden(spark, sf_dir):
    rows = _table(spark, [r[:2] for r in NORMALISE], "raw_artist string, raw_title string")
    return rows.withColumn("n", T.normalise(F.col("raw_artist"), F.col("raw_title"), compose=True)).select("raw_artist", "raw_title", "n.artist", "n.title")


def title_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in TITLES], "raw string").select("raw", T.canonical_title(F.col("raw")).alias("title"))


def version_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in VERSIONS], "raw string").withColumn("v", T.extract_version(F.col("raw"))).select("raw", "v.mix_name", "v.remixer")


def artists_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in ARTISTS], "raw string").select("raw", T.format_artists(F.split("raw", ";")).alias("credit"))


def component_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in COMPONENTS], "raw string").select("raw", T.safe_component(F.col("raw"), compose=True).alias("component"))


def genre_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in GENRES], "genre string").select("genre", T.family_for(F.col("genre")).alias("family"))


def link_golden(spark, sf_dir):
    return _table(spark, [r[:1] for r in LINKS], "url string").withColumn("r", T.parse_link(F.col("url"))).select("url", "r.provider", "r.kind", "r.identifier")


def plausible_golden(spark, sf_dir):
    rows = _table(spark, [r[:4] for r in PLAUSIBLE], "query_artist string, query_title string, artist string, title string")
    scored = similarity.match_score(rows, "query_artist", "query_title", "artist", "title")
    return scored.select("query_artist", "query_title", "artist", "title", similarity.is_plausible(F.col("match_score")).alias("plausible"))


def unrelated_golden(spark, sf_dir):
    return similarity.artist_is_unrelated(_table(spark, [r[:2] for r in UNRELATED], "query_artist string, artist string"), "query_artist", "artist").select("query_artist", "artist", "artist_unrelated")


# --- payloads: fixed values

ITUNES = '{"results":[{"trackName":"Cybernetic","artistName":"The Act","collectionName":"Record - Single","primaryGenreName":"Dance","trackNumber":3,"discNumber":0,"releaseDate":"2000-11-30T08:00:00Z","artworkUrl100":"http://a/100x100bb.jpg"}]}'
SPOTIFY = '{"results":[{"name":"Song","artists":[{"name":"First"},{"name":"Second"}],"album":{"name":"LP","artists":[{"name":"First"}],"release_date":"2011-05","images":[{"url":"http://i/1"},{"url":"http://i/2"}]},"track_number":4,"disc_number":1,"external_ids":{"isrc":"USX"}}]}'
DISCOGS = '{"results":[{"style":["Techno"],"genre":["Electronic"],"label":["Cybernetic"],"catno":"C1","year":"2010"},{"style":["Bollywood"],"genre":["Stage & Screen"],"label":["Virgin"],"catno":"V1","year":"2000"}]}'
BEATPORT = '{"results":[{"name":"Track","mix_name":"Extended Mix","artists":[{"name":"A"}],"remixers":[{"name":"R"}],"genre":{"name":"Dance"},"sub_genre":{"name":"Melodic"},"release":{"name":"EP","label":{"name":"L"},"catalog_number":"L1"},"publish_date":"2020-01-02","isrc":"GBX","bpm":"124","key":{"name":"A min","camelot_number":8,"camelot_letter":"A"}}]}'
ACOUSTID = '{"status":"ok","results":[{"id":"u","score":0.5},{"id":"x","score":0.9,"recordings":[{"id":"r1","title":"T","artists":[{"name":"A"}]},{"id":"r2"},{"id":"r1"}]},{"id":"y","score":0.997,"recordings":[]}]}'
RECORDING = (
    '{"id":"m1","title":"Neverender","length":200,"score":100,"artist-credit":[{"name":"Justice","joinphrase":" feat. "},{"name":"Tame Impala","joinphrase":""}],"releases":['
    '{"id":"a","title":"Compilation","date":"2010","artist-credit":[{"name":"Various Artists"}],"release-group":{"id":"ga","primary-type":"Album","secondary-types":["Compilation"]},"media":[{"track-count":40,"position":1,"tracks":[{"number":"7"}]}]},'
    '{"id":"b","title":"Hyperdrama","date":"2024-04-26","artist-credit":[{"name":"Justice"}],"release-group":{"id":"gb","primary-type":"Album","secondary-types":[]},"media":[{"track-count":13,"position":1,"tracks":[{"number":"A1"}]}]}]}'
)
PROBE = '{"streams":[{"codec_type":"video","codec_name":"h264"},{"codec_type":"audio","codec_name":"opus","bit_rate":"160000","sample_rate":"48000","channels":2}],"format":{"duration":"12.5","tags":{"TITLE":"T","encoder":"x"}}}'
PLAYLIST = '{"id":"p","title":"P","entries":[{"id":"v1","title":"One","channel":"C"},null,{"id":"","title":"none"},{"id":"v2","title":"Two"}]}'


def payloads_of(spark, *payloads):
    return spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload string")



def catalogue_candidates(spark, sf_dir):
    out = None
    for parse, schema, payload in ((catalogues.itunes, catalogues.ITUNES, ITUNES), (catalogues.spotify, catalogues.SPOTIFY, SPOTIFY), (catalogues.discogs, catalogues.DISCOGS, DISCOGS), (catalogues.beatport, catalogues.BEATPORT, BEATPORT)):
        rows = parse(catalogues.results_of(payloads_of(spark, payload), "payload", schema, ["id"]), ["id", "position"])
        out = rows if out is None else out.unionByName(rows)
    return out.select("source", "position", "field", "value")


def recording_candidates(spark, sf_dir):
    rows = payloads_of(spark, RECORDING).select("id", F.from_json("payload", catalogues.MUSICBRAINZ).alias("recording"))
    covers = spark.createDataFrame([("gb", "http://cover/gb")], "cover_id string, url string")
    return catalogues.musicbrainz(rows, ["id"], covers).select("field", "value")


def fingerprint_matches(spark, sf_dir):
    return catalogues.acoustid(payloads_of(spark, ACOUSTID, '{"status":"error"}'), "payload", ["id"]).select("id", "position", "acoustid", "score", F.array_join("recording_ids", ",").alias("recordings"), "title", "artist")


def media_probes(spark, sf_dir):
    return catalogues.probe(payloads_of(spark, PROBE, '{"streams":[]}'), "payload", ["id"]).select("id", "duration_s", "codec", "bitrate", "sample_rate", "channels", F.col("tags")["title"].alias("title"), F.size("tags").alias("n_tags"))


def playlist_entries(spark, sf_dir):
    return catalogues.playlist(payloads_of(spark, PLAYLIST, '{"id":"solo","title":"S","channel":"C"}'), "payload", ["id"]).select("id", "video_id", "title", "channel")


def _values(rows, names) -> str:
    show = lambda x: "NULL" if x is None else S.q(x) if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


_CANDIDATES = [
    ("itunes", 0, "title", "Cybernetic"), ("itunes", 0, "artist", "The Act"), ("itunes", 0, "album", "Record - Single"), ("itunes", 0, "genre", "Dance"), ("itunes", 0, "track_number", "3"),
    ("itunes", 0, "release_date", "2000-11-30"), ("itunes", 0, "year", "2000"), ("itunes", 0, "artwork_url", "http://a/1200x1200bb.jpg"),
    ("spotify", 0, "title", "Song"), ("spotify", 0, "artist", "First"), ("spotify", 0, "album", "LP"), ("spotify", 0, "album_artist", "First"), ("spotify", 0, "release_date", "2011-05"), ("spotify", 0, "year", "2011"),
    ("spotify", 0, "track_number", "4"), ("spotify", 0, "disc_number", "1"), ("spotify", 0, "isrc", "USX"), ("spotify", 0, "artwork_url", "http://i/1"),
    ("discogs", 0, "genre", "Electronic"), ("discogs", 0, "genre_style", "Techno"), ("discogs", 0, "label", "Cybernetic"), ("discogs", 0, "catalog_number", "C1"), ("discogs", 0, "year", "2010"),
    ("discogs", 1, "genre", "Bollywood"), ("discogs", 1, "genre_style", "Bollywood"), ("discogs", 1, "label", "Virgin"), ("discogs", 1, "catalog_number", "V1"), ("discogs", 1, "year", "2000"),
    ("beatport", 0, "title", "Track"), ("beatport", 0, "mix_name", "Extended Mix"), ("beatport", 0, "artist", "A"), ("beatport", 0, "remixer", "R"), ("beatport", 0, "genre", "Melodic"), ("beatport", 0, "album", "EP"),
    ("beatport", 0, "label", "L"), ("beatport", 0, "catalog_number", "L1"), ("beatport", 0, "release_date", "2020-01-02"), ("beatport", 0, "year", "2020"), ("beatport", 0, "isrc", "GBX"), ("beatport", 0, "bpm", "124"), ("beatport", 0, "key", "8A"),
]
_RECORDING = [
    ("title", "Neverender (feat. Tame Impala)"), ("artist", "Justice"), ("featured_artists", "Tame Impala"), ("mb_recording_id", "m1"), ("album", "Hyperdrama"), ("album_artist", "Justice"), ("disc_number", "1"),
    ("artwork_url", "http://cover/gb"), ("release_date", "2010"), ("year", "2010"),
]


WANTED = {
    "normalise_golden": _values(NORMALISE, "raw_artist, raw_title, artist, title"),
    "title_golden": _values(TITLES, "raw, title"),
    "version_golden": _values(VERSIONS, "raw, mix_name, remixer"),
    "artists_golden": _values(ARTISTS, "raw, credit"),
    "component_golden": _values(COMPONENTS, "raw, component"),
    "genre_golden": _values(GENRES, "genre, family"),
    "link_golden": _values(LINKS, "url, provider, kind, identifier"),
    "plausible_golden": _values(PLAUSIBLE, "query_artist, query_title, artist, title, plausible"),
    "unrelated_golden": _values(UNRELATED, "query_artist, artist, artist_unrelated"),
    "catalogue_candidates": _values(_CANDIDATES, "source, position, field, value"),
    "recording_candidates": _values(_RECORDING, "field, value"),
    "fingerprint_matches": "SELECT * FROM (VALUES (0, 0, 'y', 0.997::DOUBLE, '', '', ''), (0, 1, 'x', 0.9, 'r1,r2', 'T', 'A'), (0, 2, 'u', 0.5, '', '', '')) v(id, position, acoustid, score, recordings, title, artist)",
    "media_probes": "SELECT 0 AS id, 12.5::DOUBLE AS duration_s, 'opus' AS codec, 160000 AS bitrate, 48000 AS sample_rate, 2 AS channels, 'T' AS title, 1 AS n_tags",
    "playlist_entries": _values([(0, "v1", "One", "C"), (0, "v2", "Two", ""), (1, "solo", "S", "C")], "id, video_id, title, channel"),
    "default_ranking": _values(vocab.ranking_rows(), "family, field, rank, source"),
    "backoff_schedule": "SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 1.0), (2, 2.0), (3, 4.0)) v(attempt, wait)",
}


def default_ranking(spark, sf_dir):
    return vocab.default_ranking(spark)


def backoff_schedule(spark, sf_dir):
    return spark.range(1).select(F.posexplode(catalogues.backoff(0.5)).alias("attempt", "wait"))


@pytest.mark.parametrize("name", sorted(WANTED))
def test_golden(spark, sf, name):
    got, want = rows_of(globals()[name](spark, sf).toPandas()), rows_of(duckdb.sql(WANTED[name]).df())
    assert got == want
