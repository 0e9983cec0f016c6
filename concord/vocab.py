"""Closed vocabularies and thresholds of the record-resolution model.

Fixed values: everything in this module must equal what existing data and decisions were made with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAGES = ("acquired", "normalised", "classified", "resolved", "arbitrated", "transcoded", "tagged", "published")
STATUSES = ("pending", "auto", "review", "published", "failed", "skipped")
FAMILIES = ("electronic", "hip-hop", "pop", "r&b-soul", "world", "other")
EVIDENCE = ("url_override", "isrc", "acoustid", "text", "none")
REVIEW_REASONS = ("low_confidence", "no_match", "video_rip", "duplicate")
PROTECTED = ("manual", "url_override")

ALBUM_GROUP = ("album", "album_artist", "track_number", "disc_number")
DATE_FIELDS = ("release_date", "year")
JUDGEMENT_FIELDS = ("genre", "artwork_url")
CONVENTION_FIELDS = {"world": ("artist",)}
COMPILATION_CREDITS = ("various artists", "various", "va", "verschiedene interpreten", "diverse")
NON_LABELS = ("not on label", "self-released", "none", "unknown")
NON_ALBUM_TYPES = ("Compilation", "Live", "Remix", "DJ-mix", "Mixtape/Street")
DELUXE_WORDS = ("deluxe", "expanded", "special", "anniversary", "complete", "extended", "ultimate")
#: Release selection knows one edition word less.
RELEASE_DELUXE_WORDS = DELUXE_WORDS[:-1]
VARIANT_WORDS = ("instrumental", "sped up", "slowed", "reverb", "live", "radio edit", "acoustic", "karaoke", "a cappella", "acapella", "demo", "clean")
GENERIC_VERSIONS = ("extended", "original", "radio", "club", "instrumental", "acapella", "a cappella", "vip", "dub", "intro", "short", "clean", "explicit")

FAMILY_OF_GENRE = {
    "electronic": "electronic", "hip hop": "hip-hop", "hip-hop": "hip-hop", "pop": "pop", "rock": "pop",
    "funk / soul": "r&b-soul", "funk/soul": "r&b-soul", "latin": "world", "reggae": "world",
    "folk, world, & country": "world", "folk world & country": "world", "stage & screen": "world",
}
REGIONAL_GENRES = ("bollywood", "indian pop", "telugu", "tamil", "punjabi", "bhangra", "filmi", "desi pop", "hindustani", "carnatic", "qawwali", "ghazal")
REGIONAL_LABELS = ("t-series", "tips", "tips industries", "eros international", "eros music", "zee music company", "saregama", "venus records", "yrf music", "t series")
REGIONAL_ISRC_PREFIXES = ("IN", "LK", "PK", "BD")
#: Genres of one catalogue that name a place of origin, not a sound.
PROVENANCE_GENRES = ("stage & screen", "folk, world, & country", "non-music", "children's")

ELICITABLE = ("title", "artist", "album", "genre", "label", "remixer", "mix_name", "original_artist", "composer", "lyricist", "artwork_url")
FRAMES = {
    "title": "TIT2", "artist": "TPE1", "album": "TALB", "album_artist": "TPE2", "genre": "TCON", "track_number": "TRCK",
    "disc_number": "TPOS", "bpm": "TBPM", "composer": "TCOM", "lyricist": "TEXT", "remixer": "TPE4", "mix_name": "TIT3",
    "label": "TPUB", "original_artist": "TOPE", "key": "TKEY", "isrc": "TSRC", "grouping": "TIT1", "year": "TDRC", "release_date": "TDRL",
}
NON_TAG_FIELDS = ("artwork_url", "catalog_number", "classifier_genre", "featured_artists", "genre_style", "mb_recording_id", "acoustid")

AUTO_ACCEPT = 0.80
CORROBORATED = 0.90
DURATION_TOLERANCE = 3.0
RIP_TOLERANCE = 5.0
PLAUSIBLE = 0.45
VERSION_PENALTY = 0.25
VARIANT_PENALTY = 0.12
UNRELATED_BELOW = 0.5
MBID_PROBE = 3
RECORDING_PROBE = 5
RELEASE_BONUS = 0.25
TARGET_PER_CELL = 8
MIN_OBSERVATIONS = 5
PRIOR_WEIGHT = 3.0
MIN_BITRATE = 256

_SPOTIFY_FIRST = ("spotify", "musicbrainz", "itunes")
RANKING = {
    "title": ("spotify", "musicbrainz", "itunes", "discogs"),
    "artist": ("spotify", "musicbrainz", "itunes", "discogs"),
    "album": _SPOTIFY_FIRST,
    "album_artist": _SPOTIFY_FIRST,
    "track_number": _SPOTIFY_FIRST,
    "disc_number": _SPOTIFY_FIRST,
    "release_date": _SPOTIFY_FIRST,
    "year": _SPOTIFY_FIRST,
    "genre": ("itunes", "discogs", "musicbrainz", "essentia"),
    "genre_style": ("discogs", "beatport"),
    "label": ("itunes", "spotify", "discogs", "musicbrainz"),
    "catalog_number": ("discogs", "beatport"),
    "isrc": _SPOTIFY_FIRST,
    "composer": ("musicbrainz",),
    "lyricist": ("musicbrainz",),
    "remixer": ("derived", "musicbrainz", "discogs"),
    "mix_name": ("derived", "musicbrainz"),
    "original_artist": ("musicbrainz",),
    "featured_artists": ("musicbrainz",),
    "artwork_url": ("itunes", "spotify", "musicbrainz"),
    "bpm": ("local", "beatport"),
    "key": ("local", "beatport"),
}
_BEATPORT_ALBUM = ("beatport", "spotify", "musicbrainz", "itunes")
_WORLD_ALBUM = ("spotify", "itunes", "musicbrainz")
#: A family's entry replaces the whole ranking of its field.
FAMILY_RANKING = {
    "electronic": {
        "title": ("beatport", "spotify", "musicbrainz", "discogs"),
        "artist": ("beatport", "spotify", "musicbrainz", "discogs"),
        **{f: _BEATPORT_ALBUM for f in ALBUM_GROUP},
        "mix_name": ("derived", "beatport", "musicbrainz"),
        "remixer": ("derived", "beatport", "musicbrainz", "discogs"),
        "genre": ("itunes", "beatport", "discogs", "musicbrainz", "essentia"),
        "genre_style": ("beatport", "discogs"),
        "label": ("beatport", "itunes", "spotify", "discogs"),
        "catalog_number": ("beatport", "discogs"),
    },
    "world": {
        "title": ("spotify", "itunes", "musicbrainz", "discogs"),
        "artist": ("musicbrainz", "spotify", "itunes"),
        **{f: _WORLD_ALBUM for f in ALBUM_GROUP},
        "genre": ("itunes", "discogs", "musicbrainz", "essentia"),
    },
}


def ranking_rows() -> list[tuple[str, str, int, str]]:
    """(family, field, rank, source) of the built-in ranking, every family written out."""
    return [
        (family, field, rank, source)
        for family in FAMILIES
        for field, base in RANKING.items()
        for rank, source in enumerate(FAMILY_RANKING.get(family, {}).get(field, base))
    ]


def default_ranking(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ranking_rows(), "family string, field string, rank int, source string")
