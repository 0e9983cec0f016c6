"""Text rules as column expressions: cleaning, keys, titles, credits, names of files.

Unicode notes: white space is `[\\s\\p{Z}]`, a word character `[\\p{L}\\p{N}_]`; fold() is lower() plus the
letters whose case folding is not their lower case. Only nfc() leaves the JVM, and only for strings that
are not plain ASCII. Null counts as empty throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concord import vocab

S = r"[\s\p{Z}]"
_B = r"(?<![\p{L}\p{N}_])"  # where a word begins
_E = r"(?![\p{L}\p{N}_])"  # where a word ends
#: The patterns that existing decisions were made with.
VERSION_WORDS = "remix|edit|mix|bootleg|flip|vip|version|rework"
TOPIC = rf"(?i){S}*-{S}*Topic$"
VEVO = rf"(?i){S}*VEVO$"
OFFICIAL = rf"(?i){S}*-{S}*Official$"
NOISE = (
    rf"(?i)[\(\[]{S}*(?:official{S}*(?:music{S}*)?(?:video|audio|visuali[sz]er)?|music{S}*video|lyrics?(?:{S}*video)?|visuali[sz]er|m/?v|"
    rf"audio|hd|hq|4k|full{S}*(?:album|song)|out{S}*now|free{S}*(?:dl|download)|premiere|explicit|clean|remaster(?:ed)?(?:{S}*\d{{4}})?|bonus{S}*track?){S}*[\)\]]"
)
NOISE_BARE = rf"(?i){S}*[-|]?{S}*(?:official{S}*(?:music{S}*)?video|official{S}*audio|lyrics?{S}*video|visuali[sz]er|out{S}*now|bonus{S}*track){S}*$"
FEAT_CLAUSE = rf"(?i){S}*[\(\[]?{S}*{_B}(?:feat\.?|featuring|ft\.?|with){S}+[^)\]]*[\)\]]?{S}*"
FEAT_CLAUSE_STRICT = FEAT_CLAUSE.replace("|with", "")
FEAT_TRAILING = rf"(?i)[\(\[]?{S}*{_B}(?:feat\.?|featuring|ft\.?){S}+([^)\]]+?){S}*[\)\]]?{S}*$"
CREDIT_SPLIT = rf"(?i){S}*(?:;|,|&| x | vs\.? | and ){S}*"
ARTIST_SPLIT = rf"(?i){S}*(?:;|&|,| x |{_B}vs{_E}\.?|{_B}and{_E}){S}*"
MIX = rf"[\(\[]{S}*([^)\]]*{_B}(?:{VERSION_WORDS}){_E}[^)\]]*){S}*[\)\]]"
MIX_DASH = rf"{S}+[-–]{S}+([^-–]*{_B}(?:{VERSION_WORDS}){_E}[^-–]*)$"
FROM_FILM = rf"""(?i){S}*[\(\[]{S}*from{S}+(?:["“‘'].*?|the{S}+(?:motion{S}+picture|film|movie|series|soundtrack|album){_E}.*?){S}*[\)\]]{S}*$"""
VERSION_WORD = rf"(?i)^(.*?){_B}(remix|mix|edit|rework|flip|bootleg|version|dub){_E}.*$"
EDITION_BRACKET = rf"(?i){S}*[\(\[][^)\]]*{_B}(?:{'|'.join(vocab.DELUXE_WORDS)}|version|edition){_E}[^)\]]*[\)\]]{S}*$"
EDITION_TAIL = rf"(?i){S}+(?:{'|'.join(vocab.DELUXE_WORDS)}|remastered|reissue)(?:{S}+(?:edition|version))?{S}*$"
NUMBER_TAIL = rf"{S}+\d+\.\d+{S}*$"
RELEASE_TYPE_TAIL = rf"(?i){S}*[-–—]{S}*(?:single|ep){S}*$"
VIDEO_WORDS = rf"(?i){_B}(?:official{S}*(?:music{S}*)?video|music{S}*video|lyric{S}*video|visuali[sz]er|m/v|live{S}+(?:at|from|in)|performance|behind{S}+the{S}+scenes){_E}"
TIDY_FROM, TIDY_TO = "’‘“”–—", "''\"\"--"
QUOTES_FROM, QUOTES_TO = "’‘“”‐‑–—", "''\"\"----"
SPECIAL_FOLDS = {"ß": "ss", "ﬁ": "fi", "ﬂ": "fl"}
ART_SIZES = ("100x100", "60x60", "30x30")
ART_LARGE = "1200x1200"
LINKS = (
    ("spotify", "track", r"open\.spotify\.com/(?:[a-z-]+/)?track/([A-Za-z0-9]{22})"),
    ("spotify", "album", r"open\.spotify\.com/(?:[a-z-]+/)?album/([A-Za-z0-9]{22})"),
    ("spotify", "track", r"spotify:track:([A-Za-z0-9]{22})"),
    ("musicbrainz", "recording", r"musicbrainz\.org/recording/([0-9a-f-]{36})"),
    ("musicbrainz", "release", r"musicbrainz\.org/release/([0-9a-f-]{36})"),
    ("discogs", "release", r"discogs\.com/release/(\d+)"),
    ("discogs", "master", r"discogs\.com/master/(\d+)"),
    ("beatport", "track", r"beatport\.com/track/[^/]+/(\d+)"),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once; keeps the expression from doubling wherever use names it again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def drop_first(c: Column, pattern: str) -> Column:
    """The text without the first match of a pattern that has one group."""
    return F.regexp_replace(c, rf"(?is)^(.*?){pattern}(.*)$", "$1$3")


def before_first(c: Column, pattern: str) -> Column:
    """What stands before the first match of a pattern that has one group, all of the text without one."""
    return F.regexp_replace(c, rf"(?is)^(.*?){pattern}.*$", "$1")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(c, pattern, n)


def strip(c: Column) -> Column:
    return sub(c, rf"^{S}+|{S}+$")


def strip_chars(c: Column, chars: str) -> Column:
    return sub(c, rf"^[{chars}]+|[{chars}]+$")


def squeeze(c: Column) -> Column:
    return strip(sub(c, rf"{S}+", " "))


def fold(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SPECIAL_FOLDS.items(), F.translate(F.lower(text(c)), "ſς", "sσ"))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    return F.coalesce(_nfc(F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), c)), c)


def tidy(c: Column, compose: bool = False) -> Column:
    """Quotes and dashes in ASCII, underscores as spaces, single spaces. compose: NFC first, which takes a Python step."""
    c = nfc(text(c)) if compose else text(c)
    return squeeze(F.translate(F.translate(c, TIDY_FROM, TIDY_TO), "_", " "))


# --- artists and titles as downloaded


def clean_artist_full(c: Column, compose: bool = False) -> Column:
    return tidy(reduce(sub, (TOPIC, VEVO, OFFICIAL), tidy(c, compose)))


def clean_artist(c: Column, compose: bool = False) -> Column:
    noise_free = reduce(sub, (TOPIC, VEVO, OFFICIAL), tidy(c, compose))
    return tidy(F.get(F.split(noise_free, CREDIT_SPLIT, 2), F.lit(0)))


def extract_featured(c: Column, compose: bool = False) -> Column:
    names = F.transform(F.split(group(tidy(c, compose), FEAT_TRAILING), CREDIT_SPLIT), lambda n: tidy(n))
    return F.filter(names, lambda n: n != "")


def strip_artist_prefix(title: Column, artist: Column) -> Column:
    """What follows the first dash, if what precedes it is a credit that names the artist."""

    def cut(x: Column) -> Column:
        head, tail = F.substring_index(x["t"], " - ", 1), sub(x["t"], r"(?s)^.*? - ")
        credit = F.contains(x["t"], F.lit(" - ")) & (x["a"] != "") & (strip(tail) != "") & F.contains(fold(head), fold(x["a"])) & (F.length(head) < 60)
        return F.when(credit, tail).otherwise(x["t"])

    return let(F.struct(title.alias("t"), artist.alias("a")), cut)


def clean_title(title: Column, artist: Column, compose: bool = False, keep_with: bool = False) -> Column:
    """keep_with leaves titles such as "Stay With Me" whole, which the default cuts at "with"."""
    t = sub(sub(tidy(title, compose), NOISE, " "), NOISE_BARE)
    t = sub(strip_artist_prefix(t, artist), FEAT_CLAUSE_STRICT if keep_with else FEAT_CLAUSE, " ")
    return strip_chars(tidy(t), r" \-–:|")


def normalise(artist: Column, title: Column, compose: bool = False) -> Column:
    """Struct of artist, title, featured, artist_full. compose runs NFC first, in a Python step of its own."""
    artist, title = (nfc(text(c)) if compose else text(c) for c in (artist, title))

    def pair(x: Column) -> Column:
        return F.struct(x["artist"].alias("artist"), clean_title(x["raw"], x["artist"]).alias("title"), x["raw"].alias("raw"), x["full"].alias("full"))

    def done(x: Column) -> Column:
        head, tail = F.substring_index(x["title"], " - ", 1), sub(x["title"], r"(?s)^.*? - ")
        split = (x["artist"] == "") & F.contains(x["title"], F.lit(" - ")) & (strip(head) != "") & (strip(tail) != "")
        return F.struct(
            F.when(split, tidy(head)).otherwise(x["artist"]).alias("artist"), F.when(split, tidy(tail)).otherwise(x["title"]).alias("title"),
            extract_featured(x["raw"]).alias("featured"), x["full"].alias("artist_full"),
        )

    start = F.struct(clean_artist(artist).alias("artist"), title.alias("raw"), clean_artist_full(artist).alias("full"))
    return let(let(start, pair), done)


# --- house style


def asciify_quotes(c: Column) -> Column:
    return F.translate(text(c), QUOTES_FROM, QUOTES_TO)


def fix_contractions(c: Column) -> Column:
    """Lower-case the tail of a contraction; the apostrophe may be typographic."""
    return reduce(lambda x, end: sub(x, rf"(?i)(['’]){end}{_E}", f"$1{end}"), ("ll", "re", "ve", "s", "t", "d", "m", "n"), text(c))


def _without_film(t: Column) -> Column:
    return let(strip(sub(t, FROM_FILM)), lambda cut: F.when(cut == "", t).otherwise(cut))


def _take(t: Column, *patterns: str) -> Column:
    """Struct of taken, the group of the first pattern that matches, and rest: without that match; from a match of a later pattern on, without what follows."""
    taken, rest = F.lit(""), t
    for k, p in reversed(list(enumerate(patterns))):
        here = F.rlike(t, F.lit(f"(?i){p}"))
        taken = F.when(here, strip(group(t, f"(?i){p}"))).otherwise(taken)
        rest = F.when(here, before_first(t, p) if k else drop_first(t, p)).otherwise(rest)
    return F.struct(taken.alias("taken"), rest.alias("rest"))


def canonical_title(c: Column) -> Column:
    """base (ft. guests) [mix]."""
    t = squeeze(fix_contractions(asciify_quotes(c)))
    for _ in range(3):  # a title carries two such tails at most; a third pass finds none
        t = let(t, _without_film)

    def with_guests(m: Column) -> Column:
        short = sub(m["rest"], rf"(?i){_B}(?:feat\.?|featuring|ft\.?){S}+", "ft. ")
        return let(short, lambda s: let(_take(s, rf"[\(\[]{S}*ft\.{S}*([^)\]]+){S}*[\)\]]", rf"{_B}ft\.{S}+(.+)$"), lambda g: join(m["taken"], g["taken"], g["rest"])))

    def join(mix: Column, guests: Column, base: Column) -> Column:
        parts = F.array(strip_chars(sub(base, rf"{S}+", " "), r" \-–"), F.when(guests != "", F.concat(F.lit("(ft. "), guests, F.lit(")"))).otherwise(""), F.when(mix != "", F.concat(F.lit("["), mix, F.lit("]"))).otherwise(""))
        return F.array_join(F.filter(parts, lambda p: p != ""), " ")

    return let(let(t, lambda x: _take(x, MIX, MIX_DASH)), with_guests)


def safe_component(c: Column, compose: bool = False) -> Column:
    t = strip(asciify_quotes(c))
    t = squeeze(sub(nfc(t) if compose else t, r"[/:\x00-\x1f]", "-"))
    shown = lambda x: F.when(F.rlike(x, F.lit(r"^\.*$")) | (strip(F.substring(x, 1, 120)) == ""), "unknown").otherwise(strip(F.substring(x, 1, 120)))
    return let(t, shown)


def filename(artist: Column, title: Column, suffix: str = ".aiff") -> Column:
    return F.concat(safe_component(artist), F.lit(" - "), safe_component(canonical_title(title)), F.lit(suffix))


def extract_version(c: Column) -> Column:
    """Struct of mix_name and remixer."""
    label = let(squeeze(text(c)), lambda t: _take(t, MIX, MIX_DASH)["taken"])

    def judged(x: Column) -> Column:
        word, person = F.lower(group(x["label"], VERSION_WORD, 2)), x["person"]
        generic = let(fold(person), lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in vocab.GENERIC_VERSIONS]))
        nobody = (person == "") | generic | F.rlike(person, F.lit(rf"^[\d\s\p{{Z}}'’-]+$")) | ((word == "version") & F.rlike(person, F.lit(r"['’]s$")))
        return F.struct(x["label"].alias("mix_name"), F.when(nobody, "").otherwise(person).alias("remixer"))

    return let(let(label, lambda x: F.struct(x.alias("label"), strip(strip_chars(group(x, VERSION_WORD, 1), r" \-–")).alias("person"))), judged)


def strip_version(c: Column) -> Column:
    cut = let(squeeze(text(c)), lambda t: _take(t, MIX, MIX_DASH)["rest"])
    return strip_chars(sub(cut, rf"{S}+", " "), r" \-–")


def split_artists(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), ARTIST_SPLIT), strip), lambda n: n != "")


def format_artists(names: Column) -> Column:
    """A; A & B; A, B & C."""
    kept = F.filter(F.transform(names, lambda n: strip(text(n))), lambda n: n != "")

    def line(k: Column) -> Column:
        n = F.size(k)
        several = F.concat(F.array_join(F.slice(k, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" & "), F.element_at(k, -1))
        return F.when(n == 0, "").when(n == 1, F.get(k, F.lit(0))).otherwise(several)

    return let(kept, line)


# --- keys for comparison


def key(c: Column) -> Column:
    """Letters and digits alone, case-folded."""
    return sub(fold(c), r"[^\p{L}\p{N}]")


def words_key(c: Column) -> Column:
    """Case-folded, anything but word characters as spaces."""
    return squeeze(sub(fold(c), r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def ascii_key(c: Column) -> Column:
    return sub(fold(c), "[^a-z0-9]")


def same_text(a: Column, b: Column) -> Column:
    bare = lambda c: squeeze(sub(fold(c), r"[^\p{L}\p{N}_\s\p{Z}]"))
    return bare(a) == bare(b)


def option_key(c: Column) -> Column:
    return squeeze(fold(c))


def label_key(c: Column) -> Column:
    return squeeze(F.replace(fold(c), F.lit("."), F.lit(" ")))


def album_key(c: Column) -> Column:
    t = sub(sub(text(c), EDITION_BRACKET), RELEASE_TYPE_TAIL)
    for pattern in (NUMBER_TAIL, EDITION_TAIL):
        for _ in range(3):
            t = sub(t, pattern)
    return key(t)


def core_key(field: Column, c: Column) -> Column:
    names = split_artists(c)
    return F.when(field == "artist", key(F.coalesce(F.get(names, F.lit(0)), text(c)))).otherwise(key(sub(text(c), rf"{S}*[\(\[][^)\]]*[\)\]]")))


def is_non_label(c: Column) -> Column:
    base = strip(F.substring_index(strip(fold(c)), "(", 1))
    return (base == "") | base.isin(*vocab.NON_LABELS)


def variant_mismatch(query: Column, matched: Column) -> Column:
    new = lambda x: reduce(lambda a, b: a | b, [F.contains(x["m"], F.lit(w)) & ~F.contains(x["q"], F.lit(w)) for w in vocab.VARIANT_WORDS])
    return let(F.struct(fold(query).alias("q"), fold(matched).alias("m")), new)


# --- links, genres, dates, credits


def upscale_artwork(c: Column) -> Column:
    t = text(c)
    out = t
    for size in reversed(ART_SIZES):
        out = F.when(F.contains(t, F.lit(size)), F.replace(t, F.lit(size), F.lit(ART_LARGE))).otherwise(out)
    return out


def parse_link(c: Column) -> Column:
    """Struct of provider, kind and identifier; null for links that are not supported."""
    def first(t: Column) -> Column:
        return F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.struct(F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), group(t, p).alias("identifier"))) for provider, kind, p in LINKS])

    return let(strip(text(c)), first)


def genre_of(label: Column) -> Column:
    return F.substring_index(text(label), "---", 1)


def style_of(label: Column) -> Column:
    return F.coalesce(F.get(F.split(text(label), "---"), F.lit(1)), F.lit(""))


def family_for(genre: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.FAMILY_OF_GENRE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, strip(fold(genre))), F.lit("other"))


def family_for_identity(genre: Column, isrc: Column, catalogue_genre: Column, label: Column) -> Column:
    regional = F.upper(F.substring(text(isrc), 1, 2)).isin(*vocab.REGIONAL_ISRC_PREFIXES) | strip(fold(catalogue_genre)).isin(*vocab.REGIONAL_GENRES) | label_key(label).isin(*vocab.REGIONAL_LABELS)
    return F.when(regional, "world").otherwise(family_for(genre))


def padded_date(c: Column) -> Column:
    """A date of the precision YYYY, YYYY-MM or YYYY-MM-DD; null for anything else."""
    t = text(c)
    return F.coalesce(
        F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(t, "yyyy-MM-dd")),
        F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}$")), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd")),
        F.when(F.rlike(t, F.lit(r"^\d{4}$")), F.try_to_date(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd")),
    )


def split_credit(credit: Column) -> Column:
    """array<struct<name, joinphrase>> -> struct of names and featured: after a join phrase with feat or with, names are featured."""
    start = F.struct(F.lit(False).alias("guest"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("featured"))

    def step(acc: Column, x: Column) -> Column:
        name, join = strip(text(x["name"])), fold(x["joinphrase"])
        here = F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name))
        return F.struct(
            (acc["guest"] | F.contains(join, F.lit("feat")) | F.contains(join, F.lit("with"))).alias("guest"),
            F.when(acc["guest"], acc["names"]).otherwise(F.concat(acc["names"], here)).alias("names"),
            F.when(acc["guest"], F.concat(acc["featured"], here)).otherwise(acc["featured"]).alias("featured"),
        )

    return F.aggregate(credit, start, step, lambda acc: F.struct(acc["names"].alias("names"), acc["featured"].alias("featured")))


def clean_error(c: Column) -> Column:
    return F.substring(squeeze(sub(sub(text(c), r"\x1b\[[0-9;]*m"), r"^ERROR:\s*")), 1, 300)


def camelot(number: Column, letter: Column) -> Column:
    return F.when(number.isNotNull() & (text(letter) != ""), F.concat(number.cast("string"), letter)).otherwise("")
