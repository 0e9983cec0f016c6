"""Landed catalogue responses (JSON strings) as candidates in long form; fixed schemas, no inference.

Each parser takes rows of keys and a payload and returns keys, field, value, source, ord for every
non-empty value. Network access is not part of the engine: responses are tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.operators import identity
from concord.operators.relations import coalesce_relations, written
from concord.operators.state import Table

ITUNES = (
    "struct<trackName:string,artistName:string,collectionName:string,collectionArtistName:string,primaryGenreName:string,"
    "trackNumber:bigint,discNumber:bigint,releaseDate:string,artworkUrl100:string,trackTimeMillis:bigint>"
)
_NAMES = "array<struct<name:string>>"
SPOTIFY = (
    f"struct<name:string,artists:{_NAMES},album:struct<name:string,artists:{_NAMES},release_date:string,images:array<struct<url:string>>>,"
    "track_number:bigint,disc_number:bigint,external_ids:struct<isrc:string>>"
)
DISCOGS = "struct<style:array<string>,genre:array<string>,label:array<string>,catno:string,year:string>"
BEATPORT = (
    f"struct<name:string,mix_name:string,artists:{_NAMES},remixers:{_NAMES},genre:struct<name:string>,sub_genre:struct<name:string>,"
    "release:struct<name:string,label:struct<name:string>,catalog_number:string>,label:struct<name:string>,publish_date:string,"
    "new_release_date:string,isrc:string,bpm:string,key:struct<name:string,camelot_number:bigint,camelot_letter:string>>"
)
_CREDIT = "array<struct<name:string,joinphrase:string,artist:struct<name:string>>>"
MUSICBRAINZ = (
    f"struct<id:string,title:string,length:bigint,score:int,`artist-credit`:{_CREDIT},"
    f"releases:array<struct<id:string,title:string,date:string,`artist-credit`:{_CREDIT},"
    "`release-group`:struct<id:string,`primary-type`:string,`secondary-types`:array<string>,`first-release-date`:string>,"
    "media:array<struct<`track-count`:int,position:int,tracks:array<struct<number:string,position:int>>>>>>>"
)
ACOUSTID = "struct<status:string,results:array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>>>>>>"
PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,bit_rate:string,sample_rate:string,channels:int>>,"
    "format:struct<duration:string,tags:map<string,string>>>"
)
PLAYLIST = "struct<id:string,title:string,channel:string,entries:array<struct<id:string,title:string,channel:string>>>"


def results_of(rows: DataFrame, payload: str, result_schema: str, keys: Sequence[str]) -> DataFrame:
    """keys, position, result: the entries of a search response's list `results`, in order."""
    parsed = F.from_json(payload, f"struct<results:array<{result_schema}>>")["results"]
    return rows.select(*keys, F.posexplode(parsed).alias("position", "result"))


def long_form(rows: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, Column]], source: str) -> DataFrame:
    """One row for each non-empty field."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), T.text(c.cast("string")).alias("value")) for n, c in fields])
    out = rows.select(*keys, F.posexplode(pairs).alias("ord", "p"))
    return out.select(*keys, "p.field", "p.value", F.lit(source).alias("source"), "ord").where(F.col("value") != "")


def _first_name(names: Column) -> Column:
    named = F.filter(F.transform(names, lambda a: a["name"]), lambda n: T.text(n) != "")
    return F.get(named, F.lit(0))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: T.text(v) != ""), F.lit(0))


def _truthy(number: Column) -> Column:
    return F.when(number != 0, number)


def itunes(rows: DataFrame, keys: Sequence[str], result: str = "result") -> DataFrame:
    r = F.col(result)
    fields = [
        ("title", r["trackName"]), ("artist", r["artistName"]), ("album", r["collectionName"]), ("album_artist", r["collectionArtistName"]), ("genre", r["primaryGenreName"]),
        ("track_number", _truthy(r["trackNumber"])), ("disc_number", _truthy(r["discNumber"])), ("release_date", F.substring(r["releaseDate"], 1, 10)),
        ("year", F.substring(r["releaseDate"], 1, 4)), ("artwork_url", T.upscale_artwork(r["artworkUrl100"])),
    ]
    return long_form(rows, keys, fields, "itunes")


def spotify(rows: DataFrame, keys: Sequence[str], result: str = "result") -> DataFrame:
    r = F.col(result)
    fields = [
        ("title", r["name"]), ("artist", _first_name(r["artists"])), ("album", r["album"]["name"]), ("album_artist", _first_name(r["album"]["artists"])),
        ("release_date", r["album"]["release_date"]), ("year", F.substring(r["album"]["release_date"], 1, 4)), ("track_number", _truthy(r["track_number"])),
        ("disc_number", _truthy(r["disc_number"])), ("isrc", r["external_ids"]["isrc"]), ("artwork_url", F.get(r["album"]["images"], F.lit(0))["url"]),
    ]
    return long_form(rows, keys, fields, "spotify")


def discogs(rows: DataFrame, keys: Sequence[str], result: str = "result") -> DataFrame:
    r = F.col(result)
    style, top = _first(r["style"]), T.text(_first(r["genre"]))
    provenance = T.fold(top).isin(*vocab.PROVENANCE_GENRES) & style.isNotNull()
    genre = F.when(provenance | (top == ""), style).otherwise(top)
    fields = [("genre", genre), ("genre_style", style), ("label", _first(r["label"])), ("catalog_number", r["catno"]), ("year", r["year"])]
    return long_form(rows, keys, fields, "discogs")


def beatport(rows: DataFrame, keys: Sequence[str], result: str = "result") -> DataFrame:
    r = F.col(result)
    or_else = lambda a, b: F.when(T.text(a) != "", a).otherwise(b)
    published = or_else(r["publish_date"], r["new_release_date"])
    musical = or_else(T.camelot(r["key"]["camelot_number"], r["key"]["camelot_letter"]), r["key"]["name"])
    fields = [
        ("title", r["name"]), ("mix_name", r["mix_name"]), ("artist", _first_name(r["artists"])), ("remixer", _first_name(r["remixers"])),
        ("genre", or_else(r["sub_genre"]["name"], r["genre"]["name"])), ("album", r["release"]["name"]), ("label", or_else(r["release"]["label"]["name"], r["label"]["name"])),
        ("catalog_number", r["release"]["catalog_number"]), ("release_date", F.substring(published, 1, 10)), ("year", F.substring(published, 1, 4)),
        ("isrc", r["isrc"]), ("bpm", r["bpm"]), ("key", musical),
    ]
    return long_form(rows, keys, fields, "beatport")


def with_isrc_first(rows: DataFrame, query: Sequence[str], isrc: str = "isrc") -> DataFrame:
    """The results whose code is the asked one, where a query has such; else all. rows: query, isrc, result, position."""
    exact = rows.where(F.upper("result.isrc") == F.upper(isrc))
    return coalesce_relations(query, exact, rows)


def _credit(c: Column) -> Column:
    return F.transform(c, lambda x: F.named_struct(F.lit("name"), F.coalesce(F.nullif(x["name"], F.lit("")), x["artist"]["name"]), F.lit("joinphrase"), x["joinphrase"]))


def releases_of(rows: DataFrame, keys: Sequence[str], recording: str = "recording") -> DataFrame:
    """One row for each release of a recording: keys, artist, position and the release's fields; first medium only."""
    r = F.col(recording)
    lead = F.get(_credit(r["artist-credit"]), F.lit(0))["name"]
    out = rows.select(*keys, lead.alias("artist"), F.posexplode(r["releases"]).alias("position", "x"))
    return out.select(*keys, "artist", "position", *[c.alias(n) for n, c in _release(F.col("x")).items()])


def _release(x: Column) -> dict[str, Column]:
    """Fields of a release; first medium only."""
    medium, group = F.get(x["media"], F.lit(0)), x["release-group"]
    return {
        "release_id": x["id"], "release_group_id": group["id"], "title": x["title"], "track_count": F.coalesce(medium["track-count"], F.lit(0)),
        "track_number": F.get(medium["tracks"], F.lit(0))["number"].try_cast("int"), "disc_number": F.coalesce(medium["position"], F.lit(1)),
        "album_artist": T.text(F.get(_credit(x["artist-credit"]), F.lit(0))["name"]), "date": _date(x),
        "primary_type": T.text(group["primary-type"]), "secondary_types": F.coalesce(group["secondary-types"], F.array().cast("array<string>")),
    }


def _date(x: Column) -> Column:
    return F.coalesce(F.when(T.text(x["date"]) != "", x["date"]), x["release-group"]["first-release-date"], F.lit(""))


def _selected(releases: Column, artist: Column) -> Column:
    """The release of a recording that select_release() takes."""

    def order(x: Column, i: Column, act: Column) -> Column:
        group = x["release-group"]
        names = F.struct(T.fold(x["title"]).alias("title"), T.fold(F.get(_credit(x["artist-credit"]), F.lit(0))["name"]).alias("album_artist"))
        others = {"primary_type": group["primary-type"], "secondary_types": group["secondary-types"], "track_count": F.get(x["media"], F.lit(0))["track-count"], "position": i, "artist": act}
        return T.let(names, lambda n: identity.release_order({"title": n["title"], "album_artist": n["album_artist"]} | others))

    first = T.let(T.fold(artist), lambda act: F.array_min(F.transform(releases, lambda x, i: order(x, i, act))))
    return F.get(releases, first["position"])


def _earliest(releases: Column, today: str) -> Column:
    """The date of a recording that earliest_date() takes."""
    days = F.transform(F.transform(releases, _date), lambda d, i: F.struct(T.padded_date(d).alias("day"), (-F.length(d)).alias("less"), i.alias("position"), d.alias("date")))
    return F.array_min(F.filter(days, lambda d: F.coalesce(identity.is_usable(d["day"], today), F.lit(False))))["date"]


def musicbrainz(rows: DataFrame, keys: Sequence[str], covers: DataFrame | None = None, today: str = "2100-01-01", recording: str = "recording") -> DataFrame:
    """Candidates of a full recording: credit, featured names, the selected release's fields, the earliest date.

    covers: cover_id, url of releases and release groups that have a cover.
    """
    r = F.col(recording)
    credit = _credit(r["artist-credit"])
    lead = F.get(credit, F.lit(0))["name"]
    best, date = _selected(r["releases"], lead), _earliest(r["releases"], today)  # within a row: nothing is dealt by key for them
    read = rows.select(*keys, r["id"].alias("id_"), r["title"].alias("title_"), T.text(lead).alias("lead_"), T.split_credit(credit).alias("split_"), best.alias("best_"), date.alias("date_"))
    read = read.withColumns({"act_": T.format_artists(F.col("split_.names")), "featured_": F.array_distinct(F.concat("split_.featured", T.extract_featured(F.col("title_"))))})
    read = read.withColumn("guests_", T.format_artists(F.col("featured_")))
    folded = T.fold(F.col("title_"))
    shown = F.contains(folded, F.lit("feat")) | F.contains(folded, F.lit("ft."))
    title = F.when((F.size("featured_") > 0) & ~shown, F.concat("title_", F.lit(" (feat. "), F.col("guests_"), F.lit(")"))).otherwise(F.col("title_"))
    chosen = _release(F.col("best_"))
    wide = read.select(
        *keys, "id_", title.alias("title_"), F.when(F.col("act_") != "", F.col("act_")).otherwise(F.col("lead_")).alias("act_"), "guests_", "date_",
        *[chosen[c].alias(f"r_{c}") for c in ("title", "album_artist", "track_number", "disc_number", "release_id", "release_group_id")],
    )
    if covers is None:
        wide = wide.withColumn("cover", F.lit(None).cast("string"))
    else:
        a = covers.select(F.col("cover_id").alias("r_release_id"), F.col("url").alias("_a"))
        b = covers.select(F.col("cover_id").alias("r_release_group_id"), F.col("url").alias("_b"))
        wide = wide.join(a, "r_release_id", "left").join(b, "r_release_group_id", "left").withColumn("cover", F.coalesce("_a", "_b"))
    fields = [
        ("title", F.col("title_")), ("artist", F.col("act_")), ("featured_artists", F.col("guests_")), ("mb_recording_id", F.col("id_")),
        ("album", F.col("r_title")), ("album_artist", F.col("r_album_artist")), ("track_number", _truthy(F.col("r_track_number"))), ("disc_number", _truthy(F.col("r_disc_number"))),
        ("artwork_url", F.col("cover")), ("release_date", F.col("date_")), ("year", F.substring("date_", 1, 4)),
    ]
    return long_form(wide, keys, fields, "musicbrainz")


_RELATIONS = "struct<relations:array<struct<type:string,artist:struct<name:string>,work:struct<id:string>>>>"


def credits(recordings: DataFrame, works: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Composer and lyricist of recordings by way of their first work. A writer counts as composer where none is named.

    recordings: keys, payload with relations to works; works: work_id, payload with relations to artists.
    """
    linked = F.filter(F.from_json("payload", _RELATIONS)["relations"]["work"]["id"], lambda x: T.text(x) != "")
    first = recordings.select(*keys, F.get(linked, F.lit(0)).alias("work_id")).where(F.col("work_id").isNotNull())
    parsed = works.select("work_id", F.from_json("payload", _RELATIONS)["relations"].alias("relations")).dropDuplicates(["work_id"])
    rows = first.join(parsed, "work_id")
    named = lambda kind: F.array_join(F.transform(F.filter("relations", lambda r: (T.fold(r["type"]) == kind) & (T.text(r["artist"]["name"]) != "")), lambda r: r["artist"]["name"]), ", ")
    composer = F.when(T.text(named("composer")) != "", named("composer")).otherwise(named("writer"))
    return long_form(rows, keys, [("composer", composer), ("lyricist", named("lyricist"))], "musicbrainz")


#: Credentials without which a source isn't asked; none for the first.
CREDENTIALS = {
    "itunes": (), "discogs": ("DISCOGS_TOKEN",), "spotify": ("SPOTIFY_CLIENT_ID", "SPOTIFY_CLIENT_SECRET"),
    "beatport": ("BEATPORT_CLIENT_ID", "BEATPORT_CLIENT_SECRET"),
}


def enabled_sources(credentials: dict[str, str]) -> list[str]:
    return [source for source, needed in CREDENTIALS.items() if all(credentials.get(n) for n in needed)]


def enrich(landed: dict[str, DataFrame], keys: Sequence[str], credentials: dict[str, str]) -> DataFrame | None:
    """Candidates of the first result that each enabled source gave; None if no enabled source has landed anything.

    landed: by source, rows of keys and a search response in payload. ord numbers a row's sources in the order above.
    """
    parsers = {"itunes": (itunes, ITUNES), "discogs": (discogs, DISCOGS), "spotify": (spotify, SPOTIFY), "beatport": (beatport, BEATPORT)}
    out = None
    for k, source in enumerate(enabled_sources(credentials)):
        if source in landed:
            parse, schema = parsers[source]
            rows = parse(results_of(landed[source], "payload", schema, keys).where("position = 0"), keys).withColumn("ord", F.col("ord") + k * 100)
            out = rows if out is None else out.unionByName(rows)
    return out


def acoustid(rows: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """keys, position, acoustid, score, recording_ids, title, artist: matches by falling score, ids distinct in order; none unless the status is ok."""
    p = F.from_json(payload, ACOUSTID)
    results = F.when(p["status"] == "ok", p["results"])
    found = rows.select(*keys, F.posexplode(results).alias("_k", "m"))
    first = F.get(F.col("m.recordings"), F.lit(0))
    ids = F.array_distinct(F.filter(F.transform("m.recordings", lambda x: x["id"]), lambda x: T.text(x) != ""))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_k")) - 1
    out = found.select(*keys, "_k", T.text("m.id").alias("acoustid"), F.coalesce("m.score", F.lit(0.0)).alias("score"), F.coalesce(ids, F.array().cast("array<string>")).alias("recording_ids"), T.text(first["title"]).alias("title"), T.text(F.get(first["artists"], F.lit(0))["name"]).alias("artist"))
    return out.withColumn("position", place).drop("_k")


def probe(rows: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """keys, duration_s, codec, bitrate, sample_rate, channels, tags of a media probe; rows without an audio stream are dropped."""
    p = F.from_json(payload, PROBE)
    rows = rows.select(*keys, F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0)).alias("s"), p["format"].alias("f")).where(F.col("s").isNotNull())
    skip = F.array(*[F.lit(x) for x in ("major_brand", "minor_version", "compatible_brands", "encoder")])
    entries = F.filter(F.map_entries("f.tags"), lambda e: ~F.array_contains(skip, F.lower(e["key"])))
    tags = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    number = lambda c, t: F.coalesce(c.try_cast(t), F.lit(0).cast(t))
    return rows.select(*keys, number(F.col("f.duration"), "double").alias("duration_s"), T.text("s.codec_name").alias("codec"), number(F.col("s.bit_rate"), "int").alias("bitrate"), number(F.col("s.sample_rate"), "int").alias("sample_rate"), F.coalesce("s.channels", F.lit(0)).alias("channels"), F.coalesce(tags, F.create_map().cast("map<string,string>")).alias("tags"))


def playlist(rows: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """keys, position, video_id, title, channel: a listing's entries, or the listing itself as a single video."""
    p = F.from_json(payload, PLAYLIST)
    own = F.array(F.struct(p["id"].alias("id"), p["title"].alias("title"), p["channel"].alias("channel")))
    out = rows.select(*keys, F.posexplode(F.coalesce(p["entries"], own)).alias("position", "e"))
    return out.where(F.col("e").isNotNull() & (T.text("e.id") != "")).select(*keys, "position", F.col("e.id").alias("video_id"), T.text("e.title").alias("title"), T.text("e.channel").alias("channel"))


def split_urls(rows: DataFrame, urls: str, keys: Sequence[str]) -> DataFrame:
    """keys, position, url: distinct links of a free-text list, in order of first mention."""
    parts = F.filter(F.split(T.text(urls), r"[\s,]+"), lambda u: u != "")
    return rows.select(*keys, F.posexplode(parts).alias("position", "url")).groupBy(*keys, "url").agg(F.min("position").alias("position"))


def cache_key(source: Column, parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", source, *parts), 256)


def from_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their response, misses) of requests by key."""
    return requests.join(cache.select("key", "response"), "key"), requests.join(cache.select("key"), "key", "left_anti")


def cache(spark: SparkSession, path: str, buckets: int = 64) -> Table:
    """A stored cache of responses by key, in buckets of the key's hash."""
    return Table(spark, path, "key string, source string, response string", "key", buckets)


def through_cache(requests: DataFrame, stored: Table, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((key, source, response) of all requests, (key, hit)): what is stored, and for the rest what fetch gives, which is put.

    A lookup reads the buckets of its keys alone. fetch takes the missing keys and gives key, source and response; it is run once.
    """
    keys = requests.select("key").distinct()
    known = written(stored.lookup(keys), "cache-hits")
    fresh = written(fetch(keys.join(known.select("key"), "key", "left_anti")).select("key", "source", "response"), "cache-misses")
    stored.put_if_absent(fresh)
    hits = known.select("key", F.lit(True).alias("hit")).unionByName(fresh.select("key", F.lit(False).alias("hit")))
    return known.unionByName(fresh), hits


def backoff(base: float, attempts: int = 4) -> Column:
    """Array of waiting times, doubling; jitter is the caller's."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda k: F.lit(base) * F.pow(F.lit(2.0), k))


def content_hash(files: DataFrame) -> DataFrame:
    """path, sha256 of rows from the binaryFile reader."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def quality_gate(bitrate: Column) -> Column:
    """False for a known bitrate below the floor."""
    return ~((bitrate != 0) & (bitrate < vocab.MIN_BITRATE))


def top_predictions(rows: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k labels of the highest mean activation. rows: keys, label, activation."""
    means = rows.groupBy(*keys, "label").agg(F.avg("activation").alias("activation"))
    order = Window.partitionBy(*keys).orderBy(F.desc("activation"), "label")
    ranked = means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("genre", T.genre_of(F.col("label"))).withColumn("style", T.style_of(F.col("label")))
