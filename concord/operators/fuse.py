"""Fusion: one value for each field of each record from what several catalogues say.

Rows come as (track_id, family, field, value, source, ord); ord is the order of arrival and the last tie-break
everywhere. The plan has one exchange of candidates, on track_id: all windows and the last aggregation group by it and more.
Agreement of two sources outweighs the ranking, in three steps of looser keys; dates, labels, album fields
and covers have rules of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.operators.relations import partitions_for, spread, written

DECISION = ["track_id", "field", "value", "source", "decided_by"]


def resolved_ranking(default: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """The ranking in force: a calibrated cell (family, field) replaces the built-in one as a whole.

    A calibrated one comes from all answers, so it is written: fusion reads it several times, and it has a few hundred rows.
    """
    if calibrated is None:
        return default
    calibrated = written(calibrated.select(*default.columns), "ranking")
    cells = calibrated.select("family", "field").distinct()
    return calibrated.unionByName(default.join(F.broadcast(cells), ["family", "field"], "left_anti"))


def skips_consensus(family: Column, field: Column) -> Column:
    by_family = reduce(lambda a, b: a | b, [(family == k) & field.isin(*v) for k, v in vocab.CONVENTION_FIELDS.items()])
    return field.isin(*vocab.JUDGEMENT_FIELDS) | by_family


def rank_candidates(candidates: DataFrame, ranking: DataFrame, field: str | None = None, rank: str = "rank", is_ranked: str = "is_ranked") -> DataFrame:
    """candidates with rank, that of their source for their field (or for a given one), and is_ranked.

    An unranked source comes after all ranked ones. The ranking has a few hundred rows: families times fields times sources.
    """
    table = ranking if field is None else ranking.where(F.col("field") == field)
    keys = ["family", "field", "source"] if field is None else ["family", "source"]
    lengths = table.groupBy(*keys[:-1]).agg(F.count("*").cast("int").alias("_n"))
    ranked = table.select(*keys, F.col("rank").alias("_rank"))
    out = candidates.join(F.broadcast(ranked), keys, "left").join(F.broadcast(lengths), keys[:-1], "left")
    return out.withColumn(is_ranked, F.col("_rank").isNotNull()).withColumn(rank, F.coalesce("_rank", "_n", F.lit(0))).drop("_rank", "_n")


def _order(first: Column | None = None, a: Column | None = None, second: Column | None = None, b: Column | None = None) -> Column:
    """Keys of one shape for every kind of field; arrival breaks what ties are left."""
    text = lambda c: F.lit("") if c is None else c
    number = lambda c: (F.lit(0) if c is None else c).cast("long")
    return F.struct(text(first).alias("k0"), number(a).alias("k1"), text(second).alias("k2"), number(b).alias("k3"), number(F.col("ord")).alias("k4"))


def keep_agreed(ranked: DataFrame) -> DataFrame:
    """Of fields that go by place, the first candidate, where agreement counts that of the winning group; of album fields and covers every candidate.

    Adds place, the order of what is kept within its field. A looser key is worked out only for values with a sign that it cuts at;
    all others have the first key in its stead.
    """
    value, field = F.col("value"), F.col("field")
    plain = ~field.isin(*vocab.ALBUM_GROUP, *vocab.DATE_FIELDS, "artwork_url")
    agrees = plain & ~skips_consensus(F.col("family"), field)
    has = lambda *signs: reduce(lambda a, b: a | b, [F.contains(value, F.lit(x)) for x in signs])
    exact = F.col("exact")
    version = F.when(has("(", "[", "-", "–"), T.key(T.strip_version(value))).otherwise(exact)
    core = F.when((field == "artist") | has("(", "["), T.core_key(field, value)).otherwise(exact)
    keys = F.when(F.col("agrees"), F.array(exact, version, core)).otherwise(F.array(F.lit("")))
    keyed = ranked.withColumns({"agrees": agrees, "exact": F.when(agrees, T.key(value))})
    tiers = keyed.select(*ranked.columns, "agrees", F.posexplode(keys).alias("tier", "key"))
    group = Window.partitionBy("track_id", "field", "tier", "key")
    tier, whole = Window.partitionBy("track_id", "field", "tier"), Window.partitionBy("track_id", "field")
    tiers = tiers.withColumn("n", F.size(F.collect_set("source").over(group))).withColumn("group", F.struct(-F.col("n"), F.min("rank").over(group), F.min("ord").over(group)))
    tiers = tiers.withColumn("best", F.min("group").over(tier)).where(F.col("group") == F.col("best"))
    lowest = F.min(F.when(F.col("n") >= 2, F.col("tier"))).over(whole)
    kept = tiers.withColumn("used", F.coalesce(lowest, F.lit(0))).where(F.col("tier") == F.col("used"))
    trimmed = T.strip(value)
    place = (
        F.when(F.col("agrees"), _order(a=F.when(F.col("tier") == 2, -F.length("value")).otherwise(0), b=F.col("rank")))
        .when(field.isin(*vocab.DATE_FIELDS), _order(F.substring(trimmed, 1, 4), -F.length(trimmed), trimmed))
        .otherwise(_order(a=F.when(F.col("is_ranked"), 0).otherwise(1), b=F.when(F.col("is_ranked"), F.col("rank")).otherwise(0)))
    )
    placed = kept.withColumn("place", place).withColumn("first", F.min("place").over(whole))
    whole_field = field.isin(*vocab.ALBUM_GROUP, "artwork_url")
    return placed.where(whole_field | (F.col("place") == F.col("first"))).drop("agrees", "tier", "key", "n", "group", "best", "used", "first")


def is_compilation(credit: Column, artist: Column, family: Column) -> Column:
    """An album credit that names no act, or another act than the track's where the two go by one convention."""
    left, right = T.key(credit), T.key(artist)
    other = ~(F.startswith(left, right) | F.startswith(right, left))
    by_convention = family.isin(*vocab.CONVENTION_FIELDS)
    named = T.strip(T.fold(credit)).isin(*vocab.COMPILATION_CREDITS)
    return (T.text(credit) != "") & (named | ((T.text(artist) != "") & ~by_convention & other))


def choose_album(kept: DataFrame) -> DataFrame:
    """kept with own_album, the last of the row's source, and the track's album_source and album, its first title there.

    Sources whose album is a compilation are out. Of the others the group of editions that most sources name
    wins, and in it the fullest edition; without titles, the best ranked source.
    """
    track, by_source = Window.partitionBy("track_id"), Window.partitionBy("track_id", "source")
    is_album, in_group = F.col("field") == "album", F.col("field").isin(*vocab.ALBUM_GROUP)
    said = F.struct("ord", "value")
    rows = kept.withColumns({
        "artist": F.min(F.when(F.col("field") == "artist", F.struct("place", "value"))).over(track)["value"],
        "credit": F.min(F.when(F.col("field") == "album_artist", said)).over(by_source)["value"],
        "last": F.max(F.when(is_album, said)).over(by_source), "first": F.min(F.when(is_album, said)).over(by_source), "since": F.min(F.when(in_group, F.col("ord"))).over(by_source),
    })
    rows = rows.withColumn("fits", in_group & ~is_compilation(F.col("credit"), F.col("artist"), F.col("family"))).withColumn("own_key", F.when(is_album, T.album_key(F.col("last.value"))))
    rows = rows.withColumn("names", F.col("fits") & is_album & (F.col("ord") == F.col("last.ord")))  # one row for each source with a title
    edition_group = Window.partitionBy("track_id", "own_key")
    of_names = lambda c: F.when(F.col("names"), c)
    size = F.struct(-F.count(of_names(F.lit(1))).over(edition_group), F.min(of_names(F.col("album_rank"))).over(edition_group), F.min(of_names(F.col("first.ord"))).over(edition_group))
    rows = rows.withColumn("size", of_names(size)).withColumn("best", F.min("size").over(track)).withColumn("titled", F.max("names").over(track))
    deluxe = T.let(T.fold(F.col("last.value")), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in vocab.DELUXE_WORDS]))
    edition = (~deluxe, ~F.rlike("last.value", F.lit(T.NUMBER_TAIL)), F.col("album_rank"), F.col("first.ord"))
    untitled = (F.lit(0), ~F.col("album_ranked"), F.when(F.col("album_ranked"), F.col("album_rank")).otherwise(0), F.col("since"))
    shown = (F.col("source").alias("source"), F.col("first.value").alias("album"))
    entry = lambda keys: F.struct(*[k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)], *shown)
    choice = F.min(F.when(F.col("names") & (F.col("size") == F.col("best")), entry(edition)).when(~F.col("titled") & F.col("fits"), entry(untitled))).over(track)
    rows = rows.withColumn("choice", choice)
    return rows.select(*kept.columns, F.col("last.value").alias("own_album"), F.col("choice.source").alias("album_source"), F.col("choice.album").alias("album"))


def decide(chosen: DataFrame) -> DataFrame:
    """DECISION rows: album fields from the album's source, a cover of that release, everything else by place.

    A cover comes from a source whose own album is that release, else from the album's source, else by ranking.
    """
    cover, in_group = F.col("field") == "artwork_url", F.col("field").isin(*vocab.ALBUM_GROUP)
    of_source = F.coalesce(F.col("source") == F.col("album_source"), F.lit(False))
    same = cover & (T.text("album") != "") & (T.album_key(F.col("own_album")) == T.album_key(F.col("album")))  # keys of covers alone
    tier = F.when(~cover | same, 0).when(of_source, 1).otherwise(2)
    rows = chosen.where(~in_group | of_source).withColumn("tier", tier)
    order = F.when(in_group, _order()).when(cover, _order(a=F.col("tier"), b=F.when(F.col("tier") == 1, 0).otherwise(F.col("rank")))).otherwise(F.col("place"))
    won = rows.groupBy("track_id", "field").agg(F.min_by(F.struct("value", "source", "is_ranked"), order).alias("w")).select("track_id", "field", "w.*")
    own_rule = F.col("field").isin(*vocab.ALBUM_GROUP, *vocab.DATE_FIELDS, "artwork_url")
    return won.select("track_id", "field", "value", "source", F.when(own_rule | F.col("is_ranked"), "precedence").otherwise("fallback").alias("decided_by"))


def carry_features(decisions: DataFrame) -> DataFrame:
    """Titles gain featured names that neither title nor artist shows."""
    track = Window.partitionBy("track_id")
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).over(track)
    rows = decisions.withColumn("_featured", of("featured_artists")).withColumn("_lead", F.transform(T.split_artists(of("artist")), T.key)).withColumn("_known", T.key(F.col("value")))
    missing = F.filter(T.split_artists(F.col("_featured")), lambda n: ~F.contains(F.col("_known"), T.key(n)) & ~F.array_contains(F.col("_lead"), T.key(n)))
    title = F.when((F.col("field") == "title") & (F.size(missing) > 0), F.concat("value", F.lit(" (feat. "), T.format_artists(missing), F.lit(")"))).otherwise(F.col("value"))
    return rows.withColumn("value", title).select(*decisions.columns)


def with_albums(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """Non-empty candidates, ranked and narrowed by agreement, with the track's album choice."""
    rows = candidates.withColumn("value", T.text("value")).where((F.col("value") != "") & ((F.col("field") != "label") | ~T.is_non_label(F.col("value"))))
    ranked = rank_candidates(spread(rows, "track_id"), ranking)
    return choose_album(keep_agreed(rank_candidates(ranked, ranking, "album", "album_rank", "album_ranked")))


def arbitrate(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """DECISION rows, one for each field of each track. candidates: track_id, family, field, value, source, ord."""
    return carry_features(decide(with_albums(candidates, ranking)))


def rearbitrate(candidates: DataFrame, ranking: DataFrame, before: DataFrame) -> DataFrame:
    """track_id, changed: in how many fields a new arbitration differs from unprotected decisions before.

    Both sides are dealt in parts that follow the size of the files, as fusion itself is.
    """
    parts, keys = partitions_for(candidates, before), ["track_id", "field"]
    after = arbitrate(candidates, ranking).select(*keys, F.col("value").alias("new")).repartition(parts, *keys)
    old = before.where(~F.col("decided_by").isin(*vocab.PROTECTED)).select(*keys, F.col("value").alias("old")).repartition(parts, *keys)
    both = old.join(after, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("track_id").repartition(parts, "track_id").groupBy("track_id").agg(F.count("*").alias("changed"))


def persist(resolved: DataFrame, decisions: DataFrame, replace: bool = False) -> DataFrame:
    """resolved with the decisions, but for protected fields; replace drops unprotected fields that are no longer decided."""
    protected = F.col("decided_by").isin(*vocab.PROTECTED)
    old = resolved.select(*DECISION, F.when(protected, 0).otherwise(2).alias("_turn"))
    rows = (old.where("_turn = 0") if replace else old).unionByName(decisions.select(*DECISION, F.lit(1).alias("_turn")))
    won = F.min_by(F.struct("value", "source", "decided_by"), "_turn").alias("w")  # one pass: what is protected, else what is new, else what was
    return rows.groupBy("track_id", "field").agg(won).select("track_id", "field", "w.*")
