"""Properties and scenarios that the tables don't show."""

import random

import pytest
from pyspark.sql import functions as F

from concord import api, vocab
from concord.functions import similarity
from concord.functions import text as T
from concord.operators import calibrate, fuse, identity, relations, resolve, store

CANDIDATE = "track_id long, family string, field string, value string, source string, ord long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def decide(spark, family, field, *pairs):
    rows = [(1, family, field, v, s, i) for i, (s, v) in enumerate(pairs)]
    return fuse.arbitrate(spark.createDataFrame(rows, CANDIDATE), vocab.default_ranking(spark)).first()


@pytest.mark.parametrize(
    ("family", "field", "pairs", "value", "how"),
    [
        ("pop", "genre", [("musicbrainz", "Pop"), ("discogs", "Deep House")], "Deep House", "precedence"),
        ("world", "artist", [("itunes", "Mithoon & Arijit Singh"), ("spotify", "Mithoon"), ("musicbrainz", "Arijit Singh")], "Arijit Singh", "precedence"),
        ("pop", "artist", [("itunes", "Morgan Wallen"), ("spotify", "Morgan Wallen"), ("musicbrainz", "Metro Station")], "Morgan Wallen", "precedence"),
        ("pop", "title", [("musicbrainz", "There for You"), ("itunes", "Hey, Soul Sister (Country Mix)"), ("spotify", "Hey, Soul Sister")], "Hey, Soul Sister", "precedence"),
        ("pop", "title", [("itunes", "Marvin Gaye (feat. Meghan Trainor)"), ("spotify", "Marvin Gaye (feat. Meghan Trainor)"), ("musicbrainz", "Marvin Gaye")], "Marvin Gaye (feat. Meghan Trainor)", "precedence"),
        ("other", "weird_field", [("somewhere", "x")], "x", "fallback"),
    ],
)
def test_fusion(spark, family, field, pairs, value, how):
    got = decide(spark, family, field, *pairs)
    assert (got.value, got.decided_by) == (value, how)


def test_fusion_does_not_depend_on_partitions(spark, sf):
    from concord.plans import bindings

    rows = bindings.relation(spark, sf, bindings.CANDIDATES).where("track_id <= 20")
    ranking = vocab.default_ranking(spark)
    a = sorted(map(tuple, fuse.arbitrate(rows.repartition(7, "ord"), ranking).collect()))
    assert a == sorted(map(tuple, fuse.arbitrate(rows.coalesce(1), ranking).collect()))


def test_empty_candidates(spark):
    assert fuse.arbitrate(spark.createDataFrame([], CANDIDATE), vocab.default_ranking(spark)).count() == 0


def test_one_exchange_of_candidates(spark):
    rows = spark.createDataFrame([(1, "pop", "title", "x", "spotify", 0)], CANDIDATE)
    plan = fuse.arbitrate(rows, vocab.default_ranking(spark))._jdf.queryExecution().sparkPlan().toString()
    prepared = fuse.arbitrate(rows, vocab.default_ranking(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and prepared.count("Exchange hashpartitioning(track_id") == 1


@pytest.mark.parametrize("title", ["Mood (feat. A & B) [X Remix]", "Stay - Y Edit", "A (From \"B\") (ft. C)", "", "  x  ", "(Remix)"])
def test_canonical_title_is_idempotent(spark, title):
    once = one(spark, T.canonical_title(F.lit(title)))
    assert one(spark, T.canonical_title(F.lit(once))) == once


def test_unicode(spark):
    assert one(spark, T.key(F.lit("Straße É½"))) == "strasseé½"
    assert one(spark, T.squeeze(F.lit(" a  b\t"))) == "a b"
    assert one(spark, T.words_key(F.lit("कसौटी ½x²_a!"))).startswith("क")
    assert one(spark, T.tidy(F.lit("é"), compose=True)) == "é"
    assert one(spark, T.key(F.lit(None).cast("string"))) == ""


def test_with_is_cut_unless_kept(spark):
    assert one(spark, T.clean_title(F.lit("Stay With Me"), F.lit(""))) == "Stay"
    assert one(spark, T.clean_title(F.lit("Stay With Me"), F.lit(""), keep_with=True)) == "Stay With Me"


def test_credit_split(spark):
    credit = F.from_json(F.lit('[{"name":"A","joinphrase":" & "},{"name":"B","joinphrase":" feat. "},{"name":"C"}]'), "array<struct<name:string,joinphrase:string>>")
    got = one(spark, T.split_credit(credit))
    assert (got.names, got.featured) == (["A", "B"], ["C"])


def test_ranking_without_evidence_is_the_default(spark):
    obs = spark.createDataFrame([], "id long, track_id long, family string, field string, chosen array<string>, offered array<string>")
    default = vocab.default_ranking(spark)
    assert calibrate.derive(obs, default).count() == 0
    assert fuse.resolved_ranking(default, calibrate.derive(obs, default)).count() == default.count()


def test_calibration_reaches_fusion(spark):
    obs = spark.createDataFrame([(i, i, "pop", "genre", ["musicbrainz"], ["discogs", "musicbrainz"]) for i in range(20)], "id long, track_id long, family string, field string, chosen array<string>, offered array<string>")
    default = vocab.default_ranking(spark)
    ranking = fuse.resolved_ranking(default, calibrate.derive(obs, default))
    rows = spark.createDataFrame([(1, "pop", "genre", "Pop", "musicbrainz", 0), (1, "pop", "genre", "House", "discogs", 1)], CANDIDATE)
    assert fuse.arbitrate(rows, default).first().value == "House"
    assert fuse.arbitrate(rows, ranking).first().value == "Pop"


def test_release_selection(spark):
    ddl = "q int, artist string, album_artist string, primary_type string, secondary_types array<string>, title string, track_count int, position int"
    rows = [(1, "Pitbull", "Pitbull", "Album", [], "Planet Pit", 12, 0), (1, "Pitbull", "Various Artists", "Album", [], "Hit Mania", 24, 1), (1, "Pitbull", "Pitbull", "Album", [], "Planet Pit (Deluxe)", 16, 2), (1, "Pitbull", "Pitbull", "Album", ["Live"], "Live", 30, 3)]
    assert identity.select_release(spark.createDataFrame(rows, ddl), ["q"]).first().title == "Planet Pit (Deluxe)"


def test_snapshot_versions(spark, tmp_path):
    table = relations.Snapshot(spark, f"file://{tmp_path}/t", "k int, v string")
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    table.write(relations.upsert(table.read(), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"]))
    assert sorted(map(tuple, table.read().collect())) == [(1, "b"), (2, "c")]
    assert table.read(1).first().v == "a"


def test_protected_decisions_stay(spark):
    ddl = "track_id long, field string, value string, source string, decided_by string"
    old = spark.createDataFrame([(1, "title", "mine", "manual", "manual"), (1, "genre", "Pop", "x", "precedence")], ddl)
    new = spark.createDataFrame([(1, "title", "theirs", "spotify", "precedence"), (1, "genre", "Rock", "itunes", "precedence")], ddl)
    got = {r.field: r.value for r in fuse.persist(old, new).collect()}
    assert got == {"title": "mine", "genre": "Rock"}


def test_failures_are_kept_apart(spark):
    tracks = spark.createDataFrame([(1, "acquired", "pending", None), (2, "acquired", "pending", None), (3, "published", "published", None)], "track_id long, stage string, status string, error string")
    got = {r.track_id: r for r in store.advance(tracks, spark.createDataFrame([(1, None), (2, "boom" * 200)], "track_id long, error string")).collect()}
    assert (got[1].stage, got[2].status, len(got[2].error), got[3].stage) == ("normalised", "failed", 500, "published")


# Which result must win, which pairs are alike, and what two catalogues may settle.
WINNERS = [
    ("Taylor Swift", "Love Story", [("Taylor Swift", "Love Story (Taylor's Version)"), ("Taylor Swift", "Love Story (Live)"), ("Taylor Swift", "Love Story")], 2),
    ("Justin Bieber", "Beauty And A Beat", [("Justin Bieber", "Baby (feat. Ludacris)"), ("Justin Bieber", "Beauty and a Beat (feat. Nicki Minaj)")], 1),
    ("Charlie Puth", "Marvin Gaye", [("Charlie Puth", "Marvin Gaye (Remix)"), ("Charlie Puth", "Marvin Gaye (feat. Meghan Trainor)")], 1),
    ("jayseanworldwide", "Down", [("Various Artists", "Down Under"), ("Jay Sean", "Down")], 1),
    ("A", "Same Title", [("A", "Same Title"), ("A", "Same Title")], 0),
    ("Taylor Swift", "We Are Never Ever Getting Back Together", [("Luke Conard", "We Are Never Ever Getting Back Together"), ("Taylor Swift", "We Are Never Ever Getting Back Together")], 1),
]
ALIKE = [
    ("Morgan Wallen", "Last Night", "Metro Station", "California", False), ("Beyonce", "Halo", "Deborah Cox", "Nobody's Supposed to Be Here", False),
    ("Owl City", "Fireflies", "Vanilla Ice", "Ice Ice Baby", False), ("Avicii", "Waiting For Love", "Juice WRLD", "The Party Never Ends", False),
    ("Morgan Wallen", "Last Night", "Morgan Wallen", "Last Night", True), ("jayseanworldwide", "Down", "Jay Sean", "Down", True), ("iyazlive", "Replay", "Iyaz", "Replay", True),
    ("push baby", "Me And My Broken Heart", "Rixton", "Me and My Broken Heart", True), ("Train", "Hey, Soul Sister", "Train", "Hey, Soul Sister (Country Mix)", True),
]
CARLY, MAYBE = "Carly Rae Jepsen", "Call Me Maybe"
VOTES = [
    ([("itunes", CARLY, MAYBE), ("spotify", CARLY, MAYBE)], True), ([("itunes", CARLY, MAYBE)], False), ([("itunes", CARLY, MAYBE), ("spotify", "Kidz Bop Kids", MAYBE)], False),
    ([("itunes", "Metro Station", "California"), ("spotify", "Metro Station", "California")], False), ([("itunes", "Kidz Bop", MAYBE), ("spotify", "Kidz Bop", MAYBE)], False),
    ([("itunes", CARLY, "Call Me Maybe (Radio Edit)"), ("spotify", CARLY, MAYBE)], True), ([("itunes", "", MAYBE), ("spotify", "", MAYBE)], False),
]


def test_winning_results(spark):
    rows = [(k, qa, qt, a, t, n) for k, (qa, qt, results, _) in enumerate(WINNERS) for n, (a, t) in enumerate(results)]
    scored = api.score(spark.createDataFrame(rows, "q int, qa string, qt string, a string, t string, position int"), "qa", "qt", "a", "t")
    got = {r.q: r.position for r in identity.best_result(scored, ["q"], "match_score", "position").collect()}
    assert got == {k: w[-1] for k, w in enumerate(WINNERS)}


def test_results_are_ranked_and_none_is_dropped(spark):
    rows = [("q", 0, None), ("q", 1, 0.5), ("q", 2, 0.9), ("q", 3, 0.9), ("q", None, 0.9), ("r", 0, 0.1), (None, 0, 0.2), (None, 1, 0.3)]
    results = spark.createDataFrame(rows, "q string, position int, match_score double")
    ranked = identity.rank_results(results, ["q"], "match_score", "position")
    assert {(r.q, r.position): r["rank"] for r in ranked.collect()} == {("q", 2): 1, ("q", 3): 2, ("q", None): 3, ("q", 1): 4, ("q", 0): 5, ("r", 0): 1, (None, 1): 1, (None, 0): 2}
    best = identity.best_result(results, ["q"], "match_score", "position")
    assert set(map(tuple, ranked.where("rank = 1").select(*best.columns).collect())) == set(map(tuple, best.collect()))


def test_plausible_results(spark):
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(ALIKE)], "k int, qa string, qt string, a string, t string, ok boolean")
    scored = similarity.match_score(rows, "qa", "qt", "a", "t")
    assert all(r.is_ok == r.ok for r in scored.withColumn("is_ok", similarity.is_plausible(F.col("match_score"))).collect())


def test_corroboration(spark):
    rows = [(k, f, v, source, n) for k, (votes, _) in enumerate(VOTES) for n, (source, a, t) in enumerate(votes) for f, v in (("artist", a), ("title", t))]
    queries = spark.createDataFrame([(k, CARLY, MAYBE) for k in range(len(VOTES))], "track_id long, query_artist string, query_title string")
    got = {r.track_id: r.corroborated for r in identity.corroborated(spark.createDataFrame(rows, "track_id long, field string, value string, source string, ord long"), queries).collect()}
    assert got == {k: ok for k, (_, ok) in enumerate(VOTES)}


def test_fingerprints_that_link_to_another_song_fall_through_to_text(spark):
    links = [["r1"], ["r1", "r2"], ["r2"], []]
    queries = spark.createDataFrame([(k, "Morgan Wallen", "Last Night", 200.0, "") for k in range(4)], "track_id long, artist string, title string, duration_s double, isrc string")
    prints = spark.createDataFrame([(k, f"a{k}", 0.98, ids, 0) for k, ids in enumerate(links)], "track_id long, acoustid string, score double, recording_ids array<string>, position int")
    linked = spark.createDataFrame([("r1", "Metro Station", "California", 200.0, False), ("r2", "Morgan Wallen", "Last Night", 200.0, False)], "recording_id string, artist string, title string, length double, has_release boolean")
    recordings = spark.createDataFrame([(0, 1, 0, "t", "Last Night", 200.0, 95, 1)], "track_id long, tier int, position int, recording_id string, title string, length double, score int, n_releases int")
    by_text = resolve.evaluate(queries, recordings, recordings.select("track_id", "recording_id"))
    values = spark.createDataFrame([(r, "title", t, "musicbrainz", 0) for r, t in (("r1", "California"), ("r2", "Last Night"), ("t", "Last Night"))], "recording_id string, field string, value string, source string, ord long")
    nothing = spark.createDataFrame([], "track_id long, field string, value string, source string, ord long")
    matches, candidates = resolve.resolve(queries, by_text, resolve.evaluate_fingerprints(queries, prints, linked), values, nothing)
    got = {r.track_id: (r.evidence, r.recording_id, r.confidence) for r in matches.collect()}
    assert got == {0: ("text", "t", 0.85), 1: ("acoustid", "r2", 0.95), 2: ("acoustid", "r2", 0.95), 3: ("none", None, 0.0)}
    assert {r.track_id: r.value for r in candidates.collect()} == {0: "Last Night", 1: "Last Night", 2: "Last Night"}


def test_duplicates_do_not_chain(spark):
    ddl = "track_id long, isrc string, acoustid string, duration_s double, bitrate int, is_art_track boolean"
    rows = [(1, "A", None, 100.0, 320, False), (2, "A", None, 101.5, 256, True), (3, "A", None, 103.0, 192, False), (4, "B", "x", 100.0, 256, False), (5, None, "x", 101.0, 256, True), (6, "B", None, 109.0, 320, False), (7, "", None, 100.0, 1, False), (8, "", None, 100.0, 2, False), (9, "A", None, None, 999, True)]
    got = {r.track_id: r.duplicate_of for r in identity.duplicates(spark.createDataFrame(rows, ddl), ["isrc", "acoustid"]).collect()}
    assert got == {2: 1, 4: 5}  # 3 is near to 2 alone, which goes itself


@pytest.mark.parametrize("large", [0, 40, 20_000])
def test_duplicates_are_those_of_all_pairs(spark, monkeypatch, large):
    """Wherever keys count as frequent: all, some or none."""
    monkeypatch.setattr(identity, "COMMON", large)
    draw = random.Random(5)
    rows = [(k, draw.choice(["A", "A", "B", f"C{k % 40}", "", None]), draw.choice(["A", f"x{k % 60}", None]), draw.choice([None, 60.0 + draw.randrange(64_000) / 1000, 62.0, 64.0, 66.001]), draw.choice([None, 128, 256, 320]), draw.random() < 0.3) for k in range(400)]
    near = {(a[0], b[0]) for a in rows for b in rows if None not in (a[3], b[3]) and abs(round(a[3] * 1000) - round(b[3] * 1000)) <= 2000 and (a[1] and a[1] == b[1] or a[2] and a[2] == b[2])}
    worth = {r[0]: (r[4] or 0, r[5], -r[0]) for r in rows}
    by_file = {k: [b for a, b in near if a == k] for k in worth}
    stays = {k for k, others in by_file.items() if others and max(others, key=worth.get) == k}
    want = {k: max(found, key=worth.get) for k, others in by_file.items() if k not in stays and (found := [b for b in others if b in stays])}
    ddl = "track_id long, isrc string, acoustid string, duration_s double, bitrate int, is_art_track boolean"
    got = {r.track_id: r.duplicate_of for r in identity.duplicates(spark.createDataFrame(rows, ddl), ["isrc", "acoustid"]).collect()}
    assert got == want and len(want) > 100
    assert not identity.duplicates(spark.createDataFrame([], ddl), ["isrc", "acoustid"]).collect()


def test_rearbitration_drops_what_is_no_longer_decided(spark):
    ddl = "track_id long, field string, value string, source string, decided_by string"
    old = spark.createDataFrame([(1, "title", "mine", "manual", "manual"), (1, "genre", "Pop", "x", "precedence"), (1, "label", "Old", "x", "precedence")], ddl)
    after, changed = api.rearbitrate(spark.createDataFrame([(1, "pop", "genre", "Rock", "itunes", 0), (1, "pop", "title", "theirs", "itunes", 1)], CANDIDATE), old)
    assert {r.field: r.value for r in after.collect()} == {"title": "mine", "genre": "Rock"}
    assert changed.first().changed == 3


def test_sources_need_their_credentials():
    from concord.sources import catalogues

    assert catalogues.enabled_sources({}) == ["itunes"]
    assert catalogues.enabled_sources({"DISCOGS_TOKEN": "x", "SPOTIFY_CLIENT_ID": "x"}) == ["itunes", "discogs"]


def test_older_schemas_are_read(spark):
    rows = spark.createDataFrame([(1, "published")], "track_id long, stage string")
    assert store.migrated(rows, 3).columns == ["track_id", "stage", "artwork_url"] and store.migrated(rows, 4).columns == rows.columns
    with pytest.raises(ValueError, match="newer"):
        store.migrated(rows, 5)


def test_bounds_decide_as_the_score_does(spark, sf):
    """Every candidate title against every eighth track's name by two artists, and strings at the edges of the bounds."""
    from concord.plans import bindings as B

    tracks = B.relation(spark, sf, B.TRACKS).where("track_id % 8 = 0").selectExpr("raw_artist AS query_artist", "raw_title AS query_title")
    titles = B.relation(spark, sf, B.CANDIDATES).where("field = 'title'").select(F.col("value").alias("title"), F.when(F.col("ord") % 2 == 0, "Brand#11").otherwise("Nobody").alias("artist")).distinct()
    odd = ["", None, "a", "ab" * 150, "ab" * 150 + "c", "x" * 199, "x" * 200, "É", "live", "song (live)", "song"]
    rows = tracks.crossJoin(titles).unionByName(spark.createDataFrame([(a, b, b, a) for a in odd for b in odd] + [(a, b, a, b) for a in odd for b in odd], "query_artist string, query_title string, title string, artist string"))
    scored = similarity.match_score(similarity.plausible(rows, "query_artist", "query_title", "artist", "title"), "query_artist", "query_title", "artist", "title")
    assert scored.where(~F.col("plausible").eqNullSafe(similarity.is_plausible(F.col("match_score")))).count() == 0
    counts = scored.agg(F.count("*").alias("n"), F.sum(F.col("plausible").cast("int")).alias("yes")).first()
    assert 0 < counts.yes < counts.n


def test_bounds_hold(spark):
    import difflib

    words = ["", "a", "abc", "cab", "abcabc", "halo", "hello world", "xhalox", "ab" * 120, "b" + "ab" * 120]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in rows.select("a", "b", similarity.least_alike(F.col("a"), F.col("b")).alias("least"), similarity.most_alike(F.col("a"), F.col("b")).alias("most")).collect():
        exact = difflib.SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else float(r.a == r.b)
        assert r.least <= exact + 1e-12 and exact <= r.most + 1e-12, r
