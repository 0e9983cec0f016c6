"""Calibration: blind comparisons of sources, and the ranking that the answers give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord import vocab
from concord.functions import text as T
from concord.operators.relations import seeded


def build_options(candidates: DataFrame) -> DataFrame:
    """track_id, family, field, value, sources, option_key: distinct values worth asking about, two or more for each field.

    candidates: track_id, family, field, value, source, ord. A source's last value of a field counts. An
    album is told apart by the rest of its album fields too.
    """
    # One exchange, on track_id: what a source says of a track is one row, from which its fields are laid out again.
    rows = candidates.where(T.text("value") != "").repartition("track_id")
    other = [f for f in vocab.ALBUM_GROUP if f != "album"]
    last = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord"))).alias(f"_{f}") for f in dict.fromkeys((*vocab.ELICITABLE, *other))]
    said = rows.groupBy("track_id", "family", "source").agg(*last, F.min("ord").alias("first"))
    extra = F.concat_ws("|", *[F.when(F.col(f"_{f}").isNotNull(), F.concat(F.lit(f"{f}="), T.option_key(F.col(f"_{f}")))) for f in other])
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value")) for f in vocab.ELICITABLE]), lambda p: p["value"].isNotNull())
    asked = said.select("track_id", "family", "source", "first", F.nullif(extra, F.lit("")).alias("extra"), F.explode(pairs).alias("p")).select("*", "p.*")
    key = F.concat_ws("|", T.option_key(F.col("value")), F.when(F.col("field") == "album", F.col("extra")))
    options = asked.withColumn("option_key", key).groupBy("track_id", "family", "field", "option_key").agg(F.min_by("value", "first").alias("value"), F.array_sort(F.collect_set("source")).alias("sources"))
    several = F.count("*").over(Window.partitionBy("track_id", "field"))
    return options.withColumn("n", several).where("n >= 2").drop("n")


def shuffled(options: DataFrame, seed: int) -> DataFrame:
    """options with position: an order by a seeded hash, so it tells nothing about the source and repeats for a seed."""
    order = seeded(seed, "track_id", "field", "option_key")
    return options.withColumn("position", F.row_number().over(Window.partitionBy("track_id", "field").orderBy(order, "option_key")) - 1)


def observations(elicitation: DataFrame) -> DataFrame:
    """Comma-joined lists as arrays without empty entries."""
    split = lambda c: F.filter(F.split(T.text(c), ","), lambda x: x != "")
    return elicitation.withColumn("chosen", split("chosen")).withColumn("offered", split("offered"))


def record(answers: DataFrame) -> DataFrame:
    """Rows for the elicitation table: sorted, comma-joined lists."""
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return answers.withColumn("chosen", join("chosen")).withColumn("offered", join("offered"))


def answer(questions: DataFrame, choice: str = "choice") -> DataFrame:
    """chosen sources of an answered question: the option at the index, none for -1. questions: options array<array<string>>."""
    valid = (F.col(choice) >= -1) & (F.col(choice) < F.size("options"))
    return questions.where(valid).withColumn("chosen", F.coalesce(F.get("options", F.col(choice)), F.array().cast("array<string>"))).withColumn("offered", F.array_distinct(F.flatten("options")))


def tally(obs: DataFrame) -> DataFrame:
    """family, field, source, seen, wins, first: how often each source was offered and chosen. obs: id, family, field, chosen, offered."""
    offered = obs.select("family", "field", F.posexplode("offered").alias("k", "source"), F.lit(1).alias("seen"), F.lit(0).alias("wins"), "id")
    chosen = obs.select("family", "field", F.posexplode("chosen").alias("k", "source"), F.lit(0).alias("seen"), F.lit(1).alias("wins"), "id")
    return offered.unionByName(chosen).groupBy("family", "field", "source").agg(
        F.sum("seen").alias("seen"), F.sum("wins").alias("wins"), F.min(F.struct("id", (1 - F.col("seen")).alias("late"), "k")).alias("first")
    )


def derive(obs: DataFrame, ranking: DataFrame, min_observations: int = vocab.MIN_OBSERVATIONS) -> DataFrame:
    """family, field, rank, source: calibrated cells. A source's score is its share of wins, shrunk toward its place in the ranking."""
    seen = tally(obs).where(~F.col("field").isin(*vocab.DATE_FIELDS))
    enough = seen.groupBy("family", "field").agg(F.max("seen").alias("answered")).where(F.col("answered") >= min_observations).select("family", "field")
    known = ranking.join(enough, ["family", "field"]).select("family", "field", "source", F.col("rank").alias("default_rank"))
    both = known.join(seen.join(enough, ["family", "field"], "left_semi"), ["family", "field", "source"], "full")
    cell = Window.partitionBy("family", "field")
    n = F.count("default_rank").over(cell)
    prior = F.coalesce(1 - F.col("default_rank") / (n + 1), F.lit(0.0))
    score = (F.coalesce("wins", F.lit(0)) + vocab.PRIOR_WEIGHT * prior) / (F.coalesce("seen", F.lit(0)) + vocab.PRIOR_WEIGHT)
    ranked = both.withColumn("score", F.round(score, 12)).withColumn("late", F.when(F.col("default_rank").isNull(), F.col("first")))
    order = Window.partitionBy("family", "field").orderBy(F.desc("score"), F.asc_nulls_last("default_rank"), "late")
    return ranked.select("family", "field", (F.row_number().over(order) - 1).cast("int").alias("rank"), "source")


def apply(precedence: DataFrame, derived: DataFrame) -> DataFrame:
    """precedence with the calibrated cells in place of their old rows."""
    cells = derived.select("family", "field").distinct()
    return derived.unionByName(precedence.join(F.broadcast(cells), ["family", "field"], "left_anti"))


def cell_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("family", "field").agg(F.count("*").alias("n"))


def disputed(candidates: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """track_id, family, field that two or more sources fill and that have not been asked. answered: track_id, field."""
    rows = candidates.where((T.text("value") != "") & F.col("field").isin(*vocab.ELICITABLE))
    pairs = rows.groupBy("track_id", "family", "field").agg(F.count_distinct("source").alias("n")).where("n >= 2").drop("n")
    return pairs if answered is None else pairs.join(answered.select("track_id", "field").distinct(), ["track_id", "field"], "left_anti")


def next_question(candidates: DataFrame, obs: DataFrame, seed: int, target: int = vocab.TARGET_PER_CELL) -> DataFrame:
    """The one pair to ask next: of the cell with the fewest answers, by family and field, then by a seeded hash."""
    open_pairs = disputed(candidates, obs).join(build_options(candidates).select("track_id", "field").distinct(), ["track_id", "field"], "left_semi")
    rows = open_pairs.join(cell_counts(obs), ["family", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < target)
    return rows.orderBy("n", "family", "field", seeded(seed, "track_id"), "track_id").limit(1)


def progress(candidates: DataFrame, obs: DataFrame, target: int = vocab.TARGET_PER_CELL) -> DataFrame:
    """One row: answered, cells_done, cells_started, remaining."""
    counts = cell_counts(obs)
    pairs = disputed(candidates, obs).groupBy("family", "field").agg(F.count("*").alias("pairs"))
    cells = counts.join(pairs, ["family", "field"], "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return cells.agg(
        total("n").alias("answered"), total((F.col("n") >= target).cast("int")).alias("cells_done"), total((F.col("n") > 0).cast("int")).alias("cells_started"),
        total(F.least(F.greatest(F.lit(target) - F.col("n"), F.lit(0)), F.col("pairs"))).alias("remaining"),
    )
