"""Deck scoring from deck entries (deck_id, card_id, copies) joined with card attributes; all metrics of a deck come from aggregates over the entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, has_type, scoring_bucket
from ..functions.vectors import doubles, norm
from ..shared import by_key, grown

HAND = 5
KINDS = ("monster", "spell", "trap")
#: Target shares (monster, spell, trap) by format in lower case (fixed values).
TARGETS = {"goat": (0.50, 0.35, 0.15), "hat": (0.50, 0.25, 0.25)}
DEFAULT_TARGET = (0.50, 0.30, 0.20)
V2_WEIGHTS = {"consistency": 0.30, "synergy": 0.30, "brick_risk": 0.20, "balance": 0.20}


def deck_entries(entries: DataFrame, cards: DataFrame) -> DataFrame:
    """Entries with their cards' attributes; is_known is false, and the attributes null, for ids that no card has."""
    return entries.join(grown(cards.withColumnRenamed("id", "card_id").withColumn("is_known", F.lit(True))), "card_id", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def _target(fmt: Column, i: int) -> Column:
    out = F.lit(DEFAULT_TARGET[i])
    for name, shares in TARGETS.items():
        out = F.when(F.lower(F.trim(fmt)) == name, shares[i]).otherwise(out)
    return out


def _type_sums(counts: Column, bucket: Column) -> list[Column]:
    return [F.sum(F.when(counts & (bucket == k), F.col("copies")).otherwise(0)).alias(k) for k in KINDS]


def _balanced() -> dict[str, Column]:
    """Figures of the type sums beside a deck's format; sums that are null count as 0."""
    n = {k: F.coalesce(F.col(k), F.lit(0)) for k in KINDS}
    total = n["monster"] + n["spell"] + n["trap"]
    share = {k: F.when(total > 0, n[k] / total).otherwise(0.0) for k in KINDS}
    l1 = sum((F.abs(share[k] - _target(F.col("format"), i)) for i, k in enumerate(KINDS)), F.lit(0.0))
    return {**{f"{k}_count": n[k] for k in KINDS}, **{f"{k}_ratio": share[k] for k in KINDS}, "type_ratio_distance_l1": l1, "balance_score": clamp(100 * (1 - l1 / 2))}


def deck_balance(decks: DataFrame, known: DataFrame, many: int = 0) -> DataFrame:
    """Type counts and shares over cards of a known type, L1 distance to the format's targets, and its score; empty decks too."""
    rows = by_key(known.select("deck_id", "copies", scoring_bucket(F.col("type")).alias("bucket")), "deck_id", many)
    counts = rows.groupBy("deck_id").agg(*_type_sums(F.lit(True), F.col("bucket")))
    return decks.join(grown(counts), "deck_id", "left").select("deck_id", "format", *(c.alias(n) for n, c in _balanced().items()))


def _width(embeddings: DataFrame) -> int:
    """Length of the vectors, by the first of them; 0 if there are none."""
    first = embeddings.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    return first["n"] if first else 0


def _with_vectors(entries: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Entries with their cards' vectors as they came and the vectors' lengths, by which they are divided only where they are
    summed; both null for zero vectors and cards without one. A row a card; a vector of another length than the first is an
    error."""
    e = F.col("embedding")
    same = F.when(e.isNull() | (F.size(e) == width), e).otherwise(F.raise_error(F.lit("vectors differ in length")).cast(embeddings.schema["embedding"].dataType))
    vectors = embeddings.select("card_id", same.alias("vector")).withColumn("vector_length", norm(doubles(F.col("vector")))).where("vector_length > 0")
    return entries.join(grown(vectors), "card_id", "left")


def _vector_sums(width: int) -> list[Column]:
    """n_vectors and one sum for each dimension over the unit vectors of a deck's cards, as plain doubles; null without any."""
    x = lambda i: F.get("vector", F.lit(i)).cast("double") / F.col("vector_length") * F.col("copies")
    return [F.sum(F.when(F.col("vector_length").isNotNull(), F.col("copies"))).alias("n_vectors"), *(F.sum(x(i)).alias(f"u{i}") for i in range(width))]


def _similar(width: int) -> dict[str, Column]:
    n = F.coalesce("n_vectors", F.lit(0))
    s2 = sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(width)), F.lit(0.0))
    enough = n >= 2
    pairwise = F.when(enough, (s2 - n) / (n * (n - 1))).otherwise(0.0)
    centre = F.when(enough, F.sqrt(s2) / n).otherwise(0.0)
    score = F.when(enough, clamp(100 * (0.7 * (pairwise + 1) / 2 + 0.3 * (centre + 1) / 2))).otherwise(50.0)
    return {"coverage": F.when(F.col("main_size") > 0, n / F.col("main_size")), "mean_pairwise_cosine": pairwise, "mean_centroid_cosine": centre, "synergy_score": score}


def deck_synergy(entries: DataFrame, embeddings: DataFrame, many: int = 0) -> DataFrame:
    """Coverage and mean pairwise and centroid cosines of each deck, by the sum of its unit vectors rather than by pairs.

    With S the sum of n unit vectors, the mean over pairs is (|S|^2 - n) / (n (n - 1)) and the mean cosine to the mean is
    |S| / n. Copies count; zero vectors drop out; under two vectors both are 0 and the score is 50.
    """
    width = _width(embeddings)
    rows = by_key(_with_vectors(entries, embeddings, width).select("deck_id", "copies", "vector", "vector_length"), "deck_id", many)
    sums = rows.groupBy("deck_id").agg(F.sum("copies").alias("main_size"), *_vector_sums(width))
    return sums.select("deck_id", *(c.alias(n) for n, c in _similar(width).items()))


def starter_like(text: Column, kind: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    monster, spell = has_type(kind, "monster"), has_type(kind, "spell")
    return (monster & t.contains("add") & t.contains("deck") & t.contains("hand")) | (monster & t.contains("special summon") & ~t.contains("from your hand")) | (spell & t.contains("add") & t.contains("deck"))


def enabler_like(text: Column, kind: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    monster, spell = has_type(kind, "monster"), has_type(kind, "spell")
    return t.contains("special summon") | (spell & (t.contains("draw") | t.contains("add"))) | (monster & (t.contains("extender") | t.contains("summon")))


def role_ids(tags: DataFrame, role: str) -> DataFrame:
    """Distinct ids tagged with a role, with a confidence that is unknown or above 0."""
    return tags.where((F.col("role_tag") == role) & (F.col("confidence").isNull() | (F.col("confidence") > 0))).select("card_id").distinct()


def _starter(text: str) -> Column:
    return F.coalesce("tagged", F.lit(False)) | starter_like(F.col(text), F.col("type"))


def _starter_sums(hit: Column) -> list[Column]:
    return [F.sum(F.when(hit, F.col("copies")).otherwise(0)).alias("starters"), F.count_if(hit).alias("starter_kinds")]


def _drawn() -> dict[str, Column]:
    """Opening hands of main_size cards with so many starters; null without cards."""
    n, s = F.col("main_size"), F.col("starters")
    miss = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(HAND), n).cast("int") - 1), F.lit(1.0), lambda p, i: p * F.greatest(n - s - i, F.lit(0)) / (n - i))
    miss = F.when(n > 0, miss)
    return {"hit_rate": 1 - miss, "brick_rate": miss, "consistency_score": 100 * (1 - miss), "brick_risk_score": 100 * (1 - miss)}


def _flagged(entries: DataFrame, starters: DataFrame) -> DataFrame:
    return entries.join(grown(starters.select("card_id", F.lit(True).alias("tagged"))), "card_id", "left")


def deck_consistency(known: DataFrame, starters: DataFrame, text: str = "descr", many: int = 0) -> DataFrame:
    """Chance that an opening hand holds a starter: exact, 1 less the product of (n - s - i) / (n - i) over the hand's draws.

    A deck with three bricks and no enabler is a brick only if it has no starter either, and every starter is an enabler,
    so the brick rate is the rate of hands without a starter.
    """
    rows = by_key(_flagged(known, starters).select("deck_id", "copies", _starter(text).alias("starter")), "deck_id", many)
    sums = rows.groupBy("deck_id").agg(F.sum("copies").alias("main_size"), *_starter_sums(F.col("starter")))
    return sums.select("deck_id", "starters", "starter_kinds", *(c.alias(n) for n, c in _drawn().items()))


def measured(decks: DataFrame, entries: DataFrame, embeddings: DataFrame, starters: DataFrame, text: str = "descr", many: int = 0) -> DataFrame:
    """Sizes, balance, synergy and consistency of all decks, from one aggregate over all entries, each dealt once and narrow but
    for its card's vector.

    decks: deck_id, format and what is to be kept; entries: deck_id, zone, card_id, copies, is_known and card attributes;
    embeddings and starters: a row a card. The main deck alone is measured. A deck without main cards has zeros, a synergy of
    50 and null rates. many: about how many entries there are; tasks follow their number, here and in the functions above.
    """
    width, main = _width(embeddings), F.col("zone") == "main"
    rows = _with_vectors(_flagged(entries, starters), embeddings, width)
    rows = rows.select("deck_id", "zone", "copies", F.when(main & F.col("is_known"), scoring_bucket(F.col("type"))).alias("bucket"), (main & _starter(text)).alias("starter"), *(F.when(main, F.col(c)).alias(c) for c in ("vector", "vector_length")))
    sums = by_key(rows, "deck_id", many).groupBy("deck_id").agg(
        F.sum(F.when(main, F.col("copies"))).alias("main_size"), F.sum(F.when(F.col("zone") == "extra", F.col("copies"))).alias("extra_size"), F.count_if(main).alias("unique_main_count"),
        *_type_sums(F.lit(True), F.col("bucket")), *_starter_sums(F.col("starter")), *_vector_sums(width))
    joined = decks.join(grown(sums), "deck_id", "left")
    whole = ("main_size", "extra_size", "unique_main_count", "starters", "starter_kinds")
    figures = {**{c: F.coalesce(c, F.lit(0)) for c in whole}, "unique_main_ratio": F.coalesce(F.col("unique_main_count") / F.nullif(F.col("main_size"), F.lit(0)), F.lit(0.0)), **_balanced(), **_similar(width), **_drawn()}
    return joined.select(*decks.columns, *(c.alias(n) for n, c in figures.items()))


def deck_scores(decks: DataFrame, entries: DataFrame, embeddings: DataFrame, starters: DataFrame, many: int = 0) -> DataFrame:
    """Both overall scores. decks: deck_id, format, staples, novelty (how many of these were placed; in no main deck none)."""
    rows = measured(decks, entries, embeddings, starters, many=many)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    placed = lambda c: F.when(F.col("main_size") > 0, zero(c)).otherwise(0.0)
    v1 = 100 + 15 * placed("novelty") + 1.5 * placed("staples") + 12 * F.col("unique_main_ratio") - 30 * F.col("type_ratio_distance_l1")
    parts = {k: zero(f"{k}_score") for k in V2_WEIGHTS}
    v2 = clamp(sum((V2_WEIGHTS[k] * parts[k] for k in V2_WEIGHTS), F.lit(0.0)))
    return rows.select("deck_id", "format", v1.alias("score_v1"), v2.alias("score_v2"), *(parts[k].alias(f"{k}_score") for k in V2_WEIGHTS), F.col("unique_main_ratio").alias("unique_ratio"))


#: What a deck's diagnostics map may hold (fixed values).
DIAGNOSTICS = ("num_staples_injected", "num_novelty_cards", "num_repairs", "num_resamples")
#: The numbers of a score record that go out as a series each (fixed values).
SERIES = (
    "heuristic_score_v1", "heuristic_score_v2", "consistency_score", "synergy_score", "brick_risk_score", "balance_score", "starter_hit_rate", "brick_hand_rate", "unique_main_ratio", "monster_ratio",
    "spell_ratio", "trap_ratio", *DIAGNOSTICS, "constraint_flags_passed", "constraint_flags_total", "error_count",
)


def score_records(decks: DataFrame, entries: DataFrame, embeddings: DataFrame, starters: DataFrame, many: int = 0) -> DataFrame:
    """One record a deck with both scores, what they are made of, and a nested evaluation.

    decks: deck_id, format, status, diagnostics (map of DIAGNOSTICS), flags (map), errors (array); entries: deck_id, zone,
    card_id, copies, is_known and card attributes. The main deck alone is scored. Absent diagnostics, flags and errors are 0;
    decks without cards have records too.
    """
    zero = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v))
    rows = measured(decks, entries, embeddings, starters, many=many)
    count = lambda name: F.coalesce(F.try_element_at("diagnostics", F.lit(name)), F.lit(0)).cast("bigint")
    flags = F.coalesce(F.map_values("flags"), F.array().cast("array<boolean>"))
    rows = rows.withColumns({
        **{n: count(n) for n in DIAGNOSTICS},
        "constraint_flags_passed": F.size(F.filter(flags, lambda x: F.coalesce(x, F.lit(False)))), "constraint_flags_total": F.size(flags), "error_count": F.coalesce(F.size("errors"), F.lit(0)),
        **{c: zero(c) for c in ("consistency_score", "brick_risk_score", "coverage", "hit_rate", "brick_rate")}})
    v1 = 100 + 15 * F.col("num_novelty_cards") + 1.5 * F.col("num_staples_injected") + 12 * F.col("unique_main_ratio") - 30 * F.col("type_ratio_distance_l1")
    v2 = clamp(sum((V2_WEIGHTS[k] * F.col(f"{k}_score") for k in V2_WEIGHTS), F.lit(0.0)))
    named = {"hit_rate": "starter_hit_rate", "brick_rate": "brick_hand_rate", "coverage": "main_embedding_coverage", "mean_pairwise_cosine": "main_avg_pairwise_similarity", "mean_centroid_cosine": "main_centroid_similarity"}
    rows = rows.withColumnsRenamed(named).withColumns({"heuristic_score_v1": v1, "heuristic_score_v2": v2})
    features = ("starter_kinds", "starters", "main_embedding_coverage", "main_avg_pairwise_similarity", "main_centroid_similarity", "type_ratio_distance_l1")
    evaluation = F.struct(
        F.col("heuristic_score_v2").alias("overall_score"), *(F.col(f"{k}_score") for k in V2_WEIGHTS), F.struct(*(F.lit(v).alias(k) for k, v in V2_WEIGHTS.items())).alias("component_weights"),
        F.struct(F.lit(HAND).alias("hand_size"), "starter_hit_rate", "brick_hand_rate").alias("draws"), F.struct(*features).alias("features"))
    names = dict.fromkeys(["deck_id", "format", "status", *SERIES, "main_size", "extra_size", "unique_main_count", *named.values(), "type_ratio_distance_l1"])
    return rows.select(*names, evaluation.alias("evaluation"))


def score_series(records: DataFrame, steps: DataFrame) -> DataFrame:
    """(deck_id, metric, value, step): each of SERIES of each record; steps: deck_id, step."""
    long = records.select("deck_id", *(F.col(c).cast("double").alias(c) for c in SERIES)).unpivot(["deck_id"], list(SERIES), "metric", "value")
    return long.join(grown(steps), "deck_id")


def score_summary(scores: DataFrame) -> DataFrame:
    """Count, mean, population deviation, least and greatest of both scores; zeros for no decks."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in ("score_v1", "score_v2"):
        aggs += [zero(F.avg(c)).alias(f"{c}_mean"), zero(F.stddev_pop(c)).alias(f"{c}_std"), zero(F.min(c)).alias(f"{c}_min"), zero(F.max(c)).alias(f"{c}_max")]
    return scores.agg(*aggs, *(zero(F.avg(f"{k}_score")).alias(f"{k}_mean") for k in V2_WEIGHTS))


def scores_by_format(scores: DataFrame, column: str = "score_v2") -> DataFrame:
    return scores.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
