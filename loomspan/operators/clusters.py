"""Analytics over cluster assignments (card_id, cluster_id, prob, embedding); cluster -1 is noise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, doubles, norm, unit
from .blocks import beside
from .labels import LABEL, heuristic_label

NOISE = -1
#: Cluster roles by token, the first that occurs (fixed values).
ROLE_TOKENS = (
    ("searcher", ("add from deck",)), ("draw", ("draw",)), ("removal", ("destroy", "banish", "target")), ("negation", ("negate",)),
    ("graveyard_setup", ("gy", "graveyard", "send")), ("floodgate", ("cannot activate", "cannot summon")),
)
GENERIC = ("generic", "none", "unknown", "other", "misc")


@dataclass(frozen=True)
class ScoreWeights:
    clusters: float = 0.40
    noise: float = 0.25
    largest: float = 0.15
    tiny: float = 0.10
    chance: float = 0.10
    few_clusters: int = 50
    much_noise: float = 0.30
    purity: float = 0.10
    coherence: float = 0.20
    confidence: float = 0.05
    balance: float = 0.10


def clustered(assign: DataFrame) -> DataFrame:
    return assign.where(F.col("cluster_id") != NOISE)


def cluster_metrics(assign: DataFrame, run: list[str] | None = None) -> DataFrame:
    """One row for each run: counts, noise, sizes, shares; runs that are all noise have zeros."""
    run = run or []
    sizes = assign.groupBy(*run, "cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum("prob").alias("chance"))
    own = F.col("cluster_id") != NOISE
    size = F.when(own, F.col("size"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    total = F.sum("size")
    return sizes.groupBy(*run).agg(
        F.count_if(own).alias("num_clusters"), F.coalesce(F.sum(F.when(~own, F.col("size"))), F.lit(0)).alias("noise_count"), zero(F.sum(F.when(~own, F.col("size"))) / total).alias("noise_ratio"),
        F.coalesce(F.min(size), F.lit(0)).alias("size_min"), F.coalesce(F.max(size), F.lit(0)).alias("size_max"), zero(F.avg(size)).alias("size_mean"), zero(F.median(size)).alias("size_median"),
        zero(F.max(size) / total).alias("largest_ratio"), zero(F.sum(F.when(own & (F.col("size") <= 3), F.col("size"))) / total).alias("tiny_ratio"),
        zero(F.sum(F.when(own, F.col("chance"))) / F.sum(size)).alias("mean_prob"), F.to_json(F.slice(F.sort_array(F.collect_list(size), False), 1, 10)).alias("top_sizes"))


def top_values(rows: DataFrame, group: list[str], value: Column, n: int) -> DataFrame:
    """group, value, n: the n most frequent values of each group, ties to the lesser value."""
    counts = rows.groupBy(*group, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("nth") <= n)


def as_map(top: DataFrame, group: list[str], name: str) -> DataFrame:
    """The counts of each group as one JSON object, the most frequent value first."""
    return top.groupBy(*group).agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value", "n"))), lambda x: F.struct(x["value"], x["n"])))).alias(name))


def terms(rows: DataFrame, group: list[str], text: str, n: int = 20) -> DataFrame:
    """The n most frequent words (letters, digits, _) of over two characters, taken from the text and then lower-cased."""
    words = rows.select(*group, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0))).alias("word"))
    return top_values(words.where(F.length("word") > 2), group, F.lower("word"), n)


def centroids(assign: DataFrame, vectors: Column | None = None, run: list[str] | None = None) -> DataFrame:
    """cluster_id, centroid: mean vector of each cluster but noise."""
    key = [*(run or []), "cluster_id"]
    own = clustered(assign).select(*key, array_to_vector(doubles(F.col("embedding")) if vectors is None else vectors).alias("x"))
    return own.groupBy(*key).agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("centroid"))  # combines on the map side


def with_centroids(assign: DataFrame) -> DataFrame:
    return clustered(assign).join(centroids(assign), "cluster_id").withColumn("d", distance(doubles(F.col("embedding")), F.col("centroid")))


def medoids(assign: DataFrame) -> DataFrame:
    return with_centroids(assign).groupBy("cluster_id").agg(F.min(F.struct("d", "card_id")).alias("best")).select("cluster_id", F.col("best.card_id").alias("medoid_card_id"), F.col("best.d").alias("medoid_distance"))


def quality(assign: DataFrame) -> DataFrame:
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("d")))
    return with_centroids(assign).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("prob").alias("mean_prob"), F.avg(1 - F.col("prob")).alias("mean_outlier"), F.avg(near).alias("avg_similarity"))


def coherence(assign: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Mean cosine to the mean of the unit vectors, cut to [-1, 1]; clusters of one, or with a zero mean, have 0."""
    key = [*(run or []), "cluster_id"]
    x = array_to_vector(unit(doubles(F.col("embedding"))))
    means = clustered(assign).select(*key, x.alias("x")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("x"))).alias("centroid"))
    # the mean of the cosines is the mean's dot product with its own direction, which is its length: no vector meets its mean
    return means.select(*key, F.when(F.col("n") > 1, F.least(F.lit(1.0), norm(F.col("centroid")))).otherwise(0.0).alias("coherence"))


def nearest_clusters(assign: DataFrame) -> DataFrame:
    """For noise cards the nearest normalised centroid by Euclidean distance (ties to the lesser id) and 1 / (1 + distance)."""
    units = assign.withColumn("u", unit(doubles(F.col("embedding"))))
    means = centroids(units.withColumn("embedding", F.col("u")), F.col("embedding")).select("cluster_id", unit(F.col("centroid")).alias("centroid"))
    noise, blocks = beside(units.where(F.col("cluster_id") == NOISE).select("card_id", "u"), means, F.struct("cluster_id", "centroid"), "all")
    best = F.array_min(F.transform("all", lambda c: F.struct(distance(F.col("u"), c["centroid"]).alias("d"), c["cluster_id"].alias("id"))))
    found = noise.select("card_id", best.alias("best"))
    found = found if blocks == 1 else found.groupBy("card_id").agg(F.min("best").alias("best"))
    return assign.select("card_id", "cluster_id").join(found, "card_id", "left").select(
        "card_id", "cluster_id", F.col("best.id").alias("nearest_cluster_id"), F.col("best.d").alias("nearest_distance"), (1 / (1 + F.col("best.d"))).alias("nearest_confidence"))


def cluster_roles(rows: DataFrame, text: str = "descr") -> DataFrame:
    """cluster_id, functional_role: the first role one of whose tokens some card of the cluster has, else misc."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = [F.bool_or(F.greatest(*(low.contains(t) for t in tokens)) if len(tokens) > 1 else low.contains(tokens[0])).alias(role) for role, tokens in ROLE_TOKENS]
    case = F.lit("misc")
    for role, _ in reversed(ROLE_TOKENS):
        case = F.when(F.col(role), role).otherwise(case)
    return rows.groupBy("cluster_id").agg(*flags).select("cluster_id", case.alias("functional_role"))


def noise_summary(assign: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: noise cards, their share, and as JSON their ten commonest types and archetypes and the 15 clusters that most of
    them are nearest to; without noise the objects are empty. Arguments as for metadata_records."""
    noise = F.col("cluster_id") == NOISE
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    values = rows.where(noise).select(F.inline(F.array(*(named(k, F.coalesce(k, F.lit("unknown"))) for k in ("type", "archetype")))))
    near = nearest_clusters(assign).where("nearest_cluster_id is not null").select(named("nearest", F.col("nearest_cluster_id").cast("string")).alias("x")).select("x.*")
    top = top_values(values.unionByName(near), ["kind"], F.col("value"), 15).where((F.col("kind") == "nearest") | (F.col("nth") <= 10))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("counts"))), F.lit("{}"))
    counts = as_map(top, ["kind"], "counts").agg(of("type").alias("types"), of("archetype").alias("archetypes"), of("nearest").alias("nearest_clusters"))
    return assign.agg(F.count_if(noise).alias("noise_cards"), (F.count_if(noise) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("noise_ratio")).join(counts)  # one row each


def metadata_records(assign: DataFrame, rows: DataFrame, text: str = "descr", labels: DataFrame | None = None) -> DataFrame:
    """A record for each cluster, noise included: size, label, review status, medoid, and a struct of ten representative
    cards, frequent terms, types and archetypes, quality, reasoning, and for the noise its summary.

    assign: card_id, cluster_id, prob, embedding; rows: assign with the cards' name, type, archetype and text; labels:
    cluster_id and LABEL, as ingest_labels gives them, at most a row a cluster. Clusters without one, and the noise, are
    labelled by their role.
    """
    every = assign.withColumn("cluster_id", F.col("cluster_id") + 1 - NOISE)  # the noise is described like any cluster
    own = rows.withColumn("cluster_id", F.col("cluster_id") + 1 - NOISE)
    key = ["cluster_id"]
    spread = lambda c, name: as_map(top_values(own, key, F.coalesce(c, F.lit("unknown")), 15), key, name)
    words = terms(own, key, text, 20).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("top_terms"))
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("card_id"))).where("nth <= 10")
    cards = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("card_id", F.col("name").alias("card_name")))).alias("representative_cards"))
    out = quality(every).join(medoids(every).select("cluster_id", "medoid_card_id"), key).join(cluster_roles(own, text), key).join(spread("type", "type_distribution"), key).join(spread("archetype", "archetype_distribution"), key)
    out = out.join(words, key, "left").join(cards, key)
    is_noise = F.col("cluster_id") == 1
    own_label = F.struct(*(c.alias(n) for n, c in heuristic_label(F.col("functional_role")).items()))
    if labels is None:
        label = own_label
    else:
        out = out.join(labels.select((F.col("cluster_id") + 1 - NOISE).alias("cluster_id"), F.struct(*LABEL).alias("_label")), key, "left")
        label = F.when(is_noise | F.col("_label").isNull(), own_label).otherwise(F.col("_label"))
    summary = noise_summary(assign, rows)
    out = out.withColumn("label", label).join(F.broadcast(summary.select(F.lit(1).cast(out.schema["cluster_id"].dataType).alias("cluster_id"), F.struct(*summary.columns).alias("noise_summary"))), key, "left")
    found = F.struct(
        "representative_cards", F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"), "type_distribution", "archetype_distribution", F.struct("mean_prob", "mean_outlier", "avg_similarity").alias("quality_metrics"),
        F.col("label.reasoning").alias("reasoning"), is_noise.alias("noise_cluster"), "noise_summary")
    return out.select(
        (F.col("cluster_id") - 1 + NOISE).alias("cluster_id"), F.col("size").alias("cluster_size"), *(F.col("label")[c].alias(c) for c in LABEL if c != "reasoning"), F.lit("unreviewed").alias("review_status"), "medoid_card_id", found.alias("metadata"))


def structural_score(metrics: DataFrame, w: ScoreWeights = ScoreWeights()) -> DataFrame:
    score = w.clusters * F.least(F.col("num_clusters") / 100.0, F.lit(1.0)) - w.noise * F.col("noise_ratio") - w.largest * F.col("largest_ratio") - w.tiny * F.col("tiny_ratio") + w.chance * F.col("mean_prob")
    score = score - F.when(F.col("num_clusters") < w.few_clusters, 1.0).otherwise(0.0) - F.when(F.col("noise_ratio") > w.much_noise, 1.0).otherwise(0.0)
    return metrics.withColumn("structural_score", score)


def semantic_metrics(assign: DataFrame, attrs: DataFrame, run: list[str] | None = None) -> DataFrame:
    """purity (mean share of each cluster's commonest archetype), coherence, label_confidence, balance, a row for each run.

    A cluster is generic-heavy if at least 0.6 of it has a generic archetype, archetype-heavy if at least 0.6 has none;
    balance is 1 less the difference of the two kinds' shares. Without clusters: 0, 0, 0 and 0.5.
    """
    run = run or []
    key = [*run, "cluster_id"]
    rows = clustered(assign).join(attrs.select(F.col("id").alias("card_id"), "archetype"), "card_id", "left").withColumn("a", F.coalesce("archetype", F.lit("unknown")))
    counts = rows.groupBy(*key, "a").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("conf"))
    generic = F.sum(F.when(F.lower("a").isin(*GENERIC), F.col("n")).otherwise(0)) / F.sum("n")
    per = counts.groupBy(*key).agg((F.max("n") / F.sum("n")).alias("purity"), generic.alias("generic"), F.sum("n").alias("n"), F.sum("conf").alias("conf"))
    out = per.join(coherence(assign, run), key, "left").groupBy(*run).agg(
        F.count(F.lit(1)).alias("k"), F.avg("purity").alias("purity"), F.avg("coherence").alias("coherence"), (F.sum("conf") / F.sum("n")).alias("label_confidence"),
        F.avg((F.col("generic") >= 0.6).cast("double")).alias("g"), F.avg((1 - F.col("generic") >= 0.6).cast("double")).alias("h"))
    if run:  # a run that is all noise has a row too
        out = assign.select(*run).distinct().join(out, run, "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("purity", "coherence", "label_confidence")]
    return out.select(*run, *zero, F.when(F.coalesce("k", F.lit(0)) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("g") - F.col("h")))).alias("balance"))


def semantic_score(m: DataFrame, w: ScoreWeights = ScoreWeights()) -> DataFrame:
    p = F.col("purity")
    part = F.greatest(F.lit(0.0), 1 - F.abs(p - 0.65) / 0.65) - F.when(p > 0.9, 2 * (p - 0.9)).otherwise(0.0)
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return m.withColumn("semantic_score", w.purity * part + w.coherence * cut("coherence") + w.confidence * cut("label_confidence") + w.balance * cut("balance"))


def guardrails(m: DataFrame, few: int = 50, noise: float = 0.30, largest: float = 0.25, tiny: float = 0.20) -> DataFrame:
    """Flags of a run (strict) and whether it is good; a run exactly on a threshold is neither flagged nor, for noise and the largest share, good."""
    return m.withColumns({
        "too_few_clusters": F.col("num_clusters") < few, "too_much_noise": F.col("noise_ratio") > noise, "too_large_cluster": F.col("largest_ratio") > largest, "too_many_tiny": F.col("tiny_ratio") > tiny,
        "is_good_run": (F.col("noise_ratio") < noise) & (F.col("num_clusters") >= few) & (F.col("largest_ratio") < largest)})
