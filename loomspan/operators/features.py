"""Card features: flags, rule-based role tags, hashing embeddings, key-value documents and vector batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import combat_stat, has_type, is_extra, safe_int
from ..shared import saved


@dataclass(frozen=True)
class RoleRule:
    role: str
    confidence: float
    source: str
    words: tuple[str, ...] = ()


#: Rules on a card's text (fixed values); the stat rules follow below.
TEXT_RULES = (
    RoleRule("searcher", 0.9, "desc_keyword:search", ("add", "search", "from your deck")),
    RoleRule("starter", 0.75, "desc_keyword:starter", ("add", "search", "from your deck")),
    RoleRule("extender", 0.8, "desc_keyword:summon", ("special summon", "summon")),
    RoleRule("interruption", 0.8, "desc_keyword:interaction", ("negate", "banish", "destroy", "cannot")),
)
BRICK_ATTACK, LOW_STAT = 2500, 500


def card_features(cards: DataFrame) -> DataFrame:
    kind = F.col("type")
    return cards.select(
        F.col("id").alias("card_id"), "name", "type", "race", "archetype", combat_stat(F.col("atk")).alias("atk"), combat_stat(F.col("def")).alias("def"),
        has_type(kind, "effect").alias("is_effect_monster"), is_extra(kind).alias("is_extra_deck"), has_type(kind, "spell").alias("is_spell"), has_type(kind, "trap").alias("is_trap"))


def role_tags(cards: DataFrame, text: str = "descr", rules: tuple[RoleRule, ...] = TEXT_RULES) -> DataFrame:
    """card_id, role_tag, confidence, rule_source: of each role the rule with the greatest confidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    monster, atk, defence = has_type(F.col("type"), "monster"), safe_int(F.col("atk")), safe_int(F.col("def"))

    def row(hit: Column, role: str, confidence: float, source: str) -> Column:
        return F.when(hit, F.struct(F.lit(role).alias("role_tag"), F.lit(confidence).alias("confidence"), F.lit(source).alias("rule_source")))

    tests = []
    for rule in rules:
        hit = F.lit(False)
        for word in rule.words:
            hit = hit | low.contains(word)
        tests.append(row(hit, rule.role, rule.confidence, rule.source))
    tests.append(row(monster & (atk >= BRICK_ATTACK), "brick", 0.55, "stat_high_attack"))
    tests.append(row(monster & (atk <= LOW_STAT) & (defence <= LOW_STAT), "starter", 0.5, "stat_low_stats"))
    tags = cards.select(F.col("id").alias("card_id"), F.inline(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    best = tags.groupBy("card_id", "role_tag").agg(F.max(F.struct("confidence", "rule_source")).alias("best"))
    return best.select("card_id", "role_tag", "best.confidence", "best.rule_source")


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """key, embedding: counts of the text's words in `dim` hashed buckets, scaled to length 1; no words: all zeros. A row
    for each key; texts under one key are counted together."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % dim
    counts = rows.select(key, F.explode_outer(words).alias("word")).groupBy(key, bucket.alias("bucket")).agg(F.count("word").cast("double").alias("n"))
    filled = F.array_sort(F.filter(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n"))), lambda x: x.isNotNull()))
    packed = counts.groupBy(key).agg(filled.alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    bucket_at = lambda i: F.get("m", i)["bucket"]
    # each bucket with the empty ones before it, then the rest
    filled_runs = F.transform("m", lambda x, i: F.concat(zeros(x["bucket"] - 1 - F.coalesce(bucket_at(i - 1), F.lit(-1))), F.array(x["n"] / F.col("size"))))
    rest = zeros(dim - 1 - F.coalesce(bucket_at(F.size("m") - 1), F.lit(-1)))
    return packed.select(key, F.flatten(F.concat(filled_runs, F.array(rest))).alias("embedding"))


def kv_documents(features: DataFrame, roles: DataFrame) -> DataFrame:
    """(key, value): a JSON document of features and one of roles for each card."""
    own = features.select(F.concat(F.lit("card:features:"), F.col("card_id")).alias("key"), F.to_json(F.struct("card_id", "name", "type", "race", "archetype", "atk", "def", "is_effect_monster", "is_extra_deck", "is_spell", "is_trap")).alias("value"))
    tags = roles.groupBy("card_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("role_tag", "confidence")))).alias("value"))
    return own.unionByName(tags.select(F.concat(F.lit("card:roles:"), F.col("card_id")).alias("key"), "value"))


def numbered(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in a global order, without a window over the whole table: ranges by key, and the ranges' counts.

    The ranges are written before they are read twice, as a plan that runs again may cut them elsewhere.
    """
    ranged = saved(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    below = counts.withColumn("_below", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(below.select("_part", "_below")), "_part").withColumn(name, F.col("_below") + F.col("_nth")).drop("_part", "_nth", "_below")


def vector_batches(vectors: DataFrame, key: str, size: int = 500) -> DataFrame:
    """batch_id, id, a JSON payload and the vector, in batches of `size` by id."""
    return numbered(vectors, key).select((F.col("row_no") / size).cast("bigint").alias("batch_id"), F.col(key).alias("id"), F.to_json(F.struct(F.col(key).alias("id"), "cluster_id")).alias("payload"), F.col("embedding").alias("vector"))
