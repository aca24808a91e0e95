"""Labels of clusters that come as JSON texts from elsewhere, beside the heuristics that stand in for those of no use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles that a label may name (fixed values).
ROLES = ("starter", "extender", "searcher", "draw", "removal", "negation", "board_breaker", "floodgate", "graveyard_setup", "graveyard_hate", "recursion", "protection", "burn", "battle_trick", "archetype_core", "misc")
HINT_LENGTH, REASONING_LENGTH = 120, 400
ANSWERED, FALLBACK = 0.5, 0.55
LABEL = ("functional_role", "label_hint", "label_confidence", "reasoning", "label_source")


def heuristic_label(role: Column) -> dict[str, Column]:
    source = F.concat(F.lit("heuristic:"), role)
    return dict(zip(LABEL, (role, F.translate(role, "_", " "), F.lit(FALLBACK), source, source)))


def ingest_labels(answers: DataFrame, raw: str, heuristics: DataFrame) -> DataFrame:
    """The answers' columns without the text, LABEL, and failure: why a text was refused, or empty.

    A text holds an object, or a list whose first entry is one; its `result` counts in its place where that is an object. A role
    outside ROLES is misc, a hint not given is the role, a confidence not given ANSWERED; blanks at the ends go, then hints and
    reasoning are cut. JSON nulls count as not given. Refused texts, null ones too, get the label of their cluster's heuristic
    role (heuristics: cluster_id, functional_role, a row a cluster; misc for clusters without one).
    """
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    inner = lambda v, path: F.try_variant_get(v, path, "variant")
    kept = [c for c in answers.columns if c != raw]
    rows = answers.withColumn("_v", F.try_parse_json(F.col(raw)))
    is_list = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("ARRAY"), F.lit(False))
    rows = rows.withColumn("_list", is_list).withColumn("_body", F.when(F.col("_list"), inner(F.col("_v"), "$[0]")).otherwise(F.col("_v")))
    failure = F.when(F.col("_v").isNull(), "not_json").when(F.col("_list") & F.col("_body").isNull(), "empty_list").when(~is_object(F.col("_body")), F.when(F.col("_list"), "list_without_object").otherwise("no_object"))
    rows = rows.withColumn("_failure", failure).withColumn("_body", F.when(is_object(inner(F.col("_body"), "$.result")), inner(F.col("_body"), "$.result")).otherwise(F.col("_body")))
    given = lambda name, kind="string": F.try_variant_get(F.col("_body"), f"$.{name}", kind)
    text = lambda name: F.btrim(given(name), F.lit(" \t\n\r\f\v"))
    rows = rows.withColumn("_failure", F.coalesce("_failure", F.when(given("label_confidence").isNotNull() & given("label_confidence", "double").isNull(), "bad_confidence")))
    role = F.lower(text("functional_role"))
    role = F.when(role.isin(*ROLES), role).otherwise("misc")
    answer = dict(zip(LABEL, (role, F.substring(F.coalesce(text("label_hint"), role), 1, HINT_LENGTH), F.coalesce(given("label_confidence", "double"), F.lit(ANSWERED)), F.substring(F.coalesce(text("reasoning"), F.lit("")), 1, REASONING_LENGTH), F.lit("answer"))))
    rows = rows.join(heuristics.select("cluster_id", F.col("functional_role").alias("_role")), "cluster_id", "left")
    fallback = heuristic_label(F.coalesce("_role", F.lit("misc")))
    good = F.col("_failure").isNull()
    return rows.select(*kept, *(F.when(good, answer[c]).otherwise(fallback[c]).alias(c) for c in LABEL), F.coalesce("_failure", F.lit("")).alias("failure"))
