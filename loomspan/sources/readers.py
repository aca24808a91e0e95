"""Readers: tables by suffix, raw snapshots, and the JSON configurations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_int

#: Settings of a format in its JSON, and their defaults (fixed values).
FORMAT = """struct<main_deck_size: string, deck_size: string, extra_deck_size: string, min_main: string, max_main: string, min_extra: string, max_extra: string, legality_source: string, tcg_release_cutoff: string,
 card_type_ratios: struct<monster: double, spell: double, trap: double, tolerance_count: string>, generation: map<string, string>>"""
DEFAULT_MAIN, DEFAULT_EXTRA, DEFAULT_TOLERANCE = 40, 15, 2
DEFAULT_RATIOS = {"monster": 0.5, "spell": 0.3, "trap": 0.2}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet, csv (with header), json (one document) or jsonl table, by the path's suffix; others are an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(path)
    raise ValueError(f"unsupported table format: {path}")


def latest_snapshot(spark: SparkSession, pattern: str, schema: str, folders: bool = False) -> DataFrame:
    """The rows of the newest file that matches, or of the newest of the matches' folders (ties: the greatest name). No file
    is an error of the reader."""
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(path, "/[^/]*$", "") if folders else path
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_modification_time").alias("_at"), name.alias("_name"))
    newest = rows.groupBy("_name").agg(F.max("_at").alias("_at")).agg(F.max(F.struct("_at", "_name")).alias("m")).select("m._name")
    return rows.join(F.broadcast(newest), "_name", "left_semi").drop("_at", "_name")


def formats(texts: DataFrame, column: str = "json") -> DataFrame:
    """A row of rules for each format of JSON objects {name: settings}, which may stand under the name formats.

    Sizes that are missing or no numbers take their defaults, the bounds those of the sizes; an ISO date in the legality path
    stands in for a missing cutoff. generation holds the settings for drafting by name. A format that is no object, sizes or
    bounds out of order, shares outside 0..1 or of another sum than 1, and a negative tolerance are errors.
    """
    named = F.from_json(column, "struct<formats: map<string, string>>")["formats"]
    raw = texts.select(F.explode(F.coalesce(named, F.from_json(column, "map<string, string>"))).alias("format", "settings"))
    parsed = raw.select("format", F.when(F.startswith("settings", F.lit("{")), F.from_json("settings", FORMAT)).alias("f"))
    f = F.col("f")
    whole = lambda *names: F.coalesce(*(safe_int(f[n]) for n in names)).cast("int")
    out = parsed.withColumns({"main_size": F.coalesce(whole("main_deck_size", "deck_size"), F.lit(DEFAULT_MAIN)), "extra_size": F.coalesce(whole("extra_deck_size"), F.lit(DEFAULT_EXTRA))})
    own = f["card_type_ratios"]
    out = out.select(
        "format", "f", "main_size", F.coalesce(whole("min_main", "main_deck_size"), "main_size").alias("main_min"), F.coalesce(whole("max_main", "main_deck_size"), "main_size").alias("main_max"),
        "extra_size", F.coalesce(whole("min_extra"), F.lit(0)).alias("extra_min"), F.coalesce(whole("max_extra", "extra_deck_size"), "extra_size").alias("extra_max"),
        F.coalesce(f["tcg_release_cutoff"], cutoff_from_path(f["legality_source"])).alias("release_cutoff"), f["legality_source"].alias("legality"),
        *(F.coalesce(own[b], F.lit(share)).alias(b) for b, share in DEFAULT_RATIOS.items()), F.coalesce(safe_int(own["tolerance_count"]).cast("int"), F.lit(DEFAULT_TOLERANCE)).alias("tolerance"), f["generation"].alias("generation"))
    c = F.col
    checks = (
        (f.isNull(), "no object"), ((c("main_min") < 1) | (c("main_min") > c("main_size")) | (c("main_size") > c("main_max")), "main sizes out of order"),
        ((c("extra_min") < 0) | (c("extra_min") > c("extra_size")) | (c("extra_size") > c("extra_max")), "extra sizes out of order"),
        (~(c("monster").between(0, 1) & c("spell").between(0, 1) & c("trap").between(0, 1)) | (F.abs(c("monster") + c("spell") + c("trap") - 1) > 1e-9), "shares do not make 1"), (c("tolerance") < 0, "negative tolerance"))
    fine = F.lit(True)
    for wrong, text in reversed(checks):
        fine = F.when(wrong, F.raise_error(F.concat(F.lit(f"{text}: "), "format")).cast("boolean")).otherwise(fine)
    return out.where(fine).drop("f")


def cutoff_from_path(path):
    return F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def staple_pool(texts: DataFrame, column: str = "json") -> DataFrame:
    """format, card_id, weight, tags from JSON objects {format: [{card_id, weight, tags}]}."""
    kind = "map<string, array<struct<card_id: bigint, weight: double, tags: array<string>>>>"
    return texts.select(F.explode(F.from_json(column, kind)).alias("format", "rows")).select("format", F.inline("rows"))


def sampling_profiles(texts: DataFrame, column: str = "json") -> DataFrame:
    """profile, setting, value (JSON text) from JSON objects {profile: {setting: value}}, which may stand under the name
    sampling_profiles; profiles that are no objects are left out."""
    raw = F.try_parse_json(F.col(column))
    root = F.coalesce(F.try_variant_get(raw, "$.sampling_profiles", "map<string, variant>"), F.try_variant_get(raw, "$", "map<string, variant>"))
    own = texts.select(F.explode(root).alias("profile", "v")).select("profile", F.try_variant_get("v", "$", "map<string, variant>").alias("settings"))
    return own.select("profile", F.explode("settings").alias("setting", "v")).select("profile", "setting", F.to_json("v").alias("value"))


def banlist(texts: DataFrame, column: str = "json") -> DataFrame:
    """card_id, list_name from {forbidden: [], limited: [], semi_limited: []}; anything else is an empty list."""
    names = ("forbidden", "limited", "semi_limited")
    lists = F.from_json(column, "struct<" + ", ".join(f"{n}: array<bigint>" for n in names) + ">")
    rows = F.array(*(F.struct(F.lit(n).alias("list_name"), lists[n].alias("ids")) for n in names))
    return texts.select(F.inline(rows)).select("list_name", F.explode("ids").alias("card_id"))


def list_column(x, kind: str = "array<bigint>"):
    """A list given as JSON text; empty for null or broken text."""
    return F.coalesce(F.from_json(x, kind), F.array().cast(kind))
