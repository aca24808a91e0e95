"""Catalogue: flattening the nested payload, keys, foreign keys, ranges, counts and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import price
from ..schemas import BANS, DIRECT, MISC, PRICES


def payload_cards(raw: DataFrame) -> DataFrame:
    """A row for each card of the payloads. A payload without a data list is an error."""
    checked = raw.select(F.coalesce("data", F.raise_error(F.lit("raw payload has no data list")).cast(raw.schema["data"].dataType)).alias("data"))
    return checked.select(F.inline("data"))


def normalize_cards(cards: DataFrame) -> DataFrame:
    first = F.get("misc_info", F.lit(0))
    misc = [F.array_join(first["formats"], "|").alias("formats") if k == "formats" else first[k].alias(k) for k in MISC]
    direct = [F.coalesce("desc", F.lit("")).alias("desc") if k == "desc" else F.col(f"`{k}`") for k in DIRECT]
    return cards.select(*direct, *misc)


def normalize_images(cards: DataFrame) -> DataFrame:
    return cards.select(F.col("id").alias("card_id"), F.inline("card_images").alias("image_id", "image_url", "image_url_small", "image_url_cropped"))


def normalize_sets(cards: DataFrame) -> DataFrame:
    return cards.select(F.col("id").alias("card_id"), F.inline("card_sets")).withColumn("set_price", F.col("set_price").cast("double"))


def normalize_prices(cards: DataFrame) -> DataFrame:
    rows = cards.select(F.col("id").alias("card_id"), F.inline("card_prices"))
    return rows.select("card_id", *(price(F.col(k)).alias(k) for k in PRICES))


def normalize_archetypes(cards: DataFrame) -> DataFrame:
    return cards.where(F.coalesce("archetype", F.lit("")) != "").select(F.col("id").alias("card_id"), "archetype")


def normalize_banlist(cards: DataFrame) -> DataFrame:
    return cards.where(F.col("banlist_info").isNotNull()).select(F.col("id").alias("card_id"), *(F.col(f"banlist_info.{k}") for k in BANS))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in a total order."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_nth") == 1).drop("_nth")


def orphans(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """child, orphans: how many rows of each child table have no parent."""
    out = None
    for name, (child, column) in children.items():
        lost = child.select(F.col(column).alias("k")).join(parent.select(F.col(key).alias("k")), "k", "left_anti")
        row = lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("child"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def range_check(df: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """column_name, min_value, max_value, in_range: one pass over the table."""
    seen = df.agg(*(F.struct(F.min(c).cast("bigint").alias("lo"), F.max(c).cast("bigint").alias("hi")).alias(c) for c in limits))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c)["lo"].alias("min_value"), F.col(c)["hi"].alias("max_value"), (F.coalesce(F.col(c)["lo"] >= lo, F.lit(True)) & F.coalesce(F.col(c)["hi"] <= hi, F.lit(True))).alias("in_range")) for c, (lo, hi) in limits.items()))
    return seen.select(F.inline(rows))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlay(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources, the last source's for each key, with source_no."""
    stacked = None
    for i, df in enumerate(sources):
        own = df.withColumn("source_no", F.lit(i))
        stacked = own if stacked is None else stacked.unionByName(own)
    return first_per_key(stacked, [key], [F.desc("source_no")])


def overlay_report(sources: list[DataFrame], key: str) -> DataFrame:
    """source_no, n_new, n_replaced: a key is new in its first source and replaced in each later one."""
    stacked = None
    for i, df in enumerate(sources):
        own = df.select(key, F.lit(i).alias("source_no")).distinct()
        stacked = own if stacked is None else stacked.unionByName(own)
    ranked = stacked.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("source_no")))
    return ranked.groupBy("source_no").agg(F.count_if(F.col("nth") == 1).alias("n_new"), F.count_if(F.col("nth") > 1).alias("n_replaced"))
