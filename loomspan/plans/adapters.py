"""Views of the given tables as cards, decks, deck entries and cluster assignments, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARDS = """
select p_partkey id, p_name name,
 case p_type when 'STANDARD' then 'Effect Monster' when 'ECONOMY' then 'Normal Monster' when 'SMALL' then 'Tuner Effect Monster'
   when 'MEDIUM' then 'Spell Card' when 'LARGE' then 'Trap Card' else case p_size % 4 when 0 then 'Fusion Monster'
   when 1 then 'Synchro Tuner Monster' when 2 then 'XYZ Monster' else 'Link Effect Monster' end end as type,
 case p_partkey % 8 when 0 then 'Add 1 card from your Deck to your hand.' when 1 then 'Special Summon this card.'
   when 2 then 'Negate the activation; then banish it.' when 3 then 'Draw 2 cards.' when 4 then '1 tuner + 1 or more non-tuner monsters'
   when 5 then '2 dark monsters' when 6 then 'Send 1 card to the GY.' else 'A plain card.' end as descr,
 p_brand race, case when p_partkey % 5 = 0 then null else p_brand end archetype, p_size % 12 + 1 as level,
 cast(p_size*60-100 as bigint) atk, cast(p_size*50-100 as bigint) def,
 case p_partkey % 3 when 0 then 'DARK' when 1 then 'LIGHT' else 'EARTH' end attribute,
 case when p_partkey % 7 = 0 then p_partkey % 13 end scale,
 case when p_partkey % 11 = 0 then null else concat(cast(2000 + p_partkey % 15 as varchar(4)),'-03-01') end tcg_date from {part}
"""
ENTRIES = "select l_orderkey deck_id, l_partkey card_id, cast(sum(1 + l_linenumber % 3) as bigint) copies from {lineitem} group by l_orderkey, l_partkey"
DECKS = """
select o_orderkey deck_id, case o_orderpriority when '1-URGENT' then 'GOAT' when '2-HIGH' then 'HAT' when '3-MEDIUM' then 'Edison'
   when '5-LOW' then 'Advanced' end format, case o_orderstatus when 'F' then 'accepted' else 'rejected' end status from {orders}
"""
ASSIGN = "select vec_id card_id, case when label = 0 then -1 else label end cluster_id, cast((vec_id % 100)/100.0 as double) prob, embedding from {embeddings}"

VIEWS = {"cards": (CARDS, "part"), "entries": (ENTRIES, "lineitem"), "decks": (DECKS, "orders"), "assign": (ASSIGN, "embeddings")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    """A view of its table, or of these rows of it, which may be dealt in another way."""
    sql, source = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source) if rows is None else rows})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views of these names in front."""
    parts = ", ".join(f"{n} as ({VIEWS[n][0].format(**{VIEWS[n][1]: VIEWS[n][1]})})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {parts}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {parts}, {body[5:]}"
    return f"with {parts} {body}"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, for comparison across engines."""
    return df.select(*((F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
