"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_extra, safe_int, sampling_bucket, scoring_bucket
from ..operators import catalog
from ..schemas import CARD
from .adapters import rounded, table, view, with_views

S = SparkSession


def raw_cards(spark: S, d: str) -> DataFrame:
    """A raw payload made of part and lineitem: nested JSON text, parsed again with the payload's schema."""
    sets = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("SET-"), F.col("l_returnflag")).alias("set_name"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("set_code"), F.col("l_linestatus").alias("set_rarity"),
        F.concat(F.lit("("), F.col("l_linestatus"), F.lit(")")).alias("set_rarity_code"), F.col("l_quantity").cast("string").alias("set_price")))).alias("card_sets"))
    cards = view(spark, d, "cards").join(sets, F.col("id") == F.col("l_partkey"), "left")
    text = lambda x: F.concat(F.lit("https://images.example/"), F.lit(x), F.col("id").cast("string"))
    nested = cards.select(
        "id", "name", "type", F.when(F.col("id") % 9 != 0, F.col("descr")).alias("desc"), "race", "archetype", "atk", "def", F.col("level").cast("bigint").alias("level"), "attribute", F.col("scale").cast("bigint").alias("scale"), "card_sets",
        F.when(F.col("id") % 6 != 0, F.array(F.struct(
            F.when(F.col("id") % 4 != 0, F.array(F.lit("TCG"), F.col("race"))).alias("formats"), (F.col("id") * 3).alias("views"), "tcg_date", (F.col("id") % 2).alias("has_effect")))).alias("misc_info"),
        F.array(F.struct(F.col("id").alias("id"), text("full/").alias("image_url"), text("small/").alias("image_url_small"), text("cropped/").alias("image_url_cropped"))).alias("card_images"),
        F.array(F.struct(F.when(F.col("id") % 3 == 0, "").otherwise((F.col("id") / 4).cast("string")).alias("cardmarket_price"), F.lit("0.25").alias("ebay_price"))).alias("card_prices"),
        F.when(F.col("id") % 10 == 0, F.struct(F.lit("Forbidden").alias("ban_tcg"), F.when(F.col("id") % 20 == 0, "Limited").alias("ban_goat"))).alias("banlist_info"))
    card = "struct<" + ", ".join(f"`{k}`: {v}" for k, v in CARD.items()) + ">"
    return nested.select(F.from_json(F.to_json(F.struct("*")), card).alias("card")).select(F.array("card").alias("data"))


def cards_of(spark: S, d: str) -> DataFrame:
    return catalog.payload_cards(raw_cards(spark, d))


def raw_payload_explode(spark: S, d: str) -> DataFrame:
    return cards_of(spark, d).select("id", "name", "type", F.coalesce(F.size("card_sets"), F.lit(0)).alias("n_sets")).withColumn("n_sets", F.greatest("n_sets", F.lit(0)))


def normalize_cards(spark: S, d: str) -> DataFrame:
    return catalog.normalize_cards(cards_of(spark, d)).select("id", "name", "type", "desc", "race", "archetype", "atk", "def", "level", "attribute", "scale", "linkval", "views", "formats", "tcg_date", "has_effect", "md_rarity")


def normalize_sets(spark: S, d: str) -> DataFrame:
    return catalog.normalize_sets(cards_of(spark, d))


def normalize_prices(spark: S, d: str) -> DataFrame:
    return catalog.normalize_prices(cards_of(spark, d)).select("card_id", "cardmarket_price", "tcgplayer_price", "ebay_price")


def normalize_images(spark: S, d: str) -> DataFrame:
    return catalog.normalize_images(cards_of(spark, d))


def normalize_archetypes(spark: S, d: str) -> DataFrame:
    return catalog.normalize_archetypes(cards_of(spark, d))


def normalize_banlist(spark: S, d: str) -> DataFrame:
    return catalog.normalize_banlist(cards_of(spark, d))


def safe_int_query(spark: S, d: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", safe_int(x).alias("whole"))


def candidate_pool(spark: S, d: str) -> DataFrame:
    kind = F.col("type")
    low = F.lower(F.coalesce(kind, F.lit("")))
    return view(spark, d, "cards").where(F.col("id").isNotNull()).select(
        "id", (~is_extra(kind) & ~low.contains("token")).alias("in_main"), is_extra(kind).alias("in_extra"), low.contains("monster").alias("is_monster"), (low.contains("monster") & low.contains("effect")).alias("is_effect"),
        low.contains("tuner").alias("is_tuner"), (low.contains("monster") & ~low.contains("tuner")).alias("is_non_tuner"), low.contains("pendulum").alias("is_pendulum"))


def type_bucket(spark: S, d: str) -> DataFrame:
    return view(spark, d, "cards").select("id", sampling_bucket(F.col("type")).alias("sampling"), scoring_bucket(F.col("type")).alias("scoring"))


def release_cutoff(spark: S, d: str) -> DataFrame:
    return catalog_cutoff(view(spark, d, "cards"), "2008-12-31").select("id", "tcg_date")


def catalog_cutoff(cards: DataFrame, cutoff: str | None) -> DataFrame:
    """Cards released by the cutoff. None or an unreadable cutoff keeps all; no date column keeps none; unreadable dates go."""
    import datetime

    try:
        day = datetime.date.fromisoformat(cutoff) if cutoff else None
    except ValueError:
        day = None
    if day is None:
        return cards
    if "tcg_date" not in cards.columns:
        return cards.limit(0)
    return cards.where(F.expr("try_to_date(tcg_date, 'yyyy-MM-dd')") <= F.lit(day))


def cutoff_counts(spark: S, d: str) -> DataFrame:
    """Cards kept and dropped by cutoffs: one that is a date, one that is not, and none."""
    cards = view(spark, d, "cards")
    every = cards.agg(F.count(F.lit(1)).alias("n"))
    parts = [catalog_cutoff(cards, c).agg(F.count(F.lit(1)).alias("kept")).join(every).select(F.lit(str(c)).alias("cutoff"), "kept", (F.col("n") - F.col("kept")).alias("dropped")) for c in ("2008-12-31", "soon", None)]  # one row each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fk_orphans(spark: S, d: str) -> DataFrame:
    """Deck entries and cluster assignments whose card is none of the cards, and labels without their document."""
    found = catalog.orphans(table(spark, d, "part"), "p_partkey", {"lineitem": (table(spark, d, "lineitem"), "l_partkey"), "embeddings": (table(spark, d, "embeddings"), "vec_id")})
    return found.unionByName(catalog.orphans(table(spark, d, "documents"), "doc_id", {"labels": (table(spark, d, "labels"), "doc_id")}))


def row_counts(spark: S, d: str) -> DataFrame:
    return catalog.row_counts({t: table(spark, d, t) for t in ("part", "orders", "lineitem", "customer")})


def range_check(spark: S, d: str) -> DataFrame:
    return catalog.range_check(table(spark, d, "lineitem"), {"l_orderkey": (-(1 << 31), (1 << 31) - 1), "l_partkey": (0, 1000), "l_linenumber": (0, 32767)})


def duplicate_keys(spark: S, d: str) -> DataFrame:
    return catalog.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def dedupe_pk(spark: S, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return catalog.first_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


def _sources(spark: S, d: str) -> list[DataFrame]:
    part = table(spark, d, "part")
    return [part.where(f"p_partkey % 3 <> {k}").select("p_partkey", F.concat(F.lit(f"v{k} "), "p_name").alias("name")) for k in range(3)]


def overlay_merge(spark: S, d: str) -> DataFrame:
    return catalog.overlay(_sources(spark, d), "p_partkey")


def overlay_report(spark: S, d: str) -> DataFrame:
    return catalog.overlay_report(_sources(spark, d), "p_partkey")


def allowlist_ids(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_partkey") - 50).alias("id")).where("id > 0").distinct()


def allowlist_filter(spark: S, d: str) -> DataFrame:
    allowed = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return view(spark, d, "cards").join(allowed, "id", "left_semi").select("id", "name")


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (raw_payload_explode, normalize_cards, normalize_sets, normalize_prices, normalize_images, normalize_archetypes, normalize_banlist, safe_int_query, candidate_pool, type_bucket, release_cutoff, cutoff_counts, fk_orphans, row_counts, range_check, duplicate_keys, dedupe_pk, overlay_merge, overlay_report, allowlist_ids, allowlist_filter)
}
QUERIES["normalize_prices"] = lambda s, d: rounded(normalize_prices(s, d))

ORACLE_SQL = {
    "raw_payload_explode": with_views("select id, name, type, cast(count(l_partkey) as integer) n_sets from cards left join lineitem on l_partkey = id group by id, name, type", "cards"),
    "normalize_cards": with_views(
        """select id, name, type, case when id % 9 <> 0 then descr else '' end "desc", race, archetype, atk, def, cast(level as bigint) as level, attribute, cast(scale as bigint) scale, cast(null as bigint) linkval,
           case when id % 6 <> 0 then id * 3 end views, case when id % 6 <> 0 and id % 4 <> 0 then concat('TCG|', race) end formats, case when id % 6 <> 0 then tcg_date end tcg_date,
           case when id % 6 <> 0 then id % 2 end has_effect, cast(null as varchar) md_rarity from cards""", "cards"),
    "normalize_sets": "select l_partkey card_id, 'SET-' || l_returnflag set_name, l_orderkey || '-' || l_linenumber set_code, l_linestatus set_rarity, '(' || l_linestatus || ')' set_rarity_code, l_quantity set_price from lineitem where l_partkey in (select p_partkey from part)",
    "normalize_prices": "select p_partkey card_id, case when p_partkey % 3 = 0 then null else round(p_partkey / 4.0, 6) end cardmarket_price, cast(null as double) tcgplayer_price, cast(0.25 as double) ebay_price from part",
    "normalize_images": "select p_partkey card_id, p_partkey image_id, 'https://images.example/full/' || p_partkey image_url, 'https://images.example/small/' || p_partkey image_url_small, 'https://images.example/cropped/' || p_partkey image_url_cropped from part",
    "normalize_archetypes": "select p_partkey card_id, p_brand archetype from part where p_partkey % 5 <> 0 and p_brand <> ''",
    "normalize_banlist": "select p_partkey card_id, 'Forbidden' ban_tcg, cast(null as varchar) ban_ocg, case when p_partkey % 20 = 0 then 'Limited' end ban_goat, cast(null as varchar) ban_edison from part where p_partkey % 10 = 0",
    "safe_int": "select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then null else cast(trunc(o_totalprice) as bigint) end whole from orders",
    "candidate_pool": with_views(
        """select id, not regexp_matches(lower(type), 'fusion|synchro|xyz|link|token') in_main, regexp_matches(lower(type), 'fusion|synchro|xyz|link') in_extra, lower(type) like '%monster%' is_monster,
           lower(type) like '%monster%' and lower(type) like '%effect%' is_effect, lower(type) like '%tuner%' is_tuner, lower(type) like '%monster%' and lower(type) not like '%tuner%' is_non_tuner, lower(type) like '%pendulum%' is_pendulum from cards""", "cards"),
    "type_bucket": with_views("select id, case when type like '%Spell%' then 'spell' when type like '%Trap%' then 'trap' else 'monster' end sampling, case when type like '%Monster%' then 'monster' when type like '%Spell%' then 'spell' when type like '%Trap%' then 'trap' end scoring from cards", "cards"),
    "cutoff_counts": with_views("select '2008-12-31' cutoff, count(*) filter (try_cast(tcg_date as date) <= date '2008-12-31') kept, count(*) - count(*) filter (try_cast(tcg_date as date) <= date '2008-12-31') dropped from cards union all select c, count(*), 0 from cards, (values ('soon'), ('None')) v(c) group by c", "cards"),
    "release_cutoff": with_views("select id, tcg_date from cards where try_cast(tcg_date as date) <= date '2008-12-31'", "cards"),
    "fk_orphans": " union all ".join(f"select '{c}' child, count(*) orphans from {c} left join {p} on {x} = {y} where {x} is not null and {y} is null" for c, x, p, y in (("lineitem", "l_partkey", "part", "p_partkey"), ("embeddings", "vec_id", "part", "p_partkey"), ("labels", "labels.doc_id", "documents", "documents.doc_id"))),
    "row_counts": " union all ".join(f"select '{t}' table_name, count(*) n_rows from {t}" for t in ("part", "orders", "lineitem", "customer")),
    "range_check": " union all ".join(f"select '{c}' column_name, cast(min({c}) as bigint) min_value, cast(max({c}) as bigint) max_value, min({c}) >= {lo} and max({c}) <= {hi} in_range from lineitem" for c, lo, hi in (("l_orderkey", -2147483648, 2147483647), ("l_partkey", 0, 1000), ("l_linenumber", 0, 32767))),
    "duplicate_keys": "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1",
    "dedupe_pk": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) = 1",
    "overlay_merge": "select p_partkey, 'v' || k || ' ' || p_name name, cast(k as integer) source_no from (select p_partkey, p_name, case when p_partkey % 3 = 2 then 1 else 2 end k from part)",
    "overlay_report": """with s as (select p_partkey, k source_no from part, (values (0), (1), (2)) t(k) where p_partkey % 3 <> k), r as (select *, row_number() over (partition by p_partkey order by source_no) nth from s)
                         select source_no, count(*) filter (nth = 1) n_new, count(*) filter (nth > 1) n_replaced from r group by source_no""",
    "allowlist_ids": "select distinct l_partkey - 50 id from lineitem where l_partkey > 50",
    "allowlist_filter": with_views("select id, name from cards where id in (select l_partkey from lineitem where l_quantity > 45)", "cards"),
}
