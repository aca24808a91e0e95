"""Source, sink, streaming and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import composite_weight, is_extra, price, slug, version_hash
from ..operators import clusters as C
from ..shared import new_path
from ..sources import readers, writers
from ..sources.warehouse import LoadError, Rule, Warehouse
from ..streaming import incremental
from .adapters import rounded, table, view, with_views

S = SparkSession
ORDER = "o_orderkey long, o_orderstatus string, o_totalprice double"


def _orders(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def parquet_roundtrip(spark: S, d: str) -> DataFrame:
    at = new_path(spark, "tables")
    writers.write_tables({"orders": _orders(spark, d)}, at)
    return readers.read_table(spark, f"{at}/orders.parquet", ORDER)


def jsonl_roundtrip(spark: S, d: str) -> DataFrame:
    at = new_path(spark, "lines") + ".jsonl"
    rows = _orders(spark, d)
    writers.write_jsonl(rows.where("o_orderkey % 2 = 0"), at)
    writers.write_jsonl(rows.where("o_orderkey % 2 = 1"), at, append=True)
    return readers.read_table(spark, at, ORDER)


def csv_roundtrip(spark: S, d: str) -> DataFrame:
    at = new_path(spark, "report") + ".csv"
    writers.write_csv(_orders(spark, d).withColumn("parts", F.array("o_orderkey", F.col("o_orderkey") + 1)), at)
    return readers.read_table(spark, at, ORDER + ", parts string").withColumn("parts", readers.list_column(F.col("parts"))[1])


def read_table_roundtrip(spark: S, d: str) -> DataFrame:
    a, b = (f(spark, d) for f in (parquet_roundtrip, jsonl_roundtrip))
    return a.join(b.withColumnRenamed("o_totalprice", "other"), ["o_orderkey", "o_orderstatus"]).select("o_orderkey", (F.col("o_totalprice") == F.col("other")).alias("same"))


def latest_snapshot(spark: S, d: str) -> DataFrame:
    at = new_path(spark, "snapshots")
    for day in ("2024-01-01", "2024-01-02"):
        _orders(spark, d).withColumn("day", F.lit(day)).write.json(f"{at}/cards_{day}")
    return readers.latest_snapshot(spark, f"{at}/cards_*/*.json", ORDER + ", day string", folders=True)


def versioned_replace(spark: S, d: str) -> DataFrame:
    at, a = new_path(spark, "versions"), view(spark, d, "assign").select("card_id", "cluster_id")
    for version, rows in (("v1", a), ("v2", a), ("v2", a.where("cluster_id > 3"))):
        writers.replace_version(rows.withColumn("cluster_version", F.lit(version)), at)
    return spark.read.schema("card_id long, cluster_id int, cluster_version string").parquet(at).groupBy("cluster_version").agg(F.count(F.lit(1)).alias("n"))


def load_replace_append(spark: S, d: str) -> DataFrame:
    at, cards, lines = new_path(spark, "load"), view(spark, d, "cards").select("id", "name"), view(spark, d, "entries")
    writers.load({"cards": cards, "entries": lines}, at, "replace", {"cards": ["entries"]})
    writers.load({"entries": lines}, at, "append")
    n = lambda t: spark.read.parquet(f"{at}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
    before = n("cards").unionByName(n("entries")).withColumn("step", F.lit(1))
    kept = spark.createDataFrame(before.collect(), "table_name string, n long, step int")
    writers.load({"cards": cards}, at, "replace", {"cards": ["entries"]})
    return kept.unionByName(n("cards").unionByName(n("entries")).withColumn("step", F.lit(2)))


def incremental_load(spark: S, d: str) -> DataFrame:
    """Orders arrive in two files; the second call of the stream takes only the new one."""
    at, target, mark = (new_path(spark, x) for x in ("arrivals", "loaded", "progress"))
    for k in range(2):
        _orders(spark, d).where(F.col("o_orderkey") % 2 == k).write.mode("append").parquet(at)
        incremental.append_new(spark, at, ORDER, target, mark)
    return spark.read.schema(ORDER + ", batch int").parquet(target).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"))


def redelivered_load(spark: S, d: str) -> DataFrame:
    """Orders arrive in two files, the second of which brings all of the first's again: each is taken once."""
    at, target, mark = (new_path(spark, x) for x in ("arrivals", "loaded", "progress"))
    for k in range(2):
        _orders(spark, d).where(F.col("o_orderkey") % 2 <= k).write.mode("append").parquet(at)
        incremental.append_new(spark, at, ORDER, target, mark, keys=["o_orderkey"], remember="7 days")
    rows = spark.read.schema(ORDER + ", batch int").parquet(target)
    incremental.require_all(_orders(spark, d), rows, ["o_orderkey"])
    first = F.dense_rank().over(C.Window.orderBy("batch"))  # of a few batches
    sums = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"), F.sum("o_orderkey").alias("key_sum"))
    return sums.select(first.alias("delivery"), "n", "distinct_keys", "key_sum")


LOADED = {"cards": Rule({"id": "bigint", "name": "string", "level": "int"}, ("id",)), "entries": Rule({"deck_id": "bigint", "card_id": "bigint", "copies": "int"}, ("deck_id", "card_id"), ("cards", "card_id", "id"))}


def checked_load(spark: S, d: str) -> DataFrame:
    """Six loads of cards and entries, three of which fail a check, and what the tables hold after each."""
    w = Warehouse(spark, new_path(spark, "warehouse"), LOADED)
    cards, entries = view(spark, d, "cards").select("id", "name", "level"), view(spark, d, "entries")
    later = entries.withColumn("deck_id", -1 - F.col("deck_id"))
    lost = later.withColumn("card_id", F.col("card_id") + 1_000_000_000_000)
    wide = cards.withColumns({"id": -1 - F.col("id"), "level": F.col("id") * (1 << 32)})
    steps = [({"cards": cards.unionByName(cards), "entries": entries}, "replace"), ({"entries": entries}, "append"), ({"entries": lost}, "replace"), ({"cards": wide}, "append"), ({"entries": later}, "append"), ({"cards": cards}, "replace")]
    out = None
    for i, (tables, mode) in enumerate(steps, 1):
        try:
            w.load(tables, mode)
            outcome = "loaded"
        except LoadError as e:
            outcome = str(e).split(":")[0]
        for name, key in (("cards", "id"), ("entries", "deck_id")):
            row = w.table(name).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("key_sum")).select(F.lit(i).alias("step"), F.lit(outcome).alias("outcome"), F.lit(name).alias("table_name"), "n", "key_sum")
            out = row if out is None else out.unionByName(row)
    return out


def resume_pending(spark: S, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("deck_id"))
    return incremental.pending(view(spark, d, "decks"), done, ["deck_id"])


SUMMARY = "seed long, total long, main_candidates long, extra_candidates long, formats array<struct<format: string, n: long, accepted: long, rejected: long>>"


def run_summary(spark: S, d: str) -> DataFrame:
    """Accepted and rejected decks for each format, from progress rows written by format, through the run's summary file."""
    at, file = new_path(spark, "progress"), new_path(spark, "summary")
    view(spark, d, "decks").withColumn("part", F.coalesce("format", F.lit("none"))).write.partitionBy("part").parquet(at)
    rows = spark.read.schema("deck_id long, format string, status string, part string").parquet(at)
    counts = rows.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    formats = counts.agg(F.lit(1).alias("seed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("format", "n", "accepted", "rejected"))).alias("formats"))  # a row a format
    pools = view(spark, d, "cards").agg(F.count_if(~is_extra(F.col("type"))).alias("main_candidates"), F.count_if(is_extra(F.col("type"))).alias("extra_candidates"))
    writers.write_summary(formats.join(pools), file)  # one row each
    return spark.read.schema(SUMMARY).json(file).select(F.inline("formats"), "main_candidates", "extra_candidates")


def final_cluster_records(spark: S, d: str) -> DataFrame:
    a = view(spark, d, "assign").select("card_id", "cluster_id", "prob")
    cards = view(spark, d, "cards").select(F.col("id").alias("card_id"), "name", "archetype", "level")
    roles = C.cluster_roles(a.join(view(spark, d, "cards").withColumnRenamed("id", "card_id"), "card_id", "left").where("cluster_id <> -1"))
    out = a.join(cards, "card_id", "left").join(roles, "cluster_id", "left").withColumnRenamed("prob", "cluster_probability")
    return out.fillna("", ["name", "archetype", "functional_role"]).fillna(0.0, ["cluster_probability"])


def format_config(spark: S, d: str) -> DataFrame:
    """Formats from JSON made of nations' rows."""
    name = F.trim("n_name")
    k = F.col("n_nationkey")
    shares = F.when(k % 4 == 0, F.struct(F.lit(0.6).alias("monster"), F.lit(0.2).alias("spell"), (k % 5).alias("tolerance_count")))
    body = F.struct(F.when(k % 2 == 0, 40 + k).alias("deck_size"), F.when(k % 3 == 0, F.concat(F.lit("lists/2010-03-"), F.lpad((k + 1).cast("string"), 2, "0"), F.lit(".json"))).alias("legality_source"), F.when(k % 3 == 1, F.lit("2011-01-01")).alias("tcg_release_cutoff"),
                    F.when(k % 5 == 0, F.lit(10)).alias("min_main"), F.when(k % 5 == 0, F.lit("99")).alias("max_main"), F.when(k % 7 == 0, F.lit(9)).alias("extra_deck_size"), F.when(k % 7 == 1, F.lit(3)).alias("min_extra"), shares.alias("card_type_ratios"),
                    F.struct(F.when(k % 2 == 1, k).alias("max_resample_attempts")).alias("generation"))
    text = F.to_json(F.create_map(name, body))
    rows = readers.formats(table(spark, d, "nation").select(F.when(k % 2 == 0, F.concat(F.lit('{"formats": '), text, F.lit("}"))).otherwise(text).alias("json")))
    return rows.withColumn("attempts", rows["generation"]["max_resample_attempts"].cast("int")).drop("generation")


def staple_pool(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("card_id"), (F.col("p_size") / 10.0).alias("weight"), F.array("p_type").alias("tags")))).alias("rows"))
    out = readers.staple_pool(rows.select(F.to_json(F.create_map("p_brand", "rows")).alias("json")))
    return rounded(out.withColumn("tags", F.array_join("tags", "|")))


def sampling_profiles(spark: S, d: str) -> DataFrame:
    """Profiles from JSON made of nations' rows; one in four is no object, one in three stands under a name."""
    k, name = F.col("n_nationkey"), F.trim("n_name")
    body = F.when(k % 4 == 1, F.lit('"none"')).otherwise(F.concat(F.lit('{"p_staple": 0.'), 1 + k % 8, F.lit(', "mode": "'), F.lower(name), F.lit('"}')))
    text = F.concat(F.lit('{"'), name, F.lit('": '), body, F.lit("}"))
    return readers.sampling_profiles(table(spark, d, "nation").select(F.when(k % 3 == 0, F.concat(F.lit('{"sampling_profiles": '), text, F.lit("}"))).otherwise(text).alias("json")))


def banlist_lists(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 10 == 0, F.to_json(F.struct(F.array(k).alias("forbidden"), F.array(k + 1, k + 2).alias("limited")))).when(k % 10 == 1, F.lit("")).when(k % 10 == 2, F.lit("[1]"))
    return readers.banlist(table(spark, d, "part").select(text.alias("json")))


def cutoff_from_path(spark: S, d: str) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 3 == 0, F.lit("lists/current.json")).otherwise(F.concat(F.lit("lists/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".json")))
    return table(spark, d, "orders").select("o_orderkey", readers.cutoff_from_path(path).alias("cutoff"))


def parse_list_json(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("["), k, F.lit(", "), k + 1, F.lit("]"))).when(k % 4 == 1, F.lit("not a list")).when(k % 4 == 2, F.lit("[]"))
    items = readers.list_column(text)
    return table(spark, d, "orders").select("o_orderkey", F.size(items).alias("n"), F.coalesce(F.get(items, F.lit(1)), F.lit(-1)).alias("second"))


def resolve(columns: list[str], names: list[str], default: str) -> Column:
    """The first column that is there, whatever its case; blank or absent values become the default."""
    by = {c.lower(): c for c in columns}
    found = next((by[n.lower()] for n in names if n.lower() in by), None)
    return F.lit(default) if found is None else F.coalesce(F.nullif(F.trim(F.col(found).cast("string")), F.lit("")), F.lit(default))


def resolve_columns(spark: S, d: str) -> DataFrame:
    rows = view(spark, d, "cards").withColumnRenamed("archetype", "ArcheType")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("atk") / 2000.0))
    return rounded(rows.select("id", resolve(rows.columns, ["card_archetype", "archetype"], "unknown").alias("archetype"), resolve(rows.columns, ["nothing"], "unknown").alias("nothing"), share.alias("confidence")))


#: What a label's review status may be (fixed values).
REVIEW = ("unreviewed", "accepted", "rejected", "needs_split", "misc")


def domain_check(spark: S, d: str) -> DataFrame:
    """How many values lie outside their domain: review statuses made of events (one in 50 is unknown), and event types."""
    k = F.col("event_id")
    status = F.when(k % 50 == 7, F.lit("new")).otherwise(F.get(F.array(*map(F.lit, REVIEW)), (k % 5).cast("int")))
    rows = table(spark, d, "events").select(status.alias("review_status"), "event_type")
    checks = {"review_status": REVIEW, "event_type": ("view", "click", "purchase")}
    parts = [rows.agg(F.lit(c).alias("column"), F.count_if(~F.col(c).isin(*names)).alias("outside"), F.count(F.lit(1)).alias("n")) for c, names in checks.items()]
    return parts[0].unionByName(parts[1])


def nested_numbers(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def format_slug(spark: S, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 9 == 0, F.lit("--- !")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" / "), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", slug(text).alias("slug"))


def rounding(spark: S, d: str) -> DataFrame:
    x = F.col("p_size") * 0.5
    return table(spark, d, "part").select("p_partkey", F.bround(x, 0).cast("bigint").alias("half_even"), F.greatest(F.lit(0.0), F.least(F.lit(20.0), x)).alias("cut"))


def composite_weight_query(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    w = composite_weight(F.when(k % 3 != 0, k % 5 / 2.0), k % 10 / 10.0, F.lit(None).cast("double"), F.when(k % 4 != 0, k % 20 / 10.0))
    return rounded(table(spark, d, "part").select("p_partkey", w.alias("weight")))


def price_values(spark: S, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.col("p_retailprice").cast("string"))
    return rounded(table(spark, d, "part").select("p_partkey", price(text).alias("price")))


def version_hash_query(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", version_hash(F.struct("n_nationkey", "n_name")).alias("version"))


QUERIES = {f.__name__.removesuffix("_query"): f for f in (
    parquet_roundtrip, jsonl_roundtrip, csv_roundtrip, read_table_roundtrip, latest_snapshot, versioned_replace, load_replace_append, incremental_load, redelivered_load, checked_load, resume_pending, run_summary, final_cluster_records, format_config, staple_pool, sampling_profiles, banlist_lists,
    cutoff_from_path, parse_list_json, resolve_columns, domain_check, nested_numbers, format_slug, rounding, composite_weight_query, price_values, version_hash_query)}

ORACLE_SQL = {
    "parquet_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "jsonl_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "csv_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice, o_orderkey + 1 parts from orders",
    "read_table_roundtrip": "select o_orderkey, true same from orders",
    "latest_snapshot": "select o_orderkey, o_orderstatus, o_totalprice, '2024-01-02' \"day\" from orders",
    "versioned_replace": "select 'v1' cluster_version, count(*) n from embeddings union all select 'v2', count(*) from embeddings where label > 3",
    "load_replace_append": with_views("select 'cards' table_name, count(*) n, 1 step from cards union all select 'entries', 2 * count(*), 1 from entries union all select 'cards', count(*), 2 from cards union all select 'entries', 0, 2", "cards", "entries"),
    "incremental_load": "select cast(o_orderkey % 2 as integer) batch, count(*) n, count(distinct o_orderkey) distinct_keys from orders group by 1",
    "redelivered_load": "select cast(1 + o_orderkey % 2 as integer) delivery, count(*) n, count(distinct o_orderkey) distinct_keys, cast(sum(o_orderkey) as bigint) key_sum from orders group by 1",
    "checked_load": with_views("""with c as (select 'cards' table_name, count(*) n, sum(id) s from cards), e as (select 'entries' table_name, count(*) n, sum(deck_id) s from entries)
      select cast(step as integer) step, outcome, table_name, case when table_name = 'cards' then n when step < 5 then n when step = 5 then 2 * n else 0 end n, cast(case when table_name = 'cards' or step < 5 then s when step = 5 then -n else 0 end as bigint) key_sum
      from (values (1, 'loaded'), (2, 'entries'), (3, 'entries'), (4, 'cards.level'), (5, 'loaded'), (6, 'loaded')) t(step, outcome), (from c union all from e)""", "cards", "entries"),
    "resume_pending": with_views("select * from decks where deck_id not in (select l_orderkey from lineitem where l_quantity > 40)", "decks"),
    "run_summary": with_views("select format, count(*) n, count(*) filter (status = 'accepted') accepted, count(*) filter (status = 'rejected') rejected, (select count(*) from cards where not regexp_matches(lower(type), 'fusion|synchro|xyz|link')) main_candidates, (select count(*) from cards where regexp_matches(lower(type), 'fusion|synchro|xyz|link')) extra_candidates from decks group by 1", "decks", "cards"),
    "sampling_profiles": """select trim(n_name) profile, unnest(['p_staple', 'mode']) setting, unnest(['0.' || (1 + n_nationkey % 8), '"' || lower(trim(n_name)) || '"']) "value" from nation where n_nationkey % 4 <> 1""",
    "final_cluster_records": with_views("""with rol as (select cluster_id, case when bool_or(t like '%add from deck%') then 'searcher' when bool_or(t like '%draw%') then 'draw' when bool_or(t like '%destroy%' or t like '%banish%' or t like '%target%') then 'removal' when bool_or(t like '%negate%') then 'negation' when bool_or(t like '%gy%' or t like '%graveyard%' or t like '%send%') then 'graveyard_setup' else 'misc' end functional_role from (select cluster_id, lower(coalesce(descr, '')) t from assign left join cards on id = card_id where cluster_id <> -1) group by 1)
      select cluster_id, card_id, prob cluster_probability, coalesce(name, '') "name", coalesce(archetype, '') archetype, level, coalesce(functional_role, '') functional_role from assign left join cards on id = card_id left join rol using (cluster_id)""", "assign", "cards"),
    "format_config": """select trim(n_name) format, m main_size, cast(case when k % 5 = 0 then 10 else m end as integer) main_min, cast(case when k % 5 = 0 then 99 else m end as integer) main_max, cast(x as integer) extra_size, cast(case when k % 7 = 1 then 3 else 0 end as integer) extra_min, cast(x as integer) extra_max,
      case k % 3 when 0 then '2010-03-' || lpad(cast(k + 1 as varchar), 2, '0') when 1 then '2011-01-01' end release_cutoff, case when k % 3 = 0 then 'lists/2010-03-' || lpad(cast(k + 1 as varchar), 2, '0') || '.json' end legality,
      case when k % 4 = 0 then 0.6::double else 0.5::double end monster, case when k % 4 = 0 then 0.2::double else 0.3::double end spell, 0.2::double trap, cast(case when k % 4 = 0 then k % 5 else 2 end as integer) tolerance, cast(case when k % 2 = 1 then k end as integer) attempts
      from (select n_name, n_nationkey k, cast(case when n_nationkey % 2 = 0 then 40 + n_nationkey else 40 end as integer) m, case when n_nationkey % 7 = 0 then 9 else 15 end x from nation)""",
    "staple_pool": "select p_brand format, p_partkey card_id, round(p_size / 10.0, 6) weight, p_type tags from part",
    "banlist_lists": "select 'forbidden' list_name, p_partkey card_id from part where p_partkey % 10 = 0 union all select 'limited', p_partkey + 1 from part where p_partkey % 10 = 0 union all select 'limited', p_partkey + 2 from part where p_partkey % 10 = 0",
    "cutoff_from_path": "select o_orderkey, case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end cutoff from orders",
    "parse_list_json": "select o_orderkey, case when o_orderkey % 4 = 0 then 2 else 0 end n, case when o_orderkey % 4 = 0 then o_orderkey + 1 else -1 end \"second\" from orders",
    "resolve_columns": with_views("select id, coalesce(nullif(trim(archetype), ''), 'unknown') archetype, 'unknown' nothing, round(greatest(0, least(1, atk / 2000.0)), 6) confidence from cards", "cards"),
    "domain_check": "select 'event_type' \"column\", count(*) filter (event_type not in ('view', 'click', 'purchase')) outside, count(*) n from events union all select 'review_status', count(*) filter (event_id % 50 = 7), count(*) from events",
    "nested_numbers": "select event_id, cast(json_extract(props, '$.k') as bigint) k from events",
    "format_slug": "select p_partkey, case when p_partkey % 9 = 0 then 'format' else trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') end slug from part",
    "rounding": "select p_partkey, cast(round_even(p_size * 0.5, 0) as bigint) half_even, cast(greatest(0, least(20, p_size * 0.5)) as double) cut from part",
    "composite_weight": "select p_partkey, round(greatest(1e-4, coalesce(nullif(case when p_partkey % 3 <> 0 then p_partkey % 5 / 2.0 end, 0), 1) * coalesce(nullif(p_partkey % 10 / 10.0, 0), 1) * (1 - greatest(0, least(0.95, coalesce(case when p_partkey % 4 <> 0 then p_partkey % 20 / 10.0 end, 0))))), 6) weight from part",
    "price_values": "select p_partkey, case when p_partkey % 6 <> 0 then round(p_retailprice, 6) end price from part",
    "version_hash": "select n_nationkey, substr(sha1('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'), 1, 10) \"version\" from nation",
}
