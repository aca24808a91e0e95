"""Feature and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, unit
from ..operators import clusters as C
from ..operators import features as X
from ..operators.labels import ingest_labels
from .adapters import rounded, table, view, with_views

S = SparkSession


def _assign(spark: S, d: str) -> DataFrame:
    return view(spark, d, "assign")


def _attributed(spark: S, d: str) -> DataFrame:
    return _assign(spark, d).drop("embedding").join(view(spark, d, "cards").withColumnRenamed("id", "card_id"), "card_id", "left")


def card_features(spark: S, d: str) -> DataFrame:
    return X.card_features(view(spark, d, "cards"))


def role_tags(spark: S, d: str) -> DataFrame:
    return X.role_tags(view(spark, d, "cards"))


def hash_embedding(spark: S, d: str) -> DataFrame:
    e = X.hash_embedding(table(spark, d, "documents"), "doc_id", "text", 384)
    return rounded(e.select("doc_id", F.element_at("embedding", 1).alias("first"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("embedding").alias("top"), F.size(F.filter("embedding", lambda x: x > 0)).alias("filled")))


def kv_feature_docs(spark: S, d: str) -> DataFrame:
    cards = view(spark, d, "cards")
    return X.kv_documents(X.card_features(cards), X.role_tags(cards))


def vector_batches(spark: S, d: str) -> DataFrame:
    points = X.vector_batches(_assign(spark, d), "card_id", 100)
    return rounded(points.select("batch_id", "id", "payload", F.size("vector").alias("dim"), F.get("vector", F.lit(0)).cast("double").alias("first")))


def embedding_shape(spark: S, d: str) -> DataFrame:
    return _assign(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("shapes"), F.max(F.size("embedding")).cast("bigint").alias("dim"))


def l2_normalize(spark: S, d: str) -> DataFrame:
    u = _assign(spark, d).select("card_id", unit(doubles(F.col("embedding"))).alias("u"))
    return rounded(u.select("card_id", F.get("u", F.lit(0)).alias("x0"), F.get("u", F.lit(63)).alias("x63"), F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("norm2")))


def assign_with_attrs(spark: S, d: str) -> DataFrame:
    return _attributed(spark, d).select("card_id", "cluster_id", "prob", "name", "type", "archetype")


def cards_with_clusters(spark: S, d: str) -> DataFrame:
    own = _assign(spark, d).select(F.col("card_id").alias("id"), "cluster_id")
    return view(spark, d, "cards").join(own, "id", "left").select("id", "name", "cluster_id")


def cluster_metrics(spark: S, d: str) -> DataFrame:
    return rounded(C.cluster_metrics(_assign(spark, d)))


def cluster_distributions(spark: S, d: str) -> DataFrame:
    rows = _attributed(spark, d)
    top = C.top_values(rows.where("cluster_id <> -1"), ["cluster_id"], F.coalesce("archetype", F.lit("unknown")), 15)
    return top.select("cluster_id", "value", "n", "nth")


def noise_summary(spark: S, d: str) -> DataFrame:
    rows = _attributed(spark, d)
    noise = rows.where("cluster_id = -1")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster_id") == -1).alias("n")).select(F.lit("noise").alias("kind"), F.lit("all").alias("value"), "n", F.lit(1).alias("nth"))
    parts = [counts]
    for kind, value, k in (("type", F.coalesce("type", F.lit("unknown")), 10), ("archetype", F.coalesce("archetype", F.lit("unknown")), 10)):
        parts.append(C.top_values(noise.withColumn("kind", F.lit(kind)), ["kind"], value, k))
    near = C.nearest_clusters(_assign(spark, d)).where("nearest_cluster_id is not null").withColumn("kind", F.lit("nearest"))
    parts.append(C.top_values(near, ["kind"], F.col("nearest_cluster_id").cast("string"), 15))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("kind", "value", "n", "nth"))
    return out


def top_terms(spark: S, d: str) -> DataFrame:
    return C.terms(table(spark, d, "documents"), ["source"], "text", 20).select("source", "value", "n", "nth")


def cluster_quality(spark: S, d: str) -> DataFrame:
    return rounded(C.quality(_assign(spark, d)))


def cluster_centroid(spark: S, d: str) -> DataFrame:
    c = C.centroids(_assign(spark, d))
    return rounded(c.select("cluster_id", F.posexplode("centroid").alias("pos", "x")), 5)


def cluster_medoid(spark: S, d: str) -> DataFrame:
    return rounded(C.medoids(_assign(spark, d)))


def cluster_coherence(spark: S, d: str) -> DataFrame:
    return rounded(C.coherence(_assign(spark, d)))


def nearest_cluster(spark: S, d: str) -> DataFrame:
    return rounded(C.nearest_clusters(_assign(spark, d)))


def nearest_labels(spark: S, d: str) -> DataFrame:
    roles = C.cluster_roles(_attributed(spark, d).where("cluster_id <> -1")).select(F.col("cluster_id").alias("nearest_cluster_id"), "functional_role")
    near = C.nearest_clusters(_assign(spark, d)).join(roles, "nearest_cluster_id", "left")
    role = F.when(F.col("cluster_id") == -1, F.coalesce("functional_role", F.lit(""))).otherwise("")
    return near.select("card_id", "cluster_id", role.alias("nearest_role"), F.translate(role, "_", " ").alias("nearest_label"))


def cluster_role(spark: S, d: str) -> DataFrame:
    return C.cluster_roles(_attributed(spark, d))


def _scored(spark: S, d: str) -> DataFrame:
    return C.structural_score(C.cluster_metrics(_assign(spark, d)))


def structural_score(spark: S, d: str) -> DataFrame:
    return rounded(_scored(spark, d).select("num_clusters", "noise_ratio", "structural_score"))


def _semantic(spark: S, d: str) -> DataFrame:
    return C.semantic_score(C.semantic_metrics(_assign(spark, d), view(spark, d, "cards")))


def semantic_metrics(spark: S, d: str) -> DataFrame:
    return rounded(_semantic(spark, d).drop("semantic_score"))


def semantic_score(spark: S, d: str) -> DataFrame:
    return rounded(_semantic(spark, d).select("semantic_score"))


def final_score(spark: S, d: str) -> DataFrame:
    both = _scored(spark, d).join(_semantic(spark, d))  # one row each
    return rounded(both.select((F.col("structural_score") + F.col("semantic_score")).alias("final_score")))


def guardrails(spark: S, d: str) -> DataFrame:
    runs = _assign(spark, d).withColumn("run", F.explode(F.array(*(F.lit(i) for i in range(5))))).withColumn("cluster_id", F.when(F.col("card_id") % 7 < F.col("run"), -1).otherwise(F.col("card_id") % (20 * F.col("run") + 3)))
    m = C.guardrails(C.cluster_metrics(runs, ["run"]), few=40, noise=0.3, largest=0.1, tiny=0.1)
    return m.select("run", "too_few_clusters", "too_much_noise", "too_large_cluster", "too_many_tiny", "is_good_run")


def representatives(spark: S, d: str) -> DataFrame:
    w = C.Window.partitionBy("cluster_id").orderBy("card_id")
    rows = _assign(spark, d).where("cluster_id <> -1").withColumn("nth", F.row_number().over(w)).where("nth <= 10")
    return rows.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("card_id")), ",").alias("cards"))


def top_clusters(spark: S, d: str) -> DataFrame:
    rows = _attributed(spark, d).where("cluster_id <> -1")
    dist = C.as_map(C.top_values(rows, ["cluster_id"], F.coalesce("type", F.lit("unknown")), 15), ["cluster_id"], "types")
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    archetypes = C.as_map(C.top_values(rows, ["cluster_id"], F.coalesce("archetype", F.lit("unknown")), 15), ["cluster_id"], "archetypes")
    return sizes.join(dist, "cluster_id").join(archetypes, "cluster_id").orderBy(F.desc("size"), "cluster_id").limit(5)


def cluster_examples(spark: S, d: str) -> DataFrame:
    """The medoid, the five closest, five random and the five least probable cards of each cluster."""
    rows = C.with_centroids(_assign(spark, d)).select("cluster_id", "card_id", "d", "prob")
    orders = {"closest": [F.col("d"), F.col("card_id")], "random": [F.md5(F.concat_ws("|", F.lit("42"), F.col("card_id"))), F.col("card_id")], "unsure": [F.col("prob"), F.col("card_id")]}
    ranked = rows.withColumns({k: F.row_number().over(C.Window.partitionBy("cluster_id").orderBy(*o)) for k, o in orders.items()})
    picks = F.filter(F.array(F.when(F.col("closest") == 1, F.struct(F.lit("medoid").alias("kind"), F.lit(1).alias("nth"))), *(F.when(F.col(k) <= 5, F.struct(F.lit(k).alias("kind"), F.col(k).alias("nth"))) for k in orders)), lambda x: x.isNotNull())
    return ranked.select("cluster_id", "card_id", F.inline(picks))


def _metadata(spark: S, d: str) -> DataFrame:
    return C.metadata_records(_assign(spark, d), _attributed(spark, d), "descr")


def cluster_metadata(spark: S, d: str) -> DataFrame:
    """The metadata records with their struct laid out in columns."""
    m = _metadata(spark, d)
    q = F.col("metadata.quality_metrics")
    return rounded(m.select(*m.columns[:-1], q["mean_prob"].alias("mean_prob"), q["mean_outlier"].alias("mean_outlier"), q["avg_similarity"].alias("avg_similarity"), F.array_join("metadata.top_terms", " ").alias("top_terms"),
                            F.array_join(F.transform("metadata.representative_cards", lambda x: F.concat_ws(":", x["card_id"], x["card_name"])), "|").alias("representatives"), "metadata.type_distribution", "metadata.archetype_distribution", "metadata.reasoning", "metadata.noise_cluster", *(F.col("metadata.noise_summary")[c].alias(f"noise_{c.removeprefix('noise_')}") for c in ("noise_cards", "noise_ratio", "types", "archetypes", "nearest_clusters"))))


def label_ingest(spark: S, d: str) -> DataFrame:
    """Each event's label of a cluster: objects, lists, nested results, and texts that are none of these."""
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    raws = F.array(
        F.lit("not json"), q('{"functional_role": " Draw ", "label_hint": "h', e, '", "label_confidence": 0.9, "reasoning": " ', F.repeat(q(kind, "-"), 100), '"}'),
        q('[{"functional_role": "removal", "reasoning": "r', e, '"}]'), q('{"result": {"functional_role": "', kind, '", "label_hint": null, "label_confidence": "0.', F.col("user_id").cast("string"), '"}}'),
        F.lit("[]"), F.lit("[7]"), F.lit("7"), F.lit('{"functional_role": "burn", "label_confidence": "high"}'))
    answers = table(spark, d, "events").select("event_id", (F.col("user_id") % 12).cast("int").alias("cluster_id"), F.get(raws, (F.col("event_id") % 8).cast("int")).alias("raw"))
    return rounded(ingest_labels(answers, "raw", cluster_role(spark, d)))


QUERIES = {f.__name__: f for f in (
    card_features, role_tags, hash_embedding, kv_feature_docs, vector_batches, embedding_shape, l2_normalize, assign_with_attrs, cards_with_clusters, cluster_metrics, cluster_distributions, noise_summary, top_terms,
    cluster_quality, cluster_centroid, cluster_medoid, cluster_coherence, nearest_cluster, nearest_labels, cluster_role, structural_score, semantic_metrics, semantic_score, final_score, guardrails, representatives,
    top_clusters, cluster_examples, cluster_metadata, label_ingest)}

E = "cast(embedding as double[])"
SUM = "list_sum(list_transform({0}, lambda x: x))"
NORM = f"sqrt(list_dot_product({E}, {E}))"
#: Shared parts of the SQL: centroids of raw and of unit vectors.
CENT = f"cen as (select cluster_id, list(x order by pos) c from (select cluster_id, pos, avg(x) x from (select cluster_id, unnest({E}) x, generate_subscripts(embedding, 1) pos from assign where cluster_id <> -1) group by all) group by cluster_id), dist as (select a.*, sqrt(list_sum(list_transform(list_zip({E}, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) d from assign a join cen using (cluster_id))"
UNIT = f"un as (select card_id, cluster_id, prob, list_transform({E}, lambda x: x / {NORM}) u from assign), ucen0 as (select cluster_id, list(x order by pos) c from (select cluster_id, pos, avg(x) x from (select cluster_id, unnest(u) x, generate_subscripts(u, 1) pos from un where cluster_id <> -1) group by all) group by cluster_id), ucen as (select cluster_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) c from ucen0)"
COH = "coh as (select cluster_id, case when count(*) > 1 then avg(greatest(-1, least(1, list_dot_product(u, c)))) else 0 end coherence from un join ucen using (cluster_id) group by cluster_id)"
NEAR = "near as (select card_id, cluster_id, id, d from (select un.card_id, un.cluster_id, ucen.cluster_id id, sqrt(list_sum(list_transform(list_zip(u, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) d from un, ucen where un.cluster_id = -1) qualify row_number() over (partition by card_id order by d, id) = 1)"
MET = "met as (select count(*) filter (cluster_id <> -1) num_clusters, coalesce(sum(n) filter (cluster_id = -1), 0) noise_count, coalesce(sum(n) filter (cluster_id = -1), 0) / sum(n) noise_ratio, min(n) filter (cluster_id <> -1) size_min, max(n) filter (cluster_id <> -1) size_max, avg(n) filter (cluster_id <> -1) size_mean, median(n) filter (cluster_id <> -1) size_median, max(n) filter (cluster_id <> -1) / sum(n) largest_ratio, coalesce(sum(n) filter (cluster_id <> -1 and n <= 3), 0) / sum(n) tiny_ratio, sum(p) filter (cluster_id <> -1) / sum(n) filter (cluster_id <> -1) mean_prob, list(n order by n desc) filter (cluster_id <> -1) sizes from (select cluster_id, count(*) n, sum(prob) p from assign group by 1))"
STR = "str as (select 0.4 * least(num_clusters / 100.0, 1) - 0.25 * noise_ratio - 0.15 * largest_ratio - 0.1 * tiny_ratio + 0.1 * mean_prob - case when num_clusters < 50 then 1 else 0 end - case when noise_ratio > 0.3 then 1 else 0 end s, num_clusters, noise_ratio from met)"
SEM = "per as (select cluster_id, max(n) / sum(n) purity, coalesce(sum(n) filter (lower(a) in ('generic','none','unknown','other','misc')), 0) / sum(n) g, sum(n) n, sum(p) p from (select cluster_id, coalesce(archetype, 'unknown') a, count(*) n, sum(prob) p from assign left join cards on id = card_id where cluster_id <> -1 group by 1, 2) group by 1), sem as (select avg(purity) purity, avg(coherence) coherence, sum(p) / sum(n) label_confidence, greatest(0, 1 - abs(avg(case when g >= 0.6 then 1 else 0 end) - avg(case when 1 - g >= 0.6 then 1 else 0 end))) balance from per join coh using (cluster_id)), sms as (select 0.1 * (greatest(0, 1 - abs(purity - 0.65) / 0.65) - case when purity > 0.9 then 2 * (purity - 0.9) else 0 end) + 0.2 * greatest(0, least(1, coherence)) + 0.05 * label_confidence + 0.1 * balance s from sem)"
ROLE_CASE = "case when bool_or(t like '%add from deck%') then 'searcher' when bool_or(t like '%draw%') then 'draw' when bool_or(t like '%destroy%' or t like '%banish%' or t like '%target%') then 'removal' when bool_or(t like '%negate%') then 'negation' when bool_or(t like '%gy%' or t like '%graveyard%' or t like '%send%') then 'graveyard_setup' when bool_or(t like '%cannot activate%' or t like '%cannot summon%') then 'floodgate' else 'misc' end"
ROLE = f"rol as (select cluster_id, {ROLE_CASE} functional_role from (select cluster_id, lower(coalesce(descr, '')) t from assign left join cards on id = card_id where cluster_id <> -1) group by 1)"
TAGS = """tag0 as (
 select id card_id, 'searcher' role_tag, 0.9::double confidence, 'desc_keyword:search' rule_source, 1 k from cards where regexp_matches(lower(descr), 'add|search|from your deck')
 union all select id, 'starter', 0.75, 'desc_keyword:starter', 1 from cards where regexp_matches(lower(descr), 'add|search|from your deck')
 union all select id, 'extender', 0.8, 'desc_keyword:summon', 1 from cards where lower(descr) like '%summon%'
 union all select id, 'interruption', 0.8, 'desc_keyword:interaction', 1 from cards where regexp_matches(lower(descr), 'negate|banish|destroy|cannot')
 union all select id, 'brick', 0.55, 'stat_high_attack', 1 from cards where type like '%Monster%' and atk >= 2500
 union all select id, 'starter', 0.5, 'stat_low_stats', 1 from cards where type like '%Monster%' and atk <= 500 and def <= 500
), tags as (select card_id, role_tag, confidence, rule_source from tag0 qualify row_number() over (partition by card_id, role_tag order by confidence desc) = 1)"""
TYPES = "typ as (select cluster_id, '{' || string_agg('\"' || v || '\":' || n, ',' order by n desc, v) || '}' types from (select cluster_id, coalesce(type, 'unknown') v, count(*) n from assign left join cards on id = card_id where cluster_id <> -1 group by 1, 2 qualify row_number() over (partition by cluster_id order by count(*) desc, v) <= 15) group by 1)"
ARCHES = TYPES.replace("typ as", "arc as").replace("coalesce(type,", "coalesce(archetype,").replace(" types from", " archetypes from")


#: Counts of the commonest values as a JSON object: value, rows, how many.
_NOISE = "select '{{' || string_agg('\"' || v || '\":' || n, ',' order by n desc, v) || '}}' from (select {} v, count(*) n from {} group by 1 qualify row_number() over (order by count(*) desc, v) <= {})"


def ALL(sql: str) -> str:
    """The same with the noise as one more cluster."""
    return sql.replace(" where cluster_id <> -1", "")


ORACLE_SQL = {
    "card_features": with_views("select id card_id, name, type, race, archetype, case when atk >= 0 then atk end atk, case when def >= 0 then def end def, lower(type) like '%effect%' is_effect_monster, regexp_matches(lower(type), 'fusion|synchro|xyz|link') is_extra_deck, type like '%Spell%' is_spell, type like '%Trap%' is_trap from cards", "cards"),
    "role_tags": with_views(f"with {TAGS} select * from tags", "cards"),
    "hash_embedding": """with w as (select doc_id, ('0x' || substr(md5(w), 1, 8))::ubigint % 384 b from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w from documents)), c as (select doc_id, b, count(*)::double n from w group by all), s as (select doc_id, sqrt(sum(n * n)) z, sum(n) t, max(n) m, count(*) f, coalesce(max(n) filter (b = 0), 0) n0 from c group by 1)
      select doc_id, round(coalesce(n0 / z, 0), 6) "first", round(coalesce(t / z, 0), 6) total, round(coalesce(m / z, 0), 6) top, cast(coalesce(f, 0) as integer) filled from documents left join s using (doc_id)""",
    "kv_feature_docs": with_views(f"""with {TAGS} select 'card:features:' || id "key", '{{"card_id":' || id || ',"name":"' || name || '","type":"' || type || '","race":"' || race || '"' || coalesce(',"archetype":"' || archetype || '"', '') || case when atk >= 0 then ',"atk":' || atk else '' end || case when def >= 0 then ',"def":' || def else '' end || ',"is_effect_monster":' || (lower(type) like '%effect%') || ',"is_extra_deck":' || regexp_matches(lower(type), 'fusion|synchro|xyz|link') || ',"is_spell":' || (type like '%Spell%') || ',"is_trap":' || (type like '%Trap%') || '}}' "value" from cards
      union all select 'card:roles:' || card_id, '[' || string_agg('{{"role_tag":"' || role_tag || '","confidence":' || confidence || '}}', ',' order by role_tag) || ']' from tags group by card_id""", "cards"),
    "vector_batches": with_views("""select cast(floor((row_number() over (order by card_id) - 1) / 100) as bigint) batch_id, card_id id, '{"id":' || card_id || ',"cluster_id":' || cluster_id || '}' payload, cast(len(embedding) as integer) dim, round(embedding[1]::double, 6) + 0.0 "first" from assign""", "assign"),
    "embedding_shape": "select count(*) n, count(distinct len(embedding)) shapes, max(len(embedding)) dim from embeddings",
    "l2_normalize": with_views(f"with {UNIT} select card_id, round(u[1], 6) x0, round(u[64], 6) x63, round(list_dot_product(u, u), 6) norm2 from un", "assign"),
    "assign_with_attrs": with_views("select card_id, cluster_id, prob, name, type, archetype from assign left join cards on id = card_id", "assign", "cards"),
    "cards_with_clusters": with_views("select id, name, cluster_id from cards left join assign on id = card_id", "assign", "cards"),
    "cluster_metrics": with_views(f"with {MET} select num_clusters, noise_count, round(noise_ratio, 6) noise_ratio, size_min, size_max, round(size_mean, 6) size_mean, size_median, round(largest_ratio, 6) largest_ratio, round(tiny_ratio, 6) tiny_ratio, round(mean_prob, 6) mean_prob, '[' || array_to_string(sizes[1:10], ',') || ']' top_sizes from met", "assign"),
    "cluster_distributions": with_views("select cluster_id, coalesce(archetype, 'unknown') \"value\", count(*) n, cast(row_number() over (partition by cluster_id order by count(*) desc, coalesce(archetype, 'unknown')) as integer) nth from assign left join cards on id = card_id where cluster_id <> -1 group by 1, 2 qualify nth <= 15", "assign", "cards"),
    "noise_summary": with_views(f"""with {UNIT}, {NEAR}, v as (select 'type' kind, coalesce(type, 'unknown') v, 10 k from assign left join cards on id = card_id where cluster_id = -1 union all select 'archetype', coalesce(archetype, 'unknown'), 10 from assign left join cards on id = card_id where cluster_id = -1 union all select 'nearest', cast(id as varchar), 15 from near)
      select 'noise' kind, 'all' "value", count(*) n, 1 nth from assign where cluster_id = -1 union all select kind, v, count(*), cast(row_number() over (partition by kind order by count(*) desc, v) as integer) nth from v group by kind, v, k qualify nth <= k""", "assign", "cards"),
    "top_terms": "select source, lower(w) \"value\", count(*) n, cast(row_number() over (partition by source order by count(*) desc, lower(w)) as integer) nth from (select source, unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+')) w from documents) where length(w) > 2 group by 1, 2 qualify nth <= 20",
    "cluster_quality": with_views(f"with {CENT} select cluster_id, count(*) size, round(avg(prob), 6) mean_prob, round(avg(1 - prob), 6) mean_outlier, round(avg(greatest(-1, least(1, 1 - d))), 6) avg_similarity from dist group by 1", "assign"),
    "cluster_centroid": with_views(f"with {CENT} select cluster_id, cast(generate_subscripts(c, 1) - 1 as integer) pos, round(unnest(c), 5) + 0.0 x from cen", "assign"),
    "cluster_medoid": with_views(f"with {CENT} select cluster_id, card_id medoid_card_id, round(d, 6) medoid_distance from dist qualify row_number() over (partition by cluster_id order by d, card_id) = 1", "assign"),
    "cluster_coherence": with_views(f"with {UNIT}, {COH} select cluster_id, round(coherence, 6) coherence from coh", "assign"),
    "nearest_cluster": with_views(f"with {UNIT}, {NEAR} select a.card_id, a.cluster_id, id nearest_cluster_id, round(d, 6) nearest_distance, round(1 / (1 + d), 6) nearest_confidence from assign a left join near n using (card_id)", "assign"),
    "nearest_labels": with_views(f"with {UNIT}, {NEAR}, {ROLE} select a.card_id, a.cluster_id, coalesce(functional_role, '') nearest_role, replace(coalesce(functional_role, ''), '_', ' ') nearest_label from assign a left join near n using (card_id) left join rol on rol.cluster_id = n.id", "assign", "cards"),
    "cluster_role": with_views(f"select cluster_id, {ROLE_CASE} functional_role from (select cluster_id, lower(coalesce(descr, '')) t from assign left join cards on id = card_id) group by 1", "assign", "cards"),
    "structural_score": with_views(f"with {MET}, {STR} select num_clusters, round(noise_ratio, 6) noise_ratio, round(s, 6) structural_score from str", "assign"),
    "semantic_metrics": with_views(f"with {UNIT}, {COH}, {SEM} select round(purity, 6) purity, round(coherence, 6) coherence, round(label_confidence, 6) label_confidence, round(balance, 6) balance from sem", "assign", "cards"),
    "semantic_score": with_views(f"with {UNIT}, {COH}, {SEM} select round(s, 6) semantic_score from sms", "assign", "cards"),
    "final_score": with_views(f"with {MET}, {STR}, {UNIT}, {COH}, {SEM} select round(str.s + sms.s, 6) final_score from str, sms", "assign", "cards"),
    "guardrails": with_views("""with r as (select run, case when card_id % 7 < run then -1 else card_id % (20 * run + 3) end c from assign, (values (0), (1), (2), (3), (4)) t(run)), z as (select run, c, count(*) n from r group by all),
      m as (select run, count(*) filter (c <> -1) k, coalesce(sum(n) filter (c = -1), 0) / sum(n) noise, max(n) filter (c <> -1) / sum(n) largest, coalesce(sum(n) filter (c <> -1 and n <= 3), 0) / sum(n) tiny from z group by run)
      select cast(run as integer) run, k < 40 too_few_clusters, noise > 0.3 too_much_noise, largest > 0.1 too_large_cluster, tiny > 0.1 too_many_tiny, noise < 0.3 and k >= 40 and largest < 0.1 is_good_run from m""", "assign"),
    "representatives": with_views("select cluster_id, string_agg(card_id, ',' order by card_id) cards from (select * from assign where cluster_id <> -1 qualify row_number() over (partition by cluster_id order by card_id) <= 10) group by 1", "assign"),
    "top_clusters": with_views(f"with {TYPES}, {ARCHES} select cluster_id, count(*) size, types, archetypes from assign join typ using (cluster_id) join arc using (cluster_id) group by cluster_id, types, archetypes order by size desc, cluster_id limit 5", "assign", "cards"),
    "cluster_examples": with_views(f"""with {CENT}, r as (select cluster_id, card_id, row_number() over (partition by cluster_id order by d, card_id) a, row_number() over (partition by cluster_id order by md5('42|' || card_id), card_id) b, row_number() over (partition by cluster_id order by prob, card_id) c from dist)
      select cluster_id, card_id, 'medoid' kind, 1 nth from r where a = 1 union all select cluster_id, card_id, 'closest', cast(a as integer) from r where a <= 5 union all select cluster_id, card_id, 'random', cast(b as integer) from r where b <= 5 union all select cluster_id, card_id, 'unsure', cast(c as integer) from r where c <= 5""", "assign"),
    "cluster_metadata": with_views(f"""with {UNIT}, {NEAR}, {ALL(CENT)}, {ALL(ROLE)}, {ALL(TYPES)}, {ALL(ARCHES)}, q as (select cluster_id, count(*) cluster_size, round(avg(prob), 6) mean_prob, round(avg(1 - prob), 6) mean_outlier, round(avg(greatest(-1, least(1, 1 - d))), 6) avg_similarity from dist group by 1),
      m as (select cluster_id, card_id medoid_card_id from dist qualify row_number() over (partition by cluster_id order by d, card_id) = 1),
      w as (select cluster_id, string_agg(v, ' ' order by n desc, v) top_terms from (select cluster_id, lower(t) v, count(*) n from (select cluster_id, unnest(regexp_extract_all(coalesce(descr, ''), '[a-zA-Z0-9_]+')) t from assign left join cards on id = card_id) where length(t) > 2 group by 1, 2 qualify row_number() over (partition by cluster_id order by count(*) desc, lower(t)) <= 20) group by 1),
      r as (select cluster_id, string_agg(concat_ws(':', card_id, name), '|' order by card_id) representatives from (select cluster_id, card_id, name from assign left join cards on id = card_id qualify row_number() over (partition by cluster_id order by card_id) <= 10) group by 1)
      select q.*, medoid_card_id, functional_role, types type_distribution, archetypes archetype_distribution, coalesce(top_terms, '') top_terms, representatives, replace(functional_role, '_', ' ') label_hint, 0.55::double label_confidence, 'heuristic:' || functional_role label_source, 'heuristic:' || functional_role reasoning, 'unreviewed' review_status, cluster_id = -1 noise_cluster,
        case when cluster_id = -1 then (select count(*) from assign where cluster_id = -1) end noise_cards, case when cluster_id = -1 then round((select count(*) filter (cluster_id = -1) / greatest(1, count(*)) from assign), 6) end noise_ratio,
        case when cluster_id = -1 then coalesce(({_NOISE.format("coalesce(type, 'unknown')", "assign left join cards on id = card_id where cluster_id = -1", 10)}), '{{}}') end noise_types,
        case when cluster_id = -1 then coalesce(({_NOISE.format("coalesce(archetype, 'unknown')", "assign left join cards on id = card_id where cluster_id = -1", 10)}), '{{}}') end noise_archetypes,
        case when cluster_id = -1 then coalesce(({_NOISE.format("cast(id as varchar)", "near", 15)}), '{{}}') end noise_nearest_clusters
      from q join m using (cluster_id) join rol using (cluster_id) join typ using (cluster_id) join arc using (cluster_id) left join w using (cluster_id) join r using (cluster_id)""", "assign", "cards"),
    "label_ingest": with_views(f"""with {ROLE}, e as (select event_id, cast(user_id % 12 as integer) cluster_id, user_id, event_type, event_id % 8 k, coalesce(functional_role, 'misc') r from events left join rol on rol.cluster_id = user_id % 12)
      select event_id, cluster_id, case k when 1 then 'draw' when 2 then 'removal' when 3 then 'misc' else r end functional_role, case k when 1 then 'h' || event_id when 2 then 'removal' when 3 then 'misc' else replace(r, '_', ' ') end label_hint,
        round(case k when 1 then 0.9 when 2 then 0.5 when 3 then cast('0.' || user_id as double) else 0.55 end::double, 6) label_confidence, case k when 1 then left(repeat(event_type || '-', 100), 400) when 2 then 'r' || event_id when 3 then '' else 'heuristic:' || r end reasoning,
        case when k in (1, 2, 3) then 'answer' else 'heuristic:' || r end label_source, case k when 0 then 'not_json' when 4 then 'empty_list' when 5 then 'list_without_object' when 6 then 'no_object' when 7 then 'bad_confidence' else '' end failure from e""", "assign", "cards"),
}
