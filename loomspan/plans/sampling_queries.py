"""Sampling and density-clustering queries. Deck specs are the nations and customers; a card's pool is its id modulo 5 or 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import composite_weight, has_type, is_extra, sampling_bucket
from ..operators import clusters as C
from ..operators import density as DN
from ..operators import generation as G
from ..operators import neighbours as N
from ..operators import sampling as SA
from ..operators import scoring as SC
from ..operators import validation as V
from ..shared import grown, saved
from .adapters import rounded, table, view, with_views

S = SparkSession
RATIOS = {"monster": 0.5, "spell": 0.3, "trap": 0.2}


def _specs(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("deck_id"), (F.col("n_nationkey") % 5).cast("bigint").alias("pool"), (F.lit(40) + F.col("n_nationkey") % 3).cast("int").alias("main_size"))


def _candidates(spark: S, d: str) -> DataFrame:
    kind, low = F.col("type"), F.lower("type")
    extra = F.when(low.contains("fusion"), "fusion").when(low.contains("synchro"), "synchro").when(low.contains("xyz"), "xyz").when(low.contains("link"), "link")
    return view(spark, d, "cards").select(
        F.col("id").alias("card_id"), (F.col("id") % 5).cast("bigint").alias("pool"), sampling_bucket(kind).alias("bucket"), F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 50 == 1, 1).otherwise(3).alias("max_copies"),
        (F.lit(0.5) + F.col("id") % 4 / 4.0).alias("weight"), (F.col("id") % 11).alias("cluster_id"), is_extra(kind).alias("in_extra"), extra.alias("extra_type"), "level", low.contains("tuner").alias("is_tuner"), has_type(kind, "effect").alias("is_effect"),
        F.col("scale").isNotNull().alias("is_pendulum"), "scale", (has_type(kind, "spell") & (F.col("id") % 9 == 0)).alias("is_enabler"), "attribute")


def _main(spark: S, d: str) -> DataFrame:
    return _candidates(spark, d).where("not in_extra")


def _allowed(specs: DataFrame, slot: str = "deck_id") -> DataFrame:
    """Two clusters for each deck."""
    return specs.select("deck_id", F.explode(F.array(F.col(slot) % 11, (F.col(slot) + 3) % 11)).alias("cluster_id"))


def _material(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Each third extra card asks for monsters of its attribute; the pools' monsters by attribute."""
    c = _candidates(spark, d)
    tags = c.where("in_extra and card_id % 3 = 0").select("card_id", F.col("attribute").alias("tag"), (F.lit(1) + F.col("card_id") % 2).alias("needed"))
    return tags, c.where("not in_extra and bucket = 'monster' and max_copies > 0").select("pool", F.col("attribute").alias("tag"), "card_id", "bucket", "max_copies")


def _staples(spark: S, d: str) -> DataFrame:
    """A staple pool: the cards of a fourteenth of the ids."""
    return _main(spark, d).where("card_id % 14 = 3")


def quota_fill(spark: S, d: str) -> DataFrame:
    return SA.quota_fill(_specs(spark, d), _main(spark, d), RATIOS)


def weighted_fill(spark: S, d: str) -> DataFrame:
    """quota_fill with cards drawn by their composite weights."""
    k = F.col("card_id")
    weight = composite_weight(F.col("weight").cast("double"), (k % 10) / F.lit(10.0).cast("double"), F.lit(None).cast("double"), (k % 20) / F.lit(10.0).cast("double"))
    return SA.quota_fill(_specs(spark, d), _main(spark, d), RATIOS, weight=weight)


def novelty_picks(spark: S, d: str) -> DataFrame:
    specs = _specs(spark, d)
    return SA.novelty_picks(specs, _main(spark, d), _allowed(specs), 0.25).select("deck_id", "card_id", "side")


def staple_picks(spark: S, d: str) -> DataFrame:
    return SA.staple_picks(_specs(spark, d), _candidates(spark, d).where("not in_extra and max_copies > 0 and card_id % 7 < 3"), 0.2, RATIOS, slack=6)


def size_repair(spark: S, d: str) -> DataFrame:
    entries = view(spark, d, "entries").withColumn("pool", F.col("deck_id") % 100)
    return SA.size_repair(entries, view(spark, d, "cards").select(F.col("id").alias("card_id"), (F.col("id") % 100).alias("pool")), 8)


def extra_sample(spark: S, d: str) -> DataFrame:
    """The first feasible draw of up to 15 extra cards, and which draw it was."""
    tags, pairs = _material(spark, d)
    return SA.feasible_extra(_specs(spark, d), _candidates(spark, d), tags, pairs, 15).select("deck_id", "card_id", "extra_type", "draws")


def support_injection(spark: S, d: str) -> DataFrame:
    tags, pairs = _material(spark, d)
    specs, cards = _specs(spark, d), _candidates(spark, d)
    picks = SA.feasible_extra(specs, cards, tags, pairs, 15)
    return SA.support_injection(specs, picks, cards, tags, pairs).select("deck_id", "reason", "card_id", "want")


PLAN = G.Plan(RATIOS)
#: Attempts of the queries that show drafts, and accepted decks without which generation is an error.
DRAFTS_SHOWN, WANTED = 3, 5


def _drafted(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts' specs, extra picks and main cards: three attempts for each nation."""
    tags, pairs = _material(spark, d)
    specs = G.drafts(_specs(spark, d), DRAFTS_SHOWN)
    return specs, *G.draft_decks(specs, _candidates(spark, d), tags, pairs, _allowed(specs, "slot"), _staples(spark, d), PLAN)


def draft_decks(spark: S, d: str) -> DataFrame:
    """The main cards of every draft, by the stage that placed them."""
    return _drafted(spark, d)[2]


def _generated(spark: S, d: str, plan: G.Plan = PLAN) -> DataFrame:
    enabler = has_type(F.col("type"), "spell") & (F.col("id") % 9 == 0)
    cards = view(spark, d, "cards").withColumn("name", F.when(enabler, F.initcap(F.lit(V.FUSION_ENABLERS[0]))).otherwise(F.col("name")))
    (tags, pairs), candidates, staples = _material(spark, d), _candidates(spark, d), _staples(spark, d)
    limits = candidates.where("max_copies < 3").select("card_id", "max_copies")

    def draft(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return G.draft_decks(specs, candidates, tags, pairs, _allowed(specs, "slot"), staples, plan)

    def validated(of: DataFrame) -> DataFrame:
        known = SC.deck_entries(of.drop("pool", "main_size", "stage"), cards)
        ok = V.deck_support(known, tags, pairs.select("tag", "card_id")).groupBy("deck_id").agg(F.bool_and(F.col("found") >= F.col("needed")).alias("material_ok"))
        rule = F.struct("main_size", F.lit(0).alias("extra_min"), F.lit(plan.extra_size).alias("extra_max"), F.lit(None).cast("string").alias("release_cutoff"), *(F.lit(x).alias(b) for b, x in plan.ratios.items()), F.lit(4).alias("tolerance"))
        return V.validate_decks(known, limits, ok, of.select("deck_id", rule.alias("rule")).distinct())

    return G.generated(_specs(spark, d), draft, candidates, validated, plan, WANTED)


def generate_decks(spark: S, d: str) -> DataFrame:
    """Slots with their first valid draft, or their last, rejected."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["card_id"], x["copies"])), ",").alias(c)
    return _generated(spark, d).select("slot", "attempt", "status", "resamples", "repairs", F.array_join("failed", "|").alias("failed"), joined("main"), joined("extra"))


def accept_first(spark: S, d: str) -> DataFrame:
    """The first draft of each slot that has 22 different main cards or more."""
    specs, _, main = _drafted(spark, d)
    several = main.groupBy("deck_id").agg(F.count_distinct("card_id").alias("n"))
    drafts = specs.join(several, "deck_id", "left").select(F.col("slot").alias("deck_id"), "attempt", (F.coalesce("n", F.lit(0)) >= 22).alias("ok"))
    return SA.accept_first(drafts)


def ratio_jitter(spark: S, d: str) -> DataFrame:
    return rounded(SA.ratio_jitter(table(spark, d, "customer").select(F.col("c_custkey").alias("deck_id")), RATIOS, 0.05))


def _vectors(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("card_id"), "embedding")


def density_clusters(spark: S, d: str) -> DataFrame:
    v = _vectors(spark, d)
    trials = DN.trial_grid(spark, [1.14], [3], [3])
    return rounded(DN.vector_clusters(v, trials).drop("trial"))


def neighbour_pairs(spark: S, d: str) -> DataFrame:
    """Pairs of vectors within a distance that few of them have."""
    return rounded(N.neighbour_pairs(_vectors(spark, d), 1.05))


def sweep_trials(spark: S, d: str) -> DataFrame:
    """One row for each trial of a grid: cluster metrics, structural, semantic and final score and guardrails, over distances
    that all trials share."""
    v = _vectors(spark, d)
    trials = DN.trial_grid(spark, [1.10, 1.12, 1.14], [2, 3], [2, 4])
    found = saved(DN.vector_clusters(v, trials), "trials")
    m = C.guardrails(C.structural_score(C.cluster_metrics(found, ["trial"])), few=5, noise=0.9, largest=0.2, tiny=0.1)
    meaning = C.semantic_score(C.semantic_metrics(found.join(grown(v), "card_id"), view(spark, d, "cards"), ["trial"])).select("trial", "semantic_score")
    m = m.join(meaning, "trial").withColumn("final_score", F.col("structural_score") + F.col("semantic_score"))
    return rounded(m.select("trial", "num_clusters", "noise_count", "size_max", "largest_ratio", "tiny_ratio", "mean_prob", "structural_score", "semantic_score", "final_score", "is_good_run"), 5)


def rank_trials(spark: S, d: str) -> DataFrame:
    """The five best trials by final score and by structural score."""
    m = sweep_trials(spark, d)
    place = lambda c: F.row_number().over(C.Window.orderBy(F.desc(c), "trial"))  # noqa: E731  (a row for each trial of the grid)
    ranked = m.withColumns({"final_place": place("final_score"), "structural_place": place("structural_score")})
    return ranked.where("final_place <= 5 or structural_place <= 5").select("trial", "structural_score", "final_score", "final_place", "structural_place")


def best_run(spark: S, d: str) -> DataFrame:
    """The run with the best final score, with all its figures."""
    m = sweep_trials(spark, d)
    return m.agg(F.max(F.struct(F.col("final_score").alias("best"), (-F.col("trial")).alias("t"), *m.columns[1:])).alias("b")).select((-F.col("b.t")).alias("trial"), *(F.col(f"b.{c}").alias(c) for c in m.columns[1:]))


def pca_reduce(spark: S, d: str) -> DataFrame:
    return DN.pca(_vectors(spark, d), 8)


def projection_2d(spark: S, d: str) -> DataFrame:
    return rounded(DN.pca(_vectors(spark, d), 2).select("card_id", F.lit("pca").alias("method"), F.get("reduced", F.lit(0)).alias("x"), F.get("reduced", F.lit(1)).alias("y")))


def union_projections(spark: S, d: str) -> DataFrame:
    e = _vectors(spark, d)
    flat = lambda name, i: e.select("card_id", F.lit(name).alias("method"), F.get("embedding", F.lit(i)).cast("double").alias("x"), F.get("embedding", F.lit(i + 1)).cast("double").alias("y"))
    return rounded(flat("first", 0).unionByName(flat("third", 2)))


def cluster_points(spark: S, d: str) -> DataFrame:
    points = union_projections(spark, d).where("method = 'first'")
    return view(spark, d, "assign").select("card_id", "cluster_id").join(points, "card_id", "left").dropna(subset=["x", "y"]).drop("method")


QUERIES = {f.__name__: f for f in (
    quota_fill, weighted_fill, novelty_picks, staple_picks, size_repair, accept_first, extra_sample, support_injection, draft_decks, generate_decks, ratio_jitter, neighbour_pairs, density_clusters, sweep_trials, rank_trials, best_run, pca_reduce, projection_2d, union_projections, cluster_points)}

H = "(('0x' || substr(md5({0}), 1, 8))::ubigint / 4294967296.0)"


def _h(name: str, *keys: str) -> str:
    return H.format(f"'1|{name}|' || " + " || '|' || ".join(keys or ("deck_id", "card_id")))


BASE = """specs as (select n_nationkey deck_id, n_nationkey % 5 pool, 40 + n_nationkey % 3 main_size from nation),
 cand as (select id card_id, id % 5 pool, case when type like '%Spell%' then 'spell' when type like '%Trap%' then 'trap' else 'monster' end bucket, case when id % 50 = 0 then 0 when id % 50 = 1 then 1 else 3 end max_copies, 0.5 + id % 4 / 4.0 weight, id % 11 cluster_id,
  regexp_matches(lower(type), 'fusion|synchro|xyz|link') in_extra, regexp_extract(lower(type), 'fusion|synchro|xyz|link') extra_type, level, type like '%Tuner%' is_tuner, type like '%Effect%' is_effect, scale, type like '%Spell%' and id % 9 = 0 is_enabler, attribute from cards),
 tags as (select card_id, attribute tag, 1 + card_id % 2 needed from cand where in_extra and card_id % 3 = 0),
 prs as (select pool, attribute tag, card_id, bucket, max_copies from cand where not in_extra and bucket = 'monster' and max_copies > 0)"""


def _order(of: str, groups: str, name: str) -> str:
    """Rows of a table with their rank and number in their groups' shuffled orders."""
    return f"(select *, row_number() over (partition by {groups} order by {_h(name, 'card_id')}, card_id) - 1 rk, count(*) over (partition by {groups}) mn from {of})"


def _nth(name: str, *groups: str) -> str:
    """Where a row comes when a deck reads its group's order round from its own place."""
    return f"((rk - floor({_h(name, 'deck_id', *groups)} * mn)::bigint + mn) % mn)"


WANT = f"least(case when {_h('copies')} < 0.5 then 2 else 3 end, max_copies)"
GOAL = {"monster": "round_even(main_size * 0.5, 0)", "spell": "round_even(main_size * 0.3, 0)", "trap": "(main_size - round_even(main_size * 0.5, 0) - round_even(main_size * 0.3, 0))"}
PREV = "rows between unbounded preceding and 1 preceding"
DRAFTS = "slots as (from specs), drafts as (select n_nationkey * 3 + a deck_id, n_nationkey slot, a attempt, n_nationkey % 5 pool, 40 + n_nationkey % 3 main_size from nation, range(3) t(a))"


def _extra(specs: str) -> str:
    return f"""tri as (select deck_id slot, t draw, deck_id * 12 + t deck_id, pool from {specs}, range(12) x(t)),
 pk as (select *, {_nth('extra', 'pool')} nth from tri join {_order('(select * from cand where in_extra and max_copies > 0)', 'pool', 'extra')} using (pool) where nth < 15),
 bad as (select distinct n.deck_id from (select deck_id, pool, tag, max(needed) needed from pk join tags using (card_id) group by all) n left join (select pool, tag, sum(max_copies) cap from prs group by all) c using (pool, tag) where coalesce(cap, 0) < needed),
 cho as (select slot, coalesce(min(draw) filter (deck_id not in (from bad)), 11) draw from tri group by 1),
 picks as (select slot deck_id, pool, card_id, extra_type, scale is not null is_pendulum, draw + 1 draws from pk join cho using (slot, draw))"""


def _support(specs: str) -> str:
    return f"""able as (select * from cand where not in_extra and max_copies > 0), mons as (select * from able where bucket = 'monster'),
 bl as (select pool, level from mons where level is not null group by pool, level qualify row_number() over (partition by pool order by count(*) desc, level) = 1),
 kin as (select distinct s.deck_id, s.pool, k extra_type from {specs} s join (select deck_id, extra_type k from picks union all select deck_id, 'pendulum' from picks where is_pendulum) using (deck_id)),
 ofr as (select pool, card_id, bucket, max_copies, 'fusion' extra_type, '1 enabler' reason, 1 k from able where is_enabler union all select pool, card_id, bucket, max_copies, 'synchro', '2 tuner', 1 from mons where is_tuner
  union all select pool, card_id, bucket, max_copies, 'synchro', '3 non_tuner', 1 from mons where not is_tuner union all select pool, card_id, bucket, max_copies, 'xyz', '4 same_level', 2 from mons join bl using (pool, level)
  union all select pool, card_id, bucket, max_copies, 'link', '5 effect', 2 from mons where is_effect),
 ru as (select deck_id, reason, {_nth('support', 'pool', 'extra_type', 'reason')} nth, card_id, bucket, max_copies, 1 want from kin join {_order('ofr', 'pool, extra_type, reason', 'support')} using (pool, extra_type) where nth < k),
 tg as (select deck_id, '6 ' || tag reason, {_nth('tag', 'pool', 'tag')} nth, card_id, bucket, max_copies, want from (select deck_id, pool, tag, max(needed) want from picks join tags using (card_id) group by all) join {_order('prs', 'pool, tag', 'tag')} using (pool, tag) where nth < 1),
 sc as (select pool, min((scale, card_id)) lo, max((scale, card_id)) hi from mons where scale is not null group by 1),
 pp as (select pool, card_id, case when hi[1] - scale >= 2 then hi[2] when scale - lo[1] >= 2 then lo[2] end partner, 'pendulum' extra_type from mons join sc using (pool) where scale is not null),
 sp as (select deck_id, pool, card_id, partner, {_nth('scale', 'pool', 'extra_type')} nth from kin join {_order('(select * from pp where partner is not null)', 'pool, extra_type', 'scale')} using (pool, extra_type) where nth < 1),
 sup as (from ru union all from tg union all select deck_id, '7 scale', j, able.card_id, bucket, max_copies, 1 from (select deck_id, pool, 0 j, card_id c from sp union all select deck_id, pool, 1, partner from sp) x join able on able.pool = x.pool and able.card_id = c)"""


def _novelty(specs: str, slot: str) -> str:
    return f"""alw as (select deck_id, unnest([{slot} % 11, ({slot} + 3) % 11]) cluster_id from {specs}), goal as (select deck_id, pool, main_size, round_even(main_size * 0.25, 0) tot, round_even(round_even(main_size * 0.25, 0) * 0.67, 0) nn from {specs}), free as (select * from cand where not in_extra{{0}}),
 ne as (select * exclude (nth), row_number() over (partition by deck_id order by {_h('near')}, card_id) - 1 nth from (select *, {_nth('near', 'pool', 'cluster_id')} nth from goal join alw using (deck_id) join {_order('free', 'pool, cluster_id', 'near')} using (pool, cluster_id) where nth < nn) qualify row_number() over (partition by deck_id order by {_h('near')}, card_id) <= nn),
 fr as (select * exclude (nth), row_number() over (partition by deck_id order by nth) - 1 nth from (select *, {_nth('far', 'pool')} nth from goal join {_order('free', 'pool', 'far')} using (pool)) f where not exists (select 1 from alw where alw.deck_id = f.deck_id and alw.cluster_id = f.cluster_id) qualify row_number() over (partition by deck_id order by f.nth) <= tot - nn),
 nov as (select deck_id, card_id, bucket, max_copies, 'near' side, nth from ne union all select deck_id, card_id, bucket, max_copies, 'far', nth + 1000 from fr)"""


def _fill(specs: str) -> str:
    goal = f"case bucket when 'monster' then {GOAL['monster']} when 'spell' then {GOAL['spell']} else {GOAL['trap']} end"
    return f"""fl as (select deck_id, case bucket when 'monster' then 3 when 'spell' then 4 else 5 end stage, {_nth('fill', 'pool', 'bucket')} nth, card_id, bucket, max_copies, {WANT} want from {specs} join {_order('(select * from cand where not in_extra and max_copies > 0)', 'pool, bucket', 'fill')} using (pool) where nth < {goal} + main_size),
 tl as (select deck_id, 6 stage, {_nth('tail', 'pool')} nth, card_id, bucket, max_copies, {WANT} want from {specs} join {_order('(select * from cand where not in_extra and max_copies > 0)', 'pool', 'tail')} using (pool) where nth < 2 * main_size)"""


FINE = "((('0x' || substr(md5({0}), 1, 13))::ubigint)::double + 1)"
DRAW_WEIGHT = "greatest(1e-4::double, coalesce(nullif(weight::double, 0), 1) * coalesce(nullif((card_id % 10)::double / 10::double, 0), 1) * (1 - greatest(0::double, least(0.95::double, (card_id % 20)::double / 10::double))))"


def _weighted(out: str, groups: str, name: str, k: str) -> str:
    """Rows drawn one after another by weight: places on the line of weights, then -ln(u) / weight for what is lacking."""
    keys = " || '|' || ".join(["deck_id", *groups.split(", ")])
    return f"""{out}_l as (select *, coalesce(sum(units) over (partition by {groups} order by card_id {PREV}), 0) low, sum(units) over (partition by {groups}) whole, count(*) over (partition by {groups}) mn from (select *, greatest(1, floor({DRAW_WEIGHT} * 10000 + 0.5)::bigint) units from cand where not in_extra and max_copies > 0)),
 {out}_a as (select deck_id, main_size, {groups}, whole, mn, least({k}, mn)::bigint most from specs join (select distinct {groups}, whole, mn from {out}_l) using (pool)),
 {out}_t as (select *, least(whole - 1, floor(({FINE.format(f"'1|{name}|' || {keys} || '|' || t")} - 1) / 4503599627370496.0::double * whole::double)::bigint) pos from (select *, unnest(range(2 * most + 8)) t from {out}_a where most > 0)),
 {out}_h as (select a.deck_id, {', '.join('a.' + g for g in groups.split(', '))}, card_id, min(t) t from {out}_t a join {out}_l l on {' and '.join(f'a.{g} = l.{g}' for g in groups.split(', '))} and low <= pos and pos < low + units group by all),
 {out}_n as (select deck_id, {groups}, card_id, row_number() over (partition by deck_id, {groups} order by t) - 1 nth from {out}_h),
 {out}_r as (select deck_id, {groups}, card_id, row_number() over (partition by deck_id, {groups} order by -ln({FINE.format(f"'1|{name}|' || {keys} || '|' || card_id")} / 4503599627370496.0::double) / units, card_id) - 1 + got nth from (select deck_id, {groups}, card_id, units, coalesce(got, 0) got from {out}_a join {out}_l using ({groups}) left join (select deck_id, {groups}, count(*) got from {out}_n group by all) using (deck_id, {groups}) anti join {out}_n using (deck_id, {groups}, card_id))),
 {out}_w as (select deck_id, main_size, u.card_id, c.bucket, max_copies, nth from (from {out}_n union all from {out}_r) u join {out}_a using (deck_id, {groups}) join cand c on c.card_id = u.card_id where nth < most)"""


def _weighted_fill() -> str:
    goal = f"case bucket when 'monster' then {GOAL['monster']} when 'spell' then {GOAL['spell']} else {GOAL['trap']} end"
    return f"""{_weighted('wf', 'pool, bucket', 'fill', goal + ' + main_size')}, {_weighted('wt', 'pool', 'tail', '2 * main_size')},
 offers as (select deck_id, case bucket when 'monster' then 3 when 'spell' then 4 else 5 end stage, nth, card_id, bucket, max_copies, {WANT} want from wf_w union all select deck_id, 6, nth, card_id, bucket, max_copies, {WANT} from wt_w)"""


def _fold(specs: str) -> str:
    free, need = "(main_size - total)", f"greatest(0, {GOAL['monster']} - m) + greatest(0, {GOAL['spell']} - s) + greatest(0, {GOAL['trap']} - t)"
    used = "coalesce(list_sum(list_transform(list_filter(placed, lambda p: p.card_id = o.card_id), lambda p: p.copies)), 0)"
    short = f"case bucket when 'monster' then m < {GOAL['monster']} when 'spell' then s < {GOAL['spell']} else t < {GOAL['trap']} end"
    return f"""ord as (select *, row_number() over (partition by deck_id order by stage, nth, card_id) i from offers join (select deck_id, main_size from {specs}) using (deck_id)),
 fold(deck_id, i, total, m, s, t, placed) as (select deck_id, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, []::struct(card_id bigint, bucket varchar, stage bigint, copies bigint)[] from {specs} union all
  select deck_id, i, total + n, m + case bucket when 'monster' then n else 0 end, s + case bucket when 'spell' then n else 0 end, t + case bucket when 'trap' then n else 0 end,
   case when n > 0 then list_append(placed, {{'card_id': card_id, 'bucket': bucket, 'stage': stage, 'copies': n}}) else placed end
  from (select f.deck_id, o.i, total, m, s, t, placed, o.card_id::bigint card_id, bucket, stage::bigint stage, (case when (case when stage in (1, 2) then {free} > {need} when stage in (0, 6) then true else {short} end)
   then greatest(0, least(want, max_copies - {used}, {free})) else 0 end)::bigint n from fold f join ord o on o.deck_id = f.deck_id and o.i = f.i + 1)),
 put as (select deck_id, unnest(placed, recursive := true) from (select * from fold qualify row_number() over (partition by deck_id order by i desc) = 1))"""


DRAFTED = f"""{DRAFTS}, {_extra('drafts')}, {_support('drafts')}, {_novelty('drafts', 'slot').format(' and max_copies > 0')}, {_fill('drafts')},
 offers as (select deck_id, 0 stage, row_number() over (partition by deck_id order by reason, nth, card_id) nth, card_id, bucket, max_copies, want from sup
  union all select deck_id, 1, card_id, card_id, bucket, max_copies, {WANT} from drafts join (select * from cand where not in_extra and max_copies > 0 and card_id % 14 = 3) using (pool) where {_h('staple')} < greatest(0, least(1, 0.2 * weight))
  union all select deck_id, 2, nth, card_id, bucket, max_copies, {WANT} from nov union all select * from fl union all select * from tl), {_fold('drafts')}"""
DENSE = """e as (select vec_id id, cast(embedding as double[]) v from embeddings), pr as (select a.id a, b.id b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) d from e a join e b on a.id < b.id),
 pairs as (select trial, eps, ms, mc, a, b, d from pr join trials on d <= eps), bo as (select * from pairs union all select trial, eps, ms, mc, b, a, d from pairs),
 core as (select trial, a c from bo group by trial, a, ms having count(*) + 1 >= ms), ln as (select bo.trial, a, b from bo join core x on x.trial = bo.trial and x.c = a join core y on y.trial = bo.trial and y.c = b),
 reach(trial, c, r) as (select trial, c, c from core union select ln.trial, ln.b, r from reach join ln on ln.trial = reach.trial and ln.a = reach.c),
 root as (select trial, c, min(r) r from reach group by 1, 2),
 mem as (select trial, c id, r, 1.0::double prob from root union all (select bo.trial, bo.a, r, greatest(0, 1 - d / eps) from bo join root on root.trial = bo.trial and root.c = bo.b where (bo.trial, bo.a) not in (select (trial, c) from core) qualify row_number() over (partition by bo.trial, bo.a order by d, root.c) = 1)),
 num as (select mem.trial, r, row_number() over (partition by mem.trial order by min(id)) - 1 k from mem join trials using (trial) group by mem.trial, r, mc having count(*) >= mc),
 clu as (select t.trial, e.id card_id, coalesce(k, -1) cluster_id, case when k is null then 0 else prob end prob from e cross join trials t left join mem on mem.trial = t.trial and mem.id = e.id left join num on num.trial = t.trial and num.r = mem.r)"""
GRID = "trials as (select row_number() over (order by eps, ms, mc) - 1 trial, eps::double eps, ms, mc from (values (1.10), (1.12), (1.14)) x(eps), (values (2), (3)) y(ms), (values (2), (4)) z(mc))"
SWEEP = """met as (select trial, count(*) filter (cluster_id <> -1) k, coalesce(sum(n) filter (cluster_id = -1), 0) nn, sum(n) t, coalesce(max(n) filter (cluster_id <> -1), 0) mx, coalesce(sum(n) filter (cluster_id <> -1 and n <= 3), 0) tiny, coalesce(sum(p) filter (cluster_id <> -1) / sum(n) filter (cluster_id <> -1), 0) mp from (select trial, cluster_id, count(*) n, sum(prob) p from clu group by 1, 2) group by 1),
 swp as (select *, round(0.4 * least(k / 100.0, 1) - 0.25 * nn / t - 0.15 * mx / t - 0.1 * tiny / t + 0.1 * mp - case when k < 50 then 1 else 0 end - case when nn / t > 0.3 then 1 else 0 end, 5) s from met),
 tun as (select trial, clu.card_id, cluster_id, u from clu join (select id card_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from e) using (card_id) where cluster_id <> -1),
 tcen as (select trial, cluster_id, list(x order by pos) c from (select trial, cluster_id, pos, avg(x) x from (select trial, cluster_id, unnest(u) x, generate_subscripts(u, 1) pos from tun) group by all) group by all),
 tcoh as (select trial, cluster_id, case when count(*) > 1 then avg(greatest(-1, least(1, list_dot_product(u, c) / sqrt(list_dot_product(c, c))))) else 0 end coherence from tun join tcen using (trial, cluster_id) group by all),
 tper as (select trial, cluster_id, max(n) / sum(n) purity, coalesce(sum(n) filter (lower(a) in ('generic', 'none', 'unknown', 'other', 'misc')), 0) / sum(n) g, sum(n) n, sum(p) p from (select trial, cluster_id, coalesce(archetype, 'unknown') a, count(*) n, sum(prob) p from clu left join cards on cards.id = card_id where cluster_id <> -1 group by all) group by all),
 tsem as (select trial, avg(purity) pu, avg(coherence) co, sum(p) / sum(n) lc, greatest(0, 1 - abs(avg(case when g >= 0.6 then 1 else 0 end) - avg(case when 1 - g >= 0.6 then 1 else 0 end))) ba from tper join tcoh using (trial, cluster_id) group by 1),
 tmix as (select swp.*, coalesce(pu, 0) pu, coalesce(co, 0) co, coalesce(lc, 0) lc, coalesce(ba, 0.5) ba from swp left join tsem using (trial)),
 fin as (select *, 0.4 * least(k / 100.0, 1) - 0.25 * nn / t - 0.15 * mx / t - 0.1 * tiny / t + 0.1 * mp - case when k < 50 then 1 else 0 end - case when nn / t > 0.3 then 1 else 0 end s0,
  0.1 * (greatest(0, 1 - abs(pu - 0.65) / 0.65) - case when pu > 0.9 then 2 * (pu - 0.9) else 0 end) + 0.2 * greatest(0, least(1, co)) + 0.05 * greatest(0, least(1, lc)) + 0.1 * greatest(0, least(1, ba)) se from tmix),
 swf as (select *, round(se, 5) semantic_score, round(s0 + se, 5) final_score from fin)"""
SWEPT = "cast(trial as integer) trial, k num_clusters, nn noise_count, mx size_max, round(mx / t, 5) largest_ratio, round(tiny / t, 5) tiny_ratio, round(mp, 5) mean_prob, s structural_score, semantic_score, final_score, nn / t < 0.9 and k >= 5 and mx / t < 0.2 is_good_run"

ORACLE_SQL = {
    "quota_fill": with_views(f"with recursive {BASE}, {_fill('specs')}, offers as (from fl union all from tl), {_fold('specs')} select deck_id, card_id, bucket, cast(sum(copies) as bigint) copies from put group by all", "cards"),
    "weighted_fill": with_views(f"with recursive {BASE}, {_weighted_fill()}, {_fold('specs')} select deck_id, card_id, bucket, cast(sum(copies) as bigint) copies from put group by all", "cards"),
    "novelty_picks": with_views(f"with {BASE}, {_novelty('specs', 'deck_id').format('')} select deck_id, card_id, side from nov", "cards"),
    "extra_sample": with_views(f"with {BASE}, {_extra('specs')} select deck_id, card_id, extra_type, draws from picks", "cards"),
    "support_injection": with_views(f"with {BASE}, {_extra('specs')}, {_support('specs')} select deck_id, reason, card_id, want from sup", "cards"),
    "draft_decks": with_views(f"with recursive {BASE}, {DRAFTED} select * from put", "cards"),
    "accept_first": with_views(f"""with recursive {BASE}, {DRAFTED}, nv as (select slot, attempt, count(distinct card_id) >= 22 ok from drafts left join put using (deck_id) group by 1, 2), b as (select slot, min(attempt) filter (ok) attempt from nv group by 1)
      select slot deck_id, b.attempt, count(*) filter (b.attempt is null or nv.attempt < b.attempt) resamples, case when b.attempt is null then 'rejected' else 'accepted' end status from b join nv using (slot) group by slot, b.attempt""", "cards"),
    "staple_picks": with_views(f"""with {BASE}, r as (select *, {WANT} want from specs join cand using (pool) where not in_extra and max_copies > 0 and card_id % 7 < 3 and {_h('staple')} < greatest(0, least(1, 0.2 * weight))),
      f as (select *, main_size - coalesce(sum(want) over w, 0) free, {' + '.join(f"greatest(0, {g} - coalesce(sum(want) filter (bucket = '{b}') over w, 0))" for b, g in GOAL.items())} need from r window w as (partition by deck_id order by card_id {PREV})),
      s as (select *, max(case when free <= 0 or free + 6 <= need then 1 else 0 end) over (partition by deck_id order by card_id) stopped from f)
      select deck_id, card_id, least(want, free) copies from s where stopped = 0""", "cards"),
    "size_repair": with_views(f"""with k as (select *, greatest(0, least(copies, 8 - coalesce(sum(copies) over (partition by deck_id order by card_id {PREV}), 0))) kept from entries), t as (select deck_id, deck_id % 100 pool, sum(copies) total from entries group by 1, 2),
      f as (select deck_id, card_id, total from (select *, {_nth('repair', 'pool')} nth from t join {_order('(select id card_id, id % 100 pool from cards)', 'pool', 'repair')} using (pool) where total < 8) x where not exists (select 1 from entries e where e.deck_id = x.deck_id and e.card_id = x.card_id) qualify row_number() over (partition by deck_id order by nth) <= 8 - total)
      select u.deck_id, card_id, copies, cast(coalesce(n, 0) + (total > 8)::int as integer) repairs from (select deck_id, card_id, cast(kept as bigint) copies from k where kept > 0 union all select deck_id, card_id, 1 from f) u join t using (deck_id) left join (select deck_id, count(*) n from f group by 1) using (deck_id)""", "cards", "entries"),
    "ratio_jitter": """with d as (select c_custkey deck_id, i, 0.5::double + 0.05::double * (2 * (('0x' || substr(md5('1|monster|' || c_custkey || '|' || i), 1, 8))::ubigint / 4294967296.0) - 1) m, 0.3::double + 0.05::double * (2 * (('0x' || substr(md5('1|spell|' || c_custkey || '|' || i), 1, 8))::ubigint / 4294967296.0) - 1) s from customer, range(200) t(i)),
      f as (select * from d where abs(1 - m - s - 0.2) <= 0.05 qualify row_number() over (partition by deck_id order by i) = 1)
      select c_custkey deck_id, round(coalesce(m, 0.5), 6) monster, round(coalesce(s, 0.3), 6) spell, round(1 - coalesce(m, 0.5) - coalesce(s, 0.3), 6) trap from customer left join f on deck_id = c_custkey""",
    "neighbour_pairs": "with e as (select vec_id id, cast(embedding as double[]) v from embeddings), p as (select a.id a, b.id b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) d from e a join e b on a.id < b.id) select a, b, round(d, 6) d from p where d <= 1.05",
    "density_clusters": f"with recursive trials as (select 0 trial, 1.14::double eps, 3 ms, 3 mc), {DENSE} select card_id, cast(cluster_id as integer) cluster_id, round(prob, 6) prob from clu",
    "sweep_trials": with_views(f"with recursive {GRID}, {DENSE}, {SWEEP} select {SWEPT} from swf", "cards"),
    "rank_trials": with_views(f"with recursive {GRID}, {DENSE}, {SWEEP}, pl as (select cast(trial as integer) trial, s structural_score, final_score, cast(row_number() over (order by final_score desc, trial) as integer) final_place, cast(row_number() over (order by s desc, trial) as integer) structural_place from swf) select * from pl where final_place <= 5 or structural_place <= 5", "cards"),
    "best_run": with_views(f"with recursive {GRID}, {DENSE}, {SWEEP} select {SWEPT} from swf order by final_score desc, trial limit 1", "cards"),
    "union_projections": "select vec_id card_id, 'first' \"method\", round(embedding[1]::double, 6) x, round(embedding[2]::double, 6) y from embeddings union all select vec_id, 'third', round(embedding[3]::double, 6), round(embedding[4]::double, 6) from embeddings",
    "cluster_points": "select vec_id card_id, case when label = 0 then -1 else label end cluster_id, round(embedding[1]::double, 6) x, round(embedding[2]::double, 6) y from embeddings",
}
