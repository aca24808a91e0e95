"""Decks from specs, in rounds: attempts of every open slot are drafted, validated, repaired where that can help, and the
first valid one of each slot is kept; slots without one go on to the next, larger round until the attempts are used up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash01
from ..shared import saved
from . import sampling as S

#: Failures that a repair of sizes can't mend (fixed values).
BEYOND_REPAIR = ("material_requirements_ok", "type_ratio_ok")


@dataclass(frozen=True)
class Plan:
    ratios: dict[str, float] = field(default_factory=lambda: {"monster": 0.5, "spell": 0.3, "trap": 0.2})
    extra_size: int = 15
    attempts: int = 50
    first_round: int = 2
    growth: int = 4
    draws: int = 12
    p_staple: float = 0.2
    novelty: float = 0.25
    near: float = 0.67
    far: float = 0.33
    seed: int = 1


def drafts(specs: DataFrame, attempts: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """A spec for each attempt from start to before stop (of `attempts`) of each slot; deck_id becomes slot * attempts +
    attempt."""
    rows = specs.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit((attempts if stop is None else stop) - 1))))
    return rows.withColumns({"slot": F.col("deck_id"), "deck_id": F.col("deck_id") * attempts + F.col("attempt")})


def staple_offers(specs: DataFrame, staples: DataFrame, p: float, seed: int) -> DataFrame:
    """Each staple with chance p * weight, in the pool's order."""
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(p) * F.col("weight")))
    drawn = specs.join(staples, "pool").where(hash01(seed, F.lit("staple"), "deck_id", "card_id") < chance)
    return drawn.withColumns({"nth": F.col("card_id"), "want": S.desired(seed)})


def main_offers(specs: DataFrame, picks: DataFrame, candidates: DataFrame, tags: DataFrame, pairs: DataFrame, allowed: DataFrame, staples: DataFrame, plan: Plan) -> DataFrame:
    """All that the main decks may take, in the order in which they take it."""
    main = candidates.where("not in_extra and max_copies > 0")
    support = S.support_injection(specs, picks, candidates, tags, pairs, plan.seed)
    order = F.row_number().over(Window.partitionBy("deck_id").orderBy("reason", "nth", "card_id"))
    novelty = S.novelty_picks(specs, main, allowed, plan.novelty, plan.near, plan.far, plan.seed)
    novelty = novelty.withColumns({"nth": F.col("nth") + F.when(F.col("side") == "far", 1000).otherwise(0), "want": S.desired(plan.seed)})
    parts = (S._offers(support.withColumn("nth", order), S.SUPPORT), S._offers(staple_offers(specs, staples.where("max_copies > 0"), plan.p_staple, plan.seed), S.STAPLE),
             S._offers(novelty, S.NOVELTY), S.fill_offers(specs, main, plan.ratios, plan.seed))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def draft_decks(specs: DataFrame, candidates: DataFrame, tags: DataFrame, pairs: DataFrame, allowed: DataFrame, staples: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Extra picks (deck_id, card_id, draws, ...) and main cards (deck_id, card_id, bucket, stage, copies) of drafts."""
    picks = saved(S.feasible_extra(specs, candidates, tags, pairs, plan.extra_size, plan.draws, plan.seed), "extra-picks")
    return picks, S.place(specs, main_offers(specs, picks, candidates, tags, pairs, allowed, staples, plan), plan.ratios)


def draft_entries(specs: DataFrame, picks: DataFrame, main: DataFrame) -> DataFrame:
    """deck_id, pool, main_size, zone, card_id, copies, stage of drafts: a card stands at the first stage that placed it."""
    own = main.groupBy("deck_id", "card_id").agg(F.sum("copies").alias("copies"), F.min("stage").alias("stage")).withColumn("zone", F.lit("main"))
    extra = picks.select("deck_id", "card_id", F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("stage"), F.lit("extra").alias("zone"))
    return own.unionByName(extra).join(specs.select("deck_id", "pool", "main_size"), "deck_id").select("deck_id", "pool", "main_size", "zone", "card_id", "copies", "stage")


def accepted(entries: DataFrame, extra_size: int, candidates: DataFrame, validated: Callable[[DataFrame], DataFrame], attempts: int) -> DataFrame:
    """The first valid draft of each slot, or its last one, rejected.

    entries: as draft_entries gives them; validated: entries -> deck_id, failed, ok. Drafts that fail in other ways than
    BEYOND_REPAIR are cut or filled to their specs' sizes and judged again; what was placed first stays. Returns slot, attempt,
    status, resamples (invalid attempts before), repairs, failed, main and extra (card_id and copies, by id).
    """
    entries = saved(entries, "drafts")
    first = saved(validated(entries).select("deck_id", "failed", "ok"), "judged")
    mendable = first.where(~F.col("ok") & (F.size(F.array_except("failed", F.array(*map(F.lit, BEYOND_REPAIR)))) > 0)).select("deck_id")
    broken = entries.join(mendable, "deck_id", "left_semi")
    mend = lambda zone, size, test: S.size_repair(broken.where(F.col("zone") == zone), candidates.where(test).select("pool", "card_id"), size).withColumn("zone", F.lit(zone))
    specs = entries.select("deck_id", "pool", "main_size").distinct()
    mended = saved(mend("main", F.col("main_size"), "not in_extra and max_copies > 0").unionByName(mend("extra", extra_size, "in_extra and max_copies > 0")).withColumn("stage", F.lit(0).cast("bigint")).join(specs, "deck_id"), "mended")
    again = validated(mended.select(*entries.columns)).select("deck_id", "failed", "ok")
    judged = first.join(mendable, "deck_id", "left_anti").unionByName(again)
    repairs = mended.select("deck_id", "zone", "repairs").distinct().groupBy("deck_id").agg(F.sum("repairs").alias("repairs"))
    both = entries.join(mendable, "deck_id", "left_anti").unionByName(mended.select(*entries.columns))
    cards = lambda zone: F.array_sort(F.collect_list(F.when(F.col("zone") == zone, F.struct("card_id", "copies"))))
    decks = both.groupBy("deck_id").agg(cards("main").alias("main"), cards("extra").alias("extra"))
    rows = judged.join(decks, "deck_id").join(repairs, "deck_id", "left").withColumns({"slot": F.expr(f"deck_id div {attempts}"), "attempt": (F.col("deck_id") % attempts).cast("int"), "repairs": F.coalesce("repairs", F.lit(0))})
    best = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt"))))
    tries = F.when(F.col("ok"), F.col("attempt")).otherwise(F.lit(attempts))
    chosen = rows.withColumn("nth", best).where("nth = 1")
    return chosen.select("slot", "attempt", F.when(F.col("ok"), "accepted").otherwise("rejected").alias("status"), tries.alias("resamples"), "repairs", "failed", "main", "extra")


def check_pools(specs: DataFrame, candidates: DataFrame) -> None:
    """A pool without main cards that may be taken is an error, as its slots could never be filled."""
    full = candidates.where("not in_extra and max_copies > 0").select("pool").distinct()
    empty = [r["pool"] for r in specs.select("pool").distinct().join(full, "pool", "left_anti").orderBy("pool").limit(10).collect()]
    if empty:
        raise RuntimeError(f"no main cards in pools {empty}")


def generated(specs: DataFrame, draft: Callable[[DataFrame], tuple[DataFrame, DataFrame]], candidates: DataFrame, validated: Callable[[DataFrame], DataFrame], plan: Plan, wanted: int = 0) -> DataFrame:
    """A deck for each slot (a spec), as accepted() gives them, in rounds of more and more attempts.

    draft: specs of drafts -> (extra picks, main cards). Only slots that are still open are drafted again, and there is an end
    when none is left or the plan's attempts are used up. Empty pools and fewer than `wanted` accepted decks are errors.
    """
    check_pools(specs, candidates)
    open_, rounds, start, width = specs, [], 0, plan.first_round
    while True:
        stop = min(plan.attempts, start + width)
        rows = drafts(open_, plan.attempts, start, stop)
        decks = saved(accepted(draft_entries(rows, *draft(rows)), plan.extra_size, candidates, validated, plan.attempts), "round")
        if stop == plan.attempts:
            rounds.append(decks)
            break
        rounds.append(decks.where("status = 'accepted'"))
        open_ = saved(open_.join(rounds[-1].select(F.col("slot").alias("deck_id")), "deck_id", "left_anti"), "open-slots")
        if not open_.limit(1).count():
            break
        start, width = stop, width * plan.growth
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    if wanted:
        require(out, wanted)
    return out


def require(decks: DataFrame, wanted: int) -> DataFrame:
    """The accepted decks; fewer than wanted is an error."""
    found = decks.where("status = 'accepted'")
    n = found.count()
    if n < wanted:
        raise RuntimeError(f"{n} of {wanted} decks were accepted")
    return found
