"""Seeded, order-free deck sampling: every draw is a hash of the seed and the keys, so results don't depend on partitioning.

Specs are rows (deck_id, pool, main_size, ...); candidates (pool, card_id, bucket, max_copies, ...) meet them on the pool. A
pool has one shuffled order for each purpose, and each deck reads it round from a place of its own, so a deck meets as many
rows as it may need and not its whole pool. A main deck is then placed offer by offer, in one fold over the deck's offers,
whose number is bounded by its size: extra-deck support, staples, novelty, the buckets' quotas, and the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash01
from ..shared import by_key, grown

BUCKETS = ("monster", "spell", "trap")


def targets(size: Column, ratios: dict[str, float]) -> dict[str, Column]:
    """Slots for each bucket: rounded half to even, traps take the rest."""
    monster, spell = (F.bround(size * F.lit(ratios[b]), 0).cast("int") for b in BUCKETS[:2])
    return {"monster": monster, "spell": spell, "trap": size - monster - spell}


def _by_bucket(values: dict[str, Column]) -> Column:
    return F.when(F.col("bucket") == "monster", values["monster"]).when(F.col("bucket") == "spell", values["spell"]).otherwise(values["trap"])


def desired(seed: int) -> Column:
    """Two or three copies, cut to the card's limit."""
    return F.least(F.when(hash01(seed, F.lit("copies"), "deck_id", "card_id") < 0.5, 2).otherwise(3), F.col("max_copies"))


def dealt(specs: DataFrame, rows: DataFrame, groups: list[str], k: Column | None, seed: int, name: str) -> DataFrame:
    """Each deck's first k rows (all, if None) of its groups, in the group's shuffled order, read round from the deck's place:
    the columns of both and nth, from 0. Groups are columns of the rows, the first of them columns of the specs too."""
    own = Window.partitionBy(*groups)
    ranked = rows.withColumns({"rank": F.row_number().over(own.orderBy(hash01(seed, F.lit(name), "card_id"), "card_id")) - 1, "many": F.count(F.lit(1)).over(own)})
    sizes = ranked.select(*groups, "many").distinct()
    most = (F.col("many") if k is None else F.least(k, F.col("many"))).cast("int")
    asked = specs.join(sizes, [g for g in groups if g in specs.columns]).where(most > 0).withColumn("nth", F.explode(F.sequence(F.lit(0), most - 1)))
    start = F.floor(hash01(seed, F.lit(name), "deck_id", *groups) * F.col("many"))
    asked = asked.withColumn("rank", ((start + F.col("nth")) % F.col("many")).cast("int"))
    return asked.join(grown(ranked.drop("many")), [*groups, "rank"]).drop("rank", "many")


#: Units of a weight of 1: weights are drawn by whole numbers of units, at least one.
UNITS = 10_000
#: Values of a fine draw (13 hex digits).
FINE = float(1 << 52)


def _fine(*keys: Column | str | int) -> Column:
    """A number from 1 to FINE that depends on the keys alone: hash01 with 52 bits."""
    text = F.concat_ws("|", *((F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1


def weighted(specs: DataFrame, rows: DataFrame, groups: list[str], k: Column, seed: int, name: str, weight: Column, tries: int | None = None) -> DataFrame:
    """Like dealt, but each deck's k rows come one after another, each with a chance in proportion to its weight among those
    not yet drawn (k at least the group's number: all of them, in that order).

    A group's weights lie end to end on a line that is cut into as many equal cells as it has rows. A try is a place on the
    line: it meets the one or two rows (on average) that reach into its cell, by an equi-join, and a row that was drawn before
    is passed over. A deck that has not k rows after 2 k + 8 tries orders the rows it lacks by -ln(u) / weight, which goes on
    with the same chances; only such decks meet their whole group.
    """
    own = Window.partitionBy(*groups)
    before = own.orderBy("card_id").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("units", F.greatest(F.lit(1), F.floor(weight * UNITS + 0.5)).cast("bigint")).withColumns({"low": F.coalesce(F.sum("units").over(before), F.lit(0)), "whole": F.sum("units").over(own), "many": F.count(F.lit(1)).over(own)})
    lined = lined.withColumn("width", F.expr("(whole + many - 1) div many"))
    cells = lined.withColumn("cell", F.explode(F.sequence(F.expr("low div width"), F.expr("(low + units - 1) div width")))).drop("whole", "many", "width")
    sizes = lined.select(*groups, "whole", "many", "width").distinct()
    most = F.least(k, F.col("many")).cast("int")
    asked = specs.join(sizes, [g for g in groups if g in specs.columns]).withColumn("most", most).where("most > 0")
    places = F.sequence(F.lit(0), (2 * F.col("most") + 7 if tries is None else F.lit(tries - 1)).cast("int")) if tries != 0 else F.array().cast("array<int>")
    drawn = asked.withColumn("try", F.explode(places)).withColumn("at", F.least(F.col("whole") - 1, F.floor((_fine(seed, F.lit(name), "deck_id", *groups, "try") - 1) / FINE * F.col("whole")).cast("bigint")))
    hit = drawn.withColumn("cell", F.expr("at div width")).join(cells, [*groups, "cell"]).where("low <= at and at < low + units")
    named = [*dict.fromkeys([*specs.columns, *groups, *rows.columns])]
    slot = ["deck_id", *groups]
    firsts = hit.groupBy(*slot, "card_id").agg(F.min("try").alias("try"), *(F.first(c).alias(c) for c in (*named, "most") if c not in (*slot, "card_id")))
    nth = firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*slot).orderBy("try")) - 1).drop("try")
    got = nth.groupBy(*slot).agg(F.count(F.lit(1)).alias("got"))
    short = asked.join(got, slot, "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < most").select(*dict.fromkeys([*specs.columns, *groups]), "most", "got")
    left = short.join(lined.drop("low", "whole", "many", "width"), groups).join(nth.select(*slot, "card_id"), [*slot, "card_id"], "left_anti")
    key = -F.log(_fine(seed, F.lit(name), "deck_id", *groups, "card_id") / FINE) / F.col("units")
    rest = left.withColumn("nth", F.row_number().over(Window.partitionBy(*slot).orderBy(key, "card_id")) - 1 + F.col("got"))
    return nth.select(*named, "nth", "most").unionByName(rest.select(*named, "nth", "most")).where("nth < most").drop("most")


OFFER = ("deck_id", "stage", "nth", "card_id", "bucket", "max_copies", "want")
SUPPORT, STAPLE, NOVELTY, FILL, TAIL = 0, 1, 2, 3, 6


def _offers(rows: DataFrame, stage: Column | int) -> DataFrame:
    return rows.withColumn("stage", F.lit(stage) if isinstance(stage, int) else stage).select(*(F.col(c).cast("string" if c == "bucket" else "bigint").alias(c) for c in OFFER))


def fill_offers(specs: DataFrame, candidates: DataFrame, ratios: dict[str, float], seed: int = 1, weight: Column | None = None) -> DataFrame:
    """Cards for the quotas of each bucket in turn, and for the rest; as many as could be needed if others are used up. With a
    weight, cards are drawn by it."""
    draw = dealt if weight is None else lambda *a: weighted(*a, weight)
    main = candidates.where("max_copies > 0")
    goal = _by_bucket(targets(F.col("main_size"), ratios))
    own = draw(specs, main, ["pool", "bucket"], goal + F.col("main_size"), seed, "fill")
    rest = draw(specs, main, ["pool"], 2 * F.col("main_size"), seed, "tail")
    number = _by_bucket({b: F.lit(FILL + i) for i, b in enumerate(BUCKETS)})
    return _offers(own.withColumn("want", desired(seed)), number).unionByName(_offers(rest.withColumn("want", desired(seed)), TAIL))


def place(specs: DataFrame, offers: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """deck_id, card_id, bucket, stage, copies: the offers taken one after another by stage and nth.

    An offer gives what it wants, what the card's limit leaves and what the deck has room for. Staples and novelty end where
    the room is no more than the quotas still need; a bucket's stage ends when its quota is met.
    """
    goal = targets(F.col("main_size"), ratios)
    decks = offers.join(specs.select("deck_id", "main_size"), "deck_id").groupBy("deck_id").agg(
        F.first("main_size").alias("main_size"), F.array_sort(F.collect_list(F.struct("stage", "nth", "card_id", "bucket", "max_copies", "want"))).alias("offers"))
    decks = decks.select("deck_id", "main_size", "offers", *(goal[b].cast("bigint").alias(f"goal_{b}") for b in BUCKETS))
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<card_id: bigint, bucket: string, stage: bigint, copies: bigint>>")
    start = F.struct(zero.alias("total"), *(zero.alias(b) for b in BUCKETS), none.alias("placed"))

    def take(state: Column, x: Column) -> Column:
        free = F.col("main_size") - state["total"]
        need = sum((F.greatest(zero, F.col(f"goal_{b}") - state[b]) for b in BUCKETS), zero)
        used = F.aggregate(F.filter(state["placed"], lambda p: p["card_id"] == x["card_id"]), zero, lambda n, p: n + p["copies"])
        short = F.coalesce(*(F.when(x["bucket"] == b, state[b] < F.col(f"goal_{b}")) for b in BUCKETS), F.lit(False))
        allowed = F.when(x["stage"].isin(STAPLE, NOVELTY), free > need).when(x["stage"].isin(SUPPORT, TAIL), F.lit(True)).otherwise(short)
        added = F.when(allowed, F.greatest(zero, F.least(x["want"], x["max_copies"] - used, free))).otherwise(zero)

        def put(n: Column) -> Column:
            card = F.struct(x["card_id"].alias("card_id"), x["bucket"].alias("bucket"), x["stage"].alias("stage"), n.alias("copies"))
            return F.struct((state["total"] + n).alias("total"), *((state[b] + F.when(x["bucket"] == b, n).otherwise(zero)).alias(b) for b in BUCKETS),
                            F.when(n > 0, F.concat(state["placed"], F.array(card))).otherwise(state["placed"]).alias("placed"))

        return F.get(F.transform(F.array(added), put), F.lit(0))

    return decks.select("deck_id", F.inline(F.aggregate("offers", start, take, lambda state: state["placed"])))


def quota_fill(specs: DataFrame, candidates: DataFrame, ratios: dict[str, float], seed: int = 1, weight: Column | None = None) -> DataFrame:
    """deck_id, card_id, bucket, copies: bucket quotas in order (a bucket may overshoot by its last card's copies), then a tail
    to size."""
    placed = place(specs, fill_offers(specs, candidates, ratios, seed, weight), ratios)
    return placed.groupBy("deck_id", "card_id", "bucket").agg(F.sum("copies").alias("copies"))


def novelty_picks(specs: DataFrame, candidates: DataFrame, allowed: DataFrame, ratio: float, near_share: float = 0.67, far_share: float = 0.33, seed: int = 1) -> DataFrame:
    """The specs' and candidates' columns, side and nth: round(size * ratio) cards, the near share from the deck's clusters
    (allowed: deck_id, cluster_id), the rest from other clusters or none. Shares are brought to a sum of 1.

    Far cards come in the pool's order; a deck that does not find enough among the first ones looks at its whole pool.
    """
    both = near_share + far_share
    total = F.bround(F.col("main_size") * F.lit(ratio), 0)
    n_near = F.bround(total * F.lit(near_share / both if both > 0 else 1.0), 0)
    n_far = F.greatest(F.lit(0), total - n_near)
    near = dealt(specs.join(allowed, "deck_id"), candidates, ["pool", "cluster_id"], n_near, seed, "near")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("deck_id").orderBy(hash01(seed, F.lit("near"), "deck_id", "card_id"), "card_id")) - 1).where(F.col("nth") < n_near)

    def far(of: DataFrame, k: Column | None) -> DataFrame:
        rows = dealt(of, candidates, ["pool"], k, seed, "far").join(allowed, ["deck_id", "cluster_id"], "left_anti")
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("deck_id").orderBy("nth")) - 1).where(F.col("nth") < n_far)

    first = far(specs, 2 * n_far + 8)
    full = first.groupBy("deck_id").agg(F.count(F.lit(1)).alias("n"), F.first(n_far).alias("wanted")).where("n >= wanted").select("deck_id")
    rest = far(specs.join(full, "deck_id", "left_anti"), None)
    columns = [*dict.fromkeys([*specs.columns, *candidates.columns]), "nth"]
    sides = near.select(*columns, F.lit("near").alias("side")), first.join(full, "deck_id", "left_semi").select(*columns, F.lit("far").alias("side")), rest.select(*columns, F.lit("far").alias("side"))
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def staple_picks(specs: DataFrame, candidates: DataFrame, p: float, ratios: dict[str, float], slack: int = 0, seed: int = 1) -> DataFrame:
    """Staples drawn with chance p * weight, in the pool's order, up to the first that would leave more open quota slots than
    free ones, but for `slack`. The quotas fill a deck, so without slack none is placed."""
    drawn = specs.join(candidates, "pool").where(hash01(seed, F.lit("staple"), "deck_id", "card_id") < F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(p) * F.col("weight")))).withColumn("want", desired(seed))
    w = Window.partitionBy("deck_id").orderBy("card_id").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("want")).otherwise(0)).over(w), F.lit(0))
    goal = targets(F.col("main_size"), ratios)
    need = sum((F.greatest(F.lit(0), goal[b] - sofar(b)) for b in BUCKETS), F.lit(0))
    rows = drawn.withColumns({"free": F.col("main_size") - F.coalesce(F.sum("want").over(w), F.lit(0)), "need": need})
    stopped = F.max(F.when((F.col("free") <= 0) | (F.col("free") + slack <= F.col("need")), 1).otherwise(0)).over(Window.partitionBy("deck_id").orderBy("card_id"))
    return rows.withColumn("stopped", stopped).where("stopped = 0").select("deck_id", "card_id", F.least("want", "free").alias("copies"))


def size_repair(entries: DataFrame, candidates: DataFrame, size: int | Column, seed: int = 1) -> DataFrame:
    """Decks cut or filled to a size (a number, or a column of the entries that is the same in all of a deck's): deck_id,
    card_id, copies, and repairs: one for every card filled in, and one where a deck was cut.

    A deck's own cards are kept in the order of their stage, if entries have one, and id; fillers are cards of its pool that it
    lacks, one copy each, in the pool's order.
    """
    entries = by_key(entries.withColumn("_size", (F.lit(size) if isinstance(size, int) else size).cast("bigint")), "deck_id")
    w = Window.partitionBy("deck_id").orderBy(*(c for c in ("stage", "card_id") if c in entries.columns)).rowsBetween(Window.unboundedPreceding, -1)
    kept = entries.withColumn("before", F.coalesce(F.sum("copies").over(w), F.lit(0))).withColumn("kept", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("_size") - F.col("before"))))
    totals = entries.groupBy("deck_id").agg(F.sum("copies").alias("total"), F.first("pool").alias("pool"), F.count_distinct("card_id").alias("own"), F.first("_size").alias("_size"))
    lacks = F.col("_size") - F.col("total")
    fillers = dealt(totals.where(lacks > 0), candidates, ["pool"], lacks + F.col("own"), seed, "repair").join(grown(entries.select("deck_id", "card_id")), ["deck_id", "card_id"], "left_anti")
    ranked = fillers.withColumn("place", F.row_number().over(Window.partitionBy("deck_id").orderBy("nth"))).where(F.col("place") <= lacks)
    out = kept.where("kept > 0").select("deck_id", "card_id", F.col("kept").alias("copies"), F.lit(0).alias("filled")).unionByName(ranked.select("deck_id", "card_id", F.lit(1).cast("bigint").alias("copies"), F.lit(1).alias("filled")))
    done = totals.select("deck_id", (F.col("total") > F.col("_size")).cast("int").alias("cut"))
    repairs = F.sum("filled").over(Window.partitionBy("deck_id")) + F.col("cut")
    return out.join(grown(done), "deck_id").select("deck_id", "card_id", "copies", repairs.cast("int").alias("repairs"))


def accept_first(attempts: DataFrame) -> DataFrame:
    """(deck_id, attempt, ok) -> the first valid attempt of each slot, how many were drawn before it, or a rejected slot."""
    best = attempts.groupBy("deck_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("attempt"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("valid"))
    earlier = attempts.join(best.select("deck_id", F.col("attempt").alias("chosen")), "deck_id").groupBy("deck_id").agg(F.count_if(F.col("chosen").isNull() | (F.col("attempt") < F.col("chosen"))).alias("resamples"))
    return best.join(earlier, "deck_id").select("deck_id", "attempt", "resamples", F.when(F.col("attempt").isNull(), "rejected").otherwise("accepted").alias("status"))


def extra_sample(specs: DataFrame, candidates: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """One copy each of up to `size` extra-deck cards that are not forbidden, in the pool's order."""
    return dealt(specs, candidates.where("in_extra and max_copies > 0"), ["pool"], F.lit(size), seed, "extra")


def feasible_extra(specs: DataFrame, candidates: DataFrame, tags: DataFrame, pairs: DataFrame, size: int, tries: int = 12, seed: int = 1) -> DataFrame:
    """The extra sample of the first of `tries` draws whose tags the pool's main monsters can meet, else of the last; and
    draws, how many there were. tags: card_id, tag, needed; pairs: pool, tag, card_id, max_copies that match."""
    drawn = F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
    trials = specs.withColumn("draw", drawn).withColumns({"slot": F.col("deck_id"), "deck_id": F.col("deck_id") * tries + F.col("draw")})
    picks = extra_sample(trials, candidates, size, seed)
    capacity = pairs.groupBy("pool", "tag").agg(F.sum("max_copies").alias("capacity"))
    needs = picks.select("deck_id", "pool", "card_id").join(grown(tags), "card_id").groupBy("deck_id", "pool", "tag").agg(F.max("needed").alias("needed"))
    bad = needs.join(capacity, ["pool", "tag"], "left").where(F.coalesce("capacity", F.lit(0)) < F.col("needed")).select("deck_id").distinct()
    chosen = trials.select("slot", "draw", "deck_id").join(bad.withColumn("bad", F.lit(True)), "deck_id", "left").groupBy("slot").agg(F.coalesce(F.min(F.when(F.col("bad").isNull(), F.col("draw"))), F.lit(tries - 1)).alias("draw"))
    return picks.join(chosen, ["slot", "draw"]).withColumns({"deck_id": F.col("slot"), "draws": F.col("draw") + 1}).drop("slot", "draw")


def support_injection(specs: DataFrame, picks: DataFrame, candidates: DataFrame, tags: DataFrame, pairs: DataFrame, seed: int = 1) -> DataFrame:
    """deck_id, reason, nth, card_id, bucket, max_copies, want: what the deck's extra cards need - a fusion enabler; a tuner
    and a non-tuner for synchros; two monsters of the pool's commonest level for xyz; two effect monsters for links; a card for
    each material tag, as often as needed; for pendulums a scale and the pool's farthest one, two or more apart."""
    able = candidates.where("not in_extra and max_copies > 0")
    main = able.where("bucket = 'monster'")
    levels = main.groupBy("pool", "level").agg(F.count(F.lit(1)).alias("n")).where("level is not null").groupBy("pool").agg(F.max(F.struct("n", (-F.col("level")).alias("m"))).alias("b")).select("pool", (-F.col("b.m")).alias("best_level"))
    reason = lambda kind, name: F.struct(F.lit(kind).alias("extra_type"), F.lit(name).alias("reason"))
    reasons = F.array(
        F.when((F.col("bucket") == "spell") & F.col("is_enabler"), reason("fusion", "1 enabler")),
        *(F.when((F.col("bucket") == "monster") & test, reason(kind, name)) for test, kind, name in (
            (F.col("is_tuner"), "synchro", "2 tuner"), (~F.col("is_tuner"), "synchro", "3 non_tuner"), (F.col("level") == F.col("best_level"), "xyz", "4 same_level"), (F.col("is_effect"), "link", "5 effect"))))
    offers = able.join(levels, "pool", "left").select("pool", "card_id", "bucket", "max_copies", F.inline(F.filter(reasons, lambda x: x.isNotNull())))
    kinds = F.explode(F.filter(F.array("extra_type", F.when(F.col("is_pendulum"), F.lit("pendulum"))), lambda x: x.isNotNull()))
    needs = specs.select("deck_id", "pool").join(picks.select("deck_id", kinds.alias("extra_type")).distinct(), "deck_id")
    many = F.when(F.col("reason").isin("4 same_level", "5 effect"), 2).otherwise(1)
    ruled = dealt(needs, offers, ["pool", "extra_type", "reason"], many, seed, "support").withColumn("want", F.lit(1))
    asked = picks.select("deck_id", "pool", "card_id").join(grown(tags), "card_id").groupBy("deck_id", "pool", "tag").agg(F.max("needed").alias("want"))
    tagged = dealt(asked, pairs, ["pool", "tag"], F.lit(1), seed, "tag").withColumn("reason", F.concat(F.lit("6 "), "tag"))
    scales = main.where("is_pendulum and scale is not null")
    ends = scales.groupBy("pool").agg(F.min(F.struct("scale", "card_id")).alias("low"), F.max(F.struct("scale", "card_id")).alias("high"))
    partner = F.when(F.col("high.scale") - F.col("scale") >= 2, F.col("high.card_id")).when(F.col("scale") - F.col("low.scale") >= 2, F.col("low.card_id"))
    paired = scales.join(ends, "pool").withColumn("partner", partner).where("partner is not null").select("pool", "card_id", "partner", F.lit("pendulum").alias("extra_type"))
    scale = dealt(needs, paired, ["pool", "extra_type"], F.lit(1), seed, "scale")
    both = scale.select("deck_id", "pool", F.posexplode(F.array("card_id", "partner")).alias("nth", "card_id")).join(grown(able.select("pool", "card_id", "bucket", "max_copies")), ["pool", "card_id"]).withColumns({"reason": F.lit("7 scale"), "want": F.lit(1)})
    names = ("deck_id", "reason", "nth", "card_id", "bucket", "max_copies", "want")
    return ruled.select(*names).unionByName(tagged.select(*names)).unionByName(both.select(*names))


def ratio_jitter(specs: DataFrame, base: dict[str, float], jitter: float, seed: int = 1, tries: int = 200) -> DataFrame:
    """deck_id, monster, spell, trap: the first of `tries` draws within the jitter of every base share, else the base.

    Draws are made in runs, each longer than all before it, and a run is looked at only if none before it had a valid one.
    """
    draw = lambda name, i: F.lit(base[name]) + F.lit(jitter) * (2 * hash01(seed, F.lit(name), "deck_id", i) - 1)
    valid = lambda x: (F.abs(1 - x["monster"] - x["spell"] - F.lit(base["trap"])) <= jitter) & (x["monster"] >= 0) & (x["spell"] >= 0) & (1 - x["monster"] - x["spell"] >= 0)
    runs, start = [], 0
    while start < tries:
        stop = min(tries, 4 * start or 1)
        draws = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.struct(draw("monster", i).alias("monster"), draw("spell", i).alias("spell")))
        runs.append(F.get(F.filter(draws, valid), F.lit(0)))
        start = stop
    first = F.coalesce(*runs, F.struct(F.lit(base["monster"]).alias("monster"), F.lit(base["spell"]).alias("spell")))
    return specs.select("deck_id", first.alias("x")).select("deck_id", "x.monster", "x.spell", (1 - F.col("x.monster") - F.col("x.spell")).alias("trap"))
