"""Deck validation: one flag for each rule, from one aggregate over the deck's entries, and the names of those that failed."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_extra, sampling_bucket
from ..shared import by_key, grown, saved

#: Names of cards that allow fusions (fixed values).
FUSION_ENABLERS = ("polymerization", "fusion gate", "miracle fusion", "future fusion", "metamorphosis")
RULES = (
    "main_size_ok", "extra_size_ok", "cards_exist_ok", "format_release_ok", "max_copies_ok", "extra_type_ok", "main_extra_type_ok", "material_requirements_ok",
    "fusion_enabler_ok", "synchro_path_ok", "xyz_path_ok", "link_path_ok", "pendulum_path_ok", "type_ratio_ok",
)


@dataclass(frozen=True)
class DeckRules:
    main_size: int = 40
    extra_min: int = 0
    extra_max: int = 15
    cutoff: str | None = None
    ratios: dict[str, float] = field(default_factory=lambda: {"monster": 0.5, "spell": 0.3, "trap": 0.2})
    tolerance: int = 2


def copy_limits(lists: DataFrame) -> DataFrame:
    """card_id, max_copies from (card_id, list_name): of forbidden 0, limited 1, semi_limited 2 the last list wins. Others: 3."""
    order = F.when(F.col("list_name") == "forbidden", 0).when(F.col("list_name") == "limited", 1).when(F.col("list_name") == "semi_limited", 2)
    return lists.groupBy("card_id").agg(F.max(order).alias("max_copies")).where("max_copies is not null")


#: What is wrong where a rule's flag is false; {} stands for numbers of the deck.
WRONG = {
    "main_size_ok": ("the main deck has {} cards", "n_main"), "extra_size_ok": ("the extra deck has {} cards", "n_extra"), "cards_exist_ok": ("{} cards are unknown", "unknown"), "format_release_ok": ("{} cards were not released by the cutoff", "late"),
    "max_copies_ok": ("{} cards are over their copy limit", "over"), "extra_type_ok": ("{} cards do not belong in the extra deck", "bad_extra"), "main_extra_type_ok": ("{} cards belong in the extra deck", "bad_main"),
    "material_requirements_ok": ("materials are missing", None), "fusion_enabler_ok": ("{} fusions have no enabler", "has_fusion"), "synchro_path_ok": ("{} synchros lack tuner or other monster", "has_synchro"),
    "xyz_path_ok": ("{} xyz lack two monsters of a level", "has_xyz"), "link_path_ok": ("{} links lack two effect monsters", "has_link"), "pendulum_path_ok": ("{} pendulums lack a pair of scales", "has_pendulum"), "type_ratio_ok": ("card types are off their shares", None),
}


def cutoff_day(cutoff: str | None) -> datetime.date | None:
    """None for no cutoff and for one that is no ISO date."""
    try:
        return datetime.date.fromisoformat(cutoff) if cutoff else None
    except ValueError:
        return None


#: Columns of a table of rules.
RULE_COLUMNS = ("main_size", "extra_min", "extra_max", "release_cutoff", "monster", "spell", "trap", "tolerance")


def deck_rules(decks: DataFrame, rules: DataFrame, default: DeckRules) -> DataFrame:
    """deck_id and rule, a struct of RULE_COLUMNS: those of the deck's format, or the default's where it has none or its
    format has no rules. decks: deck_id, format; rules: format and RULE_COLUMNS, a row for each format."""
    own = rules.select(F.col("format").alias("_format"), F.struct(*RULE_COLUMNS).alias("_rule"))
    rest = default.ratios
    values = (default.main_size, default.extra_min, default.extra_max, default.cutoff, rest["monster"], rest["spell"], rest["trap"], default.tolerance)
    other = F.struct(*(F.lit(v).cast(rules.schema[c].dataType).alias(c) for v, c in zip(values, RULE_COLUMNS)))
    return decks.join(own, F.col("format") == F.col("_format"), "left").select("deck_id", F.coalesce("_rule", other).alias("rule"))


def validate_decks(entries: DataFrame, limits: DataFrame, support: DataFrame, rules: DeckRules | DataFrame, decks: DataFrame | None = None, many: int = 0) -> DataFrame:
    """entries: deck_id, zone (main, extra, side), card_id, copies, is_known and card attributes; support: deck_id, material_ok.

    rules: the same for all decks, or deck_id and rule as deck_rules gives them, a row for each deck; these decks are judged.
    decks: deck_id; given, decks without entries are judged too. Returns deck_id, the flags, flags (a map), failed (names,
    sorted), errors (a text for each) and ok. With a cutoff, known cards need a readable date by then, so without a date column
    none passes; a cutoff that is no date is left out. many: about how many entries there are; tasks follow their number.

    An entry's texts are tested where it lies, and only the answers, a bit each, are dealt by deck.
    """
    if isinstance(rules, DataFrame):
        decks = rules
        cutoffs = rules.select("deck_id", F.expr("try_to_date(rule.release_cutoff, 'yyyy-MM-dd')").alias("_cutoff"))
        limit = {c: F.col("rule")[c] for c in RULE_COLUMNS}
    else:
        limit = {c: F.lit(v) for c, v in zip(RULE_COLUMNS, (rules.main_size, rules.extra_min, rules.extra_max, None, *(rules.ratios[b] for b in ("monster", "spell", "trap")), rules.tolerance))}
    kind = F.col("type")
    main, extra, known = F.col("zone") == "main", F.col("zone") == "extra", F.col("is_known")
    low = F.lower(F.coalesce(kind, F.lit("")))
    monster = low.contains("monster")
    day = F.expr("try_to_date(tcg_date, 'yyyy-MM-dd')") if "tcg_date" in entries.columns else F.lit(None).cast("date")
    pendulum = main & low.contains("pendulum")
    tests = {
        "main": main, "extra": extra, "unknown": ~known, "known": known, "bad_extra": extra & known & ~(is_extra(kind) | low.contains("pendulum")), "bad_main": main & is_extra(kind),
        **{f"has_{k}": extra & low.contains(k) for k in ("fusion", "synchro", "xyz", "link", "pendulum")}, "enablers": main & F.lower("name").isin(*FUSION_ENABLERS), "asks_tuner": extra & low.contains("synchro") & F.lower("descr").contains("tuner"),
        "monsters": main & monster, "tuners": main & monster & low.contains("tuner"), "non_tuners": main & monster & ~low.contains("tuner"), "effects": main & monster & low.contains("effect"), "pendulums": pendulum,
        **{f"n_{b}": main & known & (sampling_bucket(kind) == b) for b in ("monster", "spell", "trap")}}
    place = {name: 1 << i for i, name in enumerate(tests)}
    bits = sum((F.when(test, F.lit(place[name])).otherwise(0) for name, test in tests.items()), F.lit(0))
    holds = lambda name: F.col("_bits").bitwiseAND(F.lit(place[name])) != 0
    total = lambda name: F.coalesce(F.sum(F.when(holds(name), F.col("copies")).otherwise(0)), F.lit(0))
    n_of = lambda name: F.count_if(holds(name))
    rows = by_key(entries.select("deck_id", "copies", bits.alias("_bits"), day.alias("_day"), F.when(pendulum, F.col("scale")).alias("_scale")), "deck_id", many)
    rows = rows.join(grown(cutoffs), "deck_id") if isinstance(rules, DataFrame) else rows.withColumn("_cutoff", F.lit(cutoff_day(rules.cutoff)).cast("date"))
    late = F.col("_cutoff").isNotNull() & (F.col("_day").isNull() | (F.col("_day") > F.col("_cutoff")))
    limited = entries.select("deck_id", "card_id", "copies").join(grown(limits), "card_id", "left").select("deck_id", "card_id", "copies", F.coalesce("max_copies", F.lit(3)).alias("m"))
    per_card = by_key(limited, "deck_id", many).groupBy("deck_id", "card_id").agg(F.sum("copies").alias("c"), F.max("m").alias("m"))
    over = per_card.groupBy("deck_id").agg(F.count_if(F.col("c") > F.col("m")).alias("over"))
    leveled = by_key(entries.where(main & monster & (F.col("level") > 0)).select("deck_id", "level", "copies"), "deck_id", many)
    levels = leveled.groupBy("deck_id", "level").agg(F.sum("copies").alias("c")).groupBy("deck_id").agg(F.max("c").alias("same_level"))
    counted = ("unknown", "bad_extra", "bad_main", "has_fusion", "has_synchro", "has_xyz", "has_link", "has_pendulum", "enablers", "asks_tuner")
    summed = ("monsters", "tuners", "non_tuners", "effects", "pendulums", "n_monster", "n_spell", "n_trap")
    facts = rows.groupBy("deck_id").agg(
        total("main").alias("n_main"), total("extra").alias("n_extra"), F.count_if(holds("known") & late).alias("late"), *(n_of(name).alias(name) for name in counted), *(total(name).alias(name) for name in summed),
        (F.max("_scale") - F.min("_scale")).alias("gap"))
    if decks is not None:
        facts = decks.select("deck_id", *(["rule"] if isinstance(rules, DataFrame) else [])).join(grown(facts), "deck_id", "left")
    numbers = [name for name in facts.columns if name not in ("deck_id", "gap", "rule")]
    f = facts.fillna(0, numbers).join(grown(over), "deck_id", "left").fillna(0, ["over"]).join(grown(levels), "deck_id", "left").join(grown(support), "deck_id", "left")
    c = F.col
    near = F.lit(True)
    for bucket in ("monster", "spell", "trap"):
        near = near & (F.abs(c(f"n_{bucket}") - F.bround(limit[bucket] * c("n_main"), 0)) <= limit["tolerance"])
    flags: dict[str, Column] = dict(zip(RULES, (
        c("n_main") == limit["main_size"], c("n_extra").between(limit["extra_min"], limit["extra_max"]), c("unknown") == 0, c("late") == 0, F.coalesce(c("over"), F.lit(0)) == 0,
        c("bad_extra") == 0, c("bad_main") == 0, F.coalesce("material_ok", F.lit(True)), (c("has_fusion") == 0) | (c("enablers") > 0),
        (c("has_synchro") == 0) | ((c("monsters") >= 2) & ((c("asks_tuner") == 0) | ((c("tuners") >= 1) & (c("non_tuners") >= 1)))),
        (c("has_xyz") == 0) | (F.coalesce("same_level", F.lit(0)) >= 2), (c("has_link") == 0) | (c("effects") >= 2),
        (c("has_pendulum") == 0) | ((c("pendulums") >= 2) & (F.coalesce("gap", F.lit(0)) >= 2)), near)))
    wrong = F.array(*(F.when(~flags[name], F.lit(text) if number is None else F.concat(F.lit(text.split("{}")[0]), c(number), F.lit(text.split("{}")[1]))) for name, (text, number) in WRONG.items()))
    out = f.select("deck_id", *(flag.alias(name) for name, flag in flags.items()), F.filter(wrong, lambda x: x.isNotNull()).alias("errors"))
    out = out.withColumn("flags", F.create_map(*(x for name in RULES for x in (F.lit(name), F.col(name)))))
    return out.withColumn("failed", F.array_sort(F.map_keys(F.map_filter("flags", lambda k, v: ~v)))).withColumn("ok", F.size("failed") == 0)


def deck_support(entries: DataFrame, tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """deck_id, tag, needed, found: matching main copies for each tag that a deck's extra cards ask for.

    tags: card_id, tag, needed; pairs: (tag, card_id) that match. Main cards are looked up under the tags that their deck asks
    for, not under all that they match.
    """
    needed = entries.where("zone = 'extra'").select("deck_id", "card_id").join(grown(tags), "card_id").groupBy("deck_id", "tag").agg(F.max("needed").alias("needed"))
    needed = saved(needed, "needed")  # read twice
    asked = entries.where("zone = 'main'").select("deck_id", "card_id", "copies").join(grown(needed.select("deck_id", "tag")), "deck_id")
    supply = asked.join(grown(pairs), ["card_id", "tag"]).groupBy("deck_id", "tag").agg(F.sum("copies").alias("found"))
    return needed.join(grown(supply), ["deck_id", "tag"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def failed_flags(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("failed").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def failed_combos(validated: DataFrame) -> DataFrame:
    return validated.where("not ok").groupBy(F.array_join("failed", "|").alias("combo")).agg(F.count(F.lit(1)).alias("n"))
