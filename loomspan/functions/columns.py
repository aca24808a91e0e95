"""Column functions used throughout: safe casts, seeded draws, type tests, rounding, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(x: Column) -> Column:
    """Whole part of a number or numeric text; null where there is none."""
    return x.try_cast("double").try_cast("bigint")


def combat_stat(x: Column) -> Column:
    """safe_int without negative values, which stand for unknown ones."""
    value = safe_int(x)
    return F.when(value >= 0, value)


def price(x: Column) -> Column:
    """Empty text is null; other text must be a number."""
    return F.nullif(x, F.lit("")).cast("double")


def hash01(*keys: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone."""
    parts = [F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k) for k in keys]
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def has_type(kind: Column, *names: str) -> Column:
    """Whether a card type's text holds one of the names, whatever the case; a null type holds none."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    test = F.lit(False)
    for name in names:
        test = test | low.contains(name)
    return test


EXTRA_TYPES = ("fusion", "synchro", "xyz", "link")


def is_extra(kind: Column) -> Column:
    return has_type(kind, *EXTRA_TYPES)


def sampling_bucket(kind: Column) -> Column:
    """spell, else trap, else monster."""
    return F.when(has_type(kind, "spell"), "spell").when(has_type(kind, "trap"), "trap").otherwise("monster")


def scoring_bucket(kind: Column) -> Column:
    """monster, else spell, else trap, else null (not counted)."""
    return F.when(has_type(kind, "monster"), "monster").when(has_type(kind, "spell"), "spell").when(has_type(kind, "trap"), "trap")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def slug(x: Column) -> Column:
    """Runs of other characters than letters and digits become one underscore; none at the ends; 'format' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("format"))


def version_hash(x: Column) -> Column:
    """First ten hex digits of the SHA-1 of a struct's JSON."""
    return F.substring(F.sha1(F.to_json(x)), 1, 10)


def composite_weight(base: Column, chance: Column, novelty: Column, outlier: Column) -> Column:
    """Product of a card's weights, with 1 for what is unknown or zero, and at least 1e-4."""
    one = lambda x: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(1e-4), one(base) * one(chance) * one(novelty) * (1 - clamp(F.coalesce(outlier, F.lit(0.0)), 0.0, 0.95)))
