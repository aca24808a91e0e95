"""Material requirements read from the texts of extra-deck cards, and which main-deck monsters meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import by_key, grown, saved

#: Word lists of the rules (fixed values).
RACES = (
    "aqua", "beast", "beast-warrior", "cyberse", "dinosaur", "divine-beast", "dragon", "fairy", "fiend", "fish", "insect", "machine",
    "plant", "psychic", "pyro", "reptile", "rock", "sea serpent", "spellcaster", "thunder", "warrior", "winged beast", "wyrm", "zombie",
)
ATTRIBUTES = ("dark", "light", "wind", "water", "fire", "earth", "divine")
#: Pieces of the requirement grammar, on lower-cased text (fixed values).
COUNT = r"(\d+)\+?\s*(?:or\s+more\s+)?"
OWN_COUNT = r"(?<![#\w])" + COUNT
ARTICLE = r"\b(?:a|an|one)\s+"
ATTRIBUTE = "(" + "|".join(ATTRIBUTES) + ")"
RACE = "(" + "|".join(RACES) + r")\s*(?:-?\s*type)?"
QUOTED = "[\"“”']([^\"“”']+)[\"“”']"
ROLE = r"(non[\s-]?tuners?|tuners?|monsters?)"
TUNERS, MONSTERS = r"\s+tuners?(?:\s+monsters?)?", r"\s+monsters?"
GENERIC = r"^\d+\+?\s+|\b(?:non[\s-]?tuner|tuner|monster|monsters|fusion material)\b|\b(?:type|attribute|or more|and)\b"
#: prefix, pattern after the count or article, group of the value, group of the role (0: none).
RULES = (
    ("attr_tuner", ATTRIBUTE + TUNERS, 1, 0), ("attr_monster", ATTRIBUTE + MONSTERS, 1, 0), ("type_tuner", RACE + TUNERS, 1, 0),
    ("attr", ATTRIBUTE + r"\s+" + ROLE, 1, 2), ("type", RACE + r"\s+" + ROLE, 1, 2),
    ("archetype", ROLE + r"\s+" + QUOTED + MONSTERS, 2, 1), ("archetype", QUOTED + r"\s+" + ROLE, 1, 2),
)


def normal(x: Column) -> Column:
    """Trimmed, in lower case, with single spaces."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(x, F.lit("")))), r"\s+", " ")


def clause(text: Column) -> Column:
    """The first part of a text, up to a semicolon or line end, if it can be a requirement; else null."""
    head = F.trim(F.get(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), "[;\n]", 2), F.lit(0)))
    return F.when(head.rlike("monster|tuner|[+\"']"), head)


def _role(x: Column) -> Column:
    return F.when(x.startswith("non"), "non_tuner").when(x.contains("tuner"), "tuner").otherwise("monster")


def _hits(head: Column, lead: str, pattern: str, value: int, role: int, counted: bool, make) -> Column:
    """array<struct<tag, n>> of one rule."""
    shift = 1 if counted else 0
    values = F.regexp_extract_all(head, F.lit(lead + pattern), F.lit(value + shift))
    counts = F.regexp_extract_all(head, F.lit(lead + pattern), F.lit(1)) if counted else F.transform(values, lambda x: F.lit("1"))
    roles = F.regexp_extract_all(head, F.lit(lead + pattern), F.lit(role + shift)) if role else F.transform(values, lambda x: F.lit(""))
    rows = F.arrays_zip(values.alias("v"), counts.alias("c"), roles.alias("r"))
    return F.transform(rows, lambda x: F.struct(make(normal(x["v"]), x["r"]).alias("tag"), F.greatest(F.lit(1), F.coalesce(x["c"].try_cast("int"), F.lit(1))).alias("n")))


def named(head: Column) -> Column:
    """Names of materials between plus signs: at least two words, no digit, no generic word."""
    parts = F.when(head.contains("+"), F.transform(F.split(head, r"\s*\+\s*"), lambda p: normal(F.regexp_replace(p, r"^[ \t\r\n.,;:()\[\]{}\"'`]+|[ \t\r\n.,;:()\[\]{}\"'`]+$", ""))))
    return F.coalesce(F.filter(parts, lambda p: (p != "") & ~p.rlike(GENERIC) & ~p.rlike("[0-9]") & p.contains(" ")), F.array().cast("array<string>"))


def requirement_tags(cards: DataFrame, key: str = "id", text: str = "descr") -> DataFrame:
    """key, tag, needed: of each tag the greatest count. Bare quoted tags take a weaker rule's count only without a stronger one's."""
    heads = by_key(cards.select(key, clause(F.col(text)).alias("head")).where("head is not null"), key)  # many cards lie in few files, of few bytes
    head = F.col("head")
    strong = []
    for prefix, pattern, value, role in RULES:
        make = (lambda v, r, p=prefix: F.concat(F.lit(p + ":"), v, F.lit(":"), _role(r))) if role else (lambda v, r, p=prefix: F.concat(F.lit(p + ":"), v))
        strong += [_hits(head, COUNT, pattern, value, role, True, make), _hits(head, ARTICLE, pattern, value, role, False, make)]
    names = F.transform(named(head), lambda x: F.struct(F.concat(F.lit("card_name:"), x).alias("tag"), F.lit(1).alias("n")))
    bare = [_hits(head, OWN_COUNT, QUOTED + MONSTERS, 1, 0, True, lambda v, r: v), _hits(head, OWN_COUNT, QUOTED, 1, 0, True, lambda v, r: v), _hits(head, "", QUOTED + r"\s+monster", 1, 0, False, lambda v, r: v)]

    def ranked(hits: Column, strength: int) -> Column:
        return F.transform(hits, lambda x: F.struct(x["tag"].alias("tag"), F.lit(strength).alias("strength"), x["n"].alias("n")))

    rows = [ranked(hits, i) for i, hits in ((3, F.concat(*strong, names)), *zip((2, 1, 0), bare))]
    tags = heads.select(key, F.inline(F.concat(*rows))).where("tag <> ''")
    return tags.groupBy(key, "tag").agg(F.max(F.struct("strength", "n")).alias("best")).select(key, "tag", F.col("best.n").alias("needed"))


def requirement_label(tag: Column) -> Column:
    parts = F.split(F.trim(F.lower(tag)), ":")
    kind, value, role = parts[0], F.trim(F.get(parts, F.lit(1))), F.get(parts, F.lit(2))
    suffix = F.when(F.size(parts) == 3, F.concat(F.lit(" "), F.translate(_role(role), "_", "-"))).otherwise("")
    return F.when(kind.isin("attr_tuner", "type_tuner"), F.concat(value, F.lit(" tuner"))).when(kind == "attr_monster", F.concat(value, F.lit(" monster"))).when(kind == "card_name", value).when(
        kind.isin("attr", "type", "archetype"), F.concat(value, suffix)).otherwise(F.trim(F.lower(tag)))


def matches(tag: Column) -> Column:
    """Whether a monster row (type, attribute, race, archetype, name, descr) meets a tag."""
    low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    parts = F.split(tag, ":")
    kind, value = parts[0], F.get(parts, F.lit(1))
    role = _role(F.coalesce(F.get(parts, F.lit(2)), F.lit("monster")))
    types, text, name = low("type"), low("descr"), low("name")
    tuner = types.contains("tuner")
    fits = F.when(role == "tuner", tuner).when(role == "non_tuner", ~tuner).otherwise(F.lit(True))
    attribute = F.when(low("attribute") != "", low("attribute").contains(value)).otherwise(text.contains(value) | types.contains(value))
    race = low("race").contains(value) | types.contains(value) | name.contains(value) | text.contains(value)
    own = lambda v: low("archetype").contains(v) | name.contains(v) | text.contains(v) | types.contains(v)
    test = F.when(kind == "attr_tuner", tuner & attribute).when(kind == "attr_monster", attribute).when(kind == "type_tuner", tuner & race).when(kind == "card_name", normal(F.col("name")) == value).when(
        kind == "attr", fits & attribute).when(kind == "type", fits & race).when(kind == "archetype", fits & own(value)).otherwise(own(tag))
    return types.contains("monster") & test


#: Characters of the grams by which tags and monsters meet; shorter values are grams themselves.
GRAM = 3
#: Grams that are looked for one by one in each monster's texts; if tags ask for more, all grams of the texts are laid out.
FEW_GRAMS = 256
#: Tags that may be broadcast; more are merged with the monsters.
FEW_TAGS = 1 << 14
#: What a monster is compared by.
TEXTS = ("type", "attribute", "race", "archetype", "name", "descr")
KINDS = ("attr_tuner", "attr_monster", "type_tuner", "card_name", "attr", "type", "archetype")


def needle(tag: Column) -> Column:
    """The text that a monster must hold somewhere to meet a tag."""
    parts = F.split(tag, ":")
    return F.when(parts[0].isin(*KINDS), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(tag)


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) if n else F.array(F.lit(""))


def tag_matches(tags: DataFrame, cards: DataFrame) -> DataFrame:
    """(tag, card_id) pairs that match; decks join the pairs later.

    An inverted index of grams stands between them: every tag takes the gram of its needle that fewest monsters hold, and is
    compared with those monsters only. A needle with a gram that no monster holds matches none. Where tags ask for few grams
    in all, each monster is compared where it lies and no index is made.
    """
    named = saved(tags.select("tag").distinct().where("tag is not null"), "asked-tags")  # read several times
    every = named.withColumn("needle", needle(F.col("tag"))).withColumn("n", F.least(F.length("needle"), F.lit(GRAM)))
    sizes = sorted(r["n"] for r in every.select("n").distinct().collect())  # at most GRAM + 1 of them
    if not sizes:
        return cards.sparkSession.createDataFrame([], "tag string, card_id " + cards.schema["id"].dataType.simpleString())
    whole = F.transform(F.sequence(F.lit(1), F.length("needle") - F.col("n") + 1), lambda i: F.substring(F.col("needle"), i, F.col("n")))  # by characters: no halves of surrogate pairs
    asked = every.select("tag", F.explode(F.array_distinct(whole)).alias("gram"))
    monsters = by_key(cards.select("id", *TEXTS).where(F.lower("type").contains("monster")), "id")  # many cards lie in few files, of few bytes
    held = F.concat_ws("\n", *(F.trim(F.lower(c)) for c in TEXTS), normal(F.col("name")))
    beside = F.broadcast if named.count() <= FEW_TAGS else grown  # never the monsters, which Spark takes for few by their compressed bytes
    few = [r["gram"] for r in asked.select("gram").distinct().limit(FEW_GRAMS + 1).collect()]
    if len(few) <= FEW_GRAMS:
        own = F.transform(F.array(held), lambda text: F.filter(F.array(*map(F.lit, few)), lambda gram: text.contains(gram)))  # the text is made once
        counts = monsters.select(F.explode(F.get(own, F.lit(0))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
        return monsters.withColumn("gram", F.explode(F.get(own, F.lit(0)))).join(beside(_rarest(asked, counts)), "gram").where(matches(F.col("tag"))).select("tag", F.col("id").alias("card_id"))
    index = monsters.select("id", F.explode(F.array_distinct(F.flatten(F.array(*(_grams(held, n) for n in sizes))))).alias("gram"))
    index = saved(index.join(grown(asked.select("gram").distinct()), "gram", "left_semi").distinct(), "grams")
    candidates = index.join(beside(_rarest(asked, index.groupBy("gram").agg(F.count(F.lit(1)).alias("held")))), "gram").select("tag", "id")
    return monsters.join(grown(candidates), "id").where(matches(F.col("tag"))).select("tag", F.col("id").alias("card_id"))


def _rarest(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """tag, gram: of each tag's grams the one that fewest monsters hold; none for a tag with a gram that no monster holds."""
    rarity = asked.join(grown(counts), "gram", "left")
    return rarity.groupBy("tag").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("x")).where("x.held > 0").select("tag", F.col("x.gram").alias("gram"))
