"""Edge cases of the operators on small frames."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.functions.columns import clamp, combat_stat, price, safe_int, slug
from loomspan.operators import catalog, clusters, graph, materials, sampling, scoring
from loomspan.plans.catalog_queries import catalog_cutoff
from loomspan.schemas import PAYLOAD
from loomspan.sources import readers


def values(spark, column, kind, *xs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_scalars(spark):
    x = F.col("x")
    assert values(spark, safe_int(x), "string", "12.9", "-3", "bad", None, "NaN") == [12, -3, None, None, None]
    assert values(spark, combat_stat(x), "string", "0", "-1", "2500") == [0, None, 2500]
    assert values(spark, price(x), "string", "", None, "1.5") == [None, None, 1.5]
    assert values(spark, slug(x), "string", "Edison (2010)", "--", " A b ") == ["edison_2010", "format", "a_b"]
    assert values(spark, clamp(x), "double", -1.0, 50.0, 101.0) == [0.0, 50.0, 100.0]


def test_a_payload_without_data_is_an_error(spark):
    with pytest.raises(PySparkException):
        catalog.payload_cards(spark.createDataFrame([(None,)], PAYLOAD)).collect()


def test_unknown_suffix_is_an_error(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/tmp/x.avro", "a int")


def test_cutoffs(spark):
    cards = spark.createDataFrame([(1, "2001-01-01"), (2, None), (3, "soon"), (4, "2020-01-01")], "id int, tcg_date string")
    ids = lambda cutoff: sorted(r.id for r in catalog_cutoff(cards, cutoff).collect())
    assert ids("2010-01-01") == [1] and ids(None) == [1, 2, 3, 4] and ids("never") == [1, 2, 3, 4]
    assert catalog_cutoff(cards.drop("tcg_date"), "2010-01-01").count() == 0


def test_all_noise_has_zero_metrics(spark):
    row = clusters.cluster_metrics(spark.createDataFrame([(1, -1, 0.5), (2, -1, 0.1)], "card_id int, cluster_id int, prob double")).first()
    assert (row.num_clusters, row.noise_count, row.noise_ratio, row.size_max, row.mean_prob, row.top_sizes) == (0, 2, 1.0, 0, 0.0, "[]")


def test_synergy_equals_the_pairwise_loop(spark):
    import itertools
    import math
    import random

    draw = random.Random(3)
    vectors = {i: [draw.gauss(0, 1) for _ in range(4)] for i in range(6)} | {6: [0.0] * 4}
    entries = [(1, i, 1 + i % 3) for i in range(7)] + [(2, 0, 1), (2, 6, 2)]
    got = {r.deck_id: r for r in scoring.deck_synergy(spark.createDataFrame(entries, "deck_id int, card_id int, copies int"), spark.createDataFrame(list(vectors.items()), "card_id int, embedding array<double>")).collect()}
    units = [[x / math.sqrt(sum(y * y for y in vectors[c])) for x in vectors[c]] for d, c, n in entries if d == 1 and c != 6 for _ in range(n)]
    pairs = [sum(a * b for a, b in zip(u, v)) for u, v in itertools.combinations(units, 2)]
    assert abs(got[1].mean_pairwise_cosine - sum(pairs) / len(pairs)) < 1e-9
    assert got[2].synergy_score == 50.0 and abs(got[2].coverage - 1 / 3) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 9)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_material_texts(spark):
    def tags(text):
        rows = materials.requirement_tags(spark.createDataFrame([(1, text)], "id int, descr string")).collect()
        return {r.tag: r.needed for r in rows}

    assert tags('2+ "Sky Hunter" monsters') == {"sky hunter": 2, "archetype:sky hunter:monster": 2}
    assert tags("1 WATER Tuner + 2 Dragon monsters; then 3 Fiend monsters") == {"attr_tuner:water": 1, "attr:water:tuner": 1, "type:dragon:monster": 2}
    assert tags("a non-Tuner 'Old Guard' monster") == {"old guard": 1, "archetype:old guard:non_tuner": 1}
    assert tags("Draw two.") == {} and tags(None) == {}


def test_quota_fill_never_breaks_limits(spark):
    specs = spark.createDataFrame([(i, 0, 20) for i in range(8)], "deck_id int, pool int, main_size int")
    cards = spark.createDataFrame([(i, 0, ("monster", "spell", "trap")[i % 3], i % 4) for i in range(60)], "card_id int, pool int, bucket string, max_copies int")
    ratios = {"monster": 0.5, "spell": 0.3, "trap": 0.2}
    rows = sampling.quota_fill(specs, cards, ratios).collect()
    assert all(0 < r.copies <= r.card_id % 4 for r in rows)
    assert all(sum(r.copies for r in rows if r.deck_id == d) == 20 for d in range(8))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sorted(rows) == sorted(sampling.quota_fill(specs, cards, ratios).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_blocks_cover_every_pair(spark):
    from loomspan.operators.blocks import beside

    rows, small = spark.range(7).toDF("r"), spark.range(23).toDF("s")
    for most, least in ((100, 1), (5, 5)):
        out, blocks = beside(rows, small, F.col("s"), "all", most)
        got = sorted(map(tuple, out.select("r", F.explode("all").alias("s")).collect()))
        assert blocks == least and got == [(r, s) for r in range(7) for s in range(23)]


def test_nearest_clusters_in_several_blocks(spark, monkeypatch):
    from loomspan.operators import blocks

    rows = spark.createDataFrame([(i, -1 if i % 4 == 0 else i % 4, 0.5, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)], "card_id long, cluster_id int, prob double, embedding array<double>")
    one = sorted(map(tuple, clusters.nearest_clusters(rows).collect()), key=str)
    monkeypatch.setattr(blocks.beside, "__defaults__", (1,))
    assert sorted(map(tuple, clusters.nearest_clusters(rows).collect()), key=str) == one


def test_generated_decks_keep_their_promises(spark):
    """End to end: sizes, copy limits, one valid draft a slot, and an error when there are too few."""
    from loomspan.operators import generation
    from loomspan.plans import sampling_queries as Q

    at = "/root/testdata/sf0.001"
    rows = Q._generated(spark, at).collect()
    limits = {r.card_id: (r.max_copies, r.in_extra, r.pool) for r in Q._candidates(spark, at).collect()}
    assert sorted(r.slot for r in rows) == list(range(25)) and {r.status for r in rows} == {"accepted", "rejected"}
    for r in rows:
        assert (r.status == "accepted") == (not r.failed) and 0 <= r.attempt < 50
        if r.status == "accepted":
            assert sum(c.copies for c in r.main) == 40 + r.slot % 3 and len(r.extra) <= 15 and r.resamples == r.attempt
            assert all(c.copies <= limits[c.card_id][0] and not limits[c.card_id][1] and limits[c.card_id][2] == r.slot % 5 for c in r.main)
            assert all(c.copies == 1 and limits[c.card_id][1] for c in r.extra)
        else:
            assert (r.attempt, r.resamples) == (49, 50)
    again = spark.createDataFrame(rows)
    n = sum(r.status == "accepted" for r in rows)
    assert generation.require(again, n).count() == n
    with pytest.raises(RuntimeError, match=f"{n} of {n + 1} decks"):
        generation.require(again, n + 1)


def test_places_follow_their_offers_one_by_one(spark):
    """The fold against a plain loop, with limits, repeated cards, staples that must stop and a bucket that overshoots."""
    import random

    draw = random.Random(5)
    ratios = {"monster": 0.5, "spell": 0.3, "trap": 0.2}
    specs = [(i, draw.choice([6, 10, 15])) for i in range(40)]
    offers = [(i, stage, n, draw.randrange(8), None, draw.randrange(4), draw.randrange(1, 4)) for i, _ in specs for stage in range(7) for n in range(5)]
    offers = [(i, s, n, c, sampling.BUCKETS[c % 3] if s not in (3, 4, 5) else sampling.BUCKETS[s - 3], m, w) for i, s, n, c, _, m, w in offers]
    want = []
    for i, size in specs:
        goal = {"monster": round(size * 0.5), "spell": round(size * 0.3)}
        goal["trap"] = size - goal["monster"] - goal["spell"]
        have, cards, total = dict.fromkeys(goal, 0), {}, 0
        for _, stage, _, card, bucket, most, wish in sorted(o for o in offers if o[0] == i):
            free = size - total
            if stage in (1, 2) and free <= sum(max(0, goal[b] - have[b]) for b in goal) or 3 <= stage <= 5 and have[bucket] >= goal[bucket]:
                continue
            n = max(0, min(wish, most - cards.get(card, 0), free))
            if n:
                want.append((i, card, bucket, stage, n))
                have[bucket], cards[card], total = have[bucket] + n, cards.get(card, 0) + n, total + n
    got = sampling.place(spark.createDataFrame(specs, "deck_id long, main_size int"), spark.createDataFrame(offers, "deck_id long, stage long, nth long, card_id long, bucket string, max_copies long, want long"), ratios)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_gram_index_finds_what_all_pairs_find(spark):
    """Tags of every kind, short, empty and odd ones, against every monster."""
    from loomspan.operators import materials as M

    cards = spark.createDataFrame([
        (1, "Blue Star  Giant", "Tuner Effect Monster", "Dragon-Type; a dark hero", "DARK", "Dragon", None), (2, "Ore", "Normal Monster", "light\nfoot", None, "Rock", "Ore Hero"), (3, "x", "Spell Card", "dark", "DARK", None, None),
        (4, None, "Synchro Monster", None, "EARTH", None, None), (4, None, "Synchro Monster", None, "EARTH", None, None), (5, "Ä😀ö", "Effect Monster", "ää 😀ö b:c", "LIGHT", "Fiend", "He"), (6, " dark ", " monster", "", "", "", "")],
        "id long, name string, type string, descr string, attribute string, race string, archetype string")
    tags = spark.createDataFrame([(t,) for t in (
        "attr_tuner:dark", "attr_monster:light", "type_tuner:dragon", "card_name:blue star giant", "attr:earth:non_tuner", "type:rock:monster", "archetype:hero:monster", "archetype:he:tuner", "archetype::monster", "hero", "b:c", "o", "😀ö", "none at all", "card_name:dark", "attr:dark:monster", "attr:dark:monster", None)], "tag string")
    got = Counter((r.tag, r.card_id) for r in M.tag_matches(tags, cards).collect())
    pairs = cards.crossJoin(tags.distinct().where("tag is not null")).where(M.matches(F.col("tag"))).select("tag", "id")
    assert got == Counter((r.tag, r.id) for r in pairs.collect()) and len(got) > 12
    plan = M.tag_matches(tags, cards)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert M.tag_matches(tags.limit(0), cards).count() == M.tag_matches(tags, cards.limit(0)).count() == 0


def _toy(spark):
    """Slots whose drafts are valid from an attempt of their own on; the specs seen in each round."""
    from loomspan.operators import generation as G

    specs = spark.createDataFrame([(i, i % 2, 2) for i in range(6)], "deck_id long, pool long, main_size int")
    candidates = spark.createDataFrame([(p, 10 * p + i, "monster", 3, False) for p in (0, 1) for i in range(4)], "pool long, card_id long, bucket string, max_copies int, in_extra boolean")
    from_attempt, seen = {0: 0, 1: 1, 2: 2, 3: 7, 4: 9, 5: 99}, []

    def draft(rows):
        seen.append(sorted((r.slot, r.attempt) for r in rows.collect()))
        main = rows.select("deck_id", (F.col("pool") * 10).alias("card_id"), F.lit(2).cast("long").alias("copies"), F.lit(3).cast("long").alias("stage"))
        return rows.select("deck_id", F.lit(1).alias("card_id")).limit(0), main

    def validated(entries):
        valid = F.lit(False)
        for slot, least in from_attempt.items():
            valid = valid | ((F.expr("deck_id div 10") == slot) & (F.col("deck_id") % 10 >= least))
        return entries.select("deck_id").distinct().select("deck_id", F.when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("type_ratio_ok"))).alias("failed"), valid.alias("ok"))

    return G, specs, candidates, draft, validated, seen


def test_rounds_draft_open_slots_only(spark):
    G, specs, candidates, draft, validated, seen = _toy(spark)
    plan = G.Plan(attempts=10, first_round=2, growth=2)
    got = {r.slot: (r.status, r.attempt, r.resamples) for r in G.generated(specs, draft, candidates, validated, plan, wanted=5).collect()}
    assert got == {0: ("accepted", 0, 0), 1: ("accepted", 1, 1), 2: ("accepted", 2, 2), 3: ("accepted", 7, 7), 4: ("accepted", 9, 9), 5: ("rejected", 9, 10)}
    assert seen == [[(s, a) for s in range(6) for a in (0, 1)], [(s, a) for s in (2, 3, 4, 5) for a in (2, 3, 4, 5)], [(s, a) for s in (3, 4, 5) for a in (6, 7, 8, 9)]]
    with pytest.raises(RuntimeError, match="5 of 6 decks"):
        G.generated(specs, draft, candidates, validated, plan, wanted=6)


def test_an_empty_pool_is_an_error(spark):
    G, specs, candidates, draft, validated, seen = _toy(spark)
    with pytest.raises(RuntimeError, match=r"pools \[1\]"):
        G.generated(specs, draft, candidates.where("pool = 0"), validated, G.Plan())
    assert not seen


def test_repairs_keep_what_was_placed_first(spark):
    """Cuts go by stage, and every filled card counts."""
    entries = spark.createDataFrame([(1, 0, 9, 3, 0, 4), (1, 0, 2, 3, 5, 4), (2, 0, 1, 1, 3, 4), (3, 0, 1, 2, 3, 2)], "deck_id long, pool long, card_id long, copies long, stage long, goal int")
    pool = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4, 5)], "pool long, card_id long")
    got = sampling.size_repair(entries, pool, F.col("goal")).collect()
    assert {(r.card_id, r.copies, r.repairs) for r in got if r.deck_id == 1} == {(9, 3, 1), (2, 1, 1)}
    assert {r.repairs for r in got if r.deck_id == 2} == {3} and sum(r.copies for r in got if r.deck_id == 2) == 4
    assert {(r.card_id, r.copies, r.repairs) for r in got if r.deck_id == 3} == {(1, 2, 0)}


@pytest.mark.parametrize("settings,error", [
    ('"none"', "no object"), ('{"min_main": 41}', "main sizes"), ('{"main_deck_size": 60, "max_main": 50}', "main sizes"), ('{"extra_deck_size": 3, "max_extra": 2}', "extra sizes"), ('{"min_extra": -1}', "extra sizes"),
    ('{"card_type_ratios": {"monster": 0.9}}', "shares"), ('{"card_type_ratios": {"monster": 1.5, "spell": -0.7}}', "shares"), ('{"card_type_ratios": {"tolerance_count": -1}}', "tolerance")])
def test_wrong_formats_are_errors(spark, settings, error):
    with pytest.raises(PySparkException, match=error):
        readers.formats(spark.createDataFrame([(f'{{"A": {settings}}}',)], "json string")).select("format").collect()


def test_deck_files_of_odd_decks(spark, tmp_path):
    """Decks without format or entries, formats with odd signs, sections in another order, and files of a run cut short."""
    from loomspan.sources import deck_files as DF

    at = str(tmp_path / "decks")
    decks = [(1, "GOAT"), (2, None), (3, "a/b =%"), (4, ""), (-5, "GOAT")]
    lines = [(1, 10, 3, "main"), (1, 10, 1, "side"), (1, 7, 1, "extra"), (3, 9, 2, "main"), (-5, 8, 1, "main"), (-5, None, 1, "main"), (-5, 8, 0, "extra"), (-5, 8, 1, "hand"), (77, 1, 1, "main")]
    entries, own = spark.createDataFrame(lines, "deck_id long, card_id long, copies long, zone string"), spark.createDataFrame(decks, "deck_id long, format string")
    with pytest.raises(PySparkException, match="no finished deck files"):
        DF.read_decks(spark, at).collect()
    for _ in range(2):  # a run that repeats another puts the same files in place
        DF.write_decks(entries, own, at, folders=2)
    texts = {r.deck_id: r.text for r in DF.deck_texts(entries, own).collect()}
    assert texts[1] == "#main\n10\n10\n10\n#extra\n7\n!side\n10\n" and texts[2] == "#main\n#extra\n!side\n"
    assert len(list(tmp_path.rglob("*.ydk"))) == 5 and (tmp_path / "decks" / "_SUCCESS").read_text() == "5"
    (tmp_path / "decks" / "format=GOAT" / "1" / "6.ydk").write_text("!side\r\n4\r\n#main\r\n5\r\n5\r\n\r\n")
    got = {tuple(r) for r in DF.read_decks(spark, at).select("deck_id", "format", "zone", "card_id", "copies").collect()}
    assert got == {(1, "GOAT", "main", 10, 3), (1, "GOAT", "side", 10, 1), (1, "GOAT", "extra", 7, 1), (3, "a/b =%", "main", 9, 2), (-5, "GOAT", "main", 8, 1), (6, "GOAT", "side", 4, 1), (6, "GOAT", "main", 5, 2)}
    with pytest.raises(Exception, match="decks share the id 1"):
        DF.write_decks(entries, own.unionByName(own.where("deck_id = 1")), str(tmp_path / "other"))


def _bytes(at):
    return {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file()}


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    from loomspan.sources.warehouse import LoadError, Rule, Warehouse

    rules = {"a": Rule({"id": "bigint", "n": "smallint"}, ("id",)), "b": Rule({"a_id": "bigint", "x": "string"}, (), ("a", "a_id", "id")), "c": Rule({"b_x": "string"}, (), ("b", "b_x", "x"))}
    w = Warehouse(spark, str(tmp_path / "w"), rules)
    a = lambda *rows: spark.createDataFrame(list(rows), "id long, n long, other string")
    b = lambda *rows: spark.createDataFrame(list(rows), "a_id long, x string")
    assert w.table("a").count() == 0 and w.manifest() == (0, {})
    assert w.load({"a": a((1, 5, "z"), (1, 5, "y"), (2, None, "")), "b": b((1, "p"), (None, "q")), "c": spark.createDataFrame([("p",)], "b_x string")}, "replace") == {"a": 2, "b": 2, "c": 1}
    before = _bytes(tmp_path / "w")
    wrong = [({"a": a((3, 40000, ""))}, "append", "a.n: smallint holds"), ({"a": a((1, 1, ""))}, "append", "is there already"), ({"a": a((None, 1, ""))}, "append", "without a key"),
             ({"b": b((9, "p"))}, "append", "1 rows without their a"), ({"b": b((1, "other"))}, "replace", None), ({"a": a((1, 1, "")).drop("n")}, "replace", "columns are missing")]
    for tables, mode, text in wrong:
        if text:
            with pytest.raises(LoadError, match=text):
                w.load(tables, mode)
            assert _bytes(tmp_path / "w") == before
    with pytest.raises(ValueError, match="mode"):
        w.load({}, "merge")
    with pytest.raises(ValueError, match="without a rule"):
        w.load({"d": a()}, "append")
    assert w.load({"a": a((3, 1, ""))}, "append") == {"a": 1} and sorted(r.id for r in w.table("a").collect()) == [1, 2, 3]
    number, tables = w.manifest()
    with pytest.raises(LoadError, match="another load"):
        w._publish(number, tables)  # what the slower of two loads meets
    w.load({"a": a((7, 7, ""))}, "replace")  # and empties b and c
    assert [tuple(r) for r in w.table("a").collect()] == [(7, 7)] and w.table("b").count() == w.table("c").count() == 0
    assert w.vacuum() == 2 and w.table("a").count() == 1


def test_database_load_is_one_transaction(spark, tmp_path):
    """Derby, which comes with Spark."""
    from loomspan.sources.warehouse import load_jdbc, read_jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    db = spark._jvm.java.sql.DriverManager.getConnection(url)
    for sql in ("create table cards (id bigint primary key, name varchar(20))", "create table lines (card_id bigint references cards (id), n int)"):
        statement = db.createStatement()
        statement.executeUpdate(sql)
        statement.close()
    db.close()
    cards = spark.range(1, 101).selectExpr("id", "concat('c', id) name")
    lines = spark.range(300).selectExpr("1 + id % 100 card_id", "cast(id as int) n")
    below = {"cards": ["lines"]}
    load_jdbc({"cards": cards, "lines": lines}, url, "replace", below, **driver)
    held = lambda: (read_jdbc(spark, url, "cards", "id", 4, **driver), read_jdbc(spark, url, "lines", "n", 3, **driver))
    c, n = held()
    assert c.rdd.getNumPartitions() == 4 and c.count() == 100 and n.agg({"n": "sum"}).first()[0] == 299 * 150
    for tables in ({"cards": cards.limit(3).selectExpr("id + 1000 id", "name"), "lines": lines.selectExpr("card_id + 5000 card_id", "n")}, {"cards": cards}):
        with pytest.raises(Exception):
            load_jdbc(tables, url, "append", below, **driver)
        c, n = held()
        assert c.count() == 100 and n.count() == 300
    load_jdbc({"cards": cards.where("id < 5")}, url, "replace", below, **driver)
    c, n = held()
    assert c.count() == 4 and n.count() == 0


def test_rows_delivered_again_are_taken_once(spark, tmp_path):
    from loomspan.streaming import incremental as I

    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for remember in (None, "2 days"):
        at, out, progress = (f"{p}-{remember}".replace(" ", "") for p in (source, target, mark))
        for rows in ([(1, "a"), (2, "b"), (2, "b"), (None, "n")], [(2, "b"), (3, "c"), (None, "n")], [(1, "a"), (3, "c")]):
            spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(at)
            I.append_new(spark, at, "k long, v string", out, progress, keys=["k"], remember=remember)
        done = spark.read.schema("k long, v string, batch int").parquet(out)
        assert sorted((str(r.k), r.v) for r in done.collect()) == [("1", "a"), ("2", "b"), ("3", "c"), ("None", "n")]
        I.require_all(spark.range(1, 4).toDF("k"), done, ["k"])
        with pytest.raises(ValueError, match="1 rows"):
            I.require_all(spark.range(1, 5).toDF("k"), done, ["k"])


@pytest.mark.parametrize("tries", [None, 0, 3])
def test_weighted_draws_follow_their_weights(spark, tries):
    """The first two of three cards, over 6,000 decks, against the chances worked out; with tries, without, and with too few."""
    from collections import Counter

    from loomspan.operators import sampling as SA

    weight = {1: 0.5, 2: 1.5, 3: 8.0}
    rows = spark.createDataFrame([("p", k, x) for k, x in weight.items()] + [("q", 9, None)], "pool string, card_id long, w double")
    specs = spark.range(6000).selectExpr("id deck_id", "if(id < 5990, 'p', if(id < 5995, 'q', 'none')) pool", "cast(if(id = 0, 0, 2) as int) k")
    got = {}
    for r in SA.weighted(specs, rows, ["pool"], F.col("k"), 1, "t", F.coalesce("w", F.lit(1.0)), tries).collect():
        got.setdefault((r.pool, r.deck_id), {})[r.nth] = r.card_id
    assert {len(x) for (p, _), x in got.items() if p == "p"} == {2} and [x for (p, _), x in got.items() if p == "q"] == [{0: 9}] * 5 and len(got) == 5994
    pairs = Counter((x[0], x[1]) for (p, _), x in got.items() if p == "p")
    assert all(a != b for a, b in pairs)
    for a in weight:
        for b in weight:
            if a != b:
                want = weight[a] / 10 * weight[b] / (10 - weight[a])
                assert abs(pairs[a, b] / 5989 - want) < 4 * (want * (1 - want) / 5989) ** 0.5
