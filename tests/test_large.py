"""Steps that must stay small on large tables: archives of deck files, joins that no driver holds, draws that are not made."""

import duckdb
import pytest
from pyspark.errors import PySparkException

from loomspan.operators import materials, sampling
from loomspan.plans import deck_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_deck_files(spark, tmp_path):
    """Many decks take few files, which any tar unpacks; archives that no list names are not read; a second run is refused."""
    import tarfile

    from loomspan.sources import deck_files as DF

    at = tmp_path / "decks"
    decks = spark.createDataFrame([(i, (None, "GOAT", "a/b =%")[i % 3]) for i in range(-5, 95)], "deck_id long, format string")
    entries = decks.selectExpr("deck_id", "deck_id * 3 card_id", "2L copies", "if(deck_id % 2 = 0, 'main', 'side') zone").where("deck_id <> 7")
    DF.write_decks(entries.repartition(2), decks, str(at), pack=20)
    packed = list(at.rglob("*.tar.gz"))
    assert not list(at.rglob("*.ydk")) and len(packed) < 40 and (at / "_SUCCESS").read_text() == "100"
    members = {}
    for path in packed:
        with tarfile.open(path) as tar:
            found = {m.name: tar.extractfile(m).read().decode() for m in tar}
        assert 0 < len(found) <= 20
        members |= found
    assert len(members) == 100 and members["-4.ydk"] == "#main\n-12\n-12\n#extra\n!side\n" and members["7.ydk"] == "#main\n#extra\n!side\n"
    (at / "format=GOAT" / "failed-0.tar.gz").write_bytes(packed[0].read_bytes())
    got = sorted(map(tuple, DF.read_decks(spark, str(at)).select("deck_id", "zone", "card_id", "copies").collect()))
    assert got == sorted(map(tuple, entries.select("deck_id", "zone", "card_id", "copies").collect()))
    assert {tuple(r) for r in DF.read_decks(spark, str(at)).select("deck_id", "format").distinct().collect()} == {tuple(r) for r in decks.where("deck_id <> 7").collect()}
    with pytest.raises(PySparkException, match="new folder"):
        DF.write_decks(entries, decks, str(at), pack=20)


def test_the_query_packs_its_deck_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deck_queries, "new_path", lambda _, name: str(tmp_path / name))
    assert deck_queries.deck_files(spark, "/root/testdata/sf0.001").count() > 0
    assert not list(tmp_path.rglob("*.ydk")) and list(tmp_path.rglob("*.tar.gz"))


@pytest.mark.parametrize("name", ["metrics_long", "score_records", "validate_decks", "material_support", "deck_scores", "deck_synergy", "deck_consistency"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    """But for the rules of the formats, the tags' rarest grams and the parts of numbered rows."""
    text = plan(deck_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    joins = [x for x in text.split("\n") if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
    assert all(any(f"[{c}#" in x for c in ("_format", "_part", "gram")) for x in joins) and text.count("SortMergeJoin") > 0


def test_decks_are_dealt_before_their_sums(spark):
    """No sums of 64 dimensions are made where a deck's entries lie apart: nothing is summed below the exchange by deck."""
    steps = plan(deck_queries.deck_scores(spark, "/root/testdata/sf0.001")).split("\n")
    wide = [i for i, x in enumerate(steps) if "HashAggregate(keys=[deck_id" in x and "partial_sum" in x]
    assert wide and all(any("REPARTITION_BY_NUM" in x for x in steps[i + 1 : i + 4]) for i in wide)


@pytest.mark.parametrize("few", [0, 256])
def test_gram_index_with_few_and_many_grams(spark, monkeypatch, few):
    monkeypatch.setattr(materials, "FEW_GRAMS", few)
    cards = spark.createDataFrame([(1, "Effect Monster", "DARK", "Dragon", None, "Red Moon", "x"), (2, "Tuner Monster", "dark", "a", "Brand#1", "b", None), (3, "Spell Card", "DARK", "Dragon", None, "Red Moon", "x")], "id long, type string, attribute string, race string, archetype string, name string, descr string")
    tags = spark.createDataFrame([("attr_monster:dark",), ("type:dragon:monster",), ("brand#1",), ("card_name:red moon",), ("attr:fire:tuner",), ("attr:dark:tuner",)], "tag string")
    got = {tuple(r) for r in materials.tag_matches(tags, cards).collect()}
    assert got == {("attr_monster:dark", 1), ("attr_monster:dark", 2), ("type:dragon:monster", 1), ("brand#1", 2), ("card_name:red moon", 1), ("attr:dark:tuner", 2)}


def test_few_draws_are_made_at_once(spark):
    """The first run is one draw, and later ones are looked at only where it is not valid; all tries together are as before."""
    specs = spark.range(2000).withColumnRenamed("id", "deck_id")
    ratios = {"monster": 0.5, "spell": 0.3, "trap": 0.2}
    rows = sampling.ratio_jitter(specs, ratios, 0.05)
    assert "sequence(0, 199" not in rows._jdf.queryExecution().analyzed().toString()
    sql = """with d as (select deck_id, i, 0.5 + 0.05::double * (2 * (('0x' || substr(md5('1|monster|' || deck_id || '|' || i), 1, 8))::ubigint / 4294967296.0) - 1) m, 0.3 + 0.05::double * (2 * (('0x' || substr(md5('1|spell|' || deck_id || '|' || i), 1, 8))::ubigint / 4294967296.0) - 1) s from range(2000) a(deck_id), range({}) t(i))
      select a.deck_id, round(coalesce(m, 0.5), 6), round(coalesce(s, 0.3), 6) from range(2000) a(deck_id) left join (select * from d where abs(1 - m - s - 0.2) <= 0.05 qualify row_number() over (partition by deck_id order by i) = 1) using (deck_id) order by 1"""
    for tries in (1, 3, 200):
        got = [(r.deck_id, round(r.monster, 6), round(r.spell, 6)) for r in sampling.ratio_jitter(specs, ratios, 0.05, tries=tries).orderBy("deck_id").collect()]
        assert got == duckdb.sql(sql.format(tries)).fetchall()
    assert [tuple(r) for r in sampling.ratio_jitter(specs.limit(1), ratios, 0.05, tries=0).select("monster", "spell").collect()] == [(0.5, 0.3)]


def test_repairs_are_counted_by_deck(spark):
    """A deck's own cards are counted where its entries lie together, and neither entries nor pools are broadcast."""
    from loomspan.plans import sampling_queries

    text = plan(sampling_queries.size_repair(spark, "/root/testdata/sf0.001"))
    joins = [x for x in text.split("\n") if "BroadcastHashJoin" in x]
    assert text.count("REPARTITION_BY_NUM") >= 2 and all("[pool#" in x for x in joins)


@pytest.mark.parametrize("name", ["tag_capacity", "material_support"])
def test_cards_are_dealt_by_number_and_not_broadcast(spark, name):
    """Cards of few bytes would be put together into a few tasks; of a join by grams only the tags' side may be broadcast."""
    text = plan(deck_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    joins = [x for x in text.split("\n") if "BroadcastHashJoin" in x]
    assert "REPARTITION_BY_NUM" in text and "REPARTITION_BY_COL" not in text and all("[gram#" in x and "BuildRight" in x for x in joins)


@pytest.mark.parametrize("few", [0, 256])
def test_many_tags_are_merged(spark, monkeypatch, few):
    """Tags over the bound match the same cards, a repeated id once for each of its rows that matches."""
    monkeypatch.setattr(materials, "FEW_GRAMS", few)
    cards = spark.createDataFrame([(1, "Effect Monster", "DARK", "Dragon", None, "Red Moon", "x"), (1, "Tuner Monster", "dark", "a", "Brand#1", "b", None), (2, "Monster", "FIRE", "", None, "dar", None)], "id long, type string, attribute string, race string, archetype string, name string, descr string")
    tags = spark.createDataFrame([("attr_monster:dark",), ("brand#1",), ("attr:fire:monster",), ("type:wyrm:monster",)], "tag string")
    for most in (materials.FEW_TAGS, 0):
        monkeypatch.setattr(materials, "FEW_TAGS", most)
        got = materials.tag_matches(tags, cards)
        assert sorted(tuple(r) for r in got.distinct().collect()) == [("attr:fire:monster", 2), ("attr_monster:dark", 1), ("brand#1", 1)]
        assert most or "BroadcastHashJoin" not in plan(got)


def test_checks_are_dealt_by_deck(spark):
    """Facts, copies and levels are grouped where a deck's entries lie together, and no texts are dealt for them."""
    steps = plan(deck_queries.validate_decks(spark, "/root/testdata/sf0.001")).split("\n")
    dealt = [i for i, x in enumerate(steps) if "hashpartitioning(deck_id" in x and "REPARTITION_BY_NUM" in x]
    assert len(dealt) >= 3 and not any("descr#" in steps[i + 1].split(" AS ")[-1] for i in dealt)


def test_more_rows_are_dealt_to_more_tasks(spark):
    from loomspan.shared import DEALT, by_key

    rows = spark.range(10)
    parts = [by_key(rows, "id", many).rdd.getNumPartitions() for many in (0, DEALT, 40 * DEALT - 1, 40 * DEALT + 1)]
    assert parts == [8, 8, 40, 41]


@pytest.mark.parametrize("wide", [9, 1 << 14])
def test_clusters_of_vectors_are_those_of_their_pairs(spark, monkeypatch, wide):
    """In blocks and in one: ties, copies, a repeated id, ids far apart, vectors that take no part; one number of samples and several."""
    import random

    from loomspan.operators import density, neighbours

    draw = random.Random(5)
    rows = [(7 * i - 100, [float(draw.randrange(15)), float(draw.randrange(15)), draw.randrange(3) / 2]) for i in range(110)]
    rows += [(rows[3][0], [1.0, 1.0, 0.0]), (1 << 62, rows[5][1]), (-(1 << 62), [90.0, 0.0, 0.0]), (900, None), (901, [1.0]), (902, [float("nan"), 0.0, 0.0])]
    once = list(dict(rows[::-1]).items())
    monkeypatch.setattr(density, "WIDE", wide)
    monkeypatch.setattr(neighbours, "BLOCK", min(wide, neighbours.BLOCK))
    monkeypatch.setattr(density, "STRIP", 7)
    order = lambda df: sorted((r.trial, r.card_id, r.cluster_id, round(r.prob, 12)) for r in df.collect())
    for grid in (([1.0, 1.2, 2.0], [1, 3, 5], [1, 4]), ([1.5], [4], [2]), ([1.5], [1], [2])):
        frame = spark.createDataFrame(rows if grid[1] == [4] else once, "card_id long, embedding array<double>")
        pairs = neighbours.neighbour_pairs(frame, 2.0)
        trials = density.trial_grid(spark, *grid)
        got = order(density.vector_clusters(frame, trials))
        assert got == order(density.density_clusters(frame, pairs, trials)) and len({x[2] for x in got}) > 2
    assert density.vector_clusters(frame.limit(0), trials).count() == 0


def test_clusters_write_no_pairs(spark, monkeypatch):
    """Of 600 vectors that are all near each other 180,000 pairs would be written; a row for each vector and step is."""
    from loomspan.operators import density

    written = {}
    was = density.saved
    monkeypatch.setattr(density, "saved", lambda df, name: (x := was(df, name), written.update({name: x.count()}))[0])
    frame = spark.range(600).selectExpr("id card_id", "array(float(id % 10) / 100, float(id) / 100000) embedding")
    got = density.vector_clusters(frame, density.trial_grid(spark, [0.5, 1.0], [2, 3], [2])).collect()
    assert {r.cluster_id for r in got} == {0} and written and max(written.values()) <= 600 * 4


@pytest.mark.parametrize("name", ["deck_scores", "deck_synergy", "deck_consistency"])
def test_lines_are_dealt_by_deck_and_tasks_follow_their_number(spark, monkeypatch, name):
    """A deck's lines come together before they are summed up, and more lines are dealt to more tasks."""
    from loomspan import shared

    monkeypatch.setattr(shared, "DEALT", 100)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    steps = plan(deck_queries.QUERIES[name](spark, "/root/testdata/sf0.001")).split("\n")
    for key in ("l_orderkey", "deck_id"):
        dealt = [x for x in steps if "REPARTITION_BY_NUM" in x and f"hashpartitioning({key}" in x]
        assert dealt and all(f", {-(-lines // 100)})" in x for x in dealt)
    summed = [i for i, x in enumerate(steps) if "HashAggregate(keys=[l_orderkey" in x and "partial_sum" in x]
    assert summed and all(any("REPARTITION_BY_NUM" in x for x in steps[i + 1 : i + 4]) for i in summed)


def test_copies_of_a_vector_do_not_grow_with_the_vectors(spark, monkeypatch):
    """More vectors make wider blocks, not more of them, and coherence joins no vector with its cluster's mean."""
    from loomspan.operators import clusters, density, neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(density, "NARROW", 10, raising=False)
    met = []
    was = density.saved
    monkeypatch.setattr(density, "saved", lambda df, name: (x := was(df, name), met.append(x) if name == "meetings" else None)[0])
    for many in (100, 400):
        frame = spark.range(many).selectExpr("id card_id", "array(float(id * 37 % 101), float(id * 17 % 89)) embedding")
        assert density.vector_clusters(frame, density.trial_grid(spark, [200.0], [2], [2])).where("cluster_id = 0").count() == many
    assert len({x.select("block").distinct().count() for x in met}) == 1 and len(met) == 2
    rows = spark.createDataFrame([(1, 0, [3.0, 0.0]), (2, 0, [0.0, 0.5]), (3, 0, [0.0, 0.0]), (4, 1, [1.0, 1.0]), (5, -1, [1.0, 0.0]), (6, 2, [1.0, 0.0]), (7, 2, [-1.0, 0.0])], "card_id long, cluster_id int, embedding array<double>")
    got = clusters.coherence(rows)
    assert "Join" not in plan(got)
    assert {r.cluster_id: round(r.coherence, 12) for r in got.collect()} == {0: round(2**0.5 / 3, 12), 1: 0.0, 2: 0.0}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e8])
@pytest.mark.parametrize("shift", [0.0, 300.0])
def test_no_pair_is_lost_to_single_precision(monkeypatch, scale, shift):
    """Pairs at exactly eps and a little beyond it, in tiles of any size, far from zero and of any magnitude."""
    import numpy as np
    import pyarrow as pa

    from loomspan.operators import neighbours

    monkeypatch.setattr(neighbours, "ACROSS", 13)
    monkeypatch.setattr(neighbours, "CHUNK", 5)
    x = (np.random.default_rng(3).integers(0, 9, (120, 3)) + shift) * scale
    d = np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2 + (x[:, None, 2] - x[None, :, 2]) ** 2)
    eps = float(np.sort(d[d > 0])[2000])
    for block, i, j in (([0] * 120, 0, 0), ([0] * 70 + [1] * 50, 0, 1)):
        rows = pa.table({"k": np.arange(120), "block": block, "i": [i] * 120, "j": [j] * 120, "v": list(x)})
        want = {(a, b): d[a, b] for a in range(120) for b in range(a + 1, 120) if d[a, b] <= eps and (i == j or (a < 70 <= b))}
        for together in (1, 1 << 17):
            monkeypatch.setattr(neighbours, "TOGETHER", together)
            got = [(int(a), int(b), float(z)) for p, q, w in neighbours.near_in(rows, eps, 7) for a, b, z in zip(p, q, w)]
            assert len(got) == len(want) and {(a, b): z for a, b, z in got} == want


def test_lines_are_brought_together_once_for_material_support(spark, monkeypatch):
    """A deck's extra and main cards, and what it asks for, are read from one table of entries, not from the lines each time."""
    made = []
    was = deck_queries.saved
    monkeypatch.setattr(deck_queries, "saved", lambda df, name: (made.append(name), was(df, name))[1])
    text = plan(deck_queries.material_support(spark, "/root/testdata/sf0.001"))
    assert made.count("entries") == 1 and "l_orderkey" not in text and "l_partkey" not in text


def test_floats_stay_floats_and_tasks_join_to_the_least_number(spark, monkeypatch):
    """Vectors are dealt and written in no more bytes than they came in, and tasks that share a block give the same links."""
    from loomspan.operators import density, neighbours

    monkeypatch.setattr(density, "NARROW", 10)
    kept = {}
    for module in (density, neighbours):
        monkeypatch.setattr(module, "saved", lambda df, name, was=module.saved: kept.setdefault(name, was(df, name)))
    frame = spark.range(100).selectExpr("id * 37 % 101 card_id", "array(float(id * 37 % 101 / 7), float(id * 17 % 89 / 3)) embedding")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        density.vector_clusters(frame, density.trial_grid(spark, [200.0], [2], [2])).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    links = kept["joined"].where("link")
    assert links.count() >= 99 and links.where("a <= b").count() == 0
    assert links.select("b").distinct().count() <= kept["blocks"].select("block").distinct().count()
    assert kept["blocks"].schema["v"].dataType.simpleString() == "array<float>"
    # values that a float cannot hold are told apart
    frame = spark.createDataFrame([(1, [0.1]), (2, [0.1 + 1e-12]), (3, [0.4])], "card_id long, embedding array<double>")
    assert [(r.a, r.b) for r in neighbours.neighbour_pairs(frame, 2e-12).collect()] == [(1, 2)]


def test_each_call_of_the_stream_deals_its_own_lines_once(spark):
    """Lines are read once, and a deck's rows go in one exchange that holds vectors but no texts; decks given twice count once."""
    at = "/root/testdata/sf0.001"
    decks = spark.read.parquet(f"{at}/orders.parquet").selectExpr("o_orderkey deck_id", "'GOAT' format").where("deck_id % 3 = 1")
    some = deck_queries._scores(spark, at, decks)
    steps = plan(some).split("\n")
    assert sum("FileScan parquet [l_orderkey" in x for x in steps) == 1
    dealt = [(x, steps[i + 1]) for i, x in enumerate(steps) if "Exchange hashpartitioning(deck_id" in x]
    rows = [below for x, below in dealt if "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 2 and len(rows) == 1 and all(f" AS {c}#" in rows[0] for c in ("bucket", "starter", "vector"))
    figures = lambda df: {tuple(round(x, 6) for x in r) for r in df.where("deck_id % 3 = 1").select("deck_id", "consistency_score", "synergy_score", "brick_risk_score", "unique_ratio").collect()}
    every = figures(deck_queries._scores(spark, at))
    assert len(every) == 500 and figures(some) == figures(deck_queries._scores(spark, at, decks.unionByName(decks))) == every


@pytest.mark.parametrize("columns", ["k long, v string, w int", "k long"])
def test_keys_met_are_files_and_a_call_that_failed_is_made_good(spark, tmp_path, columns):
    """No state is held by the executors; a batch that failed after it noted its keys, or wrote a part, takes the same rows again."""
    from loomspan.streaming import incremental as I

    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    n = len(columns.split(","))
    calls = []

    def work(rows):
        calls.append(rows.count())
        if len(calls) == 2:
            rows.write.parquet(f"{target}/batch=1")
            raise ValueError("lost")
        return rows

    for rows in ([(1, "a", 1), (2, None, 2), (2, None, 2), (None, "n", 3)], [(2, None, 2), (3, "c", None), (None, "n", 3), (4, "d", 4)], [(4, "d", 4), (1, "a", 1)]):
        spark.createDataFrame([r[:n] for r in rows], columns).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            try:
                I.append_new(spark, source, columns, target, mark, work, keys=["k"])
            except Exception as e:
                assert "lost" in str(e)
    assert calls == [3, 2, 2, 0]
    got = sorted((tuple(r) for r in spark.read.schema(columns).parquet(*(str(x) for x in (tmp_path / "out").glob("batch=*"))).collect()), key=str)
    assert got == sorted((r[:n] for r in [(1, "a", 1), (2, None, 2), (None, "n", 3), (3, "c", None), (4, "d", 4)]), key=str)
    assert not (tmp_path / "mark" / "state").exists()
