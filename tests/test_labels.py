"""Labels from JSON texts, records that take them, scores of decks with unknown cards, summaries and hashed words."""

import json

import pytest

from loomspan.operators import catalog, clusters, labels, scoring, validation


def ingest(spark, *texts):
    answers = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id int, cluster_id int, raw string")
    heuristics = spark.createDataFrame([(0, "graveyard_setup")], "cluster_id int, functional_role string")
    return {r.id: r for r in labels.ingest_labels(answers, "raw", heuristics).collect()}


def test_refused_texts_take_the_heuristic_of_their_cluster(spark):
    got = ingest(spark, None, "", "{", "[]", "[null]", "[[1]]", '"text"', "null", '{"label_confidence": "high"}', '{"label_confidence": {"a": 1}}')
    assert [got[i].failure for i in range(10)] == ["not_json", "not_json", "not_json", "empty_list", "list_without_object", "list_without_object", "no_object", "no_object", "bad_confidence", "bad_confidence"]
    assert tuple(got[0])[2:] == ("graveyard_setup", "graveyard setup", 0.55, "heuristic:graveyard_setup", "heuristic:graveyard_setup", "not_json")
    assert tuple(got[1])[2:] == ("misc", "misc", 0.55, "heuristic:misc", "heuristic:misc", "not_json")


def test_accepted_texts(spark):
    long = {"functional_role": "\tBURN ", "label_hint": "h" * 200, "label_confidence": "0.25", "reasoning": " " + "r" * 500}
    got = ingest(spark, json.dumps(long), json.dumps([long | {"functional_role": "none of these"}, 5]), json.dumps({"result": long, "functional_role": "draw"}), json.dumps({"result": 3, "functional_role": "draw"}), "{}", '{"label_hint": 7, "label_confidence": null}')
    assert {r.failure for r in got.values()} == {""} and {r.label_source for r in got.values()} == {"answer"}
    assert [(got[i].functional_role, got[i].label_confidence) for i in range(6)] == [("burn", 0.25), ("misc", 0.25), ("burn", 0.25), ("draw", 0.5), ("misc", 0.5), ("misc", 0.5)]
    assert got[0].label_hint == "h" * 120 and got[0].reasoning == "r" * 400
    assert (got[3].label_hint, got[3].reasoning, got[5].label_hint) == ("draw", "", "7")


@pytest.fixture
def assigned(spark):
    assign = spark.createDataFrame([(1, -1, 0.0, [1.0, 0.1]), (2, 3, 0.9, [1.0, 0.0]), (3, 3, 0.8, [0.9, 0.1]), (4, 4, 0.7, [0.0, 1.0]), (5, -1, 0.0, [0.0, 0.0])], "card_id int, cluster_id int, prob double, embedding array<double>")
    cards = spark.createDataFrame([(1, "one", "Trap", None, "draw cards"), (2, "two", "Trap", "x", "draw"), (3, "three", "Spell", "x", None), (4, "four", None, None, "negate")], "card_id int, name string, type string, archetype string, descr string")
    return assign, assign.drop("embedding").join(cards, "card_id", "left")


def test_records_take_labels_but_for_the_noise(spark, assigned):
    given = spark.createDataFrame([(3, "burn", "fire", 0.4, "it burns", "answer"), (-1, "burn", "fire", 0.4, "it burns", "answer"), (99, "burn", "", 0.4, "", "answer")], "cluster_id int, functional_role string, label_hint string, label_confidence double, reasoning string, label_source string")
    got = {r.cluster_id: r for r in clusters.metadata_records(*assigned, labels=given).collect()}
    assert set(got) == {-1, 3, 4}
    assert (got[3].functional_role, got[3].label_hint, got[3].label_confidence, got[3].label_source, got[3].metadata.reasoning) == ("burn", "fire", 0.4, "answer", "it burns")
    assert (got[4].functional_role, got[4].label_source) == ("negation", "heuristic:negation") and got[-1].label_source == "heuristic:draw"
    assert got[3].metadata.noise_summary is None and not got[3].metadata.noise_cluster
    noise = got[-1].metadata.noise_summary
    assert (noise.noise_cards, noise.noise_ratio) == (2, 0.4) and json.loads(noise.types) == {"Trap": 1, "unknown": 1} and json.loads(noise.archetypes) == {"unknown": 2}
    assert sum(json.loads(noise.nearest_clusters).values()) == 2 and json.loads(noise.nearest_clusters)["3"] >= 1


def test_without_noise_or_rows_there_is_a_summary(spark, assigned):
    assign, rows = assigned
    got = clusters.noise_summary(assign.where("cluster_id = 3"), rows.where("cluster_id = 3")).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, "{}", "{}", "{}")]
    assert [tuple(r) for r in clusters.noise_summary(assign.limit(0), rows.limit(0)).collect()] == [(0, 0.0, "{}", "{}", "{}")]


CARD = "id int, name string, type string, descr string, level int, scale int, tcg_date string"


def entries(spark):
    cards = spark.createDataFrame([(1, "a", "Effect Monster", "Special Summon this.", 4, None, "2001-01-01"), (2, "b", "Spell Card", "Plain.", None, None, "2001-01-01"), (3, "c", "Fusion Monster", "x", 6, None, "2001-01-01")], CARD)
    rows = [(10, "main", 1, 2), (10, "main", 2, 1), (10, "main", 77, 1), (10, "extra", 3, 1), (11, "extra", 3, 2)]
    return scoring.deck_entries(spark.createDataFrame(rows, "deck_id int, zone string, card_id int, copies int"), cards)


def test_unknown_cards_count_in_sizes_only(spark):
    decks = spark.createDataFrame([(10, "GOAT"), (11, None), (12, None)], "deck_id int, format string")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "card_id int, embedding array<double>")
    starters = spark.createDataFrame([], "card_id int")
    got = {r.deck_id: r for r in scoring.measured(decks, entries(spark), vectors, starters).collect()}
    a = got[10]
    assert (a.main_size, a.extra_size, a.unique_main_count, a.monster_count, a.spell_count, a.starters, a.starter_kinds) == (4, 1, 3, 2, 1, 2, 1)
    assert a.coverage == 0.75 and a.mean_pairwise_cosine == pytest.approx(1) and a.hit_rate == pytest.approx(1)
    for deck in (11, 12):
        r = got[deck]
        assert (r.main_size, r.starters, r.synergy_score, r.unique_main_ratio, r.hit_rate, r.coverage) == (0, 0, 50.0, 0.0, None, None)
    one_by_one = {r.deck_id: r for r in scoring.deck_synergy(entries(spark).where("zone = 'main'"), vectors).collect()}
    assert set(one_by_one) == {10} and one_by_one[10].synergy_score == pytest.approx(a.synergy_score)


def test_vectors_of_different_lengths_are_an_error(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0])], "card_id int, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        scoring.deck_synergy(entries(spark), vectors).collect()


def test_scores_without_vectors(spark):
    got = scoring.deck_synergy(entries(spark), spark.createDataFrame([], "card_id int, embedding array<double>")).collect()
    assert {(r.coverage, r.synergy_score) for r in got} == {(0.0, 50.0)}


def test_unknown_cards_fail_their_rule(spark):
    limits = spark.createDataFrame([], "card_id int, max_copies int")
    support = spark.createDataFrame([], "deck_id int, material_ok boolean")
    got = {r.deck_id: r for r in validation.validate_decks(entries(spark), limits, support, validation.DeckRules(main_size=4, extra_max=3)).collect()}
    assert not got[10].cards_exist_ok and "1 cards are unknown" in got[10].errors and got[11].cards_exist_ok


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (5,), (5,)], "card int")
    assert [tuple(r) for r in catalog.orphans(spark.createDataFrame([(1,), (2,)], "id int"), "id", {"child": (child, "card")}).collect()] == [("child", 2)]


def test_a_summary_is_one_document(spark, tmp_path):
    from loomspan.sources import writers

    row = spark.sql("select 3L n, cast(null as string) note, array(named_struct('format', 'GOAT', 'n', 2L)) formats")
    writers.write_summary(row, str(tmp_path / "summary"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "summary").glob("part-*")))
    assert json.loads(text) == {"n": 3, "note": None, "formats": [{"format": "GOAT", "n": 2}]}
    with pytest.raises(Exception, match="one row, not 2"):
        writers.write_summary(row.unionAll(row), str(tmp_path / "two"))


def test_hash_embedding_of_repeated_keys_and_no_words(spark):
    import hashlib

    from loomspan.operators.features import hash_embedding

    rows = [(1, "Tuner tuner monster"), (1, "spell"), (2, None), (3, "?!"), (4, "x " * 1000)]
    got = {r.id: r.embedding for r in hash_embedding(spark.createDataFrame(rows, "id int, text string"), "id", "text", 16).collect()}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
    counts = [0.0] * 16
    for w in ("tuner", "tuner", "monster", "spell"):
        counts[place(w)] += 1
    size = sum(c * c for c in counts) ** 0.5
    assert got[1] == pytest.approx([c / size for c in counts])
    assert got[2] == got[3] == [0.0] * 16 and got[4] == [float(i == place("x")) for i in range(16)]
