import itertools

from barloom.llm import decontam

ITEM = " ".join(f"w{i}" for i in range(20))


def test_masks_lose_nothing():
    """Any two differences among thirteen aligned tokens leave a mask a place without them."""
    places = [{o + p for p in m} for m in decontam.MASKS for o in range(13 - m[-1])]
    for gone in itertools.combinations(range(13), 2):
        assert any(not p & set(gone) for p in places)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, [2], "k") for i, t in docs], "doc_id long, text string, pos int, h array<int>, item string")
    b = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, key int")
    return {(r["id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}


def test_substitutions_and_clean_texts(spark):
    words = ITEM.split()
    two = words[:13]
    two[4], two[9] = "other", "another"
    three = list(two)
    three[6] = "third"
    docs = [(1, "before " + ITEM.upper().replace(" ", ", ") + " after"), (2, "x " * 40 + " ".join(two) + " y"), (3, " ".join(three)), (4, " ".join(words[:12])), (5, None), (6, ""), (7, "w1 w0 " * 60), (8, "u " * 20000 + ITEM)]
    assert run(spark, docs, [(1, ITEM), (1, ITEM), (2, "too short to tell"), (3, None)]) == {(1, 1), (2, 1), (8, 1)}


def test_shuffled_join_agrees(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, decontam.contaminated(d, b).collect())) == small and small


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == set() and run(spark, [(1, ITEM)], []) == set()


def test_very_long_texts_ties_and_refused_settings(spark, monkeypatch):
    """A long text with many hits; items that match equally well are told all; settings the masks do not cover raise."""
    import pytest

    from barloom.llm import common

    long = " ".join(["u v " * 100 + ITEM] * 400)
    docs = [(1, long), (None, long), (1, "clean words only " * 30), (2, ITEM)]
    want = {(1, 1), (1, 2), (None, 1), (None, 2), (2, 1), (2, 2)}
    assert run(spark, docs, [(1, ITEM), (2, ITEM + " and more words of its own")]) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", 0)
    assert run(spark, docs, [(1, ITEM), (2, ITEM + " and more words of its own")]) == want
    for setting in ({"window": 12}, {"differ": 3}):
        with pytest.raises(ValueError):
            decontam.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), **setting)
