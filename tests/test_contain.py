import random

import pytest
from pyspark.sql import functions as F

from stepfold.operators import contain


def plain(texts, items):
    return sorted((d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t)


def frames(spark, texts, items):
    return spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, item string")


def test_against_contains(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(900, None), (901, ""), (902, " "), (903, "a  b   c"), (904, "x" * 5000 + " tail end of it all now then")]
    items = [(i, t[rng.randrange(len(t) // 2) :][: rng.randint(1, 60)]) for i, (_, t) in enumerate(rng.sample([x for x in texts[:300] if len(x[1]) > 8], 60))]
    items += [(500, None), (501, ""), (502, " "), (503, "a  b"), (504, "w1"), (505, "1 w2 w"), (506, "xx tail end of it all no"), (507, "nowhere at all in any of these texts today")]
    a, b = frames(spark, texts, items)
    assert sorted(map(tuple, contain.contained(a, b).collect())) == plain(texts, items)
    assert contain.contained(a, b.filter(F.lit(False))).count() == 0 and contain.contained(a.filter(F.lit(False)), b).count() == 0


@pytest.mark.parametrize("only_common", [False, True])
def test_no_common_run_becomes_a_key(spark, only_common):
    """One run of words stands in every text; no key has over 1/4,096 of the rows, or an item that has no other is salted."""
    texts = [(i, f"u{i} v{i} q{i} the run that is everywhere a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(6000)]
    items = [(0, "q17 the run that is everywhere a17 b17 c")] if not only_common else [(0, "q17 the run that is everywhere a17")]
    a, b = frames(spark, texts, items)
    keys = contain.text_keys(a, [("words", 5)])
    total = keys.count()
    counts = keys.groupBy(contain.slot("key").alias("slot")).agg(F.count("*").alias("n"))
    left, right = contain.dealt(keys, contain.rarest(contain.item_keys(b), counts), total)
    most = left.groupBy("key", "salt").count().agg(F.max("count")).first()[0]
    assert most <= (total / 4096 if not only_common else 6000 / contain.SALTS * 2)
    assert right.count() == (contain.SALTS if only_common else 1)
    assert sorted(map(tuple, contain.contained(a, b).collect())) == [(17, 0)]


def test_texts_send_only_keys_that_items_ask_for(spark, monkeypatch):
    """Keys of other slots are dropped where texts are read; texts longer than a piece, of several bytes a character and without words keep theirs."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"é{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 5, 40, 900])))) for i in range(400)] + [(900, ""), (901, "ü" * 3000), (902, "  ")]
    items = [(i, " ".join(texts[i][1].split(" ")[:9])) for i in range(0, 400, 50)] + [(1000, "üü"), (1001, "é1 é"), (1002, "")]
    a, b = frames(spark, texts, items)
    monkeypatch.setattr(contain, "_PIECE", 200)
    kinds = [("words", 5)]
    every, asked = contain.text_keys(a, kinds), contain.text_keys(a, kinds, contain.asked_slots(contain.item_keys(b)))
    assert asked.count() < every.count() / 100 and asked.count() >= 1
    assert every.count() == every.distinct().count() == len({(d, *t.split(" ")[i : i + 5]) for d, t in texts for i in range(len(t.split(" ")) - 4)})
    assert sorted(map(tuple, contain.contained(a, b).collect())) == plain(texts, items)
