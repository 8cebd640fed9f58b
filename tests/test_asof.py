import random

from tidemark.operators.asof import as_of_join

HOW = dict(event_entity="who", event_time="t", entity="e", at="s", value="v", width=7, out="v")


def test_against_brute_force(spark):
    rng = random.Random(3)
    events = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(400)]
    changes = [(rng.choice(["hot", "a", "c", None]), rng.choice([None, *range(60)]), i) for i in range(80)]
    changes += changes[:10]
    got = as_of_join(spark.createDataFrame(events, "id int, who string, t int"), spark.createDataFrame(changes, "e string, s int, v int"), **HOW)
    want = {}
    for i, who, t in events:
        known = [(s, v) for e, s, v in changes if e == who and None not in (who, t, s) and s <= t]
        if known:
            want[i] = max(known)[1]
    rows = got.collect()
    assert {r.id: r.v for r in rows} == want and len(rows) == len(want)


def test_clashing_columns_repeats_and_empties(spark):
    ev = spark.createDataFrame([(1, "a", 5, 9, 9, 9)] * 2, "id int, who string, t int, entity int, start int, v int")
    ch = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y")], "e string, s int, v string")
    got = as_of_join(ev, ch, **HOW)
    assert got.columns == ["id", "who", "t", "entity", "start", "v"]
    assert [tuple(r) for r in got.collect()] == [(1, "a", 5, 9, 9, "x")] * 2
    assert as_of_join(ev.limit(0), ch, **HOW).count() == 0
    assert as_of_join(ev, ch.limit(0), **HOW).count() == 0
