import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import skewed_keys
from tidemark.operators.skewed_keys import Accumulators


def frame(spark, n=3000, keys=40):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        k = "hot" if rng.random() < 0.4 else rng.choice([None, "", *map(str, range(keys))])
        rows.append((k, rng.choice([None, 3, 10**6, -4]), rng.choice([None, float("nan"), -2.5, 0.0, -0.0, 1e-9, 7.25, rng.random()]), 1))
    return rows, spark.createDataFrame(rows, "k string, q bigint, x double, n int")


def expect(rows):
    by = {}
    for k, q, x, _ in rows:
        by.setdefault(k, []).append((q, x))
    ok = lambda v: [x for _, x in v if x is not None and x == x]
    return {k: (len(v), sum(q or 0 for q, _ in v), median(ok(v)) if ok(v) else None) for k, v in by.items()}


@pytest.mark.parametrize("flush, broadcast", [(500_000, 200_000), (20, 200_000), (500_000, 3)])
def test_against_brute_force(spark, monkeypatch, flush, broadcast):
    monkeypatch.setattr(skewed_keys, "FLUSH", flush)
    monkeypatch.setattr(skewed_keys, "MOST_KEYS", broadcast)
    rows, df = frame(spark)
    a = Accumulators(df.repartition(5), F.col("k"))
    want = expect(rows)
    assert {r.key: (r.n, r.s) for r in a.counts({"s": F.col("q")}).collect()} == {k: v[:2] for k, v in want.items()}
    near = lambda m: {k: None if x is None else round(x, 12) for k, x in m.items()}
    assert near({r.key: r.median for r in a.medians(F.col("x")).collect()}) == near({k: v[2] for k, v in want.items()})
    both = a.counts_and_medians({"s": F.col("q")}, {"m": F.col("x")}).collect()
    assert {r.key: (r.n, r.s) for r in both} == {k: v[:2] for k, v in want.items()}
    assert near({r.key: r.m for r in both}) == near({k: v[2] for k, v in want.items()})


def test_medians_of_many_values(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else "b", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for i in range(4001)]
    rows += [("c", float("inf")), ("c", float("-inf")), ("c", 5.0), ("d", 1e308), ("d", 1.7e308), ("e", float("inf"))]
    got = {r.key: r.median for r in Accumulators(spark.createDataFrame(rows, "k string, x double"), F.col("k")).medians(F.col("x")).collect()}
    for k in "abc":
        v = sorted(x for n, x in rows if n == k)
        assert got[k] == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
    assert got["e"] == float("inf")


def test_empty_and_one_value(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert Accumulators(df, F.col("k")).counts().count() == 0
    assert Accumulators(df, F.col("k")).medians(F.col("x")).count() == 0
    one = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, x double")
    assert {tuple(r) for r in Accumulators(one, F.col("k")).medians(F.col("x")).collect()} == {("a", None), ("b", 2.0)}
