import random
from datetime import date, timedelta

import numpy as np

from tidemark.operators.spikes import esd_limit, generalised_esd, implausible, tail_limit


def days(n):
    d, out = date(2020, 1, 1), []
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(1)
    return out


def series(seed, n=60, move=0.01):
    rng, x, out = random.Random(seed), 50.0, []
    for _ in range(n):
        x *= 1 + rng.gauss(0, move)
        out.append(round(x, 2))
    return out


CLOSE = dict(source="s", day="d", row_id="i", readings=("x",), zero_ok=(False,))


def found(df, **how):
    out = {}
    for r in implausible(df, **how).collect():
        out.setdefault(r.row_id, set()).add(r.reason)
    return out


def test_closes(spark):
    rows, i, want = [], 0, {}
    plan = {
        "a": {20: ("x", 10, "spike"), 40: (-5.0, None, "range"), 50: (0.0, None, "range")},
        "b": {30: ("x", 0.6, "spike"), 31: ("x", 0.6, "spike")},
        "c": {},
    }
    for n, (s, bad) in enumerate(plan.items()):
        xs = series(n)
        if s == "c":
            xs = [x * (2 if k >= 25 else 1) for k, x in enumerate(xs)]  # a move that lasts
            xs[40:47] = [xs[40]] * 7
            xs[50:54] = [xs[50]] * 4
        for k, (d, x) in enumerate(zip(days(60), xs, strict=True)):
            i += 1
            if k in bad:
                v, f, why = bad[k]
                x = x * f if v == "x" else v
                want[i] = {why}
            rows.append((s, d, i, x))
            if s == "a" and k == 20:
                rows += [(s, d, 1001, x), (s, d, 1002, x / 10)]  # a copy counts, a corrected one doesn't
                want[1001] = {"spike"}
        if s == "c":
            want |= {i - 60 + 1 + k: {"constant"} for k in range(41, 47)}
    rows += [(s, d, 2000, None) for s, d in (("a", days(70)[65]), (None, days(3)[1]), ("z", None))] + [("short", days(2)[0], 2001, 1.0), ("short", days(2)[1], 2002, 900.0)]
    df = spark.createDataFrame(rows, "s string, d date, i bigint, x double")
    assert found(df, **CLOSE) == want
    # Blocks of days with their margins give the same as whole histories.
    assert found(df, **CLOSE, block_days=50, margin_days=40) == want


def test_quotes(spark):
    mid = series(9, 22, 0.1)
    rows = [("q", d, k, round(m, 2), round(m * 1.1, 2), "x") for k, (d, m) in enumerate(zip(days(22), mid, strict=True))]
    change = {5: (0.0, None), 8: (None, 0.0), 11: (None, 9999.99), 14: (90.0, 80.0), 17: (None, None)}
    for k, (b, a) in change.items():
        r = list(rows[k])
        r[3], r[4] = (None, None) if k == 17 else (r[3] if b is None else b, r[4] if a is None else a)
        rows[k] = tuple(r)
    df = spark.createDataFrame(rows, "s string, d date, i bigint, b double, a double, _s string")
    got = found(df, source="s", day="d", row_id="i", readings=("b", "a"), zero_ok=(True, False), crossed=True)
    assert got == {8: {"range"}, 11: {"spike"}, 14: {"range"}}


def test_empty(spark):
    assert implausible(spark.createDataFrame([], "s string, d date, i bigint, x double"), **CLOSE).count() == 0


# Rosner's (1983) 54 vitamin E readings and the critical values published for them.
ROSNER = (
    -0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09,
    2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01,
)
LIMITS = (3.158, 3.151, 3.143, 3.136, 3.128, 3.120, 3.111, 3.103, 3.094, 3.085)


def test_limits_of_the_generalised_esd_are_the_published_ones():
    assert all(abs(esd_limit(len(ROSNER), i + 1, 0.05) - x) < 1.5e-3 for i, x in enumerate(LIMITS))


def test_generalised_esd_looks_behind_what_masks():
    # The second deviate is under its limit, the third over it: all three are outliers.
    r = np.concatenate((np.linspace(-1, 1, 41), [9.0, 4.0, 3.9, np.nan]))
    group = np.zeros(len(r), np.int64)
    out, deviate = generalised_esd(group, r, np.array([0.01]), 1e-4)
    assert list(np.flatnonzero(out)) == [41, 42, 43] and np.isnan(deviate[-1])
    assert not generalised_esd(group[:3], r[40:43], np.array([0.01]), 1e-4)[0].any()  # too few to judge
    # A group's own scale counts where its residuals are smaller.
    assert not generalised_esd(group, r, np.array([5.0]), 1e-4)[0].any()


def test_tail_of_all_sources():
    rng = np.random.default_rng(5)
    x = rng.exponential(0.1, 100_000)
    x[:200] = 3.0  # spikes move the tail little
    steps, n = np.unique((x / 0.005).astype(int), return_counts=True)
    counts = dict(zip(steps.tolist(), n.tolist(), strict=True))
    assert abs(tail_limit(counts, 200_000, 1e-5) - 0.1 * np.log(0.5 / 1e-5)) < 0.1
    assert tail_limit({1: 5}, 10, 1e-5) == -np.inf


def test_a_spike_beyond_the_tail_of_all_sources(spark):
    rows, i = [], 0
    for s in range(60):
        for d, x in zip(days(22), series(s, 22, 0.05), strict=True):
            i += 1
            rows.append((f"s{s}", d, i, x * (8 if i == 500 else 1.25 if i == 700 else 1)))
    df = spark.createDataFrame(rows, "s string, d date, i bigint, x double")
    assert found(df, **CLOSE, alpha=0.05, chance=1e-5) == {500: {"spike"}}
