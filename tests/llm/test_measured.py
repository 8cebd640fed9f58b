"""Recall and precision of the name and linkage operators on made-up companies whose truth is known."""

import numpy as np
import pytest

from tidemark.llm.linkage import link
from tidemark.llm.resolve import resolve

ONSETS, ENDS = ("Kar", "Zou", "Bre", "Tae", "Vol", "Mi", "Spa", "Quo", "Drel", "Nau"), ("venolt", "rvean", "ignaira", "noix", "tumeira", "ckluond", "dovast", "nteiss", "phaui", "gruill")
TRADES = ("Foods", "Biosciences", "Instruments", "Communications", "Networks", "Petroleum", "Insurance", "Logistics")
FORMS = ("Inc.", "Corp.", "LLC", "Ltd.")


def companies(rng, n):
    """Distinct names of two or three words; several share their first word."""
    heads = [a + b for a in ONSETS for b in ENDS]
    out = {}
    while len(out) < n:
        a, b = heads[int(rng.integers(len(heads)))], heads[int(rng.integers(len(heads)))]
        t, f = TRADES[int(rng.integers(len(TRADES)))], FORMS[int(rng.integers(len(FORMS)))]
        middle = f"{b} " if rng.random() < 0.5 else ""
        out.setdefault((a, t, bool(middle)), f"{a} {middle}{t} {f}")
    # Of companies that only a middle word tells apart one is kept: without it nobody could tell.
    kept = {}
    for (a, t, _), name in out.items():
        kept.setdefault((a, t), name)
    return sorted(kept.values())


def typed(rng, name):
    """The name as somebody may type it."""
    w = name.split()
    how = int(rng.integers(8))
    i = int(rng.integers(len(w) - 1))
    if how == 0:
        w[i] = w[i][:3] + w[i][4:]
    elif how == 1:
        w[i] = w[i][:2] + w[i][2:4][::-1] + w[i][4:]
    elif how == 2:
        w = w[:-1]
    elif how == 3:
        return name.upper().replace(".", "") + " /DE/"
    elif how == 4:
        w = [w[-2] + ",", *w[:-2], w[-1]]
    elif how == 5:
        w[-2] = w[-2][:4]
    elif how == 6:
        return f"  The {' '.join(w)} "
    else:
        w = ["".join(w[:2]), *w[2:]] if len(w) > 3 else w
    return " ".join(w)


@pytest.mark.parametrize("n", [60, 240])
def test_resolved_names(spark, n):
    rng = np.random.default_rng(n)
    names = companies(rng, n)
    listed, others = names[::2], names[1::2]
    heads = {x.split()[0] for x in listed}
    truth = {typed(rng, x): f"{i:010d}" for i, x in enumerate(listed) for _ in range(4)}
    truth |= {typed(rng, x): None for x in others if x.split()[0] not in heads}
    rows = spark.createDataFrame([(x, None, None) for x in truth], "name string, t string, c string")
    got = {r.name: r.id for r in resolve(rows, spark.createDataFrame([(f"{i:010d}", x, None) for i, x in enumerate(listed)], "id string, name string, t string")).collect()}
    meant = {k for k, v in truth.items() if v}
    right = sum(truth[k] == v for k, v in got.items())
    assert right / len(got) >= 0.98, {k: (v, truth[k]) for k, v in got.items() if truth[k] != v}
    assert right / len(meant) >= 0.9, [k for k in meant if k not in got]


@pytest.mark.parametrize("n", [80, 240])
def test_linked_parties(spark, n):
    rng = np.random.default_rng(n + 1)
    names = companies(rng, n)
    inside = names[: 3 * len(names) // 4]
    code = lambda i: f"Q{i:03d}X"
    say = lambda x, p: x if rng.random() < p else None
    right = [(str(1000 + i), typed(rng, x), say(code(i), 0.7), say(code(i), 0.5)) for i, x in enumerate(inside) for _ in range(4)]
    left, truth, p = [], {}, 0
    for i, x in enumerate(names):
        for _ in range(3):
            p += 1
            told = int(rng.integers(len(names))) if rng.random() < 0.05 else i  # at times a code is another's
            left.append((p, typed(rng, x), say(code(told), 0.6), say(code(i), 0.4), say(code(i), 0.3), None))
            if x in inside:
                truth[p] = str(1000 + i)
    a = spark.createDataFrame(left, "party_id bigint, name string, ticker string, underlying_symbol string, firm_id string, cik string")
    b = spark.createDataFrame(right, "source_gvkey string, source_name string, source_ticker string, source_firm_id string")
    c = spark.createDataFrame([], "gvkey string, firm_id string, cik string")
    got = [(r.party_id, r.source_gvkey, r.confidence) for r in link(a, b, c).collect()]
    good = sum(truth.get(x) == g for x, g, _ in got)
    assert good / len(got) >= 0.95 and good / len(truth) >= 0.93
    # What is said with confidence is right as often as it says.
    sure = [truth.get(x) == g for x, g, q in got if q >= 0.95]
    assert len(sure) > len(got) / 2 and sum(sure) / len(sure) >= 0.95


def test_variants_of_nobody_listed(spark):
    from tidemark.llm.variants import merge_variants

    rng = np.random.default_rng(11)
    names = companies(rng, 120)
    truth = {}
    for i, x in enumerate(names):
        for _ in range(4):
            truth.setdefault(typed(rng, x), i)
    rows = spark.createDataFrame([(x, 1) for x in [*truth, *list(truth)[:20]]] + [(None, 1), (" ", 1)], "name string, entity int")
    got = {r.name: r.entity for r in merge_variants(rows).collect()}
    assert set(got) == set(truth)
    pairs = lambda of: {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    found, true = pairs(got), pairs(truth)
    assert len(found & true) / len(found) >= 0.97, sorted(found - true)[:5]
    assert len(found & true) / len(true) >= 0.7, sorted(true - found)[:5]
    assert merge_variants(rows.limit(0)).count() == 0


def test_labels_travel_along_chains(spark):
    from tidemark.llm.variants import spread_labels

    labels = spark.createDataFrame([(i, i) for i in range(40)], "nid bigint, label bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(39, 30)], "a bigint, b bigint")
    got = {r.nid: r.label for r in spread_labels(labels, edges).collect()}
    assert got == {i: 0 if i <= 20 else 30 if i == 39 else i for i in range(40)}


def test_richer_entities_meet_again(spark):
    from tidemark.llm.variants import merge_variants

    # The first and the last differ by two errors, and only by way of the second they are one.
    rows = spark.createDataFrame([("Karvenolt Instruments Inc.",), ("Karvonolt Instruments Inc.",), ("Karvonoltt Instr. Inc.",), ("Karvenolt Foods Inc.",)], "name string")
    got = {r.name: r.entity for r in merge_variants(rows).collect()}
    assert len(set(got.values())) == 2 and got["Karvonoltt Instr. Inc."] == got["Karvenolt Instruments Inc."] != got["Karvenolt Foods Inc."]
