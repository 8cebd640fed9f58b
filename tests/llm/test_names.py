import numpy as np
import pytest

from tidemark.llm.labelmodel import LabelModel
from tidemark.llm.linkage import link
from tidemark.llm.names import edits, parse, stands_for
from tidemark.llm.resolve import resolve

LISTED = "Voumouil Grassouelle Bancorp L.L.C."


@pytest.mark.parametrize("name", [
    "voumouil grassouelle bancorp llc", "LLC Voumouil Grassouelle Bancorp", "Bancorp, Voumouil Grassouelle LLC", "Voumouil G. Bancorp", "VoumouilGrassouelle Bncp", "The Voumouil-Grassouelle Banc L.L.C. (QABC)",
    "VOUMUOIL GRASSOUELLE BANCORP LLC /DE/", "Voumouil", "Voumouil Grassouelle", "Voumouil Grassouelle Banocrp", "V0umouil Grassouelle Bancorp",
])
def test_spellings(name):
    assert stands_for(parse(name), parse(LISTED))[0] > 0.5


@pytest.mark.parametrize("name", ["Voumouil Foods LLC", "Voumouil Grassouelle Foods", "Grassouelle Bancorp LLC", "Voumouil Corp.", "Bancorp LLC", "", "...", "Voumouil Taenix Bancorp"])
def test_others(name):
    assert stands_for(parse(name), parse(LISTED))[0] == 0


@pytest.mark.parametrize("name, good", [("Bob Tendiix", True), ("Dr. Tendiix, Robert E.", True), ("R. E. Tendiix", True), ("Tendiix RE", True), ("Robret Tendiix", True), ("Susan Tendiix", False), ("Tendiix Foods", False)])
def test_people(name, good):
    assert (stands_for(parse(name), parse("TENDIIX ROBERT E"))[0] > 0) == good


def test_edits():
    assert [edits(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abcd", "badc"), ("abc", "xyz"), ("", "abcd"))] == [0, 1, 1, 2, 3, 3]


def test_label_model_learns():
    rng = np.random.default_rng(1)
    n = 20_000
    truth = rng.random(n) < 0.3
    say = lambda good, talk: np.where(rng.random(n) < talk, np.where(rng.random(n) < good, truth, ~truth) + 1, 0)
    strong, fair, weak = say(0.97, 0.9), say(0.9, 0.8), say(0.8, 0.7)
    votes = np.stack([strong, weak, weak, fair], 1)
    m = LabelModel([{1: 0.2, 2: 0.8}] * 4).fit(votes, np.ones(n))
    # With the true accuracies and the repeated voter counted once nobody could do better.
    odds = np.log(0.3 / 0.7) + sum(np.where(v == 0, 0, np.where(v == 2, 1, -1)) * np.log(a / (1 - a)) for v, a in ((strong, 0.97), (fair, 0.9), (weak, 0.8)))
    best = ((odds > 0) == truth).mean()
    assert ((m.posterior(votes) > 0.5) == truth).mean() > best - 0.02
    assert m.correlation[1, 2] > 0.9 and m.correlation[0, 3] < 0.2
    assert abs(m.prior - 0.3) < 0.06
    # Confidences are what they say: among pairs given p a share p is true.
    p = m.posterior(votes)
    for lo, hi in ((0.0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        here = (p >= lo) & (p < hi)
        if here.sum() > 200:
            assert abs(p[here].mean() - truth[here].mean()) < 0.08


PARTY = "party_id bigint, name string, ticker string, underlying_symbol string, firm_id string, cik string, g int"
SOURCE = "source_gvkey string, source_name string, source_ticker string, source_firm_id string, name string"
BRIDGE = "gvkey string, firm_id string, cik string"


def test_link(spark):
    firms = [(f"{a}{b} {t} {s}", f"Q{a[:2]}{b}".upper(), 100 + 10 * i + j) for i, a in enumerate(("Zorva", "Kelui", "Brem", "Taegno")) for j, (b, t, s) in enumerate((("nix", "Foods", "Inc."), ("oud", "Energy", "Corp."), ("uast", "Realty", "LLC")))]
    right = [(f"{g:06d}.0" if k else str(g), n if k else n.upper(), t if g % 3 else None, None, "x") for n, t, g in firms for k in range(2)]
    right += [("999", firms[0][0], None, None, None), (None, "x", None, None, None), ("998", None, None, None, None)]
    left = [(i, n.lower().replace("inc.", ""), t if i % 2 else None, None, None, None, 1) for i, (n, t, _) in enumerate(firms)]
    left += [(50, None, firms[1][1], None, None, None, 1), (51, "Unlisted Things Co.", None, None, None, None, 1), (52, None, None, None, None, None, 1), (53, "w " * 3000, None, None, None, None, 1), left[2], (None, "x", None, None, None, None, 1)]
    a, b, c = spark.createDataFrame(left, PARTY), spark.createDataFrame(right, SOURCE), spark.createDataFrame([("101", None, "7")], BRIDGE)
    rows = [(r.party_id, r.source_gvkey) for r in link(a, b, c).collect()]
    assert len(rows) == len(set(rows))
    want = {(i, str(g)) for i, (_, _, g) in enumerate(firms)} | {(0, "999"), (50, "101")}
    assert set(rows) == want
    assert link(a.limit(0), b, c).count() == link(a, b.limit(0), c).count() == 0


@pytest.mark.parametrize("ninth", ["name", "code"])
def test_every_spelling_and_code_of_a_source_counts(spark, ninth):
    spellings = [f"{a}karo Foods Inc." for a in ("Bel", "Dov", "Fim", "Gun", "Hep", "Jos", "Lut", "Mav")]
    rows = [("7", n, f"T{i}X", None, None) for i, n in enumerate(spellings) for _ in range(3)]
    rows += [("7", "Zuprenol Realty Corp.", None, None, None) if ninth == "name" else ("7", spellings[0], "ZQZ", None, None)]
    rows += [(str(100 + i), f"Other{a}ix Energy LLC", f"O{a}".upper(), None, None) for i, a in enumerate("abcdefgh")]
    party = (1, "Zuprenol Realty Corp.", None, None, None, None, 1) if ninth == "name" else (1, None, "ZQZ", None, None, None, 1)
    others = [(2 + i, f"Other{a}ix Energy LLC", f"O{a}".upper(), None, None, None, 1) for i, a in enumerate("abcdefgh")]
    got = link(spark.createDataFrame([party, *others], PARTY), spark.createDataFrame(rows, SOURCE), spark.createDataFrame([], BRIDGE), least=0.0).collect()
    assert (1, "7") in {(r.party_id, r.source_gvkey) for r in got}


def test_resolve(spark):
    listed = spark.createDataFrame([("0000000001", LISTED, "QAB"), ("0000000001", LISTED, "QAB"), ("0000000002", "Zourvean Communications Ltd.", None), ("0000000003", "Zourvean Petroleum Corp.", "ZZZ"), ("0000000004", "TENDIIX ROBERT E", None), (None, "x", None)], "id string, name string, t string")
    names = {"Voumouil G. Bancorp": "1", "Zourvean Commns": "2", "zourvean pete corp": "3", "Bob Tendiix": "4", "Zourvean": None, "Zourvean Foods Inc.": None, "": None, " ": None, "q" * 5000: None, LISTED: "1"}
    rows = [(n, None, None, 1) for n in names] * 2 + [(None, "QAB", "0000000001", 1)]
    got = resolve(spark.createDataFrame(rows, "name string, t string, c string, rec int"), listed).collect()
    assert {r.name: r.id for r in got} == {n: f"{i:0>10}" for n, i in names.items() if i} and len(got) == 5
    assert resolve(spark.createDataFrame([], "name string, t string, c string"), listed).count() == 0


def test_merged_spellings_bring_in_others(spark):
    listed = spark.createDataFrame([("0000000001", "Karvenolt Instruments Inc.", None)], "id string, name string, t string")
    # Two errors from the listed name, one from the spelling with one: only a code makes that a spelling of it.
    for number, found in ((None, 1), ("0000000001", 2)):
        rows = [("Karvonolt Instruments Inc.", None, number), ("Karvonoltt Instruments Inc.", None, None)]
        assert resolve(spark.createDataFrame(rows, "name string, t string, c string"), listed).count() == found


def _spelled(rng, name):
    """A name with a typing error, a word cut, turned, glued or left out."""
    w = name.split()
    for _ in range(rng.integers(0, 3)):
        i = int(rng.integers(len(w)))
        k = int(rng.integers(max(len(w[i]) - 1, 1)))
        how = int(rng.integers(7))
        if how == 0:
            w[i] = w[i][:k] + w[i][k + 1 :] or w[i]
        elif how == 1:
            w[i] = w[i][:k] + "x" + w[i][k:]
        elif how == 2 and len(w[i]) > 2:
            w[i] = w[i][:k] + w[i][k : k + 2][::-1] + w[i][k + 2 :]
        elif how == 3:
            w[i] = w[i][: max(1, k)]
        elif how == 4 and len(w) > 1:
            w = [*w[1:], w[0]]
        elif how == 5 and len(w) > 1:
            w = ["".join(w[:2]), *w[2:]]
        elif len(w) > 1:
            w.pop(i)
    return " ".join(w)


def test_whatever_may_stand_for_a_name_is_a_candidate(spark):
    from tidemark.llm.blocking import candidates, like_words, name_words, vocabulary
    from tidemark.llm.linkage import name_score

    rng = np.random.default_rng(3)
    trades, rest = ("Foods", "Biosciences", "Instruments", "Communications", "Rnetworks"), ("Inc", "LLC", "")
    listed = [f"{a} {b} {t} {c}".split() for a in ("Karvenolt", "Kar", "Zourvean", "Global") for b in ("", "Taenix", "Gro") for t in trades for c in rest[: 1 + len(a) % 3]]
    listed = sorted({" ".join(x) for x in listed} | {"TENDIIX ROBERT E", "TENDIIX SUSAN", "William Oxo", "Liam Oxo", "A", "", "q" * 3000 + " Foods", "Global " * 40})
    typed = sorted({_spelled(rng, n) if n else n for n in listed for _ in range(3)} | {"Bob Tendiix", "R. Tendiix", "Tendiix RE", "Bill Oxo", "Global", "Foods, Global Inc", "q" * 2999 + " Foods"})
    a = name_words(spark.createDataFrame(list(enumerate(typed)), "a bigint, n string"), "a", "n")
    b = name_words(spark.createDataFrame(list(enumerate(listed)), "b bigint, n string"), "b", "n")
    alike = like_words(vocabulary(a), vocabulary(b))
    back = alike.selectExpr("like word", "word like")
    got = {(r.a, r.b) for r in candidates(a, b, alike, "a", "b").collect()}
    turned = {(r.a, r.b) for r in candidates(b, a, back, "b", "a").collect()}
    strict = {(i, j) for i, x in enumerate(typed) for j, y in enumerate(listed) if stands_for(parse(x), parse(y))[0] > 0}
    assert strict and strict <= got
    assert got <= {(r.a, r.b) for r in candidates(a, b, alike, "a", "b", shaped=False).collect()}
    assert {(i, j) for i, x in enumerate(typed) for j, y in enumerate(listed) if name_score(x, y)[0] > 0} <= got | turned


def test_deletion_keys_of_long_words():
    from tidemark.llm.blocking import deletion_keys

    long = "ab" * 20_000
    at, keys, _ = deletion_keys([long, long[:77] + long[78:], "abc", "abd", "abcd", "abxd", ""])
    share = lambda i, j: bool(set(keys[at == i]) & set(keys[at == j]))
    assert share(0, 1) and share(4, 5) and not share(2, 3) and not share(0, 4)


def test_resolve_among_many_of_one_surname(spark):
    others = ("SUSAN", "PETER", "GEORGE", "WALTER", "HENRY", "LOUIS", "VICTOR", "OSCAR", "NORMAN", "FELIX", "IVAN", "KEITH")
    listed = [(f"{i:010d}", f"TENDIIX {n} E", None) for i, n in enumerate(("ROBERT", *others))]
    rows = spark.createDataFrame([("Bob Tendiix", None, None)], "name string, t string, c string")
    got = resolve(rows, spark.createDataFrame(listed, "id string, name string, t string")).collect()
    assert [r.id for r in got] == ["0000000000"]
