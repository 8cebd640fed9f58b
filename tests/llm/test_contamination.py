import random

import numpy as np

from tidemark.llm.contamination import Passages, leaked_items, words_of

RNG = random.Random(4)
WORDS = [f"w{i}" for i in range(300)]


def held(item, doc, window=20, changed=2, stray=3):
    """Brute force: any window of the item in the document, by dynamic programming over all starts."""
    a, b = words_of(item), words_of(doc)
    for s in range(len(a) - window + 1):
        p = a[s : s + window]
        best = {(0, j, 0): 0 for j in range(len(b) + 1)}
        for i in range(window + 1):
            for k in range(stray + 1):
                for j in range(len(b) + 1):
                    c = best.get((i, j, k), 99)
                    if c > changed:
                        continue
                    if i == window:
                        return True
                    for key, v in (((i + 1, j + 1, k), c + (j >= len(b) or p[i] != b[j])), ((i + 1, j, k), c + 1)):
                        if key[1] <= len(b) and v < best.get(key, 99):
                            best[key] = v
                    if i and j < len(b) and k < stray and c < best.get((i, j + 1, k + 1), 99):
                        best[i, j + 1, k + 1] = c
    return False


def damaged(words, rate):
    out = []
    for w in words:
        r = RNG.random()
        if r < rate / 3:
            continue
        out.append(RNG.choice(WORDS) if r < 2 * rate / 3 else w)
        if r > 1 - rate / 3:
            out.append(RNG.choice(WORDS))
    return out


def test_against_brute_force():
    items = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(20, 40)))) for i in range(6)]
    docs = []
    for n in range(60):
        w = words_of(items[n % 6][1])
        at = RNG.randint(0, len(w) - 1)
        cut = damaged(w[at : at + RNG.randint(15, 30)], RNG.choice([0, 0.1, 0.25, 0.4]))
        docs.append((n, " ".join(RNG.choices(WORDS, k=5) + cut + RNG.choices(WORDS, k=5))))
    got = set(Passages(items).leaks([k for k, _ in docs], [words_of(t) for _, t in docs]))
    want = {(k, i) for k, t in docs for i, x in items if held(x, t)}
    assert got == want and 5 < len(want) < 55


def test_words():
    assert words_of("The  $1,250.50 “Offer”—it's\nÜBER_all ﬁnal") == ["the", "125050", "offer", "its", "über", "all", "final"]
    assert words_of(None) == words_of("") == words_of(" .,\n") == []


def test_many_lanes_agree_with_few():
    item = " ".join(WORDS[:60])
    docs = [" ".join(["x"] * k + WORDS[k : k + 25]) for k in range(30)]
    p = Passages([(1, item)])
    assert p.leaks(list(range(30)), [words_of(t) for t in docs], lanes=10) == p.leaks(list(range(30)), [words_of(t) for t in docs]) == [(k, 1) for k in range(30)]
    assert not p.held(p.items[0][:20], np.zeros(0, np.int64))


def test_rows(spark):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, item.upper().replace(" ", ",\n")), (1, item), (2, None), (3, ""), (4, " ".join(WORDS[:17])), (5, "y " * 50_000 + item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item, "a"), (7, item, "b"), (8, None, "a"), (9, "short", "a"), (10, " ".join(WORDS[5:30]), "a")], "item_id bigint, text string, doc_id string")
    want = {(d, i) for d in (1, 5) for i in (7, 10)}
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == want
    assert sorted(tuple(r) for r in leaked_items(docs, items, block=1).collect()) == sorted(want)
    assert leaked_items(docs.limit(0), items).count() == leaked_items(docs, items.limit(0)).count() == 0
