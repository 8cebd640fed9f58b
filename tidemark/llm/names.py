"""Names of companies and people as typed: parsing, and how well one can stand for another."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Legal forms in their spellings, words and titles that name nobody, and nicknames.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "cos": "co",
    "llc": "llc", "ltd": "ltd", "limited": "ltd", "lp": "lp", "plc": "plc", "nv": "nv", "sa": "sa", "ag": "ag", "gmbh": "gmbh",
}
EMPTY = {"the", "and", "of"}
TITLES = {"dr", "mr", "mrs", "ms", "prof", "jr", "sr", "ii", "iii", "iv", "esq", "md", "phd"}
NICKNAMES = {
    "alexander": "alex al sandy xander", "charles": "charlie chuck chas charley", "deborah": "deb debbie debby", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty eliza lizzie betsy", "james": "jim jimmy jamie", "joseph": "joe joey", "katherine": "kate kathy katie kathryn kat",
    "margaret": "maggie meg peggy marge", "michael": "mike mick mickey", "patricia": "pat patty tricia trish", "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert", "susan": "sue susie suzy", "theodore": "ted theo teddy", "william": "bill will billy willie liam",
    "thomas": "tom tommy", "john": "jack johnny", "steven": "steve", "daniel": "dan danny", "anthony": "tony", "christopher": "chris",
    "matthew": "matt", "andrew": "andy drew", "barbara": "barb", "jennifer": "jen jenny", "rebecca": "becky", "samuel": "sam",
}
#: The code a name carries in brackets, as in ``Stukium Networks LLC (QRZK)``.
BRACKETED = r"\(([A-Z][A-Z0-9./-]{1,9})\)"
_SHORT = {n: frozenset(k for k, v in NICKNAMES.items() if n in v.split()) for ns in NICKNAMES.values() for n in ns.split()}


class Name(NamedTuple):
    tokens: tuple[str, ...]
    legal: str | None
    person: bool


@lru_cache(maxsize=1 << 17)
def parse(text: str | None) -> Name:
    """Core words in their order, the legal form, and whether the text can be a person's name.

    Tags in slashes or brackets, titles, articles and punctuation go. Of a company's name
    turned round (``Energy, Trorvuast Inc.``) the word before the comma goes last.
    """
    t = unicodedata.normalize("NFKC", text or "").lower()
    t = re.sub(r"/[^/]*/|\([^)]*\)", " ", t)
    t = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", t)
    t = re.sub(r"['’`]|(?<=[a-z]{2})\.(?=[a-z]\b)", "", t)
    t = re.sub(r"\b(?:ltd|limited)\.?\s+partnership\b", "lp", t)
    raw = re.findall(r"[^\W_]+", t)
    legal, tokens = None, []
    turned = re.match(r"\s*[^\W\d_]+\s*,", t)
    for w in raw:
        if w in LEGAL:
            legal = legal or LEGAL[w]
        elif w not in EMPTY and w not in TITLES:
            tokens.append(w)
    if turned and legal and len(tokens) > 1 and tokens[0] == raw[0]:
        tokens = [*tokens[1:], tokens[0]]
    return Name(tuple(tokens), legal, legal is None and 2 <= len(tokens) <= 4)


@lru_cache(maxsize=1 << 18)
def edits(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (adjacent swaps count one), or ``most + 1`` where it is more.

    Only the diagonals within ``most`` are worked on, so long words cost their length.
    """
    if a == b:
        return 0
    n, m, beyond, width = len(a), len(b), most + 1, 2 * most + 1
    if abs(n - m) > most:
        return beyond
    # Cell k of row i is column i + k - most.
    before: list[int] = []
    last = [k - most if most <= k <= most + m else beyond for k in range(width)]
    for i in range(1, n + 1):
        row = [beyond] * width
        for k in range(width):
            j = i + k - most
            if j == 0:
                row[k] = min(i, beyond)
            elif 0 < j <= m:
                v = last[k] + (a[i - 1] != b[j - 1])
                if k + 1 < width:
                    v = min(v, last[k + 1] + 1)
                if k:
                    v = min(v, row[k - 1] + 1)
                if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    v = min(v, before[k] + 1)
                row[k] = min(v, beyond)
        if min(row) > most:
            return beyond
        before, last = last, row
    return last[m - n + most]


LOOKS = str.maketrans("01358", "olesb")


def seen_as(word: str) -> str:
    """The word with the letters that its signs look like."""
    return word.translate(LOOKS).replace("rn", "m").replace("vv", "w")


def _abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is ``long`` cut or with letters left out: same first letter, rest in order, plural s free."""
    if not 2 <= len(short) < len(long) or short[0] != long[0]:
        return False
    body = short[:-1] if len(short) > 2 and short.endswith("s") and not long.startswith(short) else short
    it = iter(long)
    return all(c in it for c in body)


def _abbreviates_typed(short: str, long: str) -> bool:
    """Whether ``short`` abbreviates ``long`` once a letter but the first is left out or swapped with the next.

    One pass from either side: where each beginning of the short word ends in the long one,
    and where each end of it starts, as the letters are found in order.
    """
    if not short or not long or short[0] != long[0]:
        return False
    for s in {short, short[:-1] if short.endswith("s") else short}:
        n, none = len(s), len(long) + 1
        ends, starts = [0] * (n + 1), [len(long)] * (n + 1)
        for i in range(n):
            at = long.find(s[i], ends[i]) if ends[i] < none else -1
            ends[i + 1] = at + 1 if at >= 0 else none
        for i in range(n - 1, -1, -1):
            starts[i] = long.rfind(s[i], 0, starts[i + 1]) if starts[i + 1] > 0 else -1
            if starts[i] < 0:
                starts[: i + 1] = [-1] * (i + 1)
                break
        if 3 < len(short) <= len(long) and any(ends[i] <= starts[i + 1] for i in range(1, n)):
            return True
        if len(short) < len(long):
            for i in range(1, n - 1):
                if ends[i] < none and (x := long.find(s[i + 1], ends[i])) >= 0 and (y := long.find(s[i], x + 1)) >= 0 and y + 1 <= starts[i + 2]:
                    return True
    return False


@lru_cache(maxsize=1 << 18)
def likeness(a: str, b: str, proper: bool) -> float:
    """How well word ``a`` stands for word ``b`` (0: not at all). Only other words than proper ones are abbreviated."""
    if a == b:
        return 1.0
    if len(a) == 1:
        return 0.35 if b.startswith(a) else 0.0
    if b in _SHORT.get(a, ()) or a in _SHORT.get(b, ()):
        return 0.9
    x, y = seen_as(a), seen_as(b)
    if x == y:
        return 0.95
    if not proper and (_abbreviates(a, b) or _abbreviates_typed(a, b)):
        return 0.85
    n = min(len(a), len(b))
    if n >= 4:
        d = min(edits(a, b), edits(x, y))
        if d == 1:
            return 0.88
        if d == 2 and n >= 7 and not proper and a[0] == b[0]:
            return 0.55
    return 0.0


def stands_for(name: Name, listed: Name, strict: bool = True) -> tuple[float, bool]:
    """``(score, partial)``: how well ``name`` is a spelling of ``listed``, 0 where it can't be.

    Every word of the name must stand for another one of the listed name, in any order,
    one typed word may hold two; the listed name's first word must be among them. Words
    and legal form that the name lacks cost little but make it partial; a legal form that
    differs speaks against it unless all words are there. Where ``strict`` is off the other
    side may be typed too: its words may be short forms and its legal form may be missing.
    """
    left, right = name.tokens, listed.tokens
    # Every word takes a listed one of its own.
    if not left or not right or len(left) > len(right):
        return 0.0, True
    person = listed.person and listed.legal is None
    last = len(right) - 1
    # A word is no spelling of an initial, even where the other side is typed too.
    close = likeness if strict else lambda a, b, p: max(likeness(a, b, p), likeness(b, a, p) if len(b) > 1 else 0.0)
    used: dict[int, float] = {}
    if person and len(right) == 3:
        # "Vakaeor JT" and the like: initials written together.
        left = tuple(x for w in left for x in (w if w == right[1][0] + right[2][0] else (w,)))
    for w in sorted(left, key=len, reverse=True):
        best = (0.0, ())
        for j, v in enumerate(right):
            if j not in used:
                best = max(best, (close(w, v, person or j < last or last == 0), (j,)))
        for j in range(last):
            if j not in used and j + 1 not in used and len(w) > len(right[j]) + 1:
                best = max(best, (close(w, right[j] + right[j + 1], True) * 0.97, (j, j + 1)))
        if best[0] == 0.0:
            return 0.0, True
        for j in best[1]:
            used[j] = best[0]
    # Two edits in the word that names it make another name.
    if used.get(0, 0.0) < 0.6 and not (person and used.get(0, 0.0) >= 0.5):
        return 0.0, True
    if person and len(right) > 1 and 1 not in used:
        return (0.4, True) if len(left) == 1 else (0.0, True)
    weight = [2.0 if j == 0 else 1.0 for j in range(len(right))]
    if person and len(right) > 2:
        weight[2] = 0.2
    if len(right) == 3 and not person:
        weight[1] = 0.7
    got = sum(weight[j] * s for j, s in used.items())
    score = got / sum(weight)
    whole = len(used) == len(right) and min(used.values()) > 0.5
    if name.legal and listed.legal and name.legal != listed.legal:
        if not whole:
            return 0.0, True
        score -= 0.12
    elif name.legal and listed.legal:
        score += 0.03
    elif name.legal and not listed.legal and strict:
        return 0.0, True
    return score, not whole

