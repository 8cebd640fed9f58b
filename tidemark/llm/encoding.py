"""Texts decoded with the wrong character encoding: found, and restored where nothing was lost.

Characters are mapped back to the bytes of a legacy encoding; an automaton over the
structure of UTF-8 finds the maximal well-formed multibyte spans, and only those spans are
decoded. A text garbled twice is decoded twice. Cyrillic that was read as another one-byte
encoding has no byte structure to go by; there the letters' frequencies decide, span by
span. Replacement characters tell of bytes that are gone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

# The encodings texts are taken for. "western" holds Latin-1 and cp1252 at once.
ONE_BYTE = ("western", "iso8859-15", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp1254", "cp866")
TWO_BYTE = ("cp932", "gbk", "big5", "euc_kr")
# Frequencies of the letters of Russian text, in percent.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True))

_C, _NONE = "[\x80-\xbf]", "￿"
SPAN = re.compile(
    f"(?:[\xc2-\xdf]{_C}|\xe0[\xa0-\xbf]{_C}|[\xe1-\xec\xee\xef]{_C}{{2}}|\xed[\x80-\x9f]{_C}|\xf0[\x90-\xbf]{_C}{{2}}|[\xf1-\xf3]{_C}{{3}}|\xf4[\x80-\x8f]{_C}{{2}})+"
)
_FOREIGN = re.compile(r"[^\x00-\x7f]")
#: What a well-formed span must decode to, to be no accident: marks and letters that text is made of.
_PLAUSIBLE = re.compile(
    "[\xa0-\xffĀ-ſƒȘ-țˆ˜̀-̄̈Ά-ώЁ-џҐґ"
    "‐-‧‰′″‹›₠-₿№™←-↓∀-≥■-◿☀-➿"
    "　-ヿㄅ-ㄯ一-鿿가-힣！-ﾟﬁﬂ\U0001f300-\U0001faff]"
)
_CONTROL = re.compile("[\x80-\x9f]")


@lru_cache(maxsize=None)
def _table(encoding: str) -> dict[int, str]:
    """Characters to byte values (as characters); ASCII stays, all else is barred."""

    class Bytes(dict):
        def __missing__(self, key: int) -> str:
            return _NONE

    out = Bytes((b, chr(b)) for b in range(128))
    for b in range(128, 256):
        if encoding == "western":
            out[b] = chr(b)
            encoded = bytes([b]).decode("cp1252", "ignore")
        else:
            encoded = bytes([b]).decode(encoding, "ignore")
        if encoded:
            out[ord(encoded)] = chr(b)
    # Bytes an encoding leaves open pass as controls.
    for b in range(0x80, 0xA0):
        out.setdefault(b, chr(b))
    return out


@lru_cache(maxsize=None)
def _hint(encoding: str) -> re.Pattern:
    """A lead byte before a continuation byte: without one no span begins."""
    t = _table(encoding)
    some = lambda lo, hi: "".join(re.escape(chr(c)) for c, b in t.items() if c > 127 and b != _NONE and lo <= ord(b) <= hi)
    return re.compile(f"[{some(0xC2, 0xF4)}][{some(0x80, 0xBF)}]")


def _fits(old: str, new: str) -> bool:
    """Whether a span is better read as ``new``: all of it plausible and of letters of one kind or marks."""
    if not new or not all(_PLAUSIBLE.match(c) or _CONTROL.match(c) for c in new):
        return False
    if all(_CONTROL.match(c) for c in new):
        return False
    if sum("а" <= c.lower() <= "я" or c in "ёЁ" for c in old) * 3 > len(old) * 2:
        # Letters of good Russian can look like UTF-8 by chance: the new reading must be better Russian.
        return all("Ѐ" <= c <= "ӿ" for c in new) and _russian(new) > _russian(old)
    return True


def _spans_one(text: str, encoding: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if not _hint(encoding).search(text):
        return out
    for m in SPAN.finditer(text.translate(_table(encoding))):
        new = m.group().encode("latin-1").decode("utf-8")
        old = text[m.start() : m.end()]
        if _fits(old, new):
            out.append((m.start(), m.end(), new))
    return out


@lru_cache(maxsize=1 << 15)
def _two(c: str, encoding: str) -> bytes:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return b"\xff"


# The marks by which a few bytes of UTF-8 read as a two-byte encoding are told in western text.
_MARKS = set("‘’“”–—…•€£™")


def _spans_two(text: str, encoding: str, least: int = 9) -> list[tuple[int, int, str]]:
    """Spans in texts of two-byte encodings, of ``least`` bytes at least: shorter ones arise by chance.

    A shorter one counts if it is nothing but marks, follows a plain letter or sign and ends
    with one. A span starts and ends at whole characters; of one at its edge that doesn't fit,
    a plain second byte is a character of its own, other bytes are gone and read as a
    replacement character.
    """
    raw = [_two(c, encoding) if ord(c) > 127 else c.encode() for c in text]
    start = [0, *accumulate(map(len, raw))]
    at = [i for i, b in enumerate(raw) for _ in b]
    whole = b"".join(raw).decode("latin-1")
    out = []
    for m in SPAN.finditer(whole):
        new = m.group().encode("latin-1").decode("utf-8")
        if not all(_PLAUSIBLE.match(c) for c in new):
            continue
        a, b = at[m.start()], at[m.end() - 1] + 1
        head, tail = whole[start[a] : m.start()], whole[m.end() : start[b]]
        plain = not head and tail.isascii()
        if m.end() - m.start() < least and not (plain and set(new) <= _MARKS and (a == 0 or text[a - 1].isascii())):
            continue
        out.append((a, b, "�" * bool(head) + new + (tail if tail.isascii() else "�")))
    return out


_ODD_WORDS = re.compile(r"[À-ÿ¸¨£³]*[À-ÿ]{2}[À-ÿ¸¨£³]*(?:[\s,.;:!?()\"«»-]+[À-ÿ¸¨£³]+(?![A-Za-z]))*")
_CYRILLIC_WORD = re.compile(r"[Ѐ-ӿ─-╿▀-▟©°·²÷№]*[Ѐ-ӿ][Ѐ-ӿ─-╿▀-▟©°·²÷№]*")
# Pairs of (encoding the text was read by, encoding it was in).
SWAPS = (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"))


def _russian(text: str) -> float:
    """Mean log frequency of the letters as Russian; a capital after a small letter counts as rare."""
    total, n, before = 0.0, 0, ""
    for c in text:
        if c.isalpha():
            total += math.log(0.02 if c.isupper() and before.islower() else RUSSIAN.get(c.lower(), 0.01))
            n += 1
        elif ord(c) > 127 and c not in "«»—–“”„№§€…":
            total += math.log(0.01)
            n += 1
        before = c
    return total / n if n else -9.0


@lru_cache(maxsize=1 << 16)
def _swapped(word: str) -> tuple[tuple[str, str, float], ...]:
    """``(pair, new, gain)`` of each swap under which a word may be better Russian than it is."""
    now, out = _russian(word), []
    for a, b in SWAPS:
        try:
            new = word.encode(a).decode(b)
        except UnicodeError:
            continue
        gain = _russian(new) - now
        # The two common encodings have capitals and small letters in each other's place:
        # turned letters speak for a swap where their frequencies don't, the reverse never does.
        turned = word[-1:].isupper() and (new.islower() or new.istitle())
        if (gain > 0 or (turned and gain > -1.5)) and not (word.islower() and new.isupper() and len(word) > 1):
            out.append((f"{a}>{b}", new, gain))
    return tuple(out)


def _spans_cyrillic(text: str) -> list[tuple[int, int, str]]:
    """Stretches of words that are better Russian under one and the same swap of encodings.

    Letters of whole stretches are weighed, so that an odd word alone decides nothing.
    """
    words = list(_CYRILLIC_WORD.finditer(text))
    got = [_swapped(m.group()) for m in words]
    out = []
    for pair in {g[0] for gs in got for g in gs}:
        i = 0
        while i < len(words):
            j, gain, letters = i, 0.0, 0
            while j < len(words) and (g := next((g for g in got[j] if g[0] == pair), None)) and (j == i or words[j].start() - words[j - 1].end() < 12):
                gain += g[2] * len(g[1])
                letters += len(g[1])
                j += 1
            if letters >= 6 and gain / letters > 0.4 and gain > 6:
                a, b = pair.split(">")
                run = text[words[i].start() : words[j - 1].end()]
                out.append((gain, words[i].start(), words[j - 1].end(), "".join(c.encode(a, "ignore").decode(b, "ignore") or c for c in run)))
            i = max(j, i + 1)
    kept: list[tuple[int, int, str]] = []
    for _, a, b, new in sorted(out, reverse=True):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, new))
    return kept


def _spans_latin(text: str) -> list[tuple[int, int, str]]:
    """Words of accented letters only that are Russian bytes read as a western encoding."""
    runs = []
    for m in _ODD_WORDS.finditer(text):
        run = m.group()
        before = text[m.start() - 1] if m.start() else " "
        after = text[m.end()] if m.end() < len(text) else " "
        words = re.findall(r"[^\W\d_]+", run)
        if before.isalpha() or (after.isalpha() and ord(after) < 128) or (not any(len(w) >= 3 for w in words) and len(words) < 2):
            continue
        raw = run.translate(_table("western"))
        if _NONE in raw:
            continue
        runs.append((m.start(), m.end(), raw.encode("latin-1")))
    best: tuple[float, list] = (math.log(1.8), [])
    for b in ("cp1251", "koi8-r"):
        new = [(x, y, r.decode(b, "replace")) for x, y, r in runs]
        best = max(best, (_russian(" ".join(n for _, _, n in new)), new), key=lambda x: x[0])
    return best[1]


# Two-byte encodings that may have been read as a western one, the structure
# of their bytes, and the characters that show that the reading is no accident.
DOUBLE = (
    ("euc_jp", re.compile("(?:[\xa1-\xa8\xb0-\xf4][\xa1-\xfe]){3,}"), re.compile("[぀-ヿ、。]"), 0.25),
    ("shift_jis", re.compile("(?:[\x81-\x84\x88-\x9f\xe0-\xea][\x40-\x7e\x80-\xfc]){4,}"), re.compile("[぀-ヿ、。]"), 0.25),
    ("euc_kr", re.compile("(?:[\xa1-\xfd][\xa1-\xfe]){4,}"), re.compile("[가-힣]"), 0.8),
    ("gb2312", re.compile("(?:[\xa1-\xa3\xb0-\xf7][\xa1-\xfe]){4,}"), re.compile("[一-鿿]"), 0.8),
)


_THREE_ODD = re.compile(r"[^\x00-\x7f].?[^\x00-\x7f].?[^\x00-\x7f]", re.S)


def _spans_double(text: str) -> list[tuple[int, int, str]]:
    """Spans that are well-formed East Asian text under a two-byte encoding read as a western one."""
    if not _THREE_ODD.search(text):
        return []
    whole = text.translate(_table("western"))
    utf8 = [(m.start(), m.end()) for m in SPAN.finditer(whole)]
    choices = []
    for name, shape, mark, share in DOUBLE:
        out = []
        for m in shape.finditer(whole):
            new = m.group().encode("latin-1").decode(name, "replace")
            within = sum(max(0, min(b, m.end()) - max(a, m.start())) for a, b in utf8)
            common = name != "gb2312" or sum(c < "\xd8" for c in m.group()[::2]) >= 0.7 * len(new)
            if "�" not in new and common and within < 0.8 * len(m.group()) and len(mark.findall(new)) >= share * len(new):
                out.append((m.start(), m.end(), new))
        choices.append(out)
    return max(choices, key=lambda c: sum(b - a for a, b, _ in c))


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(spans):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def _weight(spans: list[tuple[int, int, str]]) -> float:
    """How much an encoding explains: characters replaced, less for readings that are rare."""
    return sum((b - a) * (1.0 if all(c.isalnum() or c.isspace() or c in ".,;:!?()\"-’‘“”–—…§£€¥°«»¿¡‑™©®ªº" for c in new) else 0.5) - 0.2 * sum(c in "ÌÍÎÏÐÒØÙÝÞåæìîïðòøùýþÿ" for c in new) for a, b, new in spans)


# What a decoder writes for bytes it couldn't read.
_GONE = "\ufffd"
# A lead character whose partner was dropped. Sound words begin with it too (Âge, Âmbito), so it
# tells nothing by itself, only what is still lost in a text that is garbled.
_CUT = re.compile(r"(?<=[a-zß-ÿ])[ÃÂ](?![A-ZÀ-Ü])|\b[ÃÂ](?=[a-z]{2})|â€(?=[\s\w.,;:])")


_EAST_ASIAN = re.compile("[぀-ヿ一-鿿ｦ-ﾟ가-힣]")


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """``(garbled, restored, whole)`` of one text.

    ``restored`` is the text with every garbled span decoded, ``whole`` whether nothing of
    it stays lost. A null, empty or blank text is not garbled. Passes end when no span is
    left (or a pass gives a text that was there before, so that they always end).
    """
    if not text or not _FOREIGN.search(text):
        return False, text, True
    now, found, seen = text, False, {text}
    while True:
        choices = [_spans_one(now, e) for e in ONE_BYTE] + [_spans_latin(now), _spans_double(now)]
        if _EAST_ASIAN.search(now):
            choices += [_spans_two(now, e) for e in TWO_BYTE]
        # The reading that explains most goes first; what it leaves is met in the next round.
        best = max(choices, key=_weight)
        if not best or (new := _apply(now, best)) in seen:
            break
        found, now = True, new
        seen.add(now)
    if spans := _spans_cyrillic(now):
        found, now = True, _apply(now, spans)
    gone = _GONE in now
    return found or gone, now, not gone and not (found and _CUT.search(now))


def repaired(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, restored, whole`` of the garbled documents only, one row each; no shuffle.

    Null, empty, blank and plain ASCII texts are never garbled. Repeated rows each give a
    row, other columns of ``docs`` are left out, and an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, *repair(t)) for k, t in zip(b[key], b[text], strict=True)]
            yield pd.DataFrame([(k, new, whole) for k, bad, new, whole in got if bad], columns=[key, "restored", "whole"])

    return docs.where(docs[text].rlike(r"[^\x00-\x7f]")).select(key, text).mapInPandas(run, f"{key} {kind}, restored string, whole boolean")
