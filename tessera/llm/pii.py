"""Operator 8: personal data, with offset-preserving deobfuscation.

Base spans are four patterns on the text as it stands. The method then reads the text through transducers, each of
which rewrites it and keeps, for every code point it writes, the place in the source where it came from:

1. homoglyphs: compatibility forms, full-width and look-alike letters of other scripts become ASCII letters and digits;
   zero-width signs go;
2. spelled digits: number words of four languages become digits, those next to each other without the blanks between;
3. signs: `plus` before a number, `dot` between numbers;
4. disguises: `(at)`, `[at]`, ` at `, `(dot)`, ` dot ` (and the words for them in other languages, in any case)
   between name parts become `@` and `.`; ` at ` only before a name with a dot.

They are chained, so their maps compose; the same patterns are run on what comes out, and a span is mapped back to the
source code points of its first and last letter. A span that no base span covers is added as `<kind>_hidden`.
A text is rewritten stretch by stretch, between signs that no pattern and no transducer reads across, and only where
a transducer may change something: the result is that of the whole text. `at` before a domain is read as a
disguise even where it is a plain preposition (`look at example.com`).

Kinds in order: email, ip, card, phone (base), then email_hidden, ip_hidden, card_hidden, phone_hidden.

Defined results: a null text is an empty one; an empty text has no spans and the digest of nothing; spans are of code
points, end exclusive; rows that repeat are judged each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"{k}_hidden" for k in BASE))
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins at the start of a run of digits: if it failed there, it would fail within the run as well.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over name signs, not into the last match, and on over the domain."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base patterns."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip("аВеԛіјКМНорРСсТуХхѕԁɡոԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "aBeqijKMHopPCcTyXxsdgnwABEZHIKMNOPTYXoa", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
#: Number words in English, French, Spanish and German, from zero to nine, and what else stands for zero.
NUMBERS = {
    w: str(i)
    for line in ("zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "null eins zwei drei vier fünf sechs sieben acht neun", "oh")
    for i, w in enumerate(line.split())
}
#: Words for the signs of addresses and numbers.
AT, DOT, PLUS = "at|arobase|arroba", "dot|point|punto|punkt", "plus|más"
_WORD = "|".join(sorted(NUMBERS, key=len, reverse=True))
#: Number words that stand next to each other, with their blanks or hyphens; ends of words are no letters on either side.
SPELLED = re.compile(rf"(?<![^\W\d_])(?:{_WORD})(?:[\x20-]{{1,2}}(?:{_WORD}))*(?![^\W\d_])", re.IGNORECASE)
NUMBER = re.compile(_WORD, re.IGNORECASE)
SIGN = re.compile(rf"(?<![^\W\d_])(?:({PLUS})\x20+(?=[(0-9])|(?<=[0-9]\x20)({DOT})\x20+(?=[0-9]))", re.IGNORECASE)
BEFORE_DOT = re.compile(r"(?<=[0-9])\x20+(?=\.[0-9])")
_NAME = r"[A-Za-z0-9_%+-]"
BRACKETED = re.compile(rf"(?<={_NAME})\x20{{0,3}}[(\[{{<]\x20?({AT}|{DOT}|@|\.)\x20?[)\]}}>]\x20{{0,3}}(?={_NAME})", re.IGNORECASE)
SPACED = re.compile(rf"(?<![A-Za-z0-9.%+-])([A-Za-z0-9._%+-]+)(\x20+(?:{AT})\x20+)([A-Za-z0-9-]+(?:(?:\x20+(?:{DOT})\x20+|\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.IGNORECASE)
SPACED_DOT = re.compile(rf"\x20+(?:{DOT})\x20+|\.", re.IGNORECASE)
HALF = re.compile(rf"(?<=@)([A-Za-z0-9-]+(?:(?:\x20+(?:{DOT})\x20+|\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.IGNORECASE)
ODD = re.compile(rf"[{INVISIBLE}{''.join(LOOKALIKES)}！-～①-⑨²³¹⁰-₉\U0001d400-\U0001d7ff]")
#: What any transducer may change: these words, these signs, and what is ODD.
WORDS = re.compile(r"[^\W\d_]+")
CLUES = frozenset([*NUMBERS, *f"{AT}|{DOT}|{PLUS}".split("|")])
SIGNS = re.compile(r"[(\[{<]\x20?[@.]\x20?[)\]}>]")
#: Signs that no pattern and no transducer reads across: what stands between two of them is rewritten by itself.
BARRIER = re.compile(r"[\x00-\x1f!\"#$&'*,/:;=?\\^`|~]")

Traced = tuple[str, list[int], list[int]]


@cache
def _letter(c: str) -> str:
    if c in INVISIBLE:
        return ""
    return LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)


def homoglyphs(text: str, start: list[int], end: list[int]) -> Traced:
    if text.isascii():
        return text, start, end
    out, own, past = [], [], []
    for c, i, j in zip(text, start, end, strict=True):
        # What it stands for must not part what is read together.
        plain = c if c.isascii() else _letter(c)
        for d in plain if not BARRIER.search(plain) else c:
            out.append(d)
            own.append(i)
            past.append(j)
    return "".join(out), own, past


def rewrite(traced: Traced, pattern: re.Pattern, made) -> Traced:
    """Replaces matches by what `made` gives: (text, begin, end) in the match's text; a text of its source's length maps sign by sign."""
    text, start, end = traced
    out, own, past, last = [], [], [], 0
    for m in pattern.finditer(text):
        out.append(text[last : m.start()])
        own += start[last : m.start()]
        past += end[last : m.start()]
        for piece, a, b in made(m):
            out.append(piece)
            own += start[a:b] if len(piece) == b - a else [start[a]] * len(piece)
            past += end[a:b] if len(piece) == b - a else [end[b - 1]] * len(piece)
        last = m.end()
    if not last:
        return traced
    return "".join([*out, text[last:]]), own + start[last:], past + end[last:]


def spelled_digits(traced: Traced) -> Traced:
    return rewrite(traced, SPELLED, lambda m: [(NUMBERS[n[0].casefold()], n.start(), n.end()) for n in NUMBER.finditer(m.string, m.start(), m.end())])


def signs(traced: Traced) -> Traced:
    """Plus before a number, and dots between numbers; the blank before the dot goes as well."""
    traced = rewrite(traced, SIGN, lambda m: [("+", m.start(1), m.end(1))] if m[1] else [(".", m.start(2), m.end(2))])
    return rewrite(traced, BEFORE_DOT, lambda m: [])


def disguises(traced: Traced) -> Traced:
    def dotted(m: re.Match, group: int) -> list[tuple[str, int, int]]:
        out, place = [], m.start(group)
        for d in SPACED_DOT.finditer(m.string, m.start(group), m.end(group)):
            out += [(m.string[place : d.start()], place, d.start()), (".", d.start(), d.end())]
            place = d.end()
        return [*out, (m.string[place : m.end(group)], place, m.end(group))]

    traced = rewrite(traced, BRACKETED, lambda m: [("." if m[1] == "." or re.fullmatch(DOT, m[1], re.IGNORECASE) else "@", m.start(1), m.end(1))])
    traced = rewrite(traced, SPACED, lambda m: [(m[1], m.start(1), m.end(1)), ("@", m.start(2), m.end(2)), *dotted(m, 3)])
    return rewrite(traced, HALF, lambda m: dotted(m, 1))


def transduced(text: str) -> Traced:
    """What the chained transducers make of a text, with the places in the source where each code point starts and ends."""
    places = list(range(len(text) + 1))
    return disguises(signs(spelled_digits(homoglyphs(text, places[:-1], places[1:]))))


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between barriers in which a transducer could change something."""
    places = [m.start() for m in WORDS.finditer(text) if m[0].casefold() in CLUES]
    more = [m.start() for m in SIGNS.finditer(text)]
    if not text.isascii():
        more += (m.start() for m in ODD.finditer(text))
    if more:
        places = sorted([*places, *more])
    done = 0
    for at in places:
        if at < done:
            continue
        lo = at
        while lo > done and not BARRIER.match(text, lo - 1):
            lo -= 1
        found = BARRIER.search(text, at)
        done = found.start() if found else len(text)
        yield lo, done


def hidden(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = set()
    for lo, hi in _stretches(text):
        source = text[lo:hi]
        plain, start, end = transduced(source)
        if plain == source:
            continue
        for a, kind, b in patterns(plain):
            s, e = lo + start[a], lo + end[b - 1]
            if not any(x <= s and e <= y for x, _, y in base):
                out.add((s, kind + 4, e))
    return sorted(out)


def scan(text: str) -> list[tuple[int, int, int]]:
    base = patterns(text)
    return sorted([*base, *hidden(text, base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(text: Column) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base_sha256, spans)"""

    @F.pandas_udf("struct<n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = []
            for text in series.tolist():
                spans = scan(text or "")
                base = [s for s in spans if s[1] < 4]
                rows.append((*[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return judge(text)
