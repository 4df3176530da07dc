"""Operator 6: secret scans, with a guess cost for values in a credential context.

Base spans are three patterns. The method looks at values in a wider credential context (`login`, `pwd`,
`passphrase`, `bearer` and others, and the base's own words) and adds those whose guess cost is high. The cost of a value
is the least, over its segmentations, of the product of its parts' costs, times the factorial of their number, plus
a term for guessing by number of parts:
- words: the rank in a fixed public vocabulary, times what capitals and look-alike signs cost;
- dates: years, and days of a range of years with and without separators;
- repeats: the cost of what is repeated, times how often;
- keyboard walks: start keys times turns;
- brute force: BRUTE guesses a character.
It is worked out by dynamic programming over end positions and numbers of parts. Cost is in log10 of guesses.

Kinds in order: assign, access, hex (base), then guess (a context value of cost `threshold` or more). Values are priced
whole; segmentations are dropped as soon as their parts alone, a lower bound, cost the threshold. A repeat is of what is no
repeat itself, as often as it follows. Numbers of parts are followed as far as they can be cheapest: k parts cost 4 (k - 1) at
least, by the term for shorter guesses, and brute force of the whole value is always there.

Defined results: a null text is an empty one; an empty text has no spans and the digest of nothing; spans are of code
points, end exclusive; rows that repeat are judged each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of `[0-9a-f]+` that are long enough
#: What may name a credential, then the value up to white space or a quote.
CONTEXT = re.compile(r"""(?<![A-Za-z])(password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|login|credentials?|bearer|pin)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)["']?([^\s"'`<>,;]+)""", re.IGNORECASE | re.ASCII)
BRUTE = 1.0  # log10 of 10 guesses a character
THRESHOLD = 10.0
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@8310!5$7+", "aabeloisstt")


@cache
def neighbours() -> dict[str, dict[str, tuple[float, int]]]:
    """Keys beside each other on a slanted keyboard, with the direction to them."""
    at = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b: (x2 - x1, y2 - y1) for b, (x2, y2) in at.items() if a != b and abs(y1 - y2) <= 1 and abs(x1 - x2) <= 1} for a, (x1, y1) in at.items()}


@cache
def ranks(path: str) -> dict[str, int]:
    """Whole words of a word-ending vocabulary, by their place in it."""
    words = (w.removesuffix("</w>") for w, _ in sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1]) if w.endswith("</w>"))
    out: dict[str, int] = {}
    for w in words:
        if len(w) > 2 and w.isascii() and w.isalpha():
            out.setdefault(w, len(out) + 1)
    return out


@cache
def longest(path: str) -> int:
    return max(map(len, ranks(path)), default=0)


def _word_cost(part: str, known: dict[str, int]) -> float | None:
    low = part.lower()
    plain = low.translate(LEET)
    rank = known.get(low) or known.get(plain)
    if not rank:
        return None
    cost = math.log10(rank)
    upper = sum(c.isupper() for c in part)
    if upper:
        cost += math.log10(2 if upper == len(part) or part[0].isupper() and upper == 1 else sum(math.comb(len(part), k) for k in range(1, upper + 1)))
    changed = sum(a != b for a, b in zip(low, plain, strict=True)) if low not in known else 0
    return cost + math.log10(2) * changed


_DATE = re.compile(r"(?:\d{1,2}([-/._]?)\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([-/._]?)\d{1,2}\2\d{1,2})")
_YEAR = re.compile(r"(?:19|20)\d\d")


def _walk_end(value: str, i: int) -> tuple[int, int]:
    """End and turns of the keyboard walk from i."""
    low, near, turns, last, j = value.lower(), neighbours(), 1, None, i
    while j + 1 < len(low) and (step := near.get(low[j], {}).get(low[j + 1])):
        turns += last is not None and step != last
        last, j = step, j + 1
    return j + 1, turns


def _parts_from(value: str, i: int, known: dict[str, int], path: str, enough: float) -> Iterator[tuple[int, float]]:
    """(end, cost) of the parts that start at i; brute force only as far as it costs less than `enough`."""
    n = len(value)
    for j in range(i + 3, min(n, i + longest(path)) + 1):
        cost = _word_cost(value[i:j], known)
        if cost is not None:
            yield j, cost
    if m := _YEAR.match(value, i):
        yield m.end(), math.log10(120)
    for j in range(i + 4, min(n, i + 10) + 1):
        if m := _DATE.fullmatch(value, i, j):
            yield j, math.log10(365 * 120) + (math.log10(4) if m[1] or m[2] else 0)
    end, turns = _walk_end(value, i)
    for j in range(i + 3, end + 1):
        yield j, math.log10(47 * 4) + math.log10(j - i) * turns
    for size in range(1, (n - i) // 2 + 1):
        if value[i + size] != value[i]:
            continue
        unit, times = value[i : i + size], 1
        if not value.startswith(unit, i + size) or (unit + unit).find(unit, 1) < size:
            continue
        while value.startswith(unit, i + times * size):
            times += 1
        if times * size >= 3:
            yield i + times * size, guess_cost(unit, path, enough) + math.log10(times)
    for j in range(i + 1, min(n, i + math.ceil(min(enough, n) / BRUTE)) + 1):
        yield j, BRUTE * (j - i) + (0.04 if j - i == 1 else 0.0)


@lru_cache(maxsize=50_000)
def guess_cost(value: str, path: str, enough: float = math.inf) -> float:
    """log10 of guesses by the cheapest segmentation; any number from `enough` on if that is not less."""
    known, n = ranks(path), len(value)
    parts = 1 + int(min(enough, BRUTE * n + 1) / 4)
    least: list[list[float] | None] = [None] * (n + 1)
    least[0] = [0.0] + [math.inf] * parts
    for i in range(n):
        if (own := least[i]) is None:
            continue
        for j, cost in _parts_from(value, i, known, path, enough):
            for k in range(parts):
                c = own[k] + cost
                if c < enough:
                    if (to := least[j]) is None:
                        to = least[j] = [math.inf] * (parts + 1)
                    to[k + 1] = min(to[k + 1], c)
    if not n:
        return 0.0
    # k parts may come in k! orders, and shorter guesses of as many parts come first.
    return min((whole_cost(k, c) for k, c in enumerate(least[n] or []) if k and c < math.inf), default=enough)


def whole_cost(k: int, parts: float) -> float:
    """log10 of (k! times the parts' guesses, plus 10000 ** (k - 1)), of sums in logarithms."""
    a, b = parts + math.lgamma(k + 1) / math.log(10), 4.0 * (k - 1)
    return max(a, b) + math.log10(1 + 10 ** -abs(a - b))


def scan(text: str, path: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".:!?)]}*#$%&")
        if len(value) >= 6 and guess_cost(value, path, threshold) >= threshold:
            out.append((m.start(2), 3, m.start(2) + len(value)))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(text: Column, path: str, threshold: float = THRESHOLD) -> Column:
    """struct(n_assign, n_access, n_hex, base_sha256, spans)"""

    @F.pandas_udf("struct<n_assign long, n_access long, n_hex long, base_sha256 string, spans string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = []
            for text in series.tolist():
                spans = scan(text or "", path, threshold)
                base = [s for s in spans if s[1] < 3]
                rows.append((*[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return judge(text)


def mask_secrets(text: Column, path: str, threshold: float = THRESHOLD) -> Column:
    """The text with every secret replaced by a mark; texts without any stay as they are, null too."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([redact(t, scan(t or "", path, threshold)) for t in series.tolist()], dtype=object)

    return mask(text)


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced by one mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a], mark
        at = max(at, b)
    return "".join([*out, text[at:]])
