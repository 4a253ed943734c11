"""Secret scans: patterns for known shapes, and the guess cost of what stands in a credential's place."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: The patterns of the base kinds, in the order in which kinds are listed. Fixed values.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Places where a credential stands: a wider set of names and separators than ASSIGN's. The value follows: printable characters.
PLACE = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth(?:orization)?|login|pin)["'\])]?\x20{0,4}(?::=|=>|[:=]|\x20is\x20)\x20{0,4}(?:(?i:bearer|basic)\x20)?["'(\[]?(?=[!-~])""",
    re.ASCII,
)
_VALUE = re.compile("[!-~]+")
#: Where a value that runs on into the next credential ends.
_NEXT = re.compile("[,;&|]")
_TRIM = "\"'`,;.()[]{}<>|"
#: Guesses (as a power of ten) from which a value counts as a secret rather than a word, a placeholder or prose.
MIN_GUESSES = 8.0
#: Longest unit of a repeat; a longer one is costed by its own segments. It is part of what a repeat is, at every length of value.
UNIT = 32
#: What each segment adds: the next one's kind must be guessed among six.
_KIND = math.log10(6)

#: Rows of a keyboard, as they stand. Fixed values.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4831!0$57", "aaebiiosst")
_YEARS = re.compile(r"(?:19|20)\d\d")
_DATES = re.compile(r"(\d{1,4})([-/._ ]?)(\d{1,2})\2(\d{1,4})")


class Ranks(dict):
    """Words and their ranks; longest: the most characters of a word."""

    def __init__(self, words):
        super().__init__(words)
        self.longest = max(map(len, self), default=0)


@lru_cache(maxsize=4)
def ranks(tokenizer: str) -> Ranks:
    """The whole lower-case words of a public vocabulary file, in its order (49,000 at most)."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha())
    return Ranks({w: k for k, (_, w) in enumerate(words, 1)})


_AT = {c: (r, i + r * 0.5) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


def _step(kind: str, a: str, b: str) -> tuple[float, float] | int | None:
    """The way from one character to the next: along neighbouring keys of the keyboard, or up or down by one."""
    if kind == "sequence":
        return d if (d := ord(b) - ord(a)) in (1, -1) else None
    if a == b or a not in _AT or b not in _AT:
        return None
    way = (_AT[b][0] - _AT[a][0], _AT[b][1] - _AT[a][1])
    return way if max(map(abs, way)) <= 1 else None


def _class(c: str) -> int:
    """Digit, lower case, upper case or another character, as a bit."""
    return 1 if c.isdigit() else 2 if c.islower() else 4 if c.isupper() else 8


#: Cost of a character guessed from a set of classes, in log10.
_RATE = [math.log10(max(10, 10 * (m & 1) + 13 * (m & 2) + 26 * (m >> 2 & 1) + 33 * (m >> 3))) for m in range(16)]


def _brute(s: str) -> float:
    """Cost of guessing a run character by character from the classes that it has, in log10."""
    m = 0
    for c in s:
        m |= _class(c)
    return len(s) * _RATE[m]


def _case(word: str) -> float:
    """Variants of upper and lower case, in log10."""
    up = sum(c.isupper() for c in word)
    if not up:
        return 0.0
    if up == len(word) or word[0].isupper() and up == 1:
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(up, len(word) - up) + 1)) or 2)


def _repeats(s: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, unit) of repeats: from any place, a unit of at most UNIT characters that is no repeat itself, as often as it goes on, three characters or more in all."""
    x, n = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), len(s)
    same: dict[int, np.ndarray] = {}
    for u in range(1, min(UNIT, n // 2) + 1):
        # How many characters in a row equal those u places on.
        other = np.flatnonzero(np.append(x[u:] != x[:-u], True))
        r = other[np.searchsorted(other, np.arange(n - u + 1))] - np.arange(n - u + 1)
        if u <= UNIT // 2:  # a longer unit asks for fewer than UNIT
            same[u] = np.minimum(r, UNIT).astype(np.uint8)
        times = r // u + 1
        hit = (times >= 2) & (times * u >= 3)
        for v in range(1, u // 2 + 1):
            if u % v == 0:
                hit &= same[v][: len(hit)] < u - v
        for i in np.flatnonzero(hit).tolist():
            yield i, i + int(times[i]) * u, u


def _spans(s: str, words: Ranks) -> dict[int, list[tuple[int, float, str]]]:
    """Matches by start: (end, log10 guesses, kind) of words, years, dates, repeats, keyboard walks and sequences."""
    out, n, low = defaultdict(list), len(s), s.lower()
    if len(low) != n:  # a few letters have a lower case of two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    plain, two = low.translate(_LEET), math.log10(2)
    for i in range(n):
        for j in range(i + 3, min(n, i + words.longest) + 1):
            w = low[i:j]
            if r := words.get(w):
                out[i].append((j, math.log10(r) + _case(s[i:j]), "word"))
            if (p := plain[i:j]) != w and (r := words.get(p)):
                out[i].append((j, math.log10(r) + two + _case(s[i:j]), "word"))
            if j - i > 3 and (r := words.get(w[::-1])):
                out[i].append((j, math.log10(r) + two + _case(s[i:j]), "word"))
    for m in _YEARS.finditer(s):
        out[m.start()].append((m.end(), math.log10(120), "date"))
    for i in range(n):
        m = s[i].isdigit() and _DATES.match(s, i)
        if m and 4 <= m.end() - i <= 10 and any(1 <= int(d) <= 31 and 1 <= int(mo) <= 12 for d, mo in ((m[1], m[3]), (m[3], m[1]), (m[4], m[3]), (m[3], m[4]))):
            out[i].append((m.end(), math.log10(365 * 100 * (4 if m[2] else 1)), "date"))
    for i, j, unit in _repeats(s):
        out[i].append((j, _brute(s[i : i + unit]) + math.log10((j - i) / unit), "repeat"))
    for kind in ("walk", "sequence"):
        i = 0
        while i < n - 2:
            j, turns, way = i, 0, None
            while j + 1 < n and (step := _step(kind, low[j], low[j + 1])) is not None and (kind == "walk" or way in (None, step)):
                turns += step != way
                way, j = step, j + 1
            if j - i >= 2:
                cost = math.log10(47 * (j + 1 - i)) + turns * math.log10(4.6) if kind == "walk" else math.log10(26 * (j + 1 - i))
                out[i].append((j + 1, cost + _case(s[i : j + 1]), kind))
            i = max(j, i + 1)
    return out


def guess_cost(value: str, words: Ranks) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses of a value over all segmentations, and the segments.

    A segment is a match (words, dates, repeats, keyboard walks, sequences) or a brute-force span; it costs its own
    guesses, ten at least, times the number of kinds. So costs add up, and the least of the whole value is exact by a
    dynamic programme over its places: every match is an arc, and a brute-force span is kept open for each set of
    character classes, which costs the same for each character. Steps and memory grow with the length.
    """
    n, spans = len(value), _spans(value, words)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    run, since = [math.inf] * 16, [0] * 16
    for j, ch in enumerate(value):
        b = best[j] + _KIND
        for end, c, kind in spans.get(j, ()):
            if (new := b + max(c, 1.0)) < best[end]:
                best[end], back[end] = new, (j, kind)
        bit = _class(ch)
        for m in range(1, 16):
            if not m & bit:
                run[m] = math.inf
                continue
            if b < run[m]:
                run[m], since[m] = b, j
            run[m] += _RATE[m]
            if run[m] < best[j + 1]:
                best[j + 1], back[j + 1] = run[m], (since[m], "brute")
    out, j = [], n
    while j:
        i, kind = back[j]
        out.append((i, j, kind))
        j = i
    return best[n], out[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def guess_spans(text: str, words: Ranks, least: float, known: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """Values in a credential's place of six characters or more. One that runs on into the next credential ends there; no value starts within another."""
    out, end = [], 0
    for m in PLACE.finditer(text):
        if m.end() < end:
            continue
        start, end = _VALUE.match(text, m.end()).span()
        for cut in _NEXT.finditer(text, start, end):
            if PLACE.match(text, cut.end()):
                end = cut.start()
                break
        v = text[start:end].rstrip(_TRIM)
        start += len(v) - len(v := v.lstrip(_TRIM))
        if len(v) < 6:
            continue
        if (cost := known.get(v)) is None:
            if len(known) > 20_000:
                known.clear()
            cost = known[v] = guess_cost(v, words)[0]
        if cost >= least:
            out.append(("guess", start, start + len(v), cost))
    return out


_CUE = re.compile(r"pass|pwd|secret|token|key|cred|auth|login|pin", re.IGNORECASE)


def scan(docs: DataFrame, words: str, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_GUESSES) -> DataFrame:
    """Returns id_col, text, found array<struct<kind, start, end, guesses>> for every row of docs, in one narrow pass.

    Positions are code points, the end is exclusive; spans are put by start, then in the order of KINDS. Kinds assign,
    access and hex are the patterns above, leftmost and non-overlapping within their kind; guess holds values in a
    credential's place whose guess cost is 10**least or more (guesses: its log10, else null). words: path of a
    vocabulary file whose whole words, in order of rank, are the dictionary.

    Null and empty texts give an empty list. Texts and values are scanned whole at any length, in steps that grow with
    it. Repeated rows give a row each; extra columns are left out.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known: dict[str, float] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        table, found = ranks(words), []
        for t in b.column(1).to_pylist():
            spans: list[tuple] = []
            if t:
                spans = [(*x, None) for x in base_spans(t)]
                if _CUE.search(t):
                    spans += guess_spans(t, table, least, known)
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
            found.append([dict(zip(("kind", "start", "end", "guesses"), x, strict=True)) for x in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["id", "text", "found"])

    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"id {kind}, text string, found array<struct<kind:string,start:int,end:int,guesses:double>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    text = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    base = F.filter("found", lambda x: x.kind != "guess")
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"), count("guess"),
        F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", text)).alias("spans"),
    )


def redact(docs: DataFrame, words: str, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by <secret>, overlapping spans by one; chars_col, if there, is counted anew where a text changed.

    All columns and rows stay. Texts without spans stay as they are, null ones null.
    """
    cols, schema = docs.columns, docs.schema
    at, n = cols.index(text_col), cols.index(chars_col) if chars_col in cols else None
    known: dict[str, float] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        table, texts, counts = ranks(words), [], b.column(n).to_pylist() if n is not None else []
        for k, t in enumerate(b.column(at).to_pylist()):
            spans = []
            if t:
                spans = [x[1:3] for x in base_spans(t)]
                if _CUE.search(t):
                    spans += [x[1:3] for x in guess_spans(t, table, MIN_GUESSES, known)]
            if spans:
                out, end = [], 0
                for i, j in sorted(spans):
                    if i >= end:
                        out += [t[end:i], "<secret>"]
                    end = max(end, j)
                t = "".join([*out, t[end:]])
                if n is not None:
                    counts[k] = len(t)
            texts.append(t)
        columns = list(b.columns)
        columns[at] = pa.array(texts, b.schema.field(at).type)
        if n is not None:
            columns[n] = pa.array(counts, b.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, names=cols)

    return arrow_map(docs, run, schema)
