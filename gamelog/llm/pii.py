"""Personal data with offsets, plain and disguised.

Plain identifiers are found by the base rules. Disguised ones are found on a normalised copy of
the text: transducers fold homoglyphs and full-width or foreign digits, take out invisible
characters, put @ and . for spelled or bracketed "at" and "dot", digits for spelled digits in
several languages and for letters standing in numbers. Each normalised character remembers the
source characters it stands for, so that spans found on the copy are given in source offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import rows_per_batch, table

# ---- fixed values: kinds in output order, base rules, spelled digits and signs ----
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-",
    "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
DOTS, PLUS = ("dot", "point", "punkt", "punto"), ("plus", "más")
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
# ---- end of fixed values ----

_FOLD = dict(HOMOGLYPHS) | dict.fromkeys(INVISIBLE, "") | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_ODD = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]|(?![0-9])\\d")
_DOT = "|".join(DOTS)
# every repetition is bounded or anchored, so that no text costs more than linear time
_BRACKETED = re.compile(
    r"\s{0,2}[\(\[\{<]\s{0,2}(?:(at|arroba|@)|(" + _DOT + r"|\.))\s{0,2}[\)\]\}>]\s{0,2}", re.I)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SAID = rf"(?:\s{{1,3}}(?:{_DOT})\s{{1,3}}|[_-](?:{_DOT})[_-]|\.)"
#: name at host dot tld: at least one dot is spelled
_BARE = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9%+-]{{1,64}}(?:(?:{_SAID}|_)[A-Za-z0-9%+-]{{1,64}}){{0,4}}?"
    rf"(?:\s{{1,3}}(?:at|arroba)\s{{1,3}}|[_-]at[_-]|@)"
    rf"(?={_LABEL}(?:\.{_LABEL}){{0,4}}(?:\s{{1,3}}(?:{_DOT})\s{{1,3}}|[_-](?:{_DOT})[_-]))"
    rf"{_LABEL}(?:{_SAID}(?!(?:at|arroba)\b){_LABEL}){{1,8}}", re.I)
_BARE_PART = re.compile(rf"\s+(at|arroba)\s+|[_-](at)[_-]|\s+(?:{_DOT})\s+|[_-](?:{_DOT})[_-]", re.I)
#: name at host.tld with only "at" spelled: joined by _, or of a name that is no plain word
_AT = re.compile(
    rf"(?<![\w.%+/-])(?:[A-Za-z0-9%+-]{{1,64}}(?:[._][A-Za-z0-9%+-]{{1,64}}){{0,4}}?_at_"
    rf"|(?=[A-Za-z0-9.%+_-]{{0,64}}[0-9._%+])[A-Za-z][A-Za-z0-9%+-]{{0,63}}(?:[._][A-Za-z0-9%+-]{{1,64}}){{0,4}}"
    rf"\s{{1,3}}(?:at|arroba)\s{{1,3}})(?={_LABEL}(?:\.{_LABEL}){{0,4}}\.[A-Za-z]{{2,}})", re.I)
_AT_PART = re.compile(r"_at_$|\s+(?:at|arroba)\s+$", re.I)
_DOTTED = re.compile(rf"(?<=[0-9])[\s_-]{{0,3}}(?:{_DOT})[\s_-]{{0,3}}(?=[0-9])", re.I)
_WORD = "|".join(sorted([*SPELLED, *REPEATS], key=len, reverse=True))
_NUMBER = re.compile(
    rf"(?<!\w)(?:(?:{'|'.join(PLUS)}|\+)[\s-]*)?(?:{_WORD}|\d{{1,4}})(?!\w)"
    rf"(?:[\s,.-]{{1,3}}(?:(?:{_DOT})[\s,-]{{1,3}})?(?:{_WORD}|\d{{1,4}})(?!\w))+", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\+")
_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[ ().-]{0,2}[0-9OolI]){6,}(?![A-Za-z0-9])")
_CHUNK = re.compile(r"[0-9OolI]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base rules, leftmost and non-overlapping per kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Copy:
    """A text under normalisation: characters and the source range of each."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def copy(self) -> Copy:
        out = Copy(self.text)
        out.start, out.end = self.start, self.end
        return out

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the text; the characters of a replacement stand for its range."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            if new:
                text.append(new)
                start.extend([self.start[a]] * len(new))
                end.extend([self.end[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        start.extend(self.start[at:])
        end.extend(self.end[at:])
        self.text, self.start, self.end = "".join(text), start, end


def _fold_edits(text: str):
    for m in _ODD.finditer(text):
        new = _FOLD.get(m[0])
        yield m.start(), m.end(), str(unicodedata.digit(m[0], "")) if new is None else new


def _bare_edits(text: str):
    for m in _BARE.finditer(text):
        for p in _BARE_PART.finditer(text, m.start(), m.end()):
            yield p.start(), p.end(), "@" if p[1] or p[2] else "."


def _at_edits(text: str):
    for m in _AT.finditer(text):
        yield m.start() + _AT_PART.search(m[0]).start(), m.end(), "@"


def _number_edits(runs, stops: bool):
    """Digits and dots for runs of numbers of which some part is spelled.

    ``stops``: full stops of the run stay; else they part digits like spaces and hyphens.
    """
    for m in runs:
        new, times, spelled, at = "", 1, 0, m.start()
        for t in _TOKEN.finditer(m.string, m.start(), m.end()):
            if stops and m.string.find(".", at, t.start()) >= 0 and new[-1:] != ".":
                new += "."
            word, at = t[0].lower(), t.end()
            if word in REPEATS:
                times, spelled = REPEATS[word], spelled + 1
                continue
            if word in SPELLED:
                new, spelled = new + SPELLED[word] * times, spelled + 1
            elif word in DOTS:
                new, spelled = new.rstrip(".") + ".", spelled + 1
            elif word in PLUS or word == "+":
                new += "+"
            else:
                new += word[0] * (times - 1) + word
            times = 1
        if spelled:
            yield m.start(), m.end(), new


def _dotted_edits(text: str):
    for m in _DOTTED.finditer(text):
        yield m.start(), m.end(), "."


def _mixed_edits(text: str):
    for m in _MIXED.finditer(text):
        for part in _CHUNK.finditer(text, m.start(), m.end()):
            if _digits(part[0]):  # letters by themselves are words
                for i, c in enumerate(part[0]):
                    if c in LETTER_DIGITS:
                        yield part.start() + i, part.start() + i + 1, LETTER_DIGITS[c]


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of identifiers that only the normalised copy shows, in source offsets."""
    copy = Copy(text)
    if not text.isascii() and _ODD.search(text):
        copy.apply(list(_fold_edits(text)))
    if _BRACKETED.search(copy.text):
        copy.apply([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(copy.text)])
    low = copy.text.lower()
    dots = any(d in low for d in DOTS)
    if dots:
        copy.apply(list(_bare_edits(copy.text)))
    if "at" in low or "arroba" in low:
        copy.apply(list(_at_edits(copy.text)))
    # readings of the numbers: dots between digits; all runs with a spelled part, full stops kept or not
    runs = list(_NUMBER.finditer(copy.text))
    edits = [list(_dotted_edits(copy.text)) if dots else [], list(_number_edits(runs, False)), list(_number_edits(runs, True))]
    if edits[2] == edits[1]:
        del edits[2]
    out = set()
    for some in edits if any(edits) else [[]]:
        read = copy.copy()
        read.apply(some)
        if _MIXED.search(read.text):
            read.apply(list(_mixed_edits(read.text)))
        if read.text != text:
            out.update((kind, read.start[a], read.end[b - 1]) for kind, a, b in base_spans(read.text))
    return _longest(out)


def _longest(spans: set[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that lie in no other of their kind."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if not out or out[-1][0] != kind or b > out[-1][2]:
            out.append((kind, a, b))
    return out


def all_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by start and kind; offsets in code points."""
    if not text:
        return []
    base = base_spans(text)
    inside: dict[str, list] = {k: [] for k in KINDS}
    for kind, a, b in base:
        inside[kind].append((a, b))
    out = {(k, a, b): True for k, a, b in base}
    for kind, a, b in disguised_spans(text):
        # added unless a plain span holds it already: plain ones of a kind follow each other, so only
        # the last that starts at or before it can
        i = bisect_right(inside[kind], a, key=lambda s: s[0]) - 1
        if i < 0 or inside[kind][i][1] < b:
            out.setdefault((kind, a, b), False)
    return sorted(((k, a, b, plain) for (k, a, b), plain in out.items()),
                  key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add the spans of personal data in ``text``: kind, start, end (code points), base.

    ``base`` tells the plain identifiers from those that only normalising shows. A spelled email is
    read with up to five parts of its name and nine of its host, so that no text costs more than linear
    time. A missing or empty text has none. An input column named ``into`` is replaced; all others stay.
    """
    rows_per_batch(df.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.DataFrame:
        return pd.Series([[{"kind": k, "start": a, "end": b, "base": p} for k, a, b, p in all_spans(t)]
                          for t in texts])

    return df.drop(into).withColumn(into, spans(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of personal data in ``text`` by its kind in angle brackets.

    Overlapping spans become one, under the kind that starts first.
    """
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            done, parts, at = -1, [], 0
            for kind, a, b, _ in all_spans(t):
                if a >= done:
                    parts += [t[at:a], f"<{kind}>"]
                done = at = max(done, b)
            out.append(t if t is None else "".join(parts) + t[at:])
        return pd.Series(out)

    return df.withColumn(text, clean(F.col(text)))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"))
