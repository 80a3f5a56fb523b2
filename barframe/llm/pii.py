"""Personal data with offset-preserving deobfuscation.

Base spans are the leftmost non-overlapping matches of four patterns on the text as it is; matches
that fail their check (octets, Luhn, number of digits) are dropped without another try. Then a chain
of transducers rewrites the text: look-alike characters become ASCII and invisible ones go, runs of
spelled digits become digits, and disguised at and dot signs become @ and dots. Every output
character keeps the source span it came from, so what the same patterns find in the output is mapped
back to source characters. Such a span is added when it holds a rewritten character and overlaps no
base span of its kind. Base spans always stay.

A bare "at" is a sign where a dotted host follows whose own dot was disguised, or whose last label is of
at least two letters in one case, and the word before it can be a local part: it has a letter, and a
digit or one of . _ % + - inside, or a word of CUES stands among the three before it, or it is neither in
NOT_LOCAL nor ends like a participle (ed, ing, able, ible).

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm.toxicity import HOMOGLYPHS

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NOT_DIGIT = re.compile(r"[^0-9]+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if place % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.split("."))
    digits = NOT_DIGIT.sub("", match)
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Every maximal run of local characters is read once; only one that an @ follows looks for a host."""
    last = 0
    if "@" not in text:
        return
    for run in LOCAL_RUN.finditer(text):
        start, at = max(run.start(), last), run.end()
        if start < at and text.startswith("@", at):
            host = HOST.match(text, at + 1)
            if host:
                last = host.end()
                yield start, last


def find_ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by single dots are read as one chain, whose matches are its groups of four."""
    for chain in NUMBERS.finditer(text):
        parts = [m.span() for m in DIGITS.finditer(text, *chain.span())]
        for k in range(0, len(parts) - 3, 4):
            yield parts[k][0], parts[k + 3][1]


def find(text: str, kind: str) -> list[tuple[int, int]]:
    """The matches of a kind's pattern that hold, in time linear in the text."""
    if kind == "email":
        return list(find_emails(text))
    places = find_ips(text) if kind == "ip" else (m.span() for m in PATTERNS[kind].finditer(text))
    return [(a, b) for a, b in places if holds(kind, text[a:b])]


# Look-alikes of the characters that identifiers are made of, beside HOMOGLYPHS.
CAPITALS = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ",
    "L": "Ꮮ", "M": "МΜϺ", "N": "Ν", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "ѴᏙ", "W": "Ԝ", "X": "ХΧ",
    "Y": "УΥҮ", "Z": "ΖᏃ", "0": "ОΟ",
}
LOOK_ALIKE = {
    "l": "ӏℓ", "f": "ϝ", "q": "գ", "z": "ᴢ", "y": "ү", "g": "ց",
    "@": "＠﹫", ".": "．。｡․", "+": "＋﹢", "-": "‐‑‒–—−－﹣", "(": "（", ")": "）",
}
# Words before "at" in prose, and words that announce an address.
NOT_LOCAL = set(
    "a about address all also am an and anyone are around available away back be been book buy check company day days down due "
    "else email everyone find for found get go good guide guys he help her here him home hosted i in info information is it "
    "join just keep learn live look made mail me meet more next not now of off office on online only open or order out over "
    "page people products read register sale save scheduled school see sell services set she shop shown sign site sold "
    "someone something start stay store students support team that the their them there these they things this time today "
    "together too up us version via visit was watch we web website well were when work works you your".split()
)
CUES = set("mail mailto email e-mail emails contact write reach address correspondence send ping".split())
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}


def _look_alikes() -> dict[str, str]:
    like = [*HOMOGLYPHS.items(), *CAPITALS.items(), *LOOK_ALIKE.items()]
    table = {c: plain for plain, some in like for c in some if not c.isascii()}
    table |= {chr(z + d): str(d) for z in DIGIT_ZEROS for d in range(10)}
    table |= {chr(0xFF21 + k): chr(65 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
    return table | {c: "" for c in INVISIBLE}


TABLE = _look_alikes()
STRANGE = re.compile("[" + re.escape("".join(TABLE)) + "]")
_ONE = "(?:" + "|".join(SPELLED) + ")"
_GAP = r"(?:[\s,_-]{1,3}|[\s]{0,2}(?:[.]|[\[({]?\bdot\b[\])}]?)[\s]{0,2})"
SPELLED_RUN = re.compile(rf"\b{_ONE}(?:{_GAP}(?:{_ONE}|[0-9]+)){{3,}}\b", re.IGNORECASE)
SPELLED_ONE = re.compile(rf"\b{_ONE}\b", re.IGNORECASE)
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
MARKED_AT = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:at|@){_CLOSE}(?=[A-Za-z0-9])", re.IGNORECASE)
MARKED_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:dot|\.){_CLOSE}(?=[A-Za-z0-9])", re.IGNORECASE)
WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9])", re.IGNORECASE)
WORD_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])", re.IGNORECASE)
LAST_LABEL = re.compile(r"(?:[a-z]{2,24}|[A-Z]{2,24})")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
PLUS = re.compile(r"\bplus[ \t]+(?=[0-9])", re.IGNORECASE)


def is_local(before: str) -> bool:
    """Whether the last word before a bare "at" can be a local part."""
    word = LOCAL.search(before)
    if not word or not any(map(str.isalpha, word[0])):
        return False
    name = word[0].lower()
    if any(c.isdigit() or c in "._%+-" for c in name.strip("._%+-")):
        return True
    cues = {w.strip(".,;:!?()[]<>\"'").lower() for w in before[:word.start()].split()[-3:]}
    return not CUES.isdisjoint(cues) and name not in ("me", "us", "him", "her", "them") or (
        len(name) > 1 and name not in NOT_LOCAL and name not in CUES and not name.endswith(("ed", "ing", "able", "ible"))
    )


class Tape:
    """A text beside the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)
        self.changed: list[bool] = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> bool:
        """Replace [a, b) by the given text, for disjoint edits in order."""
        if not edits:
            return False
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(new)
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            changed += [True] * len(new)
            at = b
        text.append(self.text[at:])
        self.start = start + list(self.start[at:])
        self.end = end + list(self.end[at:])
        self.changed = changed + self.changed[at:]
        self.text = "".join(text)
        return True


def deobfuscated(text: str) -> Tape | None:
    """The rewritten text, or None if nothing in it is disguised."""
    tape = Tape(text)
    touched = False
    if not text.isascii():
        touched |= tape.rewrite([(m.start(), m.end(), TABLE[m[0]]) for m in STRANGE.finditer(text)])
    spelled = [
        (run.start() + one.start(), run.start() + one.end(), SPELLED[one[0].lower()])
        for run in SPELLED_RUN.finditer(tape.text) for one in SPELLED_ONE.finditer(run[0])
    ]
    if tape.rewrite(spelled):
        touched = True
        # Digits that only single blanks, commas or hyphens part, beside a rewritten one, are one number.
        gaps = [
            (m.start(), m.end(), "") for m in re.finditer(r"(?<=[0-9])[ \t,_-]{1,3}(?=[0-9])", tape.text)
            if tape.changed[m.start() - 1] and tape.changed[m.end()]
        ]
        tape.rewrite(gaps)
    lowered = tape.text.lower()
    if "dot" in lowered or re.search(r"[\[({<][ \t]*(?:at|@|\.)[ \t]*[\])}>]", lowered):
        for pattern, sign in ((MARKED_AT, "@"), (MARKED_DOT, ".")):
            touched |= tape.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(tape.text)])
        if tape.rewrite([(m.start(), m.end(), ".") for m in WORD_DOT.finditer(tape.text)]):
            touched = True
    if " at" in lowered or "\tat" in lowered:
        at = []
        for m in WORD_AT.finditer(tape.text):
            host = re.compile(r"[A-Za-z0-9.-]+").match(tape.text, m.end())
            plain = HOST.match(tape.text, m.end())
            sure = host and any(tape.changed[m.end():host.end()])
            if sure or plain and LAST_LABEL.fullmatch(plain[0].rsplit(".", 1)[1]) and is_local(tape.text[max(0, m.start() - 120):m.start()]):
                at.append((m.start(), m.end(), "@"))
        touched |= tape.rewrite(at)
    if touched:
        tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text) if tape.changed[m.end()]])
    return tape if touched else None


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start."""
    if not text:
        return []
    found = {kind: [(a, b, True) for a, b in find(text, kind)] for kind in KINDS}
    tape = deobfuscated(text)
    if tape is not None:
        for kind in KINDS:
            base = [(x, y) for x, y, _ in found[kind]]
            ends = [y for _, y in base]
            for a, b in find(tape.text, kind):
                lo, hi = tape.start[a], tape.end[b - 1]
                near = range(bisect_right(ends, lo), len(base))
                meets = takewhile(lambda s, hi=hi: s[0] < hi, (base[k] for k in near))
                if any(tape.changed[a:b]) and all(lo <= x and y <= hi and (lo, hi) != (x, y) for x, y in meets):
                    found[kind].append((lo, hi, False))
    return [(kind, a, b, own) for kind in KINDS for a, b, own in sorted(found[kind])]


def pii_spans(text: Column) -> Column:
    """array<struct<kind, start, end, base>> of a string column."""

    @F.pandas_udf("kind array<string>, start array<int>, end array<int>, base array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [list(zip(*spans(t), strict=True)) or [(), (), (), ()] for t in batch]
            yield pd.DataFrame({n: [list(r[i]) for r in rows] for i, n in enumerate(("kind", "start", "end", "base"))})

    found = run(F.coalesce(text, F.lit("")))
    return F.arrays_zip(found["kind"].alias("kind"), found["start"].alias("start"), found["end"].alias("end"), found["base"].alias("base"))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans, base and added ones."""
    return docs.select(F.col(key).alias("doc_id"), pii_spans(F.col(text)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, and the spans as text and hash."""

    def listed(rows: Column) -> Column:
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(rows, one), ",")

    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of(k) for k in KINDS],
        F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
