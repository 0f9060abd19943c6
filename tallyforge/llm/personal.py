"""Personal data in texts, disguised or not: e-mail addresses, IP addresses, card and phone numbers.

What the patterns find in the text itself stays. Beside it, three transducers rewrite the text: look-alike characters
(compatible forms, other scripts' digits and letters, invisible characters, letters inside numbers), spelled digits, and
`at` and `dot` in brackets or words. Each rewrites stretches and leaves the rest, and carries for every character of its
output the start and the end of the source characters it stands for, so a span that the same patterns find in the
rewritten text maps back to the source however many transducers it went through. Such a span is added if something in
it was rewritten and no plain span of its kind covers it. All steps are linear in the text, so texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the pattern of the contract: a run of digits that fails at its first digit fails at all, so it is tried once
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o", "ᴄ": "c", "ᴍ": "m", "ⅼ": "l",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "·": ".", "•": ".", "‧": ".", "⁃": "-", "−": "-", "﹣": "-", "﹘": "-", "⁺": "+", "﹢": "+", "﹫": "@",
}
#: Characters that show nothing, and those of any space or dash.
HIDDEN = [0xAD, 0x34F, 0x61C, 0x180E, 0x20E3, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
AT_WORDS, DOT_WORDS, DASH_WORDS = ("at", "ät", "arobase", "arroba", "klammeraffe"), ("dot", "punkt", "point", "punto"), ("dash", "hyphen", "minus", "bindestrich", "tiret", "guion", "guión")
PLUS_WORDS = ("plus", "más", "mas")
#: Ends of names that a domain written in words must have.
ENDINGS = set(
    "com org net edu gov mil int info biz io co dev app ai me us uk de fr es it nl be ch at eu ca au nz jp cn in br mx ru pl se no dk fi ie pt cz gr "
    "example test invalid local online site".split()
)

_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_NUMBER = f"(?:{_any(DIGITS)}|[0-9]+)"
_TOKEN = f"(?:(?:{_any(TIMES)} )?{_NUMBER}|{_any(DOT_WORDS)}|{_any(DASH_WORDS)})"
SPELLED_HINT = re.compile(rf"\b{_any(DIGITS)}[ ,;.\n\t-]{{1,3}}(?:{_any(TIMES)} )?{_any([*DIGITS, *DOT_WORDS])}\b")
SPELLED = re.compile(rf"(?:\b{_any(PLUS_WORDS)} ?|\+ ?)?\b{_TOKEN}(?:[ ,;.\n\t-]{{1,3}}{_TOKEN})+\b")
TOKENS = re.compile(rf"{_any(PLUS_WORDS)}\b|\+|{_any(TIMES)} {_NUMBER}|{_NUMBER}|{_any(DOT_WORDS)}|{_any(DASH_WORDS)}")
_OPEN, _SHUT = r"[\[({<|*_~-]", r"[\])}>|*_~-]"
_DOTS = rf"(?:\s{{0,2}}{_OPEN}\s?(?:{_any(DOT_WORDS)}|\.)\s?{_SHUT}\s{{0,2}}|\s{{1,2}}{_any(DOT_WORDS)}\s{{1,2}}| \. |\.)"
AT = re.compile(rf"\s{{0,2}}{_OPEN}{{1,2}}\s?(?:{_any(AT_WORDS)}|@)\s?{_SHUT}{{1,2}}\s{{0,2}}|\s{{1,2}}{_any(AT_WORDS)}\s{{1,2}}|\s{{0,2}}@\s{{0,2}}")
# a written-out host keeps to what names may be: labels of at most 63 characters, 127 of them, 64 before the @
NAME = re.compile(rf"[a-z0-9-]{{1,63}}(?:{_DOTS}[a-z0-9-]{{1,63}}){{1,126}}(?![a-z0-9-])")
MOST = 64
DOT, DOT_BEFORE = re.compile(_DOTS), re.compile(rf"{_DOTS}\Z")
DOT_HINT = re.compile(rf"{_OPEN}\s?(?:{_any(DOT_WORDS)}|\.)\s?{_SHUT}|\s{_any(DOT_WORDS)}\s| \. ")
AT_HINT = re.compile(rf"@|{_OPEN}\s?{_any(AT_WORDS)}\s?{_SHUT}|\s{_any(AT_WORDS)}\s")
IP_WORDS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOTS}[0-9]{{1,3}}){{3}}(?![0-9])")
#: Letters within numbers: what they stand for, and a number that may hold some.
LETTERS = str.maketrans("OoQIlSBZ", "00011582")
LETTERED_HINT = re.compile(r"[0-9][OoQIlSBZ]|[OoQIlSBZ][0-9]")
LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoQIlSBZ](?:[ ().-]{0,2}[0-9OoQIlSBZ])+(?![A-Za-z0-9])")
GROUP = re.compile("[0-9OoQIlSBZ]+")

Spans = dict[str, list[tuple[int, int]]]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain(text: str) -> Spans:
    """The contract's patterns: per kind, leftmost and without overlap; what fails its check goes."""
    out: Spans = {k: [] for k in KINDS}
    at, floor = text.find("@"), 0
    while at >= 0:
        own = text[floor:at]
        size = len(own) - len(own.rstrip(LOCAL))
        name = DOMAIN.match(text, at) if size else None
        if name:
            out["email"].append((at - size, name.end()))
        floor = name.end() if name else at + 1
        at = text.find("@", floor)
    if text.count(".") >= 3:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


class Source:
    """A rewritten text, with the source characters that each of its characters stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (start, end, new), in order and without overlap."""
        if not edits:
            return
        n = len(self.text)
        starts = np.arange(n) if self.starts is None else self.starts
        ends = starts + 1 if self.ends is None else self.ends
        new, s, e, at = [], [], [], 0
        for a, b, by in edits:
            new += [self.text[at:a], by]
            s += [starts[at:a], np.full(len(by), starts[a])]
            e += [ends[at:a], np.full(len(by), ends[b - 1])]
            at = b
        self.text = "".join([*new, self.text[at:]])
        self.starts, self.ends = np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])

    def exchange(self, table: dict[int, str]) -> None:
        """Replace characters one for one."""
        if self.starts is None:
            self.starts = np.arange(len(self.text))
            self.ends = self.starts + 1
        self.text = self.text.translate(table)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


@cache
def characters() -> tuple[dict[int, str], list[re.Pattern], re.Pattern]:
    """What each look-alike stands for, built from the character database and LOOKALIKES; patterns that find them and the invisible ones; one of the latter."""
    table = dict(LOOKALIKES)
    for code in range(0x80, 0x20000):
        char = chr(code)
        if char in table or 0xD800 <= code < 0xE000:
            continue
        kind = unicodedata.category(char)
        digit = unicodedata.digit(char, None)
        if digit is not None:
            table[char] = str(digit)
        elif kind == "Zs":
            table[char] = " "
        elif kind == "Pd":
            table[char] = "-"
        else:
            same = unicodedata.normalize("NFKC", char)
            if len(same) == 1 and same.isascii() and (same.isalnum() or same in "@.+-()[]{}<>_"):
                table[char] = same
    unseen = "".join(map(chr, HIDDEN))
    return {ord(c): by for c, by in table.items() if c not in unseen}, [re.compile("[" + "".join(re.escape(c) for c in table if c < "\U00010000") + unseen + "]"), re.compile("[\U00010000-\U0001ffff]")], re.compile(f"[{unseen}]+")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def lookalikes(now: Source) -> None:
    if not now.text.isascii():
        table, seen, hidden = characters()
        if any(p.search(now.text) for p in seen):
            now.rewrite([(m.start(), m.end(), "") for m in hidden.finditer(now.text)])
            now.exchange(table)
    if LETTERED_HINT.search(now.text):
        edits = []
        for m in LETTERED.finditer(now.text):
            groups = list(GROUP.finditer(m[0]))
            while groups and groups[-1][0].isalpha():  # a word after a number is none of it, nor one before it
                groups.pop()
            while groups and groups[0][0].isalpha():
                groups.pop(0)
            own = m[0][groups[0].start() : groups[-1].end()] if groups else ""
            letters, digits = sum(map(str.isalpha, own)), sum(map(str.isdigit, own))
            if letters and digits >= max(letters, 4) and all(len(g[0]) >= 3 or not g[0].isalpha() for g in groups):
                start = m.start() + groups[0].start()
                edits.append((start, start + len(own), own.translate(LETTERS)))
        now.rewrite(_single(now.text, edits))


def _single(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of equal length, character by character, so that what is the same keeps its own place."""
    return [(a + i, a + i + 1, new) for a, _, by in edits for i, new in enumerate(by) if text[a + i] != new]


def spelled(now: Source) -> None:
    """Three digits or more of which some are words become digits; `plus` before them, `dot` and `dash` among them too."""
    low = lowered(now.text)
    if not SPELLED_HINT.search(low):
        return
    edits = []
    for m in SPELLED.finditer(low):
        digits, words, own = 0, 0, []
        for t in TOKENS.finditer(low, m.start(), m.end()):
            token = t[0]
            if token == "+" or token in PLUS_WORDS:
                by = "+"
            elif token in DOT_WORDS:
                by = "."
            elif token in DASH_WORDS:
                by = "-"
            else:
                times, _, number = token.rpartition(" ")
                by = (number if number[0].isdigit() else str(DIGITS[number])) * TIMES.get(times, 1)
                digits, words = digits + len(by), words + (not number[0].isdigit())
            own.append((t.start(), t.end(), by))
        if digits < 3 or not words:
            continue
        at = None
        for a, b, by in own:
            if at is not None and a > at:  # what stood between two of them goes
                edits.append((at, a, ""))
            edits.append((a, b, by))
            at = b
    now.rewrite(edits)


def _dots(low: str, a: int, b: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in DOT.finditer(low, a, b) if m[0] != "."]


def _run(low: str, floor: int, upto: int) -> int:
    """How many characters of a local part stand before a place; more than MOST are too many."""
    own = low[max(floor, upto - MOST - 1) : upto]
    return len(own) - len(own.rstrip(LOCAL))


def ats_and_dots(now: Source) -> None:
    """`name (at) host (dot) com`, `name at host dot com` and their like, and addresses with such dots."""
    low = lowered(now.text)
    dots = DOT_HINT.search(low)
    if not dots and not AT_HINT.search(low):
        return
    edits, floor = [], 0
    for m in AT.finditer(low):
        if m[0] == "@" and not dots:
            continue
        name = NAME.match(low, m.end())
        if not name or m.start() <= floor:
            continue
        own = _dots(low, name.start(), name.end())
        ending = name[0].rsplit(".", 1)[-1] if not own else low[max(own[-1][1], low.rfind(".", name.start(), name.end()) + 1) : name.end()]
        kind = "plain" if m[0] == "@" else "spaced" if m[0].strip() == "@" else "word" if m[0].strip() in AT_WORDS else "bracket"
        if kind == "plain" and not own or not ending.isalpha() or len(ending) < 2:
            continue
        size = _run(low, floor, m.start())
        start, before = m.start() - size, []
        while 0 < size <= MOST and floor < start:  # john dot doe at ...
            d = DOT_BEFORE.search(low, max(floor, start - 16), start)
            more = _run(low, floor, d.start()) if d and d[0] != "." and d[0] != " . " else 0
            if not 0 < more <= MOST:
                break
            before.append((d.start(), d.end(), "."))
            start = d.start() - more
        local = low[m.start() - size : m.start()]
        worded = any(not re.search(_OPEN, low[a:b]) for a, b, _ in own) or kind in ("spaced", "word")
        if not 0 < size <= MOST or not re.search("[a-z0-9]", local) or worded and ending not in ENDINGS:
            continue
        if kind == "word" and not own and not re.search("[a-z0-9][._%+0-9-]+[a-z0-9]", local):
            continue  # "look at example.com" is no address
        edits += [*reversed(before), *([] if kind == "plain" else [(m.start(), m.end(), "@")]), *own]
        floor = name.end()
    taken = [(a, b) for a, b, _ in edits]
    if dots:
        at = 0
        for m in IP_WORDS.finditer(low):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                edits += _dots(low, *m.span())
    now.rewrite(sorted(edits))


def spans_of(text: str) -> list[tuple[str, int, int, str, bool]]:
    """kind, start, end (code points, end exclusive), the identifier as it was read, and whether it stood there plainly."""
    base = plain(text)
    out = [(k, a, b, text[a:b], True) for k in KINDS for a, b in base[k]]
    now = Source(text)
    for step in (lookalikes, spelled, ats_and_dots):
        step(now)
    if now.starts is not None:
        for kind, found in plain(now.text).items():
            known, at = base[kind], 0
            for a, b in found:
                s, e = now.span(a, b)
                while at < len(known) and known[at][1] < e:
                    at += 1
                if text[s:e] != now.text[a:b] and not (at < len(known) and known[at][0] <= s):
                    out.append((kind, s, e, now.text[a:b], False))
    return sorted(out, key=lambda r: (KINDS.index(r[0]), r[1], r[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("plain", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "value", "plain"), s)) for s in spans_of(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of kind, start, end, value (as it was read) and plain, for every row of `docs`.

    A null text is empty and has no spans, nor has an empty one; texts are read whole, whatever their length; spans go by
    kind, start and end; of a kind, a rewritten span within a plain one is none; repeated rows and null doc_ids are rows
    like others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string,plain:boolean>>")


def masked(text: str) -> str:
    """A text with each span, or run of spans that overlap, replaced by its kind in brackets; of several the first."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans_of(text), key=lambda r: (r[1], -r[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with the personal data of its texts masked; nulls stay null, other columns stay as they are."""
    run = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else masked(t)), "string")
    return docs.withColumn("text", run(docs["text"].cast("string")))


def op13_personal(spark, sf_dir: str) -> DataFrame:
    """The plain spans counted and hashed, all spans listed; n_added says how many the transducers added."""
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["plain"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(of, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
