"""Personal data in texts, with offset-preserving deobfuscation.

The base detectors read the text as it is. Transducers then rewrite disguises, one after the other: look-alike
and compatibility characters, bracketed at and dot, spelled or spaced at and dot of mail addresses, and numbers
whose digits and dots are spelled, in English, Spanish, French and German. Every character that they put out
keeps the stretch of source characters that it stands for. The same detectors read the rewritten text, and what
they find is mapped back to source offsets (code points) and added, unless a base span lies there that it does not
wholly contain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base detectors. Each takes a whole run of its leading class and
# keeps no choice to come back to, so a text is read once; runs that turn out incomplete are dropped
# below (no match can start inside one).
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_AFTER_AT = re.compile(r"[A-Za-z0-9._%+@-]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, read only around each @: a match never leaves its run of address characters."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = _AFTER_AT.match(text, at + 1).end()
        out += [m.span() for m in _EMAIL.finditer(text, start, done) if "@" in m.group()]
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: leftmost and non-overlapping within a kind, dropped where the check fails."""
    ips = [m.span() for m in _IP.finditer(text) if m.group().count(".") == 3 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


# What disguises stand for.
_DIGIT_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_PLUS_NAMES, _DOT_NAMES = ("plus", "más", "mas"), ("dot", "point", "punto", "punkt")
#: Words for @ that mean nothing else, and the one that does.
_AT_NAMES, _BARE_AT = ("arroba", "arobase", "arrobase", "klammeraffe"), ("at",)
#: Words before a dot that are no host's name, and top domains of more than two letters that a bare "at" may lead to.
_NO_HOST = frozenset("a an the this that these those my your his her its our their one some any each every el la los las un una le les der die das ein eine".split())
_TOP = frozenset("com org net edu gov mil int info biz name pro app dev xyz online site shop blog cloud museum coop aero jobs mobi travel example test".split())
#: Letters of other scripts that look like Latin ones; compatibility forms (full width, mathematical, circled) and digits of all scripts follow by rule.
_LOOKALIKE = {
    "а": "a", "ь": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ց": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "զ": "q", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʏ": "y", "ꓳ": "O", "ꓮ": "A",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "﹒": ".", "﹫": "@",
}

_DOTS, _ATS = "|".join(_DOT_NAMES), "|".join((*_AT_NAMES, *_BARE_AT))
_ODD = re.compile("[^\x00-\x7fÀ-ɏ]")
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*+(?:(?P<at>{_ATS}|@)|{_DOTS}|\.)\s*+[\])}}>]")
_AT = re.compile(rf"(?i)(?<=\s)(?:{_ATS}|@)(?=\s)|@")
_DOT = re.compile(rf"(?i)\.|\s++(?:{_DOTS}|\.)\s++")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_WORD, _WORD_OR_PLUS, _FIGURES = re.compile(r"\w++"), re.compile(r"\w++|\+"), re.compile(r"[0-9]++")
_GAP = re.compile(r"[\s,-]*+")
_SAID = _DIGIT_NAMES | dict.fromkeys(_PLUS_NAMES, "+") | dict.fromkeys(_DOT_NAMES, ".") | {"+": "+"}


class _Gate:
    """If a text has one of the words, or the sign."""

    def __init__(self, words, sign: str | None = None):
        self.words, self.sign = frozenset(words), sign

    def search(self, text: str) -> bool:
        return (self.sign is not None and self.sign in text) or not self.words.isdisjoint(_WORD.findall(text.lower()))


# What each rewritten address, and each rewritten number, has somewhere.
_AT_GATE, _NUMBER_GATE = _Gate((*_AT_NAMES, *_BARE_AT), "@"), _Gate((*_DIGIT_NAMES, *_DOT_NAMES))


class Tape:
    """A text whose characters know which stretch of the source each of them stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts, self.ends = (range(len(text)), range(1, len(text) + 1)) if starts is None else (starts, ends)

    def rewritten(self, changes: list[tuple[int, int, str]]) -> Tape:
        """With each (start, end, what it stands for) put in; of those that overlap the first, and of these the longest, counts."""
        if not changes:
            return self
        out, starts, ends, at = [], [], [], 0
        for s, e, x in sorted(changes, key=lambda c: (c[0], -c[1])):
            if s < at:
                continue
            out += [self.text[at:s], x]
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            starts += [self.starts[s]] * len(x)
            ends += [self.ends[e - 1]] * len(x)
            at = e
        out.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Tape("".join(out), starts, ends)


@cache
def folded(char: str) -> str:
    """The ASCII that a character looks like or is a compatibility form of, nothing for an invisible one, else itself."""
    if char in _LOOKALIKE:
        return _LOOKALIKE[char]
    if unicodedata.category(char) == "Cf":
        return ""
    digit = unicodedata.decimal(char, None)
    plain = unicodedata.normalize("NFKC", char) if digit is None else str(digit)
    return plain if plain.isascii() else char


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    return [(*m.span(), x) for m in _ODD.finditer(text) if (x := folded(m.group())) != m.group()]


def brackets(text: str) -> list[tuple[int, int, str]]:
    """(at), [dot] and the like, with the white space around them."""
    out = []
    for m in _BRACKETED.finditer(text):
        s, e = m.span()
        while s and text[s - 1].isspace():
            s -= 1
        while e < len(text) and text[e].isspace():
            e += 1
        out.append((s, e, "@" if m["at"] else "."))
    return out


def spelled_numbers(text: str) -> list[tuple[int, int, str]]:
    """Digit names and figures in a row, with spelled dots between them and a plus before them, as one number.

    Of rows with neither a digit name nor a spelled dot nothing changes.
    """
    if not _NUMBER_GATE.search(text):
        return []
    rows, row = [], []
    for m in _WORD_OR_PLUS.finditer(text):
        x = m.group()
        what = _SAID.get(x.lower()) or (x if _FIGURES.fullmatch(x) else None)
        if what is None:
            continue
        if row and (what == "+" or _GAP.match(text, row[-1][1]).end() != m.start()):
            rows.append(row)
            row = []
        row.append((*m.span(), what))
    out = []
    for row in [*rows, row]:
        while row and row[-1][2] in ("+", "."):
            row.pop()
        while row and row[0][2] == ".":
            row.pop(0)
        if not any(text[s:e] != x for s, e, x in row):
            continue
        for k, (s, e, x) in enumerate(row):
            out.append((s, row[k + 1][0] if k + 1 < len(row) else e, x))
    return out


def _host(text: str, at: int, bare: bool) -> tuple[int, list[tuple[int, int]]]:
    """End of the host that starts at `at`, and its spelled or spaced dots; 0 if there is none.

    After a bare "at" the last label has to be a top domain: two letters or one of _TOP.
    """
    label = _LABEL.match(text, at)
    end, dots, found = 0, [], []
    if not label or (bare and label.group().lower() in _NO_HOST):
        return 0, []
    while dot := _DOT.match(text, label.end()):
        following = _LABEL.match(text, dot.end())
        if not following:
            break
        found = [*found, dot.span()] if dot.group() != "." else found
        name, spaced = following.group().lower(), dot.group() != "." and dot.group().strip() == "."
        if name in _TOP or (len(name) == 2 and name.isalpha() and not spaced) or (not bare and len(name) > 1):
            end, dots = following.end(), found
        label = following
    return end, dots


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Spelled or spaced at and dot between the parts of a mail address."""
    if not _AT_GATE.search(text):
        return []
    out = []
    for m in _AT.finditer(text):
        s, e = m.span()
        while s and text[s - 1].isspace():
            s -= 1
        while e < len(text) and text[e].isspace():
            e += 1
        if not s or text[s - 1] not in _LOCAL:
            continue
        end, dots = _host(text, e, m.group().lower() in _BARE_AT)
        if not end:
            continue
        if (s, e) != m.span() or m.group() != "@":
            out.append((s, e, "@"))
        out += [(*d, ".") for d in dots]
        while True:  # spelled dots before the at
            a = s
            while a and text[a - 1] in _LOCAL:
                a -= 1
            b = a
            while b and text[b - 1].isspace():
                b -= 1
            c = b
            while c and text[c - 1].isalpha():
                c -= 1
            if b == a or text[c:b].lower() not in _DOT_NAMES:
                break
            s = c
            while s and text[s - 1].isspace():
                s -= 1
            if s == c or not s or text[s - 1] not in _LOCAL:
                break
            out.append((s, a, "."))
    return out


def transduce(text: str) -> Tape | None:
    """The text through one transducer after the other; None if nothing is disguised."""
    plain = tape = Tape(text)
    for step in (look_alikes, brackets, addresses, spelled_numbers):
        tape = tape.rewritten(step(tape.text))
    return None if tape is plain else tape


def _torn(text: str, start: int, end: int) -> bool:
    """If a letter or digit that an address cannot have stands right beside it."""
    return (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans, by kind; null is an empty text."""
    text = text or ""
    base = base_spans(text)
    more = {k: [] for k in KINDS}
    got = transduce(text)
    if got:
        taken = [(*x, k) for k in KINDS for x in base[k]]
        for k, spans in base_spans(got.text).items():
            for s, e in spans:
                a, b = got.starts[s], got.ends[e - 1]
                if text[a:b] == got.text[s:e] or (k == "email" and _torn(got.text, s, e)):
                    continue
                if all(b <= x or y <= a or (k == kind and a <= x and y <= b) for x, y, kind in taken):
                    more[k].append((a, b))
    return base, more


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, base and added spans as strings `kind:start:end,...`, counts of base spans.

    Offsets are code points, ends exclusive. Null and empty texts have none; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(len(KINDS) + 3)]
            for t in b.column(1).to_pylist():
                base, more = find(t)
                for c, k in zip(cols, KINDS, strict=False):
                    c.append(len(base[k]))
                cols[-3].append(written(base))
                cols[-2].append(written({k: base[k] + more[k] for k in KINDS}))
                cols[-1].append(sum(map(len, more.values())))
            types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    kind = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, f"doc_id {kind}, {counts}, base string, spans string, n_added long")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def redacted(text: str | None) -> str | None:
    """text with each stretch of personal data replaced by <KIND>; overlapping spans become one."""
    if not text:
        return text
    base, more = find(text)
    spans = sorted((s, e, k) for k in KINDS for s, e in base[k] + more[k])
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the text redacted, and its length column (if there is one) brought up to date; null texts stay null."""
    cols = docs.columns
    place, kind = cols.index(text_col), docs.schema[text_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redacted(t) for t in b.column(place).to_pylist()], pa.string())
            yield b.set_column(place, b.schema.field(place).name, texts)

    out = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in cols])
    out = out.mapInArrow(scan, out.schema)
    if length_col in cols:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.col(text_col).cast(kind))
