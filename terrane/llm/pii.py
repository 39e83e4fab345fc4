"""Personal data found in texts as written and as disguised, with spans in the source's code points.

A tape holds a text and, for each of its characters, the source characters that it stands for. Transducers rewrite tapes: the first
undoes look-alike and invisible characters, the second bracketed or spelled ``at`` and ``dot``, the third spelled digits. Identifiers
are looked for in the source itself (base spans) and on the last tape; what the tape shows is mapped back and added where it overlaps no
base span of its kind.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import batch_of, map_batches

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like Latin ones, each over its double.
_LOOK_ALIKE = "АВЕЅІЈКМНОРСТХҮаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
_LATIN = "ABESIJKMHOPCTXYaesijopcyxdqwABEZHIKMNOPTYXo"
# The words for 0 to 9 in English, German, French and Spanish.
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {w: str(i) for line in _DIGIT_WORDS for i, w in enumerate(line.split())}
# Full stops of East Asian texts, which compatibility forms leave as they are.
_STOPS = "。｡"
# First labels of mail hosts that many people use.
_MAIL_HOSTS = "gmail googlemail yahoo hotmail outlook icloud aol protonmail proton gmx mail yandex live msn"
_DOUBLES = dict(zip(_LOOK_ALIKE, _LATIN, strict=True)) | dict.fromkeys(_STOPS, ".")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_MAX = 64
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_GROUPED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-ɏ]")
_AT = r"(?:at|arroba|arobase)"
_DOT = r"(?:dot|punkt|point|punto)"
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:{_AT}|@|{_DOT}|\.)\s?[\])}}>]", re.I)
_SPELLED = re.compile(rf"\s{_DOT}\s", re.I)
_SIGNS = re.compile(
    rf"\s?[\[({{<]\s?(?:(?P<at>{_AT}|@)|(?:{_DOT}|\.))\s?[\])}}>]\s?"
    rf"|(?<=[A-Za-z0-9._%+-])\s(?P<bare>{_AT})\s(?=[A-Za-z0-9-]+(?:\s{_DOT}\s|\s?[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s?)[A-Za-z0-9-])"
    rf"|(?<=[A-Za-z0-9])\s{_DOT}\s(?=[A-Za-z0-9])",
    re.I,
)
# A bare "at" before a plain domain; it counts if the host is a mail host or what stands before looks like no word of prose.
_HALF = re.compile(r" (?:at|arroba|arobase) (?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
_HOST = re.compile(rf"(?:{'|'.join(_MAIL_HOSTS.split())})\.", re.I)
# Single characters with a blank between each two; a local part has 64 at most.
_SPACED = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+-] ){1,64}@(?: [A-Za-z0-9-]){1,63}(?: \.(?: [A-Za-z0-9-]){1,63}){1,8}(?!\S)")
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?:\bplus[ ,-]{{1,2}}|\+[0-9]{{1,3}}[ ,-]{{1,2}})?(?<!\w)(?:{_WORD})(?:(?:[ ,-]{{1,2}}|(?P<dot>\.))(?:{_WORD}|[0-9]+)(?!\w))+", re.I)
_TOKEN = re.compile(rf"(?P<plus>plus|\+)|(?P<word>{_WORD})|(?P<digits>[0-9]+)|(?P<dot>\.)", re.I)
#: Fewer spelled digits in a row than this are left as words; after a plus the second number will do, if there are digits for a phone.
SPOKEN_MIN, SPOKEN_AFTER_PLUS, PHONE_MIN = 4, 2, 8


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ is the only one that a match can hold: its local part is the run before it, as far as the last match ended."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Fours of the numbers in each dotted chain."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15] if "+" in text else []


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Tape:
    """A text whose character i stands for the source's code points first[i] to last[i], the end excluded."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None):
        self.text = text
        self.first = np.arange(len(text)) if first is None else first
        self.last = np.arange(1, len(text) + 1) if last is None else last

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Tape:
        """Replaces matches; ``to`` gives the new strings, each with the part of the tape that it stands for, or None to leave it."""
        texts, first, last, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (new := to(m)) is None:
                continue
            texts.append(self.text[at : m.start()])
            first.append(self.first[at : m.start()])
            last.append(self.last[at : m.start()])
            for s, a, b in new:
                texts.append(s)
                first.append(np.full(len(s), self.first[a]))
                last.append(np.full(len(s), self.last[b - 1]))
            at = m.end()
        if not at:
            return self
        return Tape("".join([*texts, self.text[at:]]), np.concatenate([*first, self.first[at:]]), np.concatenate([*last, self.last[at:]]))


def _plain(m: re.Match) -> list[tuple[str, int, int]] | None:
    c = m.group()
    if unicodedata.category(c) in ("Cf", "Mn"):
        return []
    if (digit := unicodedata.decimal(c, None)) is not None:
        return [(str(digit), *m.span())]
    plain = _DOUBLES.get(c) or unicodedata.normalize("NFKC", c)
    return [(plain, *m.span())] if plain.isascii() else None


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    return [("@" if m["at"] or m["bare"] else ".", *m.span())]


def _half(m: re.Match) -> list[tuple[str, int, int]] | None:
    start = end = m.start()
    while start and end - start < _LOCAL_MAX and m.string[start - 1] in _LOCAL:
        start -= 1
    local = m.string[start:end].strip(".")
    return [("@", *m.span())] if local and (_HOST.match(m.string, m.end()) or "." in local or "_" in local) else None


def _close(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group()) if c != " "]


def _spoken(m: re.Match) -> list[tuple[str, int, int]] | None:
    out, words = [], 0
    for t in _TOKEN.finditer(m.group()):
        words += t["word"] is not None
        s = "+" if t["plus"] else "." if t["dot"] else t["digits"] or DIGITS[t.group().lower()]
        out.append((s, m.start() + t.start(), m.start() + t.end()))
    phone = out[0][0] == "+" and sum(len(s) for s, _, _ in out[1:]) >= PHONE_MIN
    return out if words >= (SPOKEN_AFTER_PLUS if phone else SPOKEN_MIN) else None


def normalised(text: str) -> Tape | None:
    """The tape after all transducers; None if nothing in the text calls for one."""
    tape = Tape(text)
    if not text.isascii() and _ODD.search(text):
        tape = tape.rewrite(_ODD, _plain)
    if _BRACKETED.search(tape.text) or _SPELLED.search(tape.text):
        tape = tape.rewrite(_SIGNS, _sign)
    tape = tape.rewrite(_HALF, _half)
    if " @ " in tape.text:
        tape = tape.rewrite(_SPACED, _close)
    words = tape.text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if sum(map(DIGITS.__contains__, words)) >= (SPOKEN_AFTER_PLUS if "+" in tape.text or "plus" in words else SPOKEN_MIN):
        tape = tape.rewrite(_SPOKEN, _spoken)
    return None if tape.text is text else tape


Span = tuple[str, int, int]


def find_in(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind and start."""
    base = [(kind, *span) for kind, find in _FINDERS.items() for span in find(text)]
    tape = normalised(text)
    if tape is None:
        return base, base
    added = set()
    for kind, find in _FINDERS.items():
        own = [(s, e) for k, s, e in base if k == kind]
        for s, e in find(tape.text):
            a, b = int(tape.first[s]), int(tape.last[e - 1])
            before = bisect_left(own, (b,))  # those that start before b; the last of them ends last
            if not before or own[before - 1][1] <= a:
                added.add((kind, a, b))
    if not added:
        return base, base
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base_spans and spans, arrays of (kind, start, end) in code points, the end excluded.

    Null and empty texts have none. Repeated rows each give a row, null ids stay null, other columns of ``docs`` are not read. Of
    overlapping spans of several kinds each is given; those of one kind don't overlap, but that a disguised one may touch another.
    """
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))

    def kernel():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [find_in(x.as_py() or "") for x in batch.column(1)]
            both = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row[i]] for row in found], _SPANS) for i in (0, 1)]
            return batch_of(pa.schema([batch.schema.field(0), ("base_spans", _SPANS), ("spans", _SPANS)]), [batch.column(0), *both])

        return run

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(picked, kernel, f"doc_id {dict(picked.dtypes)['doc_id']}, base_spans {spans}, spans {spans}")


def joined(spans: str):
    """kind:start:end of the spans in a column, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    """The number of spans of a kind in a column."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
