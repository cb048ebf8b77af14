"""Personal data in texts, also where it is disguised, with spans in the source's own code points.

Detectors find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. They run over the
text as it is (base spans), and over a normalised tape that transducers make from it, one after the other:

1. look-alike characters become the ASCII ones they imitate (full-width and styled forms by compatibility folding, digits of
   other scripts, Cyrillic and Greek letters of Latin shape), invisible characters go;
2. written dots and bracketed at-signs become `.` and `@`;
3. a bare "at" becomes `@` if a host name follows whose dots were written out, or the word before looks like a mailbox;
4. runs of three or more spelled digits (English, German, French, Spanish; "double" and "triple", "plus") become digits.

Each transducer keeps which source characters a piece of its output came from, so spans found on the tape are mapped back
through all of them. A span from the tape that no base span of its kind contains is added; base spans always stay.

Null and empty texts have no spans. Very long texts are searched whole; all detectors take time in proportion to the length,
also on long runs without a match. Ties: spans are ordered by kind (email, ip, card, phone), then start, then end. Repeated
rows give equal rows; an empty table none. Ids may have any type; other columns are not looked at by spans() and digests(),
redacted() keeps them all."""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, named, steps

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, spelled digits, written signs.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝвкмнтАВСЕНІЈКМОРЅТХУαικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdqwbkmhtABCEHIJKMOPSTXYaiknopuxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­͏؜᠎​‌‍⁠⁡⁢⁣⁤﻿"
DIGITS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
TIMES = {"double": 2, "triple": 3}
AT, DOT = "at|arroba|arobase", "dot|punto|point|punkt"

SPELLED = {word: str(d) for d, words_ in enumerate(DIGITS) for word in words_}
_ANY = "|".join(sorted(SPELLED, key=len, reverse=True))
_WORD = rf"(?:(?:double|triple) )?(?:{_ANY})(?![^\W_])"
FEW = re.compile(rf"(?:{_ANY})[ .,-]")
RUN = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9]{{1,19}})(?:[ .,-]{{1,3}}(?:{_WORD}|[0-9]{{1,19}}(?![^\W_])))+")
TOKEN = re.compile(rf"(double |triple )?({_ANY})(?![^\W_])|[0-9]+|\.|[ ,-]+")
PLUS = re.compile(r"(?<![^\W_])plus (?=[0-9])")
BRACKETED = re.compile(rf"[(\[{{<]\s{{0,3}}(?:{AT}|@|{DOT}|\.)\s{{0,3}}[)\]}}>]")
WRITTEN = re.compile(rf"\s{{0,3}}[(\[{{<]\s{{0,3}}(?:({AT}|@)|{DOT}|\.)\s{{0,3}}[)\]}}>]\s{{0,3}}|(?<=[a-z0-9])\s{{1,3}}(?:{DOT})\s{{1,3}}(?=[a-z0-9])")
BARE = re.compile(rf"(?<=[a-z0-9_%+-])\s{{1,3}}(?:{AT}|@)\s{{1,3}}(?=[a-z0-9-]+(?:\.[a-z0-9-]+)+)")
LOOSE = re.compile(rf" (?:{AT}|@) [a-z0-9-]+\.[a-z0-9-]")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}(?![a-z0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    disguised: bool = False


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of mailbox@host.host: for each at-sign, the characters before it that a mailbox may have."""
    done = last = 0
    at = text.find("@")
    while at >= 0:
        first = max(done, last)
        before = text[first:at]
        other = len(before.rstrip(LOCAL))
        if other < len(before) and (host := DOMAIN.match(text, at + 1)):
            yield first + other, host.end()
            done = host.end()
        last = at + 1
        at = text.find("@", last)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, each at most 255."""
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(number: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in number[-2::-2]]
    return (sum(number[-1::-2]) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(number := digits(m[0])) <= 19 and luhn(number):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")  # most texts have none
    while at >= 0:
        if m := PHONE.match(text, at):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.span()
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


class Tape:
    """A text made from another by replacing pieces; knows where each of its characters comes from."""

    def __init__(self, source: str, pieces: list[tuple[int, int, str]], below: Tape | None = None):
        """pieces: (start, end, new text) in the source, in order, without overlap."""
        out, self.begins, self.origin, self.below = [], [], [], below
        at = size = 0
        for start, end, new in [*pieces, (len(source), len(source), "")]:
            for a, b, text, same in ((at, start, source[at:start], True), (start, end, new, False)):
                if text:
                    self.begins.append(size)
                    self.origin.append((a, b, same))
                    out.append(text)
                    size += len(text)
            at = end
        self.text = "".join(out)

    def changed(self, start: int, end: int) -> bool:
        """Whether a replaced piece is part of the span of the tape."""
        first, last = bisect.bisect_right(self.begins, start) - 1, bisect.bisect_left(self.begins, end)
        return any(not same for _, _, same in self.origin[first:last])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span, through all tapes below, of a span of the tape that isn't empty."""
        i, j = bisect.bisect_right(self.begins, start) - 1, bisect.bisect_right(self.begins, end - 1) - 1
        (a, _, same), (b, c, also) = self.origin[i], self.origin[j]
        span = a + start - self.begins[i] if same else a, b + end - self.begins[j] if also else c
        return self.below.source(*span) if self.below else span


@functools.cache
def glyphs() -> dict[str, str]:
    """What look-alike and invisible characters stand for."""
    table = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    for first, last in ((0x660, 0xE60), (0x1E00, 0x2200), (0x2460, 0x2500), (0xFE50, 0xFFF0), (0x1D400, 0x1D800)):
        for c in map(chr, range(first, last)):
            plain = unicodedata.normalize("NFKC", c)
            plain = str(d) if (d := unicodedata.decimal(c, None)) is not None else plain
            if c != plain and len(plain) == 1 and "\x20" < plain < "\x7f":
                table[c] = plain
    return table


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def replaced(tape: Tape | None, text: str, pattern: re.Pattern, new: Callable[[re.Match], str | None], low: str | None = None) -> Tape | None:
    """The tape after one transducer; the tape itself if nothing is replaced. A match whose new text is None stays."""
    pieces = [(*m.span(), x) for m in pattern.finditer(text if low is None else low) if (x := new(m)) is not None]
    return Tape(text, pieces, tape) if pieces else tape


def spelled_pieces(low: str) -> list[tuple[int, int, str]]:
    """Replacements of runs with three or more spelled digits: digits join, dots stay, other separators between them go."""
    pieces = []
    for run in RUN.finditer(low):
        tokens = list(TOKEN.finditer(low, run.start(), run.end()))
        if sum(TIMES.get((t[1] or "").strip(), 1) for t in tokens if t[2]) >= 3:
            for k, t in enumerate(tokens):
                if t[2]:
                    pieces.append((*t.span(), SPELLED[t[2]] * TIMES.get((t[1] or "").strip(), 1)))
                elif t[0][0] in " ,-" and k and (tokens[k - 1][2] or tokens[k + 1][2]) or t[0][0] in " ,-" and "." in (tokens[k - 1][0], tokens[k + 1][0]):
                    pieces.append((*t.span(), ""))
    return pieces


def normalised(text: str) -> Tape | None:
    """The tape of all transducers, or None for a text without any sign of a disguise."""
    tape = None
    if not text.isascii():
        table = glyphs()
        if found := table.keys() & set(text):
            tape = Tape(text, [(i, i + 1, table[c]) for i, c in enumerate(text) if c in found])
    now = tape.text if tape else text
    low = lowered(now)
    if BRACKETED.search(low) or any(f" {w} " in low for w in DOT.split("|")):
        tape = replaced(tape, now, WRITTEN, lambda m: "@" if m[1] else ".", low)
        now = tape.text if tape else text
        low = lowered(now)
    if LOOSE.search(low):
        written = tape

        def sign(m: re.Match) -> str | None:
            host = DOMAIN.match(low, m.end())
            before = low[max(0, m.start() - 64) : m.start()]
            mailbox = before[len(before.rstrip(LOCAL)) :]
            told = written is not None and written.text == now and written.changed(m.end(), host.end())
            odd = any(c in "0123456789._%+-" for c in mailbox) and any(c.isalpha() for c in mailbox)
            return "@" if told or (odd or m[0].strip() == "@") and HOST.fullmatch(host[0]) else None

        tape = replaced(tape, now, BARE, sign, low)
        now = tape.text if tape else text
        low = lowered(now)
    if FEW.search(low) and (pieces := spelled_pieces(low)):
        tape = Tape(now, pieces, tape)
        now = tape.text
        low = lowered(now)
    if "plus " in low:
        tape = replaced(tape, now, PLUS, lambda m: "+", low)
    return tape


def base(text: str) -> list[Span]:
    return [Span(kind, a, b) for kind in KINDS for a, b in DETECTORS[kind](text)]


def find(text: str | None) -> list[Span]:
    """All spans of a text, base ones and those behind a disguise, by kind, start and end."""
    if not text:
        return []
    plain = base(text)
    if (tape := normalised(text)) is None:
        return plain
    more = set()
    for kind in KINDS:
        own = [s for s in plain if s.kind == kind]
        starts = [s.start for s in own]
        for a, b in (tape.source(*span) for span in DETECTORS[kind](tape.text)):
            k = bisect.bisect_right(starts, a) - 1
            if k < 0 or own[k].end < b:
                more.add(Span(kind, a, b, True))
    return sorted([*plain, *more], key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def per_text(documents: DataFrame, make: Callable[[str | None], tuple], fields: list[T.StructField]) -> DataFrame:
    """doc_id and what make() gives for each text."""
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in steps(batches):
            made = list(zip(*map(make, batch.column("text").to_pylist())))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {f.name: pa.array(v, k) for f, v, k in zip(fields, made, kinds)})

    return map_arrow(documents.select("doc_id", "text"), run, schema)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType()), T.StructField("value", T.StringType())])


def spans(documents: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end (exclusive), disguised, value (the source's characters)."""
    each = per_text(documents, lambda t: ([s._asdict() | {"value": t[s.start : s.end]} for s in find(t)],), [T.StructField("spans", T.ArrayType(SPAN))])
    return each.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")


def redact(text: str | None) -> str | None:
    """The text with a placeholder for each run of overlapping spans, after the kind of the first."""
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return text if text is None else "".join(out) + text[at:]


def redacted(documents: DataFrame) -> DataFrame:
    """documents with redacted texts; all columns stay."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    where = documents.columns.index("text")
    plain = documents.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, f"c{where}"):
            text = pa.array([redact(t) for t in batch.column(where).to_pylist()], batch.schema.field(where).type)
            yield batch.set_column(where, batch.schema.field(where), text)

    return map_arrow(plain, run, plain.schema).toDF(*documents.columns).select(*[named(c) for c in documents.columns])


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_disguised."""

    def make(text: str | None) -> tuple:
        found = find(text)
        plain = [s for s in found if not s.disguised]
        return (*[sum(s.kind == k for s in plain) for k in KINDS], hashlib.sha256(told(plain).encode()).hexdigest(), told(found), len(found) - len(plain))

    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    return per_text(documents, make, [*counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_disguised", T.LongType())])
