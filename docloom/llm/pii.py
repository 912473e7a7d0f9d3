"""Personal data in whole texts, with offset-preserving deobfuscation.

Base patterns run on the text as it is. Two transducers then rewrite disguises and keep, for each rewritten stretch, where it
came from: the first maps homoglyphs, compatibility forms and zero-width characters to ASCII; the second maps spelled digits,
letters that stand for digits, and at/dot disguises. Base patterns on the outcome give further spans, mapped back to the
source's characters; only those that touch a rewritten stretch count, so plain texts get base spans alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import spread, table

KINDS = ("email", "ip", "card", "phone")
# An address is looked for at each @: what may come before it is the run of such characters, so no run is read twice.
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match that can't start at a number's first digit can't start at another of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters, and the ASCII letters they look like.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТХІЈЅԚԜУасеорхуіјѕԛԝһӏԁ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρτυικ" "ıɑɡɩʟ",
    "ABEKMHOPCTXIJSQWYaceopxyijsqwhld" "ABEZHIKMNOPTYXovptuik" "iagil",
))
# Dashes, dots, at signs and blanks that stand for ASCII ones; characters without a width.
LOOKALIKES |= dict.fromkeys("‐‑‒–—―−﹣－", "-") | dict.fromkeys("․。｡．﹒·•∙⋅", ".") | dict.fromkeys("＠﹫", "@") | dict.fromkeys("       　", " ")
LOOKALIKES |= dict.fromkeys("​‌‍⁠﻿­᠎‎‏‪‫‬‭‮", "")

# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT, _DOT = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto|period"
_NAME = r"[A-Za-z0-9_%+-]+"
# Blanks and brackets that stand together are counted up to a bound, wider gaps end a disguise: so long runs are read once. Parts of an
# address are as many as one may have: 64 characters before the at sign, 253 after it.
_GAP = r"[ \t]{0,3}[,;._/()-]{0,2}[ \t]{0,3}"
#: Digits, most of them spelled, one after another; a dot word or a full stop between them stays as a full stop.
SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus\b|\+)[ \t]{{0,3}})?(?:{_WORDS})(?:{_GAP}(?:(?:{_WORDS})(?!\w)|(?:{_DOT})(?!\w)|[0-9]+))+|(?:(?i:(?<!\w)(?:plus\b|\+)[ \t]{{0,3}})|(?<![0-9]))[0-9]++(?:{_GAP}(?i:(?:{_WORDS})(?!\w)|(?:{_DOT})(?!\w)|[0-9]++(?!\w)))+")
_SPELLED_TOKEN = re.compile(rf"(?i)(plus)\b|({_WORDS})(?!\w)|({_DOT})(?!\w)|([0-9]+)|(\+)|(\.)")
_HAS_WORDS = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w){_GAP}(?:(?:{_WORDS}|{_DOT})(?!\w)|[0-9])")
#: Letters that stand for digits within a number.
LEET = re.compile(r"(?<![\w@.%-])\+?[0-9OolIB](?:[ .()-]{0,2}[0-9OolIBS]){6,}(?![\w@])")
_LEET = str.maketrans("OolIBS", "001185")
_RUN, _LETTER_FOR_DIGIT = re.compile("[0-9A-Za-z]+"), re.compile("[OolIBS]")
BRACKETED_AT = re.compile(rf"(?i)[ \t]{{0,3}}(?:[\[({{<]{{1,3}}[ \t]{{0,3}}(?:{_AT}|@)[ \t]{{0,3}}[\])}}>]{{1,3}}|[_*|]{{1,3}}(?:{_AT})[_*|]{{1,3}}|-at-)[ \t]{{0,3}}|[ \t]{{1,3}}@[ \t]{{0,3}}|[ \t]{{0,3}}@[ \t]{{1,3}}")
BRACKETED_DOT = re.compile(rf"(?i)[ \t]{{0,3}}(?:[\[({{<]{{1,3}}[ \t]{{0,3}}(?:{_DOT}|\.)[ \t]{{0,3}}[\])}}>]{{1,3}}|[_*|]{{1,3}}(?:{_DOT})[_*|]{{1,3}}|-dot-)[ \t]{{0,3}}")
_ADDRESS = re.compile(
    rf"(?i)(?<![\w.%+-])(?P<local>{_NAME}(?:(?:\.|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}){_NAME}){{0,31}})(?P<at>@|[ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}})"
    rf"(?P<host>[A-Za-z0-9-]+(?:(?:\.|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}})[A-Za-z0-9-]+){{1,126}})(?![\w-])"
)
_DOT_WORD = re.compile(rf"(?i)[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}")
#: What marks a word as the local part of an address.
_NAMED = re.compile(r"[A-Za-z][._+-][A-Za-z0-9]|[0-9]")
_PLAIN_HOST = re.compile(rf"(?i)[ \t](?:{_AT})[ \t]{{1,3}}[A-Za-z0-9-]+\.[A-Za-z]")
_NUMBER_DOT = re.compile(rf"(?i)[ \t]{{1,3}}(?:{_DOT}|\.)[ \t]{{1,3}}")
_DOTTED_NUMBERS = re.compile(rf"(?i)(?<!\w)[0-9]{{1,3}}(?:[ \t]{{1,3}}(?:{_DOT}|\.)[ \t]{{1,3}}[0-9]{{1,3}}){{3}}(?!\w)")
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile("[0-9]")
_MARKED = re.compile(rf"(?i)[\[({{<_*|-][ \t]{{0,3}}(?:{_AT}|{_DOT}|@|\.)[ \t]{{0,3}}[\])}}>_*|-]")
_AT_SET, _DOT_SET = frozenset(_AT.split("|")), frozenset(_DOT.split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right, in time linear in the text."""
    least, at = 0, text.find("@")
    while at >= 0:
        host = EMAIL_HOST.match(text, at + 1)
        start = least + len(text[least:at].rstrip(EMAIL_LOCAL)) if host else at
        if start < at:
            yield start, host.end()
            least = host.end()
        else:
            least = at + 1
        at = text.find("@", least)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind, end) order is the caller's; here (start, end, kind) of what the base patterns find."""
    out = []
    out += [(s, e, "email") for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


class Rewritten:
    """A text after edits (start, end, replacement), with the way back to the source's offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts, self.starts, self.marks, at, size = [], [], [], 0, 0
        for s, e, new in edits:
            if s > at:
                self.starts.append(size), self.marks.append((at, s, False))
                parts.append(text[at:s])
                size += s - at
            self.starts.append(size), self.marks.append((s, e, True))
            parts.append(new)
            size += len(new)
            at = e
        self.starts.append(size), self.marks.append((at, len(text), False))
        parts.append(text[at:])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source offsets of ``start:end``, and whether a rewritten stretch lies in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (s, e, new), (s2, e2, new2) = self.marks[i], self.marks[j]
        return s if new else s + start - self.starts[i], e2 if new2 else s2 + end - self.starts[j], any(m[2] for m in self.marks[i : j + 1])


def _ascii_of() -> dict[str, str]:
    """Non-ASCII characters whose compatibility form is one printable ASCII character, decimal digits of all scripts, look-alikes."""
    out = {}
    for cp in [*range(0xA1, 0x3400), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD)]:
        c = chr(cp)
        n = unicodedata.normalize("NFKC", c)
        d = unicodedata.decimal(c, None)
        if d is not None:
            out[c] = str(int(d))
        elif len(n) == 1 and " " < n < "\x7f" and n != c:
            out[c] = n
    return out | LOOKALIKES


_TABLE: dict[str, str] = {}
_CLASS: list[re.Pattern] = []


def glyphs(text: str) -> Rewritten | None:
    """The first transducer; None where it changes nothing. Words that no rewriting makes ASCII stay as they are."""
    if text.isascii():
        return None
    if not _CLASS:
        _TABLE.update(_ascii_of())
        _CLASS.append(re.compile("[" + "".join(map(re.escape, sorted(_TABLE))) + "]"))
    if _TABLE.keys().isdisjoint(set(text)):
        return None
    return Rewritten(text, [(m.start(), m.end(), _TABLE[m.group()]) for m in _CLASS[0].finditer(text)])


def _spelled(s: str) -> str | None:
    out, seen, n_words = [], set(), 0
    for m in _SPELLED_TOKEN.finditer(s):
        plus, word, dot, number, sign, stop = m.groups()
        if word:
            out.append(DIGIT_WORDS[word.lower()])
            seen.add(out[-1])
            n_words += 1
        elif number:
            out.append(number)
        elif plus or sign:
            out.append("+")
        elif dot or stop:
            out.append(".")
    return "".join(out) if n_words >= 3 and len(seen) >= 2 else None  # a word said again and again is no number


def disguises(text: str) -> tuple[Rewritten | None, list[tuple[int, int]]]:
    """The second transducer, and the stretches it made of ten digits or more without a plus sign: spelled phone numbers."""
    edits, numbers = [], []
    said = set(_LETTERS.findall(text.lower()))
    has_digit = _DIGIT.search(text) is not None
    if len({DIGIT_WORDS[w] for w in said & DIGIT_WORDS.keys()}) >= 2 and _HAS_WORDS.search(text):
        for m in SPELLED.finditer(text):
            new = _spelled(m.group())
            if new is not None:
                end = m.end()
                while new.endswith("."):
                    new = new[:-1]
                edits.append((m.start(), end, new))
    for m in LEET.finditer(text) if has_digit else ():
        if sum("0" <= c <= "9" for c in m.group()) >= 6:
            for run in _RUN.finditer(m.group()):  # letters stand for digits only beside digits
                if _DIGIT.search(run.group()):
                    at = m.start() + run.start()
                    edits += [(at + x.start(), at + x.end(), x.group().translate(_LEET)) for x in _LETTER_FOR_DIGIT.finditer(run.group())]
    if said & _DOT_SET or " @" in text or "@ " in text or has_digit and " . " in text or _MARKED.search(text) or said & _AT_SET and _PLAIN_HOST.search(text):
        marks = [(m.start(), m.end(), "@") for m in BRACKETED_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in BRACKETED_DOT.finditer(text)]
        taken = _disjoint(marks)
        step = Rewritten(text, taken)
        taken_starts, taken_ends = [t[0] for t in taken], [t[1] for t in taken]
        for m in _ADDRESS.finditer(step.text):
            own = []
            if "@" not in m.group("at") and not _DOT_WORD.search(m.group("host")) and m.group("at").strip() != "AT" and not _NAMED.search(m.group("local")):
                continue  # "look at example.com" may be plain prose
            for a, b in [m.span("at"), *[(m.start(g) + x.start(), m.start(g) + x.end()) for g in ("local", "host") for x in _DOT_WORD.finditer(m.group(g))]]:
                s, e, _ = step.source(a, b)
                own.append((s, e, "@" if (a, b) == m.span("at") else "."))
            s, e, changed = step.source(m.start(), m.end())
            own += taken[bisect_left(taken_starts, s) : bisect_right(taken_ends, e)]
            edits += [t for t in own if text[t[0] : t[1]] != t[2]]
        edits += [(m.start() + x.start(), m.start() + x.end(), ".") for m in _DOTTED_NUMBERS.finditer(text) for x in _NUMBER_DOT.finditer(m.group())]
        # Full stops in brackets between numbers: addresses such as 10[.]0[.]0[.]1.
        edits += [t for t in taken if t[2] == "." and t[0] > 0 and text[t[0] - 1].isdigit() and text[t[1] : t[1] + 1].isdigit()]
    edits = _disjoint(edits)
    if not edits:
        return None, numbers
    out = Rewritten(text, edits)
    for (s, e, new), at in zip(out.marks, out.starts):
        if new:
            k = bisect_right(out.starts, at)
            end = out.starts[k] if k < len(out.starts) else len(out.text)
            made = out.text[at:end]
            if 10 <= len(made) <= 15 and made.isdigit() and re.search(r"[A-Za-z]{2}", text[s:e]):
                numbers.append((at, end))
    return out, numbers


def _disjoint(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits from left to right, the longest first, without those that overlap one before."""
    out, end = [], -1
    for s, e, new in sorted(set(edits), key=lambda x: (x[0], -x[1])):
        if s >= end and e > s:
            out.append((s, e, new))
            end = e
    return out


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of disguised identifiers, in the source's offsets, beside the base ones."""
    first = glyphs(text)
    step = first.text if first else text
    second, numbers = disguises(step)
    if first is None and second is None:
        return []
    found = base_spans(second.text if second else step)
    covered = Covered(found)
    found += [(s, e, "phone") for s, e in numbers if not covered.meets(s, e)]
    own = {k: [(s, e) for s, e, kind in base if kind == k] for k in KINDS}
    starts, ends = {k: [s for s, _ in x] for k, x in own.items()}, {k: [e for _, e in x] for k, x in own.items()}
    out = []
    for s, e, kind in found:
        changed = False
        if second:
            s, e, changed = second.source(s, e)
        if first:
            s, e, also = first.source(s, e)
            changed = changed or also
        # Base spans of a kind are disjoint: of those that meet this one, all but the first and the last lie within it.
        met = own[kind][bisect_right(ends[kind], s) : bisect_left(starts[kind], e)]
        if changed and all(s <= a and b <= e and (s, e) != (a, b) for a, b in (*met[:1], *met[-1:])):
            out.append((s, e, kind))
    return out


class Covered:
    """Whether a stretch meets one of some spans: by the largest end of all spans that begin before its end."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        spans = sorted(spans)
        self.starts, self.ends = [s for s, *_ in spans], list(accumulate((e for _, e, _ in spans), max))

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def spans_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans (start, end, kind) of a whole text, each by start, then kind; none for null and empty."""
    if not text:
        return [], []
    base = base_spans(text)
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=order), sorted(added_spans(text, base), key=order)


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, named by the first."""
    base, more = spans_of(text)
    if not base and not more:
        return text
    merged: list[list] = []
    for s, e, k in sorted([*base, *more], key=lambda x: (x[0], -x[1])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    out, at = [], 0
    for s, e, k in merged:
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: for each row of ``docs(doc_id, text)`` its base spans and all its spans, as arrays of structs.

    Null and empty texts have none; a long text is read whole, in time linear in it; spans of one start and kind are ordered by
    their end; repeated rows stay rows; other columns are ignored; an empty table gives no rows.
    """
    one = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("base", one), T.StructField("spans", one)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        for batch in batches:
            base, both = [], []
            for text in batch.column("text"):
                b, more = spans_of(text.as_py())
                base.append(named(b))
                both.append(named(sorted(b + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, arrow), pa.array(both, arrow)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars``, if there, counted anew.

    Null and empty texts stay as they are; overlapping spans are replaced as one; repeated rows stay rows; long texts are read whole, in
    time linear in them; other columns stay, whatever their names; an empty table gives no rows.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t.as_py()) for t in batch.column("text")]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """Counts are of all spans, base and added; texts without any have empty strings, whose hash is that of no bytes."""
    found = find(spread(table(spark, sf_dir, "documents")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def sha_of(base: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(as_text(base).encode()).hexdigest()
