"""Text functions as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The scripts that documents don't use: CJK, CJK extension A, kana, Arabic, Hangul.
FOREIGN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{0600}-\x{06FF}\x{AC00}-\x{D7AF}]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: within lambdas Spark would compute a repeated expression again each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return trim_ws(text_or_empty(c)) == ""


#: The white space of Unicode.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Trim all Unicode white space, not blanks alone."""
    return F.trim(c, F.lit(WHITE))


#: The blanks among it, which are all that SQL's trim takes: no line breaks, no tabs.
BLANKS = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trim_blanks(c: Column) -> Column:
    """Trim blanks as SQL's trim does; other white space stays."""
    return F.trim(c, F.lit(BLANKS))


def trim_ascii(c: Column) -> Column:
    r"""Trim what SQL's ``\s`` matches: blank, tab, line feed, form feed, carriage return."""
    return F.trim(c, F.lit(" \t\n\f\r"))


def normalise_ws(c: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.regexp_replace(trim_ws(c), r"(?U)\s+", " ")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_line(c: Column) -> Column:
    """The tokens of a text in one string, a blank between two."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", " "))


def hash_prefix(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def message_id(role: Column, content: Column) -> Column:
    """Stable id of a message: 12 hex digits of the hash of role and content."""
    return hash_prefix(F.concat(text_or_empty(role), text_or_empty(content)), 12)


def chunk_id(document_id: Column, index: Column) -> Column:
    return hash_prefix(F.concat(document_id.cast("string"), index.cast("string")), 16)


def new_id() -> Column:
    """A random id of 32 hex digits; hashes are preferred where a rerun must agree."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Character references resolved; texts without ``&`` stay in the JVM."""
    has = F.contains(c, F.lit("&"))
    return F.when(has, _unescaped(F.when(has, c))).otherwise(c)


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def foreign_ratio(c: Column) -> Column:
    """Share of characters in scripts that the documents don't use; 0 for empty."""
    n = F.char_length(text_or_empty(c))
    rest = F.char_length(F.regexp_replace(text_or_empty(c), FOREIGN, ""))
    return F.when(n == 0, 0.0).otherwise((n - rest) / n)


def is_foreign(c: Column, most: float = 0.15) -> Column:
    return foreign_ratio(c) > most


def strip_fence(c: Column) -> Column:
    """Without a Markdown fence around the whole."""
    return trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(c), r"^```[A-Za-z]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""))


def is_svg(c: Column) -> Column:
    return F.lower(F.ltrim(text_or_empty(c))).startswith("<svg") | F.lower(text_or_empty(c)).rlike(r"(?s)^\s*<\?xml.*<svg")


def usable_output(c: Column) -> Column:
    """Not blank, and, without a fence, JSON that parses or SVG."""
    bare = strip_fence(c)
    json = (bare.startswith("[") | bare.startswith("{")) & F.try_parse_json(bare).isNotNull()
    return ~is_blank(c) & (is_svg(bare) | F.coalesce(json, F.lit(False)))


def word_list_ratio(c: Column, words: list[str]) -> Column:
    """Share of the blank-separated words that are in a list."""
    hits = lambda own: F.size(F.filter(own, lambda w: F.array_contains(F.array(*map(F.lit, words)), w)))
    return let(F.filter(F.split(F.lower(text_or_empty(c)), r"\s+"), lambda w: w != ""), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(hits(own) / F.size(own)))


def placeholder_if_listed(c: Column, words: list[str], placeholder: str = "[unreadable]", most: float = 0.55, least_words: int = 4) -> Column:
    n = F.size(F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w != ""))
    return F.when((n >= least_words) & (word_list_ratio(c, words) > most), F.lit(placeholder)).otherwise(c)


def drop_listed_words(c: Column, words: list[str]) -> Column:
    """Without the listed words, but for those that are non-ASCII, numbers, or two characters at most."""
    listed = F.array(*map(F.lit, words))
    keep = lambda w: ~F.array_contains(listed, F.lower(w)) | w.rlike(r"[^\x00-\x7F]") | w.rlike(r"^[0-9]+([.,][0-9]+)*$") | (F.char_length(w) <= 2)
    return F.array_join(F.filter(F.split(text_or_empty(c), " "), keep), " ")


def slug(c: Column) -> Column:
    """Lower case, blanks to ``_``, letters, digits and ``_`` kept, ``_`` trimmed at the ends."""
    spaced = F.regexp_replace(F.lower(trim_ws(c)), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", ""), "^_+|_+$", "")


_ACCENTS: list[str] = []


def _accented() -> tuple[str, str]:
    """Letters with marks, and the ASCII letters under them (canonical decomposition); and đ."""
    if not _ACCENTS:
        bare = {"đ": "d"}
        for cp in range(0x80, 0x3000):
            letters = [c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"]
            if len(letters) == 1 and "a" <= letters[0] <= "z":
                bare[chr(cp)] = letters[0]
        _ACCENTS.extend(("".join(bare), "".join(bare.values())))
    return _ACCENTS[0], _ACCENTS[1]


def ascii_key(c: Column) -> Column:
    """Marks stripped, then only a-z, 0-9 and ``_`` kept (upper case goes)."""
    return F.regexp_replace(F.translate(F.replace(c, F.lit("Đ"), F.lit("D")), *_accented()), "[^a-z0-9_]", "")


def clean_label(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"^[\-–•* ]+", "")


def text_layer_usable(c: Column) -> Column:
    """At least ten words, at most 5% garbage characters, words of 15 characters at most on average."""
    own = F.filter(F.split(text_or_empty(c), r"(?U)\s+"), lambda w: w != "")
    letters = F.char_length(F.regexp_replace(text_or_empty(c), r"(?U)\s+", ""))
    garbage = F.regexp_count(text_or_empty(c), F.lit(r"[?\x{25A1}\x{FFFD}]"))
    mean = F.when(F.size(own) == 0, 0.0).otherwise(letters / F.size(own))
    share = F.when(letters == 0, 1.0).otherwise(garbage / letters)
    return (F.size(own) >= 10) & (share <= 0.05) & (mean <= 15)


def image_type(raw: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(raw, 1, 4))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646"), "image/webp").when(head.startswith("25504446"), "application/pdf").otherwise("application/octet-stream")
    )


def decode_data_uri(c: Column) -> Column:
    return F.unbase64(F.substring_index(c, ",", -1))


def byte_size(c: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB``."""
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1 << 20, F.format_string("%.1f KB", c / 1024.0)).otherwise(F.format_string("%.1f MB", c / float(1 << 20)))


def millis_text(c: Column) -> Column:
    return F.when(c == 0, F.lit("—")).otherwise(F.date_format(F.timestamp_millis(c), "dd/MM/yyyy HH:mm"))


def session_name(at: Column) -> Column:
    return F.concat(F.lit("Chat "), F.date_format(at, "dd/MM HH:mm"))


def renamed(c: Column) -> Column:
    return F.left(trim_ws(c), F.lit(80))


def category_code(c: Column) -> Column:
    """A layout category by its text, whatever its case, with or without ``-`` and blanks; else Unknown."""
    from docloom.schemas import CATEGORIES

    table = F.create_map(*[x for k in CATEGORIES for x in (F.lit(k.lower()), F.lit(k))])
    return F.coalesce(F.element_at(table, F.regexp_replace(F.lower(text_or_empty(c)), r"[\s_-]", "")), F.lit("Unknown"))


def json_long(json: Column, path: str) -> Column:
    """A number from JSON, 0 where absent or of another type."""
    return F.coalesce(F.get_json_object(json, path).try_cast("long"), F.lit(0).cast("long"))


def json_flag(json: Column, path: str) -> Column:
    """True for true or a number that isn't 0."""
    raw = F.get_json_object(json, path)
    return F.coalesce(raw.try_cast("boolean"), raw.try_cast("double") != 0, F.lit(False))


def score_class(c: Column) -> Column:
    return F.when(c.isNull() | (c < 0), "none").when(c >= 0.7, "high").when(c >= 0.4, "mid").otherwise("low")


def error_class(c: Column) -> Column:
    """Of a character or word error rate."""
    return F.when(c < 0.05, "good").when(c < 0.15, "fair").otherwise("poor")


def overlap_class(c: Column) -> Column:
    return F.when(c >= 0.5, "high").when(c >= 0.25, "mid").otherwise("low")
