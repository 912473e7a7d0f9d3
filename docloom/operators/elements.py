"""Layout elements: from text, from OCR output, and their cleaning."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import category_code, is_blank, is_foreign, let, placeholder_if_listed, strip_fence, trim_blanks, trim_ws
from docloom.schemas import BBOX

LAYOUT = "array<struct<bbox:array<int>,category:string,text:string>>"
LEAST_LINE, WINDOW = 20, 2000


def box(x1: int, y1: int, x2: int, y2: int) -> Column:
    return F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])


def windows(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters; none for an empty text."""
    if size < 1:
        raise ValueError("size must be positive")
    n = F.char_length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size))))


def is_heading(t: Column) -> Column:
    return (F.char_length(t) < 100) & ~t.endswith(".") & ~t.endswith(",")


def text_elements(docs: DataFrame, document_id: str = "document_id", text: str = "text", trim: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """``document_id, ord, page, category, text, bbox`` in text order.

    Paired tables are elements of their own; other stretches give their lines of over 20 characters, or, where one line of over
    2,000 characters is all there is, windows of 2,000. ``##`` lines and short lines that don't end a sentence are headers; lines
    of a pipe table stay text. A text without any element is one element. ``trim`` says what goes at the ends of a line or window:
    all white space, as the service does, or blanks alone, as SQL does.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    segments = F.split(F.regexp_replace(whole, r"(?is)(<table>.*?</table>)", "\u0001$1\u0001"), "\u0001")
    one = lambda kind, x: F.struct(F.lit(kind).alias("k"), x.alias("x"))
    long_ = lambda x: F.char_length(trim(x)) > LEAST_LINE

    def of_segment(segment: Column) -> Column:
        cut = lambda lines: F.when((F.size(lines) <= 1) & (F.char_length(segment) > WINDOW), F.filter(windows(segment, WINDOW), long_)).otherwise(lines)
        lines = let(F.filter(F.split(segment, r"\r?\n"), long_), cut)
        table = F.lower(F.ltrim(segment)).startswith("<table>")
        return F.when(table, F.array(one("t", trim_ws(segment)))).otherwise(F.transform(lines, lambda x: one("p", trim(x))))

    # All within a row: a document's elements need no shuffle.
    own = docs.select(F.col(document_id).alias("document_id"), whole.alias("_all"), F.flatten(F.transform(segments, of_segment)).alias("_own"))
    own = own.select("document_id", F.when(F.size("_own") == 0, F.array(one("w", F.col("_all")))).otherwise(F.col("_own")).alias("_own"))
    out = own.select("document_id", F.posexplode("_own").alias("ord", "_e")).select("document_id", "ord", "_e.k", "_e.x")
    marked_header = (F.col("k") == "p") & F.col("x").startswith("##")
    header = marked_header | ((F.col("k") == "p") & is_heading(F.col("x")) & ~F.col("x").startswith("|"))
    category = F.when(F.col("k") == "t", "Table").when(header, "SectionHeader").otherwise("Text")
    body = F.when(marked_header, trim_ws(F.regexp_replace("x", "^#+", ""))).otherwise(F.col("x"))
    bbox = F.when(marked_header, box(0, 0, 1000, 30)).when(F.col("k") == "w", box(0, 0, 1000, 1000)).otherwise(box(0, 0, 1000, 50))
    return out.select("document_id", "ord", F.lit(1).alias("page"), category.alias("category"), body.alias("text"), bbox.alias("bbox"))


def salvage_json(c: Column) -> Column:
    """JSON without its fence; an array cut short is closed after its last whole element; null if that doesn't parse either."""
    bare = strip_fence(c)
    closed = F.regexp_replace(bare, r"(?s)\},(?!.*\},).*$", "}]")
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(closed).isNotNull(), closed)


def ocr_elements(pages: DataFrame, json: str = "json") -> DataFrame:
    """Layout JSON to elements: ``document_id, page, ord, category, text, bbox``; blank texts go, but for pictures."""
    rows = pages.select("document_id", "page", F.posexplode(F.from_json(salvage_json(F.col(json)), LAYOUT)).alias("ord", "e"))
    b = F.col("e.bbox")
    bbox = F.when(F.size(b) >= 4, F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])).otherwise(box(0, 0, 1000, 1000))
    out = rows.select("document_id", "page", "ord", category_code(F.col("e.category")).alias("category"), F.col("e.text").alias("text"), bbox.cast(BBOX).alias("bbox"))
    return out.where((F.col("category") == "Picture") | ~is_blank(F.col("text")))


def second_ocr_elements(pages: DataFrame, json: str = "json") -> DataFrame:
    """``{results:[{text,bbox,confidence}]}`` to text elements; blank texts go."""
    parsed = F.from_json(json, "struct<results:array<struct<text:string,bbox:array<int>,confidence:double>>>")
    rows = pages.select("document_id", "page", F.posexplode(parsed["results"]).alias("ord", "e")).where(~is_blank(F.col("e.text")))
    b = F.col("e.bbox")
    bbox = F.when(F.size(b) >= 4, F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])).otherwise(box(0, 0, 1000, 50))
    return rows.select("document_id", "page", "ord", F.lit("Text").alias("category"), trim_blanks(F.col("e.text")).alias("text"), bbox.cast(BBOX).alias("bbox"))


def quad_bbox(quad: Column) -> Column:
    """Four corners ``[[x,y],..]`` to the upright box around them."""
    xs, ys = F.transform(quad, lambda p: F.get(p, F.lit(0))), F.transform(quad, lambda p: F.get(p, F.lit(1)))
    return F.struct(*[f(v).cast("int").alias(n) for n, f, v in (("x1", F.array_min, xs), ("y1", F.array_min, ys), ("x2", F.array_max, xs), ("y2", F.array_max, ys))])


def ocr_text(elements: DataFrame) -> DataFrame:
    """``document_id, text``: elements joined in page order, without page headers, footers and pictures."""
    kept = elements.where(~F.col("category").isin("PageHeader", "PageFooter", "Picture") & ~is_blank(F.col("text")))
    rows = kept.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))).alias("x"))
    return rows.select("document_id", F.array_join(F.transform("x", lambda e: trim_blanks(e["text"])), "\n").alias("text"))


@F.pandas_udf(T.StringType())
def sanitise_table(s: pd.Series) -> pd.Series:
    """Blank the inner text of cells in a foreign script."""
    foreign = re.compile("[一-鿿㐀-䶿぀-ヿ؀-ۿ가-힯]")

    def one(html: str) -> str:
        def cell(m: re.Match) -> str:
            inner = re.sub("<[^>]+>", " ", m.group(2)).strip()
            bad = bool(inner) and len(foreign.findall(inner)) / len(inner) > 0.15
            return m.group(1) + ("" if bad else m.group(2)) + m.group(3)

        return re.sub(r"(?is)(<t[dh]\b[^>]*>)(.*?)(</t[dh]>)", cell, html)

    return s.map(one, na_action="ignore")


def clean_elements(elements: DataFrame, listed_words: list[str] | None = None) -> DataFrame:
    """Pictures stay; tables are sanitised and go if nothing is left; other elements go if foreign or under 5 characters, and
    become a placeholder if most of their words are in the list."""
    t, table, picture = F.col("text"), F.col("category") == "Table", F.col("category") == "Picture"
    text = F.when(table, sanitise_table(t)).otherwise(placeholder_if_listed(t, listed_words) if listed_words else t)
    out = elements.withColumn("text", F.when(picture, t).otherwise(text))
    empty = is_blank(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", " "))
    fine = ~is_foreign(F.col("text")) & (F.char_length(trim_ws(F.coalesce("text", F.lit("")))) >= 5)
    return out.where(picture | F.when(table, ~empty).otherwise(fine))


def repetitive_pages(elements: DataFrame, least: int = 5, most: float = 0.6) -> DataFrame:
    """``document_id, page, repetitive``: at least five texts, of which the two most frequent make over 60%."""
    texts = elements.where(~is_blank(F.col("text"))).groupBy("document_id", "page", trim_blanks(F.col("text")).alias("t")).count()
    w = Window.partitionBy("document_id", "page")
    top = texts.withColumn("r", F.row_number().over(w.orderBy(F.col("count").desc(), "t")))
    sums = top.groupBy("document_id", "page").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("r") <= 2, F.col("count"))).alias("two"))
    return sums.select("document_id", "page", ((F.col("n") >= least) & (F.col("two") / F.col("n") > most)).alias("repetitive"))


def repeats(json: Column, least: int = 5, most: float = 0.6) -> Column:
    """Whether layout JSON says the same again and again: of five texts or more, the two most frequent make over 60%."""
    said = F.filter(F.transform(F.from_json(salvage_json(json), LAYOUT), lambda e: trim_ws(e["text"])), lambda t: t != "")

    def test(texts: Column) -> Column:
        counts = F.reverse(F.array_sort(F.transform(F.array_distinct(texts), lambda d: F.size(F.filter(texts, lambda t: t == d)))))
        two = F.coalesce(F.get(counts, F.lit(0)), F.lit(0)) + F.coalesce(F.get(counts, F.lit(1)), F.lit(0))
        return (F.size(texts) >= least) & (two / F.size(texts) > most)

    return F.coalesce(let(said, test), F.lit(False))


def ocr_cascade(first: Column, second: Column, fallback: Column, usable, placeholder: str = "[page could not be read]", repeated=repeats) -> Column:
    """First of two attempts that is usable and doesn't repeat itself, else the second engine's text, else a placeholder."""
    fine = lambda c: usable(c) & ~repeated(c)
    return F.coalesce(F.when(fine(first), first), F.when(fine(second), second), F.when(~is_blank(fallback), fallback), F.lit(placeholder))


def pdf_elements(text_rows: DataFrame, ocr_rows: DataFrame) -> DataFrame:
    """Text elements, and OCR elements of the pages that have no text, by page. ``text_rows`` has a row for each page; those
    with a null text are the empty ones."""
    empty = text_rows.where(is_blank(F.col("text"))).select("document_id", "page").distinct()
    digital = text_rows.where(~is_blank(F.col("text")))
    return digital.unionByName(ocr_rows.join(empty, ["document_id", "page"], "left_semi").select(*digital.columns)).sortWithinPartitions("document_id", "page")


def svg_text(c: Column, trim: Callable[[Column], Column] = trim_ws) -> Column:
    """Texts of an SVG, a line each, ``trim`` at their ends; the input where there is none."""
    from docloom.functions.text import html_unescape

    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<text\b[^>]*>(.*?)</text>"), F.lit(1)), lambda x: trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: trim_ws(x) != "")
    return F.when(F.size(found) > 0, html_unescape(F.array_join(found, "\n"))).otherwise(c)
