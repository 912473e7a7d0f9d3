"""File sources and sinks: JSON questions, text, DOCX, XLSX, SVG, PDF text, CSV, and dispatch by type."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import text_layer_usable
from docloom.operators.elements import svg_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """``id, question, ground_truth`` from the first of the paths that can be read; none gives no rows."""
    schema = "id int, question string, ground_truth string"
    for path in paths:
        try:
            df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
            df.limit(1).count()
            return df
        except Exception as e:  # the next candidate
            print(f"questions not read from {path}: {type(e).__name__}")
    return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def file_of(files: DataFrame, document_id: str) -> DataFrame:
    """The cached file ``document_id.*``."""
    return files.where(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1) == document_id)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """Parser of a file: by extension, else by MIME type; null where none supports it."""
    e, m = extension(path), F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    return (
        F.when(e.isin(".txt", ".md"), "text").when(e == ".docx", "docx").when(e == ".xlsx", "xlsx").when(e == ".pdf", "pdf").when(e == ".svg", "svg").when(e.isin(".png", ".jpg", ".jpeg", ".gif", ".webp"), "image")
        .when(m.startswith("text/"), "text").when(m == "application/pdf", "pdf").when(m.contains("wordprocessingml"), "docx").when(m.contains("spreadsheetml"), "xlsx").when(m.startswith("image/"), "image")
    )


def docx_text(raw: bytes) -> str:
    """Body in order: a paragraph is a line, a table one of escaped cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            out.append(text(node))
        elif node.tag == f"{W}tbl":
            rows = ["<tr>" + "".join(f"<td>{html.escape(text(c))}</td>" for c in row.iter(f"{W}tc")) + "</tr>" for row in node.iter(f"{W}tr")]
            out.append("<table>" + "".join(rows) + "</table>")
    return "\n".join(out)


def xlsx_text(raw: bytes) -> str:
    """``## sheet``, then ``| a | b |`` for each used row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            out.append(f"## {sheet.get('name')}")
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{R}id")].removeprefix("/xl/"))).iter(f"{S}row"):
                cells = []
                for c in row.iter(f"{S}c"):
                    v = c.find(f"{S}v")
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t")))
                if any(x.strip() for x in cells):
                    out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def pdf_pages(raw: bytes) -> list[str]:
    """Text of each page of a simple PDF: literal and hexadecimal strings of its plain or deflated content streams."""
    objects = {int(n): body for n, body in re.findall(rb"(?s)(\d+)\s+\d+\s+obj(.*?)endobj", raw)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        data = m.group(1) if m else b""
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in body else data

    def shown(data: bytes) -> str:
        out = []
        for m in re.finditer(rb"\((?P<s>(?:\\.|[^\\()])*)\)|<(?P<h>[0-9A-Fa-f\s]+)>|(?P<n>T\*|T[dD]\b|')", data):
            if m["n"]:
                out.append("\n")
            elif m["h"]:
                out.append(bytes.fromhex("".join(m["h"].decode().split()).ljust(2, "0")).decode("latin-1"))
            else:
                out.append(re.sub(rb"\\([()\\])", rb"\1", m["s"]).decode("latin-1"))
        return re.sub(r"\n+", "\n", "".join(out)).strip()

    pages = []
    for body in objects.values():
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            pages.append("\n".join(shown(stream(objects.get(int(n), b""))) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1))) if refs else "")
    return pages


def _safely(f, raw):
    try:
        return f(bytes(raw))
    except Exception:
        return None


@F.pandas_udf(T.StringType())
def docx(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: _safely(docx_text, x), na_action="ignore")


@F.pandas_udf(T.StringType())
def xlsx(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: _safely(xlsx_text, x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def pdf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: _safely(pdf_pages, x), na_action="ignore")


def pdf_text_rows(files: DataFrame) -> DataFrame:
    """``document_id, page, text, usable`` for each page; a PDF that can't be read gives none."""
    rows = files.select("document_id", F.posexplode(pdf("content")).alias("_p", "text"))
    return rows.select("document_id", (F.col("_p") + 1).alias("page"), "text", text_layer_usable(F.col("text")).alias("usable"))


def smart_text(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """``document_id, text``: each page's own text where usable, else the OCR's, marked ``[PAGE n]``. ``ocr(document_id, page, ocr_text)``."""
    met = pages.join(ocr, ["document_id", "page"], "left")
    own = F.when(F.col("usable"), F.col("text")).otherwise(F.coalesce("ocr_text", "text", F.lit("")))
    rows = met.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", own.alias("t")))).alias("x"))
    return rows.select("document_id", F.array_join(F.transform("x", lambda e: F.concat(F.lit("[PAGE "), e["page"].cast("string"), F.lit("]\n"), e["t"])), "\n\n").alias("text"))


def parse(files: DataFrame) -> DataFrame:
    """``document_id, kind, text, error`` for each file of ``files(path, content[, mime])``; unsupported and unreadable files get an error."""
    mime = F.col("mime") if "mime" in files.columns else None
    rows = files.withColumns({"document_id": F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1), "kind": kind_of(F.col("path"), mime)})
    # A guard around each input: a worker then parses only what is of its kind.
    only = lambda k: F.when(F.col("kind") == k, F.col("content"))
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(F.when(F.col("kind") == "text", decoded), F.when(F.col("kind") == "svg", svg_text(decoded)), docx(only("docx")), xlsx(only("xlsx")), F.array_join(pdf(only("pdf")), "\n\n"))
    error = F.when(F.col("kind").isNull(), "unsupported").when((F.col("kind") != "image") & F.col("_text").isNull(), "unreadable")
    return rows.withColumn("_text", text).select("document_id", "kind", F.col("_text").alias("text"), error.alias("error"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; fields are quoted only where they must be."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
