"""DOCX forms: the fields of a template, and filling them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARK = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")
_BLANK = re.compile(r"([^:\n{}_.]{1,80}):[ \t]*(_{2,}|\.{3,}|…+)")
_LABEL = re.compile(r"[^:\n{}_.]{1,80}:")
_NOTHING = re.compile(r"[_.…\s]*")
_MERGE = re.compile(r"MERGEFIELD\s+\"?([^\s\"\\]+)\"?")


def key_of(label: str) -> str:
    spaced = re.sub(r"\s+", "_", label.strip().lower())
    return re.sub(r"^_+|_+$", "", "".join(c for c in spaced if c.isalnum() or c == "_"))


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def _body(raw: bytes) -> tuple[ElementTree.Element, dict[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    return ElementTree.fromstring(parts["word/document.xml"]), parts


def _label_of(control: ElementTree.Element) -> str:
    for name in ("alias", "tag"):
        found = control.find(f"{W}sdtPr/{W}{name}")
        if found is not None and found.get(f"{W}val"):
            return found.get(f"{W}val")
    return ""


def _paragraphs(root: ElementTree.Element) -> list[tuple[ElementTree.Element, ElementTree.Element | None]]:
    """Each paragraph with the one after it in the document."""
    own = list(root.iter(f"{W}p"))
    return list(zip(own, [*own[1:], None]))


def _listed(p: ElementTree.Element) -> bool:
    return p.find(f"{W}pPr/{W}numPr") is not None


def _merged_runs(p: ElementTree.Element) -> list[tuple[str, list[ElementTree.Element]]]:
    """(field, texts shown for it) of merge fields that are spread over runs: begin, instruction, separate, shown texts, end."""
    out: list[tuple[str, list[ElementTree.Element]]] = []
    code, shown, inside = "", [], 0  # 0 outside, 1 in the instruction, 2 in what is shown
    for run in p.iter(f"{W}r"):
        for node in run:
            kind = node.get(f"{W}fldCharType") if node.tag == f"{W}fldChar" else None
            if kind == "begin":
                code, shown, inside = "", [], 1
            elif kind == "separate":
                inside = 2
            elif kind == "end":
                m = _MERGE.search(code)
                if m and shown:
                    out.append((m.group(1), shown))
                inside = 0
            elif inside == 1 and node.tag == f"{W}instrText":
                code += node.text or ""
            elif inside == 2 and node.tag == f"{W}t":
                shown.append(node)
    return out


def fields(raw: bytes) -> list[tuple[str, str]]:
    """(key, label) in document order, the first of each key: content controls, merge fields, marks, blanks after a label (also
    with the blank in the next table cell), labels that end a paragraph. Labels with a comma or over five words don't count."""
    root, _ = _body(raw)
    found: list[str] = [_label_of(c) for c in root.iter(f"{W}sdt")]
    found += [f.get(f"{W}instr", "") and (_MERGE.search(f.get(f"{W}instr", "")) or [None, ""])[1] for f in root.iter(f"{W}fldSimple")]
    codes = ["".join(i.text or "" for i in p.iter(f"{W}instrText")) for p in root.iter(f"{W}p")]  # one may be spread over runs
    found += [m.group(1) for c in codes for m in _MERGE.finditer(c)]
    for row in root.iter(f"{W}tr"):
        cells = [_text(c).strip() for c in row.findall(f"{W}tc")]
        found += [a.rstrip(":").strip() for a, b in zip(cells, cells[1:]) if a.endswith(":") and (not b or re.fullmatch(r"[_.…\s]+", b))]
    for p, after in _paragraphs(root):
        t = _text(p)
        found += [m.group(1) for m in _MARK.finditer(t)] + [m.group(1) for m in _BLANK.finditer(t)]
        # A label before a list introduces the list; it is no blank to fill.
        if _LABEL.fullmatch(t.strip()) and not (after is not None and _listed(after) and not _listed(p)):
            found.append(t.strip()[:-1])
    out: dict[str, tuple[str, str]] = {}
    for label in found:
        label = re.sub(r"^[\-–•*,; ]+", "", (label or "").strip())
        key = key_of(label)
        if key and "," not in label and len(label.split()) <= 5:
            out.setdefault(key.lower(), (key, label))
    return list(out.values())


def fill(raw: bytes, values: dict[str, str]) -> bytes:
    """The document with values in its content controls, merge fields, marks and blanks; unknown fields stay. The value of a label that
    ends a paragraph goes into the next paragraph if that is blank, else behind the label; not if a list follows."""
    root, parts = _body(raw)
    known = {k.lower(): v for k, v in values.items()}
    cells_of = {p for c in root.iter(f"{W}tc") for p in c.iter(f"{W}p")}  # labels in cells are filled in the next cell

    def put(node: ElementTree.Element, value: str) -> None:
        own = list(node.iter(f"{W}t"))
        for i, t in enumerate(own):
            t.text = value if i == 0 else ""

    for control in root.iter(f"{W}sdt"):
        value = known.get(key_of(_label_of(control)))
        content = control.find(f"{W}sdtContent")
        if value is not None and content is not None:
            put(content, value)
    for f in root.iter(f"{W}fldSimple"):
        m = _MERGE.search(f.get(f"{W}instr", ""))
        if m and key_of(m.group(1)) in known:
            put(f, known[key_of(m.group(1))])
    for row in root.iter(f"{W}tr"):
        cells = row.findall(f"{W}tc")
        for a, b in zip(cells, cells[1:]):
            label, there = _text(a).strip(), _text(b).strip()
            if label.endswith(":") and re.fullmatch(r"[_.…\s]+", there) and key_of(label[:-1]) in known:
                put(b, known[key_of(label[:-1])])
    for p in root.iter(f"{W}p"):
        before = _text(p)
        new = _MARK.sub(lambda m: known.get(key_of(m.group(1)), m.group(0)), before)
        new = _BLANK.sub(lambda m: f"{m.group(1)}: {known[key_of(m.group(1))]}" if key_of(m.group(1)) in known else m.group(0), new)
        if new != before:
            put(p, new)
        for name, shown in _merged_runs(p):
            if key_of(name) in known:
                for i, t in enumerate(shown):
                    t.text = known[key_of(name)] if i == 0 else ""
    for p, after in _paragraphs(root):
        label = _text(p).strip()
        if not _LABEL.fullmatch(label) or key_of(label[:-1]) not in known or p in cells_of or after is not None and _listed(after) and not _listed(p):
            continue
        blank = after is not None and after not in cells_of and _NOTHING.fullmatch(_text(after)) is not None
        own, value = (after, known[key_of(label[:-1])]) if blank else (p, " " + known[key_of(label[:-1])])
        if blank and next(own.iter(f"{W}t"), None) is not None:
            put(own, value)
        else:
            t = ElementTree.SubElement(ElementTree.SubElement(own, f"{W}r"), f"{W}t")
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            t.text = value
    parts["word/document.xml"] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.StringType())])))
def docx_fields(raw: pd.Series) -> pd.Series:
    """Fields of each template; null for what isn't a DOCX."""

    def one(x):
        try:
            return [{"key": k, "label": label} for k, label in fields(bytes(x))]
        except Exception:
            return None

    return raw.map(one, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def docx_fill(raw: pd.Series, values: pd.Series) -> pd.Series:
    """Each template filled from a map of keys to values (as JSON); null for what isn't a DOCX."""

    def one(x, v):
        try:
            return fill(bytes(x), json.loads(v or "{}"))
        except Exception:
            return None

    return pd.Series([None if x is None else one(x, v) for x, v in zip(raw, values)])
