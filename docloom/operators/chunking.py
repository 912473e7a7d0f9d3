"""Chunks from elements: sections carried forward, text gathered up to a ceiling, tables split by rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import chunk_id, is_blank, let, trim_ws
from docloom.operators.elements import windows
from docloom.schemas import BBOX
from docloom.shared import discard, written

CEILING, SMALL_TABLE, TABLE_BATCH = 8000, 1500, 1200
DROPPED, HEADERS = ("PageHeader", "PageFooter", "Picture"), ("Title", "SectionHeader")


def with_section(elements: DataFrame, trim: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """Elements with the header they stand under, ``trim`` at its ends; a header without text resets it. Dropped categories are gone."""
    w = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kept = elements.where(~F.col("category").isin(*DROPPED))
    header = F.when(F.col("category").isin(*HEADERS), F.struct(trim(F.col("text")).alias("h")))
    return kept.withColumn("section", F.last(header, ignorenulls=True).over(w)["h"])


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)(<tr[\s\S]*?</tr>)"), F.lit(1))


def split_table(html: Column) -> Column:
    """A table's pieces: the whole up to 1,500 characters; else batches of rows of at most 1,200 under the first row again; a
    long table without rows in windows of 1,500. An oversized first data row leaves an empty batch before it, and a long table
    of one row gives nothing."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    full = lambda acc, row: F.char_length(acc["now"]) + F.char_length(row) > TABLE_BATCH
    step = lambda acc, row: F.struct(
        F.when(full(acc, row), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
        F.when(full(acc, row), row).otherwise(F.concat(acc["now"], row)).alias("now"),
    )
    finish = lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    def by_rows(rows: Column) -> Column:
        batches = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step, finish)
        whole = F.transform(batches, lambda b: F.concat(F.lit("<table>"), F.get(rows, F.lit(0)), b, F.lit("</table>")))
        return F.when(F.size(rows) == 0, windows(html, SMALL_TABLE)).otherwise(whole)

    return F.when(F.char_length(html) <= SMALL_TABLE, F.array(html)).otherwise(let(table_rows(html), by_rows))


def _cut_starts(lengths: DataFrame) -> DataFrame | None:
    """``document_id, ord`` of the elements that begin a chunk because the one before is full, among ``lengths(document_id, stretch, ord,
    n)``, the elements of text between headers and tables; None where no stretch is as long as a chunk.

    The sum of lengths before an element tells with which element a chunk that began there would be full: the first whose own sum is
    ``CEILING`` more, found for all by one sort of both kinds of points. From each element that leads to the next beginning; these steps
    are doubled (2, 4, 8 beginnings on), and the beginnings of a stretch are those that its first element reaches.
    """
    at = ["document_id", "stretch"]
    along, whole = Window.partitionBy(*at).orderBy("ord"), Window.partitionBy(*at)
    rows = lengths.withColumns({"s": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(along), "all": F.sum("n").over(whole), "last": F.count("*").over(whole)})
    rows = written(rows.where(F.col("all") >= CEILING), "stretches")
    most = rows.agg(F.max("all")).first()[0]
    if most is None:
        discard(rows)
        return None
    points = rows.select(*at, "i", "last", F.col("s").alias("v"), F.lit(1).alias("full")).unionByName(rows.select(*at, "i", "last", (F.col("s") - F.col("n") + CEILING).alias("v"), F.lit(0).alias("full")))
    down = Window.partitionBy(*at).orderBy(F.col("v").desc(), F.col("full").desc(), F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(F.col("full") == 1, F.col("i")), ignorenulls=True).over(down)
    step = points.withColumn("j", nearest + 1).where((F.col("full") == 0) & (F.col("j") <= F.col("last"))).select(*at, "i", "j")

    def onward(x: DataFrame, by: DataFrame) -> DataFrame:
        """``x(..., j)`` with each j led on by ``by(i, j)``; those that it leads no further are left out."""
        to = by.select(F.col("document_id").alias("_d"), F.col("stretch").alias("_s"), F.col("i").alias("_i"), F.col("j").alias("_j"))
        met = x.join(to, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("stretch") == F.col("_s")) & (F.col("j") == F.col("_i")))
        return met.drop("j", "_d", "_s", "_i").withColumnRenamed("_j", "j")

    steps = [written(step, "steps")]
    while 1 << len(steps) < most // CEILING + 1:  # no stretch has more beginnings
        steps.append(written(onward(steps[-1], steps[-1]), "steps"))
    reached = rows.where("i = 1").select(*at, F.col("i").cast("int").alias("j"))
    for by in reversed(steps):  # each round is written: a row for each chunk, at the end
        reached = reached.unionByName(written(onward(reached, by).select(*at, "j"), "reached"))
    discard(*steps)
    found = reached.where("j > 1").select(F.col("document_id").alias("_d"), F.col("stretch").alias("_s"), F.col("j").alias("_j"))
    return rows.join(found, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("stretch") == F.col("_s")) & (F.col("i") == F.col("_j")), "left_semi").select("document_id", "ord")


def layout_chunks(elements: DataFrame, trim_header: Callable[[Column], Column] = trim_ws, trim_body: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """``document_id, chunk_no, content, content_type, page, bbox, section`` of each document's elements, in order.

    Headers, tables and full chunks are breaks; their number up to an element is the number of its chunk, whose texts are gathered. The
    cut at 8,000 characters depends on all before it: see ``_cut_starts``, which handles numbers alone. Null is a document of its own. ``trim_header`` and ``trim_body`` say what goes at the ends of headers and texts.
    The elements are written to the shared folder; ``discard`` of the result, once it has been used, removes them.
    """
    # Elements are made once: numbers, texts and tables are taken from what is written.
    kept = written(elements.where(~F.col("category").isin(*DROPPED)).select("document_id", "ord", "category", "text", "page", "bbox"), "elements")
    is_header, is_table = F.coalesce(F.col("category").isin(*HEADERS), F.lit(False)), F.coalesce(F.col("category") == "Table", F.lit(False))
    along = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbers = kept.select("document_id", "ord", (is_header | is_table).alias("breaks"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    numbers = numbers.withColumn("stretch", F.sum(F.col("breaks").cast("int")).over(along)).where("not breaks")
    full = _cut_starts(numbers.select("document_id", "stretch", "ord", "n"))
    rows = kept.select("document_id", "ord", "category", "text", "page", "bbox")
    if full is None:
        rows = rows.withColumn("_cut", F.lit(False))
    else:
        full = full.select(F.col("document_id").alias("_d"), F.col("ord").alias("_o"), F.lit(True).alias("_c"))
        rows = rows.join(full, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("ord") == F.col("_o")), "left").withColumn("_cut", F.coalesce("_c", F.lit(False))).drop("_d", "_o", "_c")
    # A table is alone; what follows it begins anew.
    header = F.when(is_header, F.struct(trim_header(F.col("text")).alias("h")))
    rows = rows.withColumns({"_head": is_header, "_table": is_table})
    rows = rows.withColumn("_at", F.sum((F.col("_head") | F.col("_table") | F.col("_cut")).cast("int") + F.coalesce(F.lag("_table").over(Window.partitionBy("document_id").orderBy("ord")).cast("int"), F.lit(0))).over(along))
    rows = rows.withColumn("section", F.last(header, ignorenulls=True).over(along)["h"]).where(~F.col("_head"))
    body = trim_body(F.coalesce("text", F.lit("")))
    first = lambda c: F.min(F.struct("ord", F.col(c).alias("v")))["v"]
    box = lambda f, k: f(F.col(f"bbox.{k}"))
    around = F.when(F.count("bbox") > 0, F.struct(box(F.min, "x1").alias("x1"), box(F.min, "y1").alias("y1"), box(F.max, "x2").alias("x2"), box(F.max, "y2").alias("y2")))
    texts = rows.where(~F.col("_table")).groupBy("document_id", "_at").agg(
        F.array_sort(F.collect_list(F.when(body != "", F.struct("ord", body.alias("t"))))).alias("_x"), first("page").alias("page"), around.alias("bbox"), first("section").alias("section")
    )
    texts = texts.where(F.size("_x") > 0).select("document_id", "_at", F.lit(0).alias("_p"), F.array_join(F.transform("_x", lambda x: x["t"]), "\n\n").alias("content"), F.lit("text").alias("content_type"), "page", "bbox", "section")
    tables = rows.where("_table").select("document_id", "_at", F.posexplode(split_table(F.coalesce("text", F.lit("")))).alias("_p", "content"), F.lit("table").alias("content_type"), "page", "bbox", "section")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_at", "_p")) - 1
    content = F.when(F.col("section").isNotNull(), F.concat(F.lit("## "), "section", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    out = texts.unionByName(tables)
    out = out.select(F.col("document_id").cast("string").alias("document_id"), number.cast("int").alias("chunk_no"), content.alias("content"), "content_type", F.col("page").cast("int").alias("page"), F.col("bbox").cast(BBOX).alias("bbox"), "section")
    out._docloom_path = kept._docloom_path
    return out


def fixed_chunks(texts: DataFrame, size: int, key: str = "document_id", text: str = "text") -> DataFrame:
    """``key, chunk_no, content``: windows of ``size`` characters; none for empty and null texts."""
    return texts.select(key, F.posexplode(windows(F.coalesce(text, F.lit("")), size)).alias("chunk_no", "content"))


def joined_chunks(texts: DataFrame, size: int, key: str, text: str = "text", block: int = 4096) -> DataFrame:
    """``chunk_no, content``: windows of ``size`` characters over all texts joined by a blank line, in the order of the integer ``key``
    (rows without one first). Null texts count as empty.

    No text is ever joined to all others: each row's place on the line is the sum of the lengths before it, counted within blocks of
    keys and then over the blocks; a row gives a piece to each window that it reaches into, and a window's pieces are put together.
    """
    if size < 1:
        raise ValueError("size must be positive")
    own = texts.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_b", F.coalesce(F.floor(F.col("_k") / block), F.lit(-(1 << 62))))
    own = own.withColumn("_n", F.char_length("_t") + 2)
    sums = own.groupBy("_b").agg(F.sum("_n").alias("_s"))  # a row for each block of keys
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), (F.sum("_s").over(Window.partitionBy()) - 2).alias("_all"))
    within = Window.partitionBy("_b").orderBy(F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(sums, "_b")
    at = F.col("_o") + F.col("_w")
    # The last text has no blank line after it.
    rows = rows.select(at.alias("_a"), F.concat("_t", F.when(at + F.col("_n") < F.col("_all") + 2, F.lit("\n\n")).otherwise(F.lit(""))).alias("_t")).where("_t <> ''")
    first, last = F.floor(F.col("_a") / size), F.floor((F.col("_a") + F.char_length("_t") - 1) / size)
    pieces = rows.select("_a", "_t", F.explode(F.sequence(first, last)).alias("chunk_no"))
    from_ = F.greatest(F.col("chunk_no") * size - F.col("_a"), F.lit(0))
    upto = F.least((F.col("chunk_no") + 1) * size - F.col("_a"), F.char_length("_t"))
    pieces = pieces.select("chunk_no", "_a", F.substring("_t", (from_ + 1).cast("int"), (upto - from_).cast("int")).alias("_p"))
    whole = pieces.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("_a", "_p"))).alias("x"))  # one window's
    return whole.select("chunk_no", F.array_join(F.transform("x", lambda e: e["_p"]), "").alias("content"))


def length_stats(chunks: DataFrame, strategy: str, preserves: bool, order: list[str]) -> DataFrame:
    """One row: number, mean, least and greatest length, and the first two chunks cut to 200 characters."""
    first = F.expr(f"slice(array_sort(collect_list(s)), 1, 2)")
    ranked = chunks.select(F.char_length("content").alias("n"), "content", *order).orderBy(*order).limit(2)
    samples = ranked.select(F.struct(*order, F.concat(F.left("content", F.lit(200)), F.lit("…")).alias("c")).alias("s")).agg(first.alias("x")).select(F.transform("x", lambda e: e["c"]).alias("samples"))
    stats = chunks.agg(F.count("*").alias("chunks"), F.avg(F.char_length("content")).alias("avg_len"), F.min(F.char_length("content")).alias("min_len"), F.max(F.char_length("content")).alias("max_len"))
    return stats.crossJoin(F.broadcast(samples)).withColumns({"strategy": F.lit(strategy), "preserves_structure": F.lit(preserves)})  # one row each


#: Digits of a chunk's place in the ``seq:`` keyword.
SEQUENCE = 10


def to_store(chunks: DataFrame, tags: DataFrame, dataset_id: str) -> DataFrame:
    """Chunks as rows of the store, with stable ids and the document's tags; ``tags`` has a row for each document."""
    own = chunks.withColumn("id", chunk_id(F.col("document_id"), F.col("chunk_no")))
    return own.join(tags, "document_id", "left").select(
        "id", F.lit(dataset_id).alias("dataset_id"), "document_id", "document_name", "content", F.array().cast("array<float>").alias("embedding"),
        F.array(F.concat(F.lit("seq:"), F.lpad(F.col("chunk_no").cast("string"), SEQUENCE, "0"))).alias("keywords"), "department", "doc_type", "scope", "status", "chunk_no",
    )


def documents_without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.join(chunks, "document_id", "left_anti").withColumn("error", F.lit("no chunks"))


def union_bbox(elements: DataFrame, *by: str) -> DataFrame:
    c = F.col
    return elements.where("bbox is not null").groupBy(*by).agg(F.struct(F.min(c("bbox.x1")).alias("x1"), F.min(c("bbox.y1")).alias("y1"), F.max(c("bbox.x2")).alias("x2"), F.max(c("bbox.y2")).alias("y2")).alias("bbox"))


def join_texts(elements: DataFrame, by: str = "document_id", trim: Callable[[Column], Column] = trim_ws) -> DataFrame:
    """Texts joined by a blank line, in order, ``trim`` at their ends."""
    rows = elements.where(trim(F.coalesce("text", F.lit(""))) != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return rows.select(by, F.array_join(F.transform("x", lambda e: trim(e["text"])), "\n\n").alias("text"))
