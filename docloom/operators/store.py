"""The chunk store as tables: scans, upserts, deletes, updates, and lists over it.

Writes are new DataFrames (base without the touched keys, and the new rows); ``save`` puts one in place of a Parquet table.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.acl import Viewer, visible
from docloom.schemas import TAG_VALUES
from docloom.shared import written


def scan_dataset(chunks: DataFrame, viewer: Viewer, cap: int | None = None) -> DataFrame:
    out = chunks.where(visible(viewer))
    return out.orderBy("id").limit(cap) if cap else out


def scan_document(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id)


def store_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of all files under a path, whose contents aren't read; 0 where there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return spark.range(1).select(F.lit(0).cast("long").alias("bytes"))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def upsert(base: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    return base.join(new, key, "left_anti").unionByName(new)


def upsert_latest(base: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins: of all rows of a key the latest stays."""
    return latest(base.unionByName(new), keys, at)


def latest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in ties])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_where(base: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true (null counts as not)."""
    return base.where(~F.coalesce(predicate, F.lit(False)))


def set_tag(chunks: DataFrame, document_id: str, field: str, value: str) -> DataFrame:
    """A tag of all chunks of a document; field and value must be of the closed sets."""
    if field not in TAG_VALUES or value not in TAG_VALUES[field]:
        raise ValueError(f"no such tag: {field}={value}")
    return chunks.withColumn(field, F.when(F.col("document_id") == document_id, F.lit(value)).otherwise(F.col(field)))


def edit_chunk(chunks: DataFrame, chunk_id: str | Column, content: str, embed) -> DataFrame:
    """Replace a chunk's content; ``embed`` is a column function from text to a vector."""
    hit = F.col("id") == chunk_id
    out = chunks.withColumn("content", F.when(hit, F.lit(content)).otherwise(F.col("content")))
    return out.withColumn("embedding", F.when(hit, embed(F.col("content"))).otherwise(F.col("embedding")))


def reingest(chunks: DataFrame, document_id: str, fresh: DataFrame) -> DataFrame:
    """New chunks of a document in place of the old, with the tags of the old first chunk; the document's id stays."""
    tags = ["dataset_id", "document_name", *TAG_VALUES]
    first = documents(scan_document(chunks, document_id)).select("document_id", *tags)
    out = fresh.drop(*tags).join(first, "document_id")
    return delete_where(chunks, F.col("document_id") == document_id).unionByName(out.select(*chunks.columns))


def insert_if_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.unionByName(new.join(base, key, "left_anti"))


def set_status(rows: DataFrame, key: str, value: str, status: str) -> DataFrame:
    return rows.withColumn("status", F.when(F.col(key) == value, F.lit(status)).otherwise(F.col("status")))


def keep_newest(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The newest ``n`` rows: a distributed top-k, not a full sort."""
    return rows.orderBy(F.col(at).desc(), *ties).limit(n)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents, key, "left_semi")


def swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in place of ``path``. The old one is removed last, and comes back if the new one can't be put there; in
    between the path is missing for a moment, so readers that must never see that read a path of their own."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{path}.old-{uuid.uuid4().hex}"))
    fs = at.getFileSystem(conf)

    def moved(a, b) -> bool:
        try:
            return bool(fs.rename(a, b))
        except Py4JJavaError:
            return False

    had = fs.exists(at)
    if had and not moved(at, old):
        raise OSError(f"{path} could not be moved aside; it is as it was, the new rows are in {fresh}")
    # A file system may move the folder into one that has appeared meanwhile.
    if fs.exists(at) or not moved(new, at):
        if had and not fs.exists(at):
            moved(old, at)
        raise OSError(f"{fresh} could not be moved to {path}; the old rows are in {path if not fs.exists(old) else old.toString()}")
    if had:
        fs.delete(old, True)


def save(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap; ``df`` may read the table itself."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    swap(df.sparkSession, fresh, path)


def documents(chunks: DataFrame) -> DataFrame:
    """A row for each document: number of chunks, name and tags of its first chunk."""
    first = lambda c: F.min_by(c, F.struct("chunk_no", "id")).alias(c)
    return chunks.groupBy("document_id").agg(*[first(c) for c in ("dataset_id", "document_name", "department", "doc_type", "scope", "status")], F.count("*").alias("chunk_count"))


def sort_documents(docs: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """By name or status (whatever the case), chunks, size or upload; descending is the exact reverse of ascending."""
    key = {"name": F.lower("document_name"), "status": F.lower("status"), "chunks": F.col("chunk_count")}.get(by)
    if key is None:
        key = F.col(by) if by in docs.columns else F.lower("document_name")
    return docs.orderBy(key.desc() if descending else key.asc(), F.col("document_id").desc() if descending else F.col("document_id").asc())


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, their place in the order, from 0; rows that tie may take each other's. They are dealt by ranges of it, and a
    range's first place is the sum of the ranges before: no row is sorted in one task with all others. The dealt rows are written, as their
    ranges are read twice: planned twice, they would be cut otherwise by size. Give the columns that are needed alone."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "numbered")
    first = dealt.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = first.select("_p", "_m0", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    out = dealt.join(F.broadcast(first), "_p").select(*rows.columns, (F.col("_o") + F.col("_m") - F.col("_m0")).alias("pos"))  # a row for each range
    out._docloom_path = dealt._docloom_path
    return out


def department_counts(chunks: DataFrame, top: int = 20) -> DataFrame:
    return chunks.groupBy("department").agg(F.count("*").alias("chunks")).orderBy(F.col("chunks").desc(), "department").limit(top)


def tag_filter(docs: DataFrame, **tags: str) -> DataFrame:
    """Equal on each tag given; an empty value is any."""
    out = docs
    for name, value in tags.items():
        if value:
            out = out.where(F.col(name) == value)
    return out


def tag_values(docs: DataFrame, field: str) -> DataFrame:
    return docs.select(F.col(field).alias("value")).where("value <> ''").distinct().orderBy("value")


def content_search(chunks: DataFrame, q: str) -> DataFrame:
    return chunks.where(F.contains(F.lower("content"), F.lower(F.lit(q))))


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page ``number``, from 1; the order must tell rows apart."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, size: int, keys: list[str], after: tuple | None = None) -> DataFrame:
    """The ``size`` rows that follow the one with the values ``after`` of ``keys`` (none null, together unique); the first page without it.
    Where the rows lie sorted by the keys, those before are skipped by their files' statistics: a late page costs what the first does."""
    if after is not None:
        later = F.lit(False)
        for i in reversed(range(len(keys))):
            c, v = F.col(keys[i]), F.lit(after[i])
            later = (c > v) if i == len(keys) - 1 else (c > v) | ((c == v) & later)
        rows = rows.where((F.col(keys[0]) >= F.lit(after[0])) & later)
    return rows.orderBy(*keys).limit(size)


def cursor_of(page_: DataFrame, keys: list[str]) -> tuple | None:
    """The values of the last row of a page, to go on from; None for an empty page."""
    row = page_.orderBy(*[F.col(k).desc() for k in keys]).select(*keys).first()
    return tuple(row) if row else None


def by_sequence(chunks: DataFrame) -> DataFrame:
    """By the ``seq:`` keyword, as text of ten digits, missing last."""
    return chunks.orderBy(sequence_of(F.col("keywords")), "id")


def sequence_of(keywords: Column) -> Column:
    seq = F.get(F.filter(keywords, lambda k: k.startswith("seq:")), F.lit(0))
    return F.coalesce(F.lpad(F.substring(seq, 5, 1 << 20), 10, "0"), F.lit("9" * 10))


def scale_metrics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, datasets, mean length, and latency by the assumed 0.01 ms a chunk."""
    out = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("dataset_id").alias("datasets"), F.avg(F.char_length("content")).alias("a"))
    return out.select("total_chunks", "documents", "datasets", F.coalesce(F.bround("a", 1), F.lit(0.0)).alias("avg_chars"), F.bround(F.col("total_chunks") * 0.01, 2).alias("est_query_ms"))


def named(ids: Column, names: Column) -> Column:
    """The name of each id of an array, by place; the id itself where there is none."""
    return F.transform(F.arrays_zip(ids.alias("i"), names.alias("n")), lambda x: F.coalesce(x["n"], x["i"]))


def match_name(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.where(F.lower(column) == name.lower()).orderBy(column).limit(1)
