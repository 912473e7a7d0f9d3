"""Helpers that the training-data operators share: shared-folder tables, row keys, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import shared
from docloom.shared import shared_dir as shared_dir
from docloom.shared import ship as ship
from docloom.shared import written as stash  # cuts lineage, and its rows survive lost executors

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame | None) -> None:
    """Remove the files of a ``stash`` that nothing reads any more."""
    if df is not None:
        shared.discard(df)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew only if it has fewer partitions than the cluster has cores (a small table in one file). Not for inputs that
    are given row keys: these must come in the order of the files."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def keyed(df: DataFrame, key: str = "_row") -> DataFrame:
    """Add a row key that holds within one plan. It follows the splits of files, which may differ at the next reading (more cores):
    write the rows with it before they are used twice, or tell rows by what they hold."""
    return df.withColumn(key, F.monotonically_increasing_id())


#: What tells a row: whether it has an id, its id, and 128 bits of its text. It is the same at each reading of a table, however
#: its files are split; rows that share it are repeated rows.
ROW = ["_none", "_id", "_t1", "_t2"]


def with_row(docs: DataFrame, *more: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``ROW``; further columns that tell rows apart go into the hashes."""
    held = [F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")), *[F.coalesce(F.concat(F.lit("t"), F.col(c)), F.lit("")) for c in more]]
    return docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_t1": F.xxhash64(*held), "_t2": F.xxhash64(*held, F.lit(1))})


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of the text; ``['']`` where there is none (null included)."""
    return F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def steps_of(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at a time: so many at most, and so many bytes of the column (strings), but one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def tidied(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task makes; at its end memory that is free goes back to the system, since workers stay and wait for the next task."""
    yield from made
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for each node but the roots, ``root`` being the smallest node of its component. A hub's edges are
    never gathered in one task: minima are aggregated map-side, then joined, and the join may be split by AQE. Each round is
    written to the shared folder, so its cost is that of the edges alone.
    """
    spark = edges.sparkSession
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        small = large.join(least.withColumnRenamed("b", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        after = stash(small.unionByName(least).distinct(), "edges")
        discard(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (seen["n"], seen["h"]) == sign:
            break
        sign = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._docloom_path = now._docloom_path
    return out
