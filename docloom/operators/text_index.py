"""Substring search over a versioned table: a signature of each folder's texts tells which folders can hold the string; these alone are read.

A signature is the set of all stretches of three bytes of the lower-cased texts, each hashed to one of ``BITS`` bits, kept as words of 64.
Folders never change, so a signature holds as long as its folder; after a write only new folders are taken in, and a folder without a
signature is always read. What is read is compared with the whole string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_or_empty
from docloom.operators.versioned import VersionedTable
from docloom.shared import ship

BITS = 1 << 18
#: Words of a signature that lie in one folder, and bytes of text that are taken apart at once.
WORDS_A_PART, STEP = 256, 1 << 20
#: Marks that a folder has a signature, be it empty.
PRESENT = -1


def positions(data: np.ndarray) -> np.ndarray:
    """The bits of all stretches of three bytes."""
    x = data.astype(np.uint64)
    three = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    return ((three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


class SubstringIndex:
    def __init__(self, table: VersionedTable, path: str, text: str = "content") -> None:
        ship(table.spark)
        self.table, self.text = table, text
        self.signatures = VersionedTable(table.spark, path)

    def refresh(self) -> SubstringIndex:
        """Take in the folders that have no signature yet."""
        m, known = self.table.manifest(), self._known()
        new = [f for f in m.folders if f not in known]
        if not self.signatures.version():
            self.signatures.create(self._signed(m, new), ["word", "folder"], ["_part"])
        elif new:
            self.signatures.append(self._signed(m, new))
        return self

    def _known(self) -> set[str]:
        """Names of folders, some bytes each, as in a manifest."""
        if not self.signatures.version():
            return set()
        return {r["folder"] for r in self.signatures.read().where(F.col("_part") == PRESENT).select("folder").distinct().collect()}

    def _signed(self, m, folders: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, np.ndarray] = {}  # a task reads a few folders
            for batch in batches:
                for file, text in zip(batch.column("_file").to_pylist(), batch.column("_text")):
                    bits = seen.setdefault(file.rpartition("/")[0], np.zeros(BITS, bool))
                    data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else np.zeros(0, np.uint8)
                    for i in range(0, max(0, len(data) - 2), STEP):
                        bits[positions(data[i : i + STEP + 2])] = True
            for folder, bits in seen.items():
                words = np.packbits(bits, bitorder="little").view(np.int64)
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array([folder] * (len(at) + 1)), pa.array([PRESENT, *at], pa.int32()), pa.array([0, *words[at]], pa.int64())], names=["folder", "word", "bits"])

        rows = self.table._rows(m, folders)
        if not folders:
            found = self.table.spark.createDataFrame([], "folder string, word int, bits long")
        else:
            texts = rows.select(F.col("_metadata.file_path").alias("_file"), F.lower(text_or_empty(F.col(self.text))).cast("string").alias("_text"))
            found = texts.mapInArrow(run, "folder string, word int, bits long").groupBy("folder", "word").agg(F.bit_or("bits").alias("bits"))
        name = F.url_decode(F.replace(F.regexp_extract("folder", r"/data/(v=.*)$", 1), F.lit("+"), F.lit("%2B")))
        names = found.where(F.col("word") == PRESENT).select("folder", name.alias("name"))
        found = found.join(names, "folder").drop("folder").withColumnRenamed("name", "folder")
        part = F.when(F.col("word") == PRESENT, PRESENT).otherwise(F.floor(F.col("word") / WORDS_A_PART)).cast("int")
        return found.select("word", "folder", "bits", part.alias("_part"))

    def folders(self, q: str) -> list[str]:
        """Folders of the table that may hold ``q``, whatever the case."""
        m = self.table.manifest()
        small = self.table.spark.range(1).select(F.lower(F.lit(q)).alias("q")).first()["q"].encode()
        if len(small) < 3 or not self.signatures.version():
            return m.folders
        need: dict[int, int] = {}
        for b in np.unique(positions(np.frombuffer(small, np.uint8))).tolist():
            need[b >> 6] = need.get(b >> 6, 0) | 1 << (b & 63)
        masks = self.table.spark.createDataFrame([(w, v - (1 << 64) if v >> 63 else v) for w, v in need.items()], "_w int, _mask long")  # of the string's own bits
        parts = sorted({w // WORDS_A_PART for w in need})
        rows = self.signatures.read().where(F.col("_part").isin(parts) & F.col("word").isin(list(need)))
        fit = rows.join(masks, F.col("word") == F.col("_w")).where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).groupBy("folder").count().where(F.col("count") == len(need))
        able, known = {r["folder"] for r in fit.collect()}, self._known()
        return [f for f in m.folders if f in able or f not in known]

    def search(self, q: str) -> DataFrame:
        """Rows whose text holds ``q``, whatever the case."""
        m = self.table.manifest()
        own = set(self.folders(q))
        rows = self.table._rows(m, [f for f in m.folders if f in own])
        return rows.where(F.contains(F.lower(self.text), F.lower(F.lit(q))))
