"""The chunk store as a versioned table: by dataset and status, so that access decides which folders are read, and by bucket of the
document, so that a change of one document writes that bucket alone."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.acl import Viewer, visible
from docloom.operators.versioned import SPREAD, VersionedTable, chunk_bucket
from docloom.schemas import TAG_VALUES

KEYS, PARTS = ["document_id", "chunk_no"], ["dataset_id", "status", "_bucket"]
BUCKETS = 64


class ChunkStore:
    """Chunks by ``document_id`` and ``chunk_no``. Each write is a version; a reader keeps the one it began with."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path)

    def _laid(self, chunks: DataFrame, layout: dict | None = None) -> DataFrame:
        layout = layout or self.table.manifest().properties
        # A store that says nothing of a spread was laid out without one.
        return chunks.withColumn("_bucket", chunk_bucket(layout["buckets"], spread=layout.get("spread")))

    def create(self, chunks: DataFrame, buckets: int = BUCKETS) -> ChunkStore:
        layout = {"buckets": buckets, "spread": SPREAD}
        self.table.create(self._laid(chunks, layout), KEYS, PARTS, "_bucket", **layout)
        return self

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).drop("_bucket")

    def upsert(self, chunks: DataFrame) -> int:
        return self.table.merge(self._laid(chunks))

    def replace_documents(self, chunks: DataFrame, documents: DataFrame) -> int:
        """The chunks of ``documents(document_id)`` are ``chunks`` from now on."""
        had = self.table.read().join(documents.select("document_id").distinct(), "document_id", "left_semi")
        return self.table.merge(self._laid(chunks), had)

    def delete_document(self, document_id: str) -> int:
        return self.table.delete(F.col("document_id") == document_id)

    def set_tag(self, document_id: str, field: str, value: str) -> int:
        if field not in TAG_VALUES or value not in TAG_VALUES[field]:
            raise ValueError(f"no such tag: {field}={value}")
        there = (F.col("document_id") == document_id) & ~F.col(field).eqNullSafe(F.lit(value))
        return self.table.update(there, **{field: F.lit(value)})

    def scan(self, viewer: Viewer) -> DataFrame:
        """What one viewer may see: folders of other datasets, and for others than admins of other statuses, aren't read."""
        return self.read().where(visible(viewer))

    def visible_to_each(self, viewers: DataFrame) -> DataFrame:
        """``username`` and chunk, for all of ``viewers(username, dataset_id, is_admin, department)``. Which datasets are read follows from
        the viewers' table while the query runs; those in force alone are read for others than admins."""
        rows = self.read()
        v = viewers.select("username", F.col("dataset_id").alias("v_dataset"), F.col("is_admin").alias("v_admin"), F.col("department").alias("v_department")).where("v_dataset is not null")
        admins = rows.join(v.where("v_admin"), F.col("dataset_id") == F.col("v_dataset"))
        own = (F.trim(F.coalesce("v_department", F.lit(""))) != "") & (F.col("department") == F.col("v_department"))
        others = rows.where("status = 'in_force'").join(v.where("not coalesce(v_admin, false)"), (F.col("dataset_id") == F.col("v_dataset")) & ((F.col("scope") == "company") | own))
        return admins.unionByName(others).drop("v_dataset", "v_admin", "v_department")

    def reingest(self, fresh: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
        """``fresh(document_id, chunk_no, content, ...)`` in place of all chunks of its documents, written only where something changed.

        Chunks with the text of an old one keep its vector, wherever they have moved; the rest are embedded. New chunks have the tags of
        the document's first chunk. Returns the differences, as ``differences`` gives them."""
        old = self.read().join(fresh.select("document_id").distinct(), "document_id", "left_semi")
        found = differences(old, fresh)
        kept = found.where("old_no is not null").select("document_id", "old_no", F.col("new_no").alias("chunk_no"))
        vectors = old.select("document_id", F.col("chunk_no").alias("old_no"), F.col("embedding").alias("_vector"))
        tags = ["dataset_id", "document_name", *TAG_VALUES]
        first = old.groupBy("document_id").agg(*[F.min_by(c, "chunk_no").alias(c) for c in tags])
        rows = fresh.select("document_id", "chunk_no", *[c for c in fresh.columns if c in old.columns and c not in (*tags, *KEYS, "embedding")])
        rows = rows.join(kept.where("chunk_no is not null"), ["document_id", "chunk_no"], "left").join(vectors, ["document_id", "old_no"], "left")
        rows = rows.withColumn("embedding", F.when(F.col("old_no").isNotNull(), F.col("_vector")).otherwise(embed(F.col("content")))).join(first, "document_id", "left")
        # A chunk that stands where it stood isn't written.
        stays = found.where("old_no = new_no").select("document_id", F.col("new_no").alias("chunk_no"))
        rows = rows.join(stays, ["document_id", "chunk_no"], "left_anti")
        missing = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in rows.columns]
        gone = old.select(*KEYS).join(fresh.select(*KEYS), KEYS, "left_anti")
        before = self.table.version()
        self.table.merge(self._laid(rows.select("*", *missing).select(*old.columns)), self._laid(gone))
        return differences(self.read(before).join(fresh.select("document_id").distinct(), "document_id", "left_semi"), fresh)


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``document_id, kind, old_no, new_no`` between two sets of chunks ``(document_id, chunk_no, content)``.

    A chunk with the text, by hash, of the one that stands in its place is that; of the rest the k-th chunk with a text is the k-th with
    that text in the other set. Of a place, each set has one chunk. ``kept``: those of the longest run of such pairs that
    rises in both, so that as few as possible have moved; ``moved``: the other pairs; ``added`` and ``removed``: what has no partner.
    Texts themselves aren't gathered: for a document in which something changed its pairs of numbers are, some bytes a chunk, between the
    first and the last of them that stand elsewhere than before.
    """
    side = lambda df, name: df.select("document_id", F.sha2("content", 256).alias("h"), "chunk_no", F.lit(name).alias("side"))
    of = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    places = side(old, "old_no").unionByName(side(new, "new_no")).groupBy("document_id", "h", "chunk_no").agg(of("old_no", "chunk_no").alias("old_no"), of("new_no", "chunk_no").alias("new_no"))
    both = F.col("old_no").isNotNull() & F.col("new_no").isNotNull()
    rest = places.where(~both).select("document_id", "h", "chunk_no", F.when(F.col("old_no").isNotNull(), "old_no").otherwise("new_no").alias("side"))
    nth = F.row_number().over(Window.partitionBy("document_id", "h", "side").orderBy("chunk_no"))
    met = rest.withColumn("k", nth).groupBy("document_id", "h", "k").agg(of("old_no", "chunk_no").alias("old_no"), of("new_no", "chunk_no").alias("new_no"))
    met = places.where(both).select("document_id", "old_no", "new_no").unionByName(met.select("document_id", "old_no", "new_no"))
    pairs = met.where("old_no is not null and new_no is not null")
    # Pairs that change places with another: one before in the old order that comes later in the new one, or the other way round.
    # Both from frames that grow: one that shrinks is summed up anew for each row.
    upto = lambda *order: Window.partitionBy("document_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumns({"_most": F.max("old_no").over(upto(F.col("new_no"))), "_least": F.min("old_no").over(upto(F.col("new_no").desc()))})
    crossed = F.coalesce(F.col("_most") > F.col("old_no"), F.lit(False)) | F.coalesce(F.col("_least") < F.col("old_no"), F.lit(False))
    pairs = pairs.withColumn("_crossed", crossed).drop("_most", "_least")

    def rising(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("new_no")
        return frame.assign(kept=longest_rise(frame["old_no"].tolist()))[["document_id", "old_no", "new_no", "kept"]]

    among = pairs.where("_crossed").select("document_id", "old_no", "new_no").groupBy("document_id").applyInPandas(rising, "document_id string, old_no int, new_no int, kept boolean")
    named = lambda df, kind: df.select(F.col("document_id").cast("string").alias("document_id"), kind.alias("kind"), F.col("old_no").cast("int").alias("old_no"), F.col("new_no").cast("int").alias("new_no"))
    return (
        named(pairs.where("not _crossed"), F.lit("kept")).unionByName(named(among, F.when(F.col("kept"), "kept").otherwise("moved")))
        .unionByName(named(met.where("new_no is null"), F.lit("removed"))).unionByName(named(met.where("old_no is null"), F.lit("added")))
    )


def longest_rise(x: list[int]) -> list[bool]:
    """Which of some distinct numbers are of a longest rising run; of several such runs the one whose end is least, and so on back."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(x)
    for i, v in enumerate(x):
        k = bisect_left(ends, v)
        before[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(v), at.append(i)
        else:
            ends[k], at[k] = v, i
    out, i = [False] * len(x), at[-1] if at else -1
    while i >= 0:
        out[i], i = True, before[i]
    return out
