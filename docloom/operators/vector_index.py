"""A kept index for nearest neighbours by cosine: vectors lie by dataset and cell, and a question reads the cells that can matter.

Cells are fitted on a bounded sample of each dataset (spherical k-means); every vector is in the index, in the cell of the centroid nearest
to it. A table of cells holds, for each combination of tags, how many vectors a cell has and the widest angle of one to the centroid. So
the access filter counts before the cut: a question takes its nearest cells until these hold as many vectors that it may see as it wants
candidates. An exact search then goes on to all other cells in which, by the triangle inequality of angles, a better vector can lie.
Both tables are versioned; a search reads the vectors of the version that its table of cells was made for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.vectors import dot, norm
from docloom.operators.acl import visible_to
from docloom.operators.retrieval import SPREAD, TOP, top_k
from docloom.operators.versioned import VersionedTable
from docloom.shared import ship

#: Vectors that a question looks at, at least, where a dataset has as many.
CANDIDATES = 240
#: Cells of all datasets together, and numbers in their centroids: what is sent to the executors. Vectors that a cell has at least, about.
MOST_CELLS, MOST_NUMBERS, CELL_ROWS = 4096, 1 << 23, 64
#: Vectors (and numbers in them) of a dataset that its cells are fitted on, at most, and rounds of fitting.
SAMPLE, SAMPLE_NUMBERS, ROUNDS = 65_536, 1 << 24, 10
TAGS = ["department", "scope", "status"]
#: The cell of vectors that are of another length than the dataset's centroids.
ODD = -1
_KEPT = ["id", "dataset_id", *TAGS, "embedding"]


def usable(embedding: Column) -> Column:
    """Vectors that take part: not null, empty or zero, and finite in all components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & (norm(embedding) > 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fitted(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``cells`` cells of unit vectors; an empty cell is put where vectors are furthest from theirs."""
    x = _unit(x.astype(np.float64))
    cells = min(cells, len(x))
    centre = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        own, near = _nearest(x, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=cells)
        empty = np.flatnonzero(size == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        centre = _unit(sums)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the nearest centroid and its cosine, some vectors at a time."""
    own, near, step = np.zeros(len(x), np.int64), np.zeros(len(x)), max(1, (1 << 22) // len(centre))
    for i in range(0, len(x), step):
        cosine = x[i : i + step] @ centre.T
        own[i : i + step] = cosine.argmax(axis=1)
        near[i : i + step] = cosine[np.arange(len(cosine)), own[i : i + step]]
    return own, near


class VectorIndex:
    """``rows``: id, dataset, tags and vector by dataset and cell; ``cells``: counts and widest angles; ``centroids``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        self.spark = spark
        self.rows, self.cells, self.centroids = (VersionedTable(spark, f"{path.rstrip('/')}/{n}") for n in ("rows", "cells", "centroids"))

    # Making and keeping ----------------------------------------------------------------------------------------------------

    def build(self, chunks: DataFrame, seed: int = 7) -> VectorIndex:
        """From ``chunks(id, dataset_id, department, scope, status, embedding)``; ids must be unique. Fits cells and puts all vectors in."""
        own = chunks.select(*_KEPT).where(usable(F.col("embedding")))
        sizes = own.groupBy("dataset_id", F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("dataset_id").orderBy(F.col("n").desc(), "dims")
        sizes = sizes.withColumns({"rank": F.row_number().over(w), "all": F.sum("n").over(Window.partitionBy())}).where("rank = 1")
        # Cells in proportion to the vectors; a dataset that would have one alone needs no centroid.
        most = F.least(F.lit(MOST_CELLS), F.floor(MOST_NUMBERS / F.col("dims")), F.ceil(F.col("all") / CELL_ROWS))
        sizes = sizes.withColumn("cells", F.floor(F.col("n") / F.col("all") * most).cast("int")).where("cells > 1")
        sizes = sizes.withColumn("sample", F.least(F.lit(SAMPLE), F.floor(SAMPLE_NUMBERS / F.col("dims"))))
        share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.col("sample") / F.col("n") * (1 << 30)
        met = own.join(sizes.withColumnRenamed("dataset_id", "_d"), F.col("dataset_id").eqNullSafe(F.col("_d")) & (F.size("embedding") == F.col("dims"))).where(share)

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            """A dataset's sample."""
            frame = frame.sort_values("id")
            centre = fitted(np.stack(frame["embedding"].to_list()), int(frame["cells"].iloc[0]), seed)
            return pd.DataFrame({"dataset_id": [frame["dataset_id"].iloc[0]] * len(centre), "cell": np.arange(len(centre)), "centroid": list(centre)})

        centres = met.select("id", "dataset_id", "embedding", "cells").groupBy("dataset_id").applyInPandas(fit, "dataset_id string, cell int, centroid array<double>")
        self.centroids.create(centres, ["dataset_id", "cell"], [])
        version = self.rows.create(self._celled(own), ["id"], ["dataset_id", "cell"], vectors=0)
        self.cells.create(self._counted(self.rows.read(version)), ["dataset_id", "cell", *TAGS], [], rows=version)
        return self

    def _centres(self) -> dict[str | None, np.ndarray]:
        """At most ``MOST_NUMBERS`` numbers."""
        out: dict = {}
        for r in self.centroids.read().orderBy("dataset_id", "cell").collect():
            out.setdefault(r["dataset_id"], []).append(r["centroid"])
        return {k: np.array(v) for k, v in out.items()}

    def _celled(self, own: DataFrame) -> DataFrame:
        """Vectors with the cell of their nearest centroid and the angle to it."""
        centres = self._centres()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                datasets = batch.column("dataset_id").to_pylist()
                vectors = batch.column("embedding").to_pylist()
                cell, angle = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.pi)
                by: dict = {}
                for i, (d, v) in enumerate(zip(datasets, vectors)):
                    if d in centres:
                        by.setdefault(d if len(v) == centres[d].shape[1] else (d,), []).append(i)
                for d, at in by.items():
                    if isinstance(d, tuple):
                        cell[at] = ODD
                    else:
                        own, near = _nearest(_unit(np.array([vectors[i] for i in at], np.float64)), centres[d])
                        cell[at], angle[at] = own, np.arccos(np.clip(near, -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        schema = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        return own.mapInArrow(run, schema)

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dataset_id", "cell", *TAGS).agg(F.count("*").alias("n"), F.max("angle").alias("angle"))

    def upsert(self, chunks: DataFrame) -> int:
        """Chunks in place of those of their ids; those without a usable vector go. Cells stay as fitted; only touched ones are counted anew."""
        own = chunks.select(*_KEPT)
        fits = usable(F.col("embedding"))
        return self._changed(self._celled(own.where(fits)), own.where(~fits).select("id"))

    def delete(self, ids: DataFrame) -> int:
        return self._changed(None, ids.select("id"))

    def _changed(self, upserts: DataFrame | None, deletes: DataFrame) -> int:
        before = self.rows.manifest(self._version())
        version = self.rows.merge(upserts, deletes)
        # Cells of the folders that came or went.
        moved = set(before.folders) ^ set(self.rows.manifest(version).folders)
        if moved:
            there = _among({tuple(r) for r in self.rows._rows(before, sorted(moved)).select("dataset_id", "cell").distinct().collect()})
            self.cells.merge(self._counted(self.rows.read(version).where(there)), self.cells.read().where(there), rows=version)
        return version

    def _version(self) -> int:
        return self.cells.manifest().properties["rows"]

    # Searching -------------------------------------------------------------------------------------------------------------

    def plan(self, queries: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
        """``query_id, q_*, cell, before, bound``: for each question the cells of its dataset that hold a vector it may see, the number of
        such vectors in the cells nearer to it, and the greatest cosine that a vector of the cell can have."""
        centres = self._centres()
        names = ["query_id", "q_dataset", "q_admin", "q_department", "q_vector"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own = batch.slice(i, 1)
                    centre, v = centres.get(own.column("q_dataset")[0].as_py()), np.array(own.column("q_vector")[0].as_py(), np.float64)
                    if centre is None:
                        cell, cosine = [0], np.zeros(1)
                    elif centre.shape[1] != len(v):
                        cell, cosine = [ODD], np.zeros(1)
                    else:
                        cell, cosine = np.arange(len(centre)), centre @ (v / np.linalg.norm(v))
                    same = [c.take(pa.array(np.zeros(len(cell), np.int32))) for c in own.columns]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(cell, pa.int32()), pa.array(cosine)], names=[*names, "cell", "cosine"])

        q = queries.select("query_id", F.col("dataset_id").alias("q_dataset"), F.col("is_admin").alias("q_admin"), F.col("department").alias("q_department"), F.col("vector").alias("q_vector")).where(usable(F.col("q_vector")))
        met = q.mapInArrow(run, T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
        cells = self.cells.read().withColumnRenamed("cell", "_cell")
        met = met.join(cells, visible_to(F.col("q_dataset"), F.col("q_admin"), F.col("q_department"), cells) & (F.col("cell") == F.col("_cell")))
        met = met.groupBy(*names, "cell", "cosine").agg(F.sum("n").alias("n"), F.max("angle").alias("angle"))
        before = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
        away = F.greatest(F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))) - F.col("angle") - 1e-7, F.lit(0.0))
        return met.select(*names, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.cos(away).alias("bound"))

    def vectors(self, plan: DataFrame) -> DataFrame:
        """The index's rows in the cells of a plan: other cells' files are not read."""
        cells = {tuple(r) for r in plan.select("q_dataset", "cell").distinct().collect()}  # of the questions' datasets
        return self.rows.read(self._version()).where(_among(cells))

    def _scored(self, plan: DataFrame) -> DataFrame:
        rows = self.vectors(plan)
        q = plan.withColumnRenamed("cell", "_cell")
        met = rows.join(q, (F.col("cell") == F.col("_cell")) & visible_to(F.col("q_dataset"), F.col("q_admin"), F.col("q_department"), rows) & (F.size("embedding") == F.size("q_vector")))
        return met.select("query_id", "id", (dot(F.col("embedding"), F.col("q_vector")) / (norm(F.col("embedding")) * norm(F.col("q_vector")))).alias("score"))

    def search(self, queries: DataFrame, k: int = TOP * SPREAD, candidates: int = CANDIDATES, exact: bool = False) -> DataFrame:
        """``query_id, id, score, rank``, as ``retrieval.knn`` gives it: of the candidates, or, ``exact``, of all."""
        plan = self.plan(queries, candidates).persist()
        first = F.col("before") < candidates
        hits = top_k(self._scored(plan.where(first)), k)
        if not exact:
            return hits
        hits = hits.persist()
        least = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        more = plan.where(~first).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
        return top_k(hits.drop("rank").unionByName(top_k(self._scored(more), k).drop("rank")), k)


def _among(cells: set[tuple]) -> Column:
    """Rows of these pairs of dataset and cell, as a filter on folders."""
    by: dict = {}
    for d, c in cells:
        by.setdefault(d, []).append(c)
    out = F.lit(False)
    for d, own in by.items():
        out = out | (F.col("dataset_id").eqNullSafe(F.lit(d)) & F.col("cell").isin(sorted(own)))
    return out
