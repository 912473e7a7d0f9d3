"""Tables in versions: files never change, a manifest names those that make up a version, and a write touches only what it changes.

A table is a folder: ``data/v=<n>-<writer>/<partition folders>/`` holds what version n wrote, ``manifest/<n>.json`` the list of the folders
of that version, the schema and some properties. A commit is one rename of a manifest to a name that must not exist: readers see the old
version or the new one, and of two writers of one version one fails. A merge writes the new rows, looks for their keys in the old folders
(by the key columns alone, and only in the partitions where the keys can be), and writes those folders again that hold one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that stay readable when old files are removed.
KEEP = 2
#: Buckets that the chunks of one document lie in, at most.
SPREAD = 4


class Conflict(RuntimeError):
    """Another writer has committed meanwhile: read again, and repeat the write."""


def bucket_of(buckets: int, *keys: Column) -> Column:
    """A row's bucket by its keys; in a table that is merged by key, one of the partition columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def chunk_bucket(buckets: int, span: int = 4096, spread: int | None = SPREAD) -> Column:
    """The bucket of a chunk: all chunks of a document lie in one, but for documents of more than ``span`` chunks, which lie in several, at most
    ``spread``: however long they grow, a change of one doesn't touch the others' buckets. Without ``spread`` a long document lies in all."""
    place = F.floor(F.coalesce("chunk_no", F.lit(0)) / span)
    if spread is None:
        return bucket_of(buckets, F.col("document_id"), place)
    return F.pmod(bucket_of(buckets, F.col("document_id")) + F.pmod(place, F.lit(spread)), F.lit(buckets)).cast("int")


def _nullable(schema: T.StructType) -> str:
    """The schema as JSON, with nulls allowed everywhere: later rows may have them."""
    out = schema.json()
    for word in ("nullable", "containsNull", "valueContainsNull"):
        out = out.replace(f'"{word}":false', f'"{word}":true')
    return out


@dataclass
class Manifest:
    version: int
    schema: str
    keys: list[str]
    parts: list[str]
    bucket: str | None
    folders: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)


class VersionedTable:
    """A table merged by ``keys``, laid out by ``parts``; ``bucket`` names the one of the parts that the keys determine;
    ``compression`` is that of its files, Spark's own where none is said."""

    def __init__(self, spark: SparkSession, path: str, compression: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._options = {"compression": compression} if compression else {}
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # Files -----------------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("data").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def version(self) -> int:
        """The latest version; 0 where there is no table."""
        return max((int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = version or self.version()
        stream = self._fs().open(self._at(f"manifest/{version:010d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, m: Manifest) -> None:
        fs, new, at = self._fs(), self._at(f"manifest/.{m.version:010d}-{uuid.uuid4().hex}"), self._at(f"manifest/{m.version:010d}.json")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        none = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # fails where the name is taken
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(fs.makeQualified(new), fs.makeQualified(at), none)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {m.version} of {self.path} has been written by another") from None
            raise

    def _folders(self, top: str, depth: int) -> list[str]:
        found = [top]
        for _ in range(depth):
            found = [f"{f}/{n}" for f in found for n in self._names(f"data/{f}") if "=" in n]
        return found

    def _write(self, df: DataFrame, top: str, m: Manifest, dealt: bool = False) -> None:
        order = [c for c in m.keys if c not in m.parts]
        # A partition's rows are gathered where they are written, in few files; AQE splits what is large. Rows that the caller has dealt stay.
        (df if dealt else df.hint("rebalance", *m.parts)).sortWithinPartitions(*m.parts, *order).write.mode("append").options(**self._options).partitionBy(*m.parts).parquet(f"{self.path}/data/{top}")

    # Reading ---------------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; later writes don't change what is read."""
        m = self.manifest(version)
        return self._rows(m, m.folders)

    def _rows(self, m: Manifest, folders: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        # A folder is of one version; its name is a column that is left out.
        whole = T.StructType([*schema.fields, T.StructField("v", T.StringType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*[self._escaped(f) for f in folders]).select(*schema.names)

    def _escaped(self, folder: str) -> str:
        """Partition values may hold characters that a path pattern would take as its own."""
        return f"{self.path}/data/" + "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in folder)

    # Writing ---------------------------------------------------------------------------------------------------------------

    def create(self, df: DataFrame, keys: Sequence[str], parts: Sequence[str], bucket: str | None = None, dealt: bool = False, **properties) -> int:
        """Version 1, or the next one, with these rows alone. No two rows may share their keys. ``dealt``: a task has rows of few partitions
        already, and they aren't shuffled again."""
        m = Manifest(self.version() + 1, _nullable(df.schema), list(keys), list(parts), bucket, properties=properties)
        top = f"v={m.version}-{uuid.uuid4().hex[:8]}"
        self._write(df, top, m, dealt)
        m.folders = self._folders(top, len(m.parts))
        self._commit(m)
        return m.version

    def merge(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, **properties) -> int:
        """The next version: ``upserts`` in place of the rows of their keys, without the rows whose keys are in ``deletes``. Of several
        upserts of one key which counts is open: give one. A null key meets a null key. Properties are added to those of the table."""
        m = self.manifest()
        top = f"v={m.version + 1}-{uuid.uuid4().hex[:8]}"
        wanted = [*dict.fromkeys([*m.keys, *([m.bucket] if m.bucket else [])])]
        changed = None
        if upserts is not None:
            schema = T.StructType.fromJson(json.loads(m.schema))
            self._write(upserts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), top, m)
            changed = self._rows(m, self._folders(top, len(m.parts))).select(*wanted)  # read back: computed once
        if deletes is not None:
            gone = deletes.select(*wanted).distinct()
            changed = gone if changed is None else changed.unionByName(gone)
        if changed is None:
            return m.version
        written = self._folders(top, len(m.parts))
        buckets = [r[0] for r in changed.select(m.bucket).distinct().collect()] if m.bucket else None  # at most as many as there are
        changed = changed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(m.keys)]).distinct()
        same = lambda: [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(m.keys)]
        hit = self._holding(m, changed, same(), buckets)
        if hit:
            self._write(self._rows(m, hit).join(changed, same(), "left_anti"), top, m)
        taken = set(hit)
        m.folders = [f for f in m.folders if f not in taken] + self._folders(top, len(m.parts))
        if not hit and not written:
            return m.version
        m.version += 1
        m.properties |= properties
        self._commit(m)
        return m.version

    def append(self, rows: DataFrame, dealt: bool = False, **properties) -> int:
        """The next version: these rows beside the others, whose keys they must not share. ``dealt``: as for ``create``."""
        m = self.manifest()
        top = f"v={m.version + 1}-{uuid.uuid4().hex[:8]}"
        schema = T.StructType.fromJson(json.loads(m.schema))
        self._write(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), top, m, dealt)
        m.folders += self._folders(top, len(m.parts))
        m.version += 1
        m.properties |= properties
        self._commit(m)
        return m.version

    def _holding(self, m: Manifest, changed: DataFrame, same: list[Column], buckets: list | None) -> list[str]:
        """The folders that hold a changed key."""
        if not m.folders:
            return []
        old = self._rows(m, m.folders)
        old = old if buckets is None else old.where(F.col(m.bucket).isin(buckets))
        where = old.select(*m.keys, F.col("_metadata.file_path").alias("_file")).join(changed, same, "left_semi").select(F.regexp_extract("_file", r"/data/(v=.*)/[^/]*$", 1).alias("f")).distinct()
        found = {unquote(r["f"]) for r in where.collect()}  # some of the manifest's
        return [f for f in m.folders if f in found]

    def delete(self, where: Column) -> int:
        """Without the rows for which ``where`` is true."""
        return self.merge(deletes=self.read().where(where))

    def update(self, where: Column, **values: Column) -> int:
        """Other values for the rows for which ``where`` is true; keys stay as they are."""
        m = self.manifest()
        if set(values) & {*m.keys, m.bucket}:
            raise ValueError("keys can't be updated: delete, and insert")
        return self.merge(self.read().where(where).withColumns(values))

    def compact(self, most: int = 8) -> int:
        """Write anew the partitions that lie in more than ``most`` folders."""
        m = self.manifest()
        by: dict[str, list[str]] = {}
        for f in m.folders:
            by.setdefault(f.partition("/")[2], []).append(f)
        many = [f for own in by.values() if len(own) > most for f in own]
        if not many:
            return m.version
        m.version += 1
        top = f"v={m.version}-{uuid.uuid4().hex[:8]}"
        self._write(self._rows(m, many), top, m)
        taken = set(many)
        m.folders = [f for f in m.folders if f not in taken] + self._folders(top, len(m.parts))
        self._commit(m)
        return m.version

    def vacuum(self, keep: int = KEEP) -> list[str]:
        """Remove the manifests before the last ``keep`` versions, and what no manifest left names. Not while a writer is at work: what it has
        written but not committed would go as well."""
        last = self.version()
        old = [n for n in self._names("manifest") if not n.endswith(".json") or int(n[:-5]) <= last - keep]
        used = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v).folders}
        gone = []
        for top in self._names("data"):
            if not top.startswith("v="):
                continue
            own = self._folders(top, len(self.manifest(last).parts))
            for f in own:
                if f not in used:
                    self._fs().delete(self._at(f"data/{f}"), True)
                    gone.append(f)
            if not any(f in used for f in own):
                self._fs().delete(self._at(f"data/{top}"), True)
        for n in old:
            self._fs().delete(self._at(f"manifest/{n}"), False)
        return gone
