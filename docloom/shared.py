"""The folder that driver and executors share, and tables written to it: they cut lineage, and outlive lost executors."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        top = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp(prefix='docloom-')}/docloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted([*top.rglob("*.py"), *top.rglob("*.txt")]):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(path)


def by_value(module: str) -> None:
    """Functions of a module travel to workers whole, for those that start before the package is sent, or beside it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a temporary one."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="docloom-"))
    return _LOCAL[0]


def own_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path, schema = own_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._docloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_docloom_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
