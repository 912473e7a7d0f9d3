"""Who may see which chunk. Retrieval and scans take a viewer; there is no way round it by default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Viewer:
    dataset_id: str
    is_admin: bool = False
    department: str | None = None


def visible_to(dataset: Column, is_admin: Column, department: Column, row: DataFrame | None = None) -> Column:
    """The access predicate over the columns of chunks: the dataset's; for others than admins in force, and company-wide or of
    the viewer's department (a blank department sees what is company-wide)."""
    c = (lambda n: row[n]) if row is not None else F.col
    own = (F.trim(F.coalesce(department, F.lit(""))) != "") & (c("department") == department)
    return (c("dataset_id") == dataset) & (is_admin | ((c("status") == "in_force") & ((c("scope") == "company") | own)))


def visible(v: Viewer) -> Column:
    return visible_to(F.lit(v.dataset_id), F.lit(v.is_admin), F.lit(v.department))


def viewer_columns(users: DataFrame) -> DataFrame:
    """Users with the dataset they read: an admin's own, else the first admin's (by creation) that has one; ``error`` if none."""
    admins = users.where(F.col("is_admin") & (F.trim(F.coalesce("dataset_id", F.lit(""))) != ""))
    shared = admins.agg(F.min_by("dataset_id", F.struct("created_at", "username")).alias("_shared"))  # one row
    own = F.when(F.col("is_admin") & (F.trim(F.coalesce("dataset_id", F.lit(""))) != ""), F.col("dataset_id"))
    out = users.crossJoin(F.broadcast(shared)).withColumn("reads_dataset", F.coalesce(own, "_shared")).drop("_shared")
    return out.withColumn("error", F.when(F.col("reads_dataset").isNull(), F.lit("no dataset")))


def viewer_of(users: DataFrame, username: str) -> Viewer | None:
    """The viewer for one user: reads a row of the users' table; None if there is no such user or no dataset to read."""
    row = viewer_columns(users).where(F.col("username") == username).select("reads_dataset", "is_admin", "department").first()
    return Viewer(row["reads_dataset"], bool(row["is_admin"]), row["department"]) if row and row["reads_dataset"] else None


def first_admin(users: DataFrame) -> DataFrame:
    return users.where(F.col("is_admin") & (F.trim(F.coalesce("dataset_id", F.lit(""))) != "")).orderBy("created_at", "username").limit(1)


def with_dataset(users: DataFrame) -> DataFrame:
    """``users``, of whom each admin without a dataset is given a new one; its id follows from the username, so that a repeated run makes
    the same."""
    none = F.coalesce(F.col("is_admin"), F.lit(False)) & (F.trim(F.coalesce("dataset_id", F.lit(""))) == "")
    return users.withColumn("dataset_id", F.when(none, F.left(F.sha2(F.concat(F.lit("dataset:"), "username"), 256), F.lit(32))).otherwise(F.col("dataset_id")))


def valid_username(c: Column) -> Column:
    """Three characters or more: letters and digits of any script, ``_`` and ``-``."""
    return c.rlike(r"\A[\p{L}\p{Nd}_-]{3,}\z")


def valid_password(c: Column) -> Column:
    """Six characters or more, not all of them blank."""
    return (F.char_length(c) >= 6) & c.rlike(r"(?U)\S")


def valid_template_id(c: Column) -> Column:
    return c.rlike("^[a-f0-9]{32}$")


def is_image(name: Column) -> Column:
    return name.rlike(r"(?i)\.(png|jpe?g|gif|webp)$")


def is_pdf(name: Column) -> Column:
    return name.rlike(r"(?i)\.pdf$")
