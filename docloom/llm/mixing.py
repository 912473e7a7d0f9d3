"""Mixing sources to target weights by systematic sampling.

Targets are words for each source. Within a source, each document expects ``target / source_size`` copies; documents are put in
order, their expected copies are prefix-summed, one random offset is added, and a document is emitted once for each integer
boundary that its stretch crosses. The order is by size, so that each stretch of the line holds documents of like sizes and
the words taken come near the target. DataFrame and window functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ROW, n_words, stash, table, with_row

WEIGHTS = (5, 2, 1)
#: No source is given more than this many times its size.
CAP = 3
SEED = 42


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, a row for each source.

    Sources by code point, null last, take the weights in turn and share the whole. A source whose share is above ``cap`` times
    its size gets that; the excess is shared by weight among the others. Sorted by ``cap * size / weight``, sources are capped
    up to the first whose share of what remains is not above its cap. The windows hold a row for each source.
    """
    all_ = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn - 1) % len(weights) + 1))
    rows = rows.withColumns({"_most": cap * F.col("source_size"), "_all": F.sum("source_size").over(all_)})
    up = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_level": (F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0))) / F.sum("_w").over(after), "_at": F.row_number().over(up)})
    free = F.col("_most") >= F.col("_level") * F.col("_w")
    rows = rows.withColumn("_first", F.min(F.when(free, F.struct("_at", "_level"))).over(all_))
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), F.col("_most").cast("double")).otherwise(F.col("_first._level") * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in (0, 1) for each source, the same at each run; multiples of 2**-20, so that sums with ranks stay exact."""
    named = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("is "), source)))
    return (F.conv(F.substring(F.sha2(named, 256), 1, 5), 16, 10).cast("long") % ((1 << 20) - 1) + 1) / F.lit(float(1 << 20))


def dealt_in_order(rows: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """``rows(source, size, doc_id, ...)`` by source, size, doc_id and the columns ``ties``, written once with ``_part`` and their place
    ``_at``. The rows are dealt by ranges of that order, so that a hot source lies in many; the last column of the order is a row key,
    which parts rows that are alike in all else and could change places."""
    order = [F.col("source").asc_nulls_first(), F.col("size"), F.col("doc_id").asc_nulls_first(), *map(F.col, ties), F.col("_like")]
    columns = rows.columns
    rows = rows.withColumn("_like", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(dealt.select(*columns).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")


def ranked(dealt: DataFrame) -> DataFrame:
    """Rows in order with ``_rank``, from 1 within the source: the place from the source's first row in the range, added to the
    source's rows in the ranges before. The counts joined to the rows are one for each range and source in it."""
    counts = dealt.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = dealt.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return met.select(*dealt.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_rank"))


def copied(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, ties: Sequence[str] = ()) -> DataFrame:
    """``rows(source, size, doc_id, ...)`` with ``source_size``, ``target`` and ``copies``. Rows that tie in these three are told apart by ``ties``."""
    dealt = dealt_in_order(rows, ties)
    aims = targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).withColumnRenamed("source", "_s")
    met = ranked(dealt).join(aims, F.col("source").eqNullSafe(F.col("_s")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(offset(F.col("source"), seed) + F.col("_rank") * share) - F.floor(offset(F.col("source"), seed) + (F.col("_rank") - 1) * share)
    return met.select(*rows.columns, "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for each row of ``docs(doc_id, text, source)``.

    Sizes are words, of whole texts of any length; null and empty texts have none. Repeated rows are rows of their own; null sources are one
    source, the last. A source of size 0 has target 0 and takes nothing; an empty table gives no rows; other columns are ignored. Rows of
    one source, size and id tie, and it makes no difference which of them is taken. Reruns on the same rows agree.
    """
    sizes = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")  # texts are read once
    return copied(sizes, weights, cap, seed)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they were.

    The mix is made of ids, sources, sizes and hashes of the texts alone; rows are found again by what they hold, and ranked by it, so that
    ties in source, size and id (such as null ids) don't follow the splits of files. Repeated rows share the copies that all of them have.
    Null and empty texts have size 0: they cross no boundary but that of a neighbour's, and cost no words. An empty table gives no rows.
    """
    sizes = with_row(docs.select("doc_id", "source", "text"), "source").select("doc_id", "source", n_words(F.col("text")).alias("size"), *ROW)
    copies = copied(stash(sizes, "sizes"), ties=ROW, **how).groupBy(*ROW).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = with_row(docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_all")), "source").join(copies, ROW)
    nth = F.row_number().over(Window.partitionBy(*ROW).orderBy("_t1"))
    own = rows.withColumn("_nth", nth).withColumn("_own", F.expr("int(_copies * _nth div _rows - _copies * (_nth - 1) div _rows)")).where("_own > 0")
    return own.select("_all", F.explode(F.sequence(F.lit(1), F.col("_own"))).alias("_copy")).select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same mix in SQL (ids tell the rows apart here, so ranks need no row key).
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS at_, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(at_) AS first, arg_min(level, at_) AS level FROM o WHERE most >= level * w),
t AS (SELECT o.source, source_size, CASE WHEN f.first IS NULL OR at_ < f.first THEN most::DOUBLE ELSE f.level * w END AS target FROM o, f),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS n FROM d),
x AS (SELECT doc_id, size, source_size, target, n, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
  (('0x' || substr(sha256('42:' || CASE WHEN r.source IS NULL THEN 'null' ELSE 'is ' || r.source END), 1, 5))::BIGINT % 1048575 + 1) / 1048576.0::DOUBLE AS u FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(u + n * share) - floor(u + (n - 1) * share), 3) * size)::BIGINT AS taken FROM x
"""
