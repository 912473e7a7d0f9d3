"""Incremental ingestion: documents arrive as files, chunks are upserted, job states are kept. Uploads and reparses are two queues,
each a stream of its own; what a document has is what its latest job left, of whichever queue."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.chunking import layout_chunks
from docloom.operators.elements import text_elements
from docloom.operators.store import latest, numbered, swap
from docloom.shared import discard

JOB = "job_id string, dataset_id string, document_id string, text string, file_name string, department string, doc_type string, scope string, status string, queued_at timestamp"
REPARSE = "job_id string, document_id string, file_name string, queued_at timestamp"
TAGS = ["dataset_id", "document_name", "department", "doc_type", "scope", "status"]


def job_stream(spark: SparkSession, path: str, files_per_batch: int = 100, schema: str = JOB) -> DataFrame:
    """Jobs dropped as Parquet files; at most ``files_per_batch`` are taken at once, the rest waits in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _states(jobs: DataFrame, state: str, path: str) -> None:
    at = F.current_timestamp()
    jobs.select("job_id", "document_id", "file_name", F.lit(state).alias("state"), F.lit(None).cast("string").alias("message"), at.alias("at"), F.lit(None).cast("timestamp").alias("finished_at")).write.mode("overwrite").parquet(path)


#: A job's place among the jobs of a micro-batch; ids may be repeated or null.
_PLACE = "_place"


def chunks_of_texts(jobs: DataFrame) -> DataFrame:
    """The chunks of ``jobs(document_id, text)``, as the service makes them."""
    return layout_chunks(text_elements(jobs))


def _chunked(jobs: DataFrame, path: str, failed: list[tuple[str, str]], n: int, chunks_of: Callable[[DataFrame], DataFrame], first: int = 0, piece: str = "0") -> None:
    """Write the chunks of the ``n`` jobs whose places begin at ``first``. If that fails, they are halved by place until those that fail are
    alone: these alone are lost."""
    own = jobs.where((F.col(_PLACE) >= first) & (F.col(_PLACE) < first + n))
    try:
        chunks = chunks_of(own.where("trim(coalesce(text, '')) <> ''"))
        tags = own.select(F.col("document_id").alias("_d"), "job_id", "dataset_id", F.col("file_name").alias("document_name"), "department", "doc_type", "scope", "status")
        chunks.join(tags, F.col("document_id").eqNullSafe(F.col("_d"))).drop("_d").write.mode("overwrite").parquet(f"{path}/piece={piece}")
        discard(chunks)
    except Exception as e:
        if n <= 1:
            failed += [(r["document_id"], f"{type(e).__name__}: {e}"[:500]) for r in own.select("document_id").collect()]
            return
        _chunked(jobs, path, failed, n // 2, chunks_of, first, piece + "0")
        _chunked(jobs, path, failed, n - n // 2, chunks_of, first + n // 2, piece + "1")


def ingest_batch(jobs: DataFrame, chunks_path: str, states_path: str, batch_id: int, queue: str = "upload", chunks_of: Callable[[DataFrame], DataFrame] = chunks_of_texts) -> None:
    """One micro-batch: its jobs go from pending over processing to done or failed; the chunks of its documents are written under the
    batch's own folder. Of several jobs of a document the one queued last counts (of one time, that with the largest job_id), the others are
    done without effect. A document without chunks, or one that can't be worked on, fails alone. Writing the same batch again replaces it, so a restart adds
    nothing twice."""
    spark = jobs.sparkSession
    jobs = jobs.persist()
    own, log = f"{chunks_path}/queue={queue}/batch={batch_id}", f"{states_path}/queue={queue}/batch={batch_id}"
    try:
        for folder in (own, log):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _states(jobs, "pending", f"{log}/step=0")
        last = latest(jobs, ["document_id"], "queued_at", "job_id")
        # A row for each document of the batch, written as it gets its place: the places hold whatever is computed again.
        last = placed = numbered(last, F.col("document_id").asc_nulls_first())
        last = last.withColumnRenamed("pos", _PLACE)
        _states(last, "processing", f"{log}/step=1")
        failed: list[tuple[str, str]] = []
        _chunked(last, own, failed, last.count(), chunks_of)
        done = stored_chunks(spark, own).groupBy(F.col("document_id").alias("d")).agg(F.count("*").alias("n"))
        why = spark.createDataFrame(failed, "w string, why string")
        kept = last.select(F.col("document_id").alias("l"), F.col("job_id").alias("kept"), F.col("queued_at").alias("kept_at"))
        c = F.col
        rows = jobs.join(kept, c("document_id").eqNullSafe(c("l")), "left").join(done, c("document_id").eqNullSafe(c("d")), "left").join(why, c("document_id").eqNullSafe(c("w")), "left")
        old = ~(c("kept").eqNullSafe(c("job_id")) & c("kept_at").eqNullSafe(c("queued_at")))
        message = F.when(old, F.concat(F.lit("replaced by "), F.coalesce("kept", F.lit("a later job")))).otherwise(F.coalesce("why", F.when(c("n").isNull(), F.lit("no chunks"))))
        state = F.when(old | (c("n") > 0), "done").otherwise("failed")
        rows = rows.select("job_id", "document_id", "file_name", state.alias("state"), message.alias("message"), F.current_timestamp().alias("at"), F.current_timestamp().alias("finished_at"))
        rows.write.mode("overwrite").parquet(f"{log}/step=2")
        discard(placed)
    finally:
        jobs.unpersist()


def ingest(stream: DataFrame, chunks_path: str, states_path: str, checkpoint: str, available_now: bool = True, chunks_of: Callable[[DataFrame], DataFrame] = chunks_of_texts):
    """Start ingestion; with ``available_now`` it ends when the folder is worked off. ``chunks_of`` makes the chunks of a batch's documents."""
    return _start(stream, checkpoint, available_now, lambda df, k: ingest_batch(df, chunks_path, states_path, k, chunks_of=chunks_of))


def reparse(stream: DataFrame, texts, chunks_path: str, states_path: str, checkpoint: str, available_now: bool = True):
    """Start the second queue: documents are read again and chunked anew, with the tags that their chunks have. ``texts`` gives the cached
    files as they are now: a function of the session that returns ``document_id, text``."""

    def batch(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        had = latest(current_chunks(spark, chunks_path, states_path), ["document_id"], "chunk_no").select("document_id", *TAGS)
        jobs = df.join(texts(spark).select("document_id", "text"), "document_id", "left").join(had, "document_id", "left")
        name = F.coalesce("document_name", "file_name")
        jobs = jobs.select("job_id", "dataset_id", "document_id", "text", name.alias("file_name"), "department", "doc_type", "scope", "status", "queued_at")
        ingest_batch(jobs, chunks_path, states_path, k, "reparse")

    return _start(stream, checkpoint, available_now, batch)


def _start(stream: DataFrame, checkpoint: str, available_now: bool, batch):
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="3 seconds")).start()


CHUNKS = (
    "document_id string, chunk_no int, content string, content_type string, page int, bbox struct<x1:int,y1:int,x2:int,y2:int>, section string, job_id string, dataset_id string, document_name string, "
    "department string, doc_type string, scope string, status string"
)
STATES = "job_id string, document_id string, file_name string, state string, message string, at timestamp, finished_at timestamp"


def _read(spark: SparkSession, path: str, schema: str, *folders: str) -> DataFrame:
    """Rows of a folder with the columns of its subfolders; none where nothing has been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ", ".join([schema, *folders]))
    return spark.read.schema(", ".join([schema, *folders])).parquet(path)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CHUNKS)


def states(spark: SparkSession, states_path: str) -> DataFrame:
    """All states that jobs have gone through."""
    return _read(spark, states_path, STATES, "queue string", "batch long", "step int")


def _current(spark: SparkSession, chunks_path: str, states_path: str) -> DataFrame:
    """The chunks that each document's latest job left, with the folders they lie in."""
    ended = states(spark, states_path).where("step = 2 and coalesce(message, '') not like 'replaced by %'")
    last = ended.groupBy(F.col("document_id").alias("_d")).agg(F.max_by(F.struct(F.col("queue").alias("_q"), F.col("batch").alias("_b")), F.struct("at", "batch")).alias("x")).select("_d", "x.*")
    rows = _read(spark, chunks_path, CHUNKS, "queue string", "batch long", "piece string")
    return rows.join(last, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("queue") == F.col("_q")) & (F.col("batch") == F.col("_b")), "left_semi")


def current_chunks(spark: SparkSession, chunks_path: str, states_path: str) -> DataFrame:
    """What upserting leaves: the chunks of each document's latest job; none if that has none, as it replaces what was there."""
    return _current(spark, chunks_path, states_path).drop("queue", "batch", "piece", "job_id")


def compact(spark: SparkSession, chunks_path: str, states_path: str) -> None:
    """Write the chunks anew without those that were replaced. For times when no stream runs; rows keep their queue and batch, so the
    streams go on as before."""
    rows = _current(spark, chunks_path, states_path)
    fresh = f"{chunks_path}.new-{uuid.uuid4().hex}"
    rows.withColumn("piece", F.lit("0")).repartition("queue", "batch").write.partitionBy("queue", "batch", "piece").parquet(fresh)
    swap(spark, fresh, chunks_path)


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a window and type, with late data up to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def job_state_stream(events: DataFrame) -> DataFrame:
    """The latest state of each job as it changes (update mode)."""
    return events.groupBy("job_id").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))
