"""Sessions, messages, ratings and citations. Messages are ordered by ``turn``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import hash_prefix, message_id
from docloom.operators.store import latest


def collapse_regenerations(messages: DataFrame) -> DataFrame:
    """Messages without superseded tries: a user message is superseded if the message after next is a user's with the same
    content; it goes with the message after it. Islands of superseded messages go whole, and the one after an island goes if
    the island's length is odd."""
    w = Window.partitionBy("session_id").orderBy("turn")
    after = lambda c: F.lead(c, 2).over(w)
    sup = (F.col("role") == "user") & F.coalesce(after("role") == "user", F.lit(False)) & F.coalesce(after("content") == F.col("content"), F.lit(False))
    rows = messages.withColumns({"_s": sup, "_n": F.row_number().over(w)})
    island = F.col("_n") - F.sum(F.col("_s").cast("int")).over(w)
    rows = rows.withColumn("_i", island)
    size = F.count_if("_s").over(Window.partitionBy("session_id", "_i").orderBy("_n"))
    rows = rows.withColumn("_k", F.when(F.col("_s"), size).otherwise(0))
    left = F.coalesce(F.lag("_k").over(w), F.lit(0))
    return rows.withColumn("_b", left).where(~F.col("_s") & (F.col("_b") % 2 == 0)).drop("_s", "_n", "_i", "_k", "_b")


def with_message_ids(messages: DataFrame) -> DataFrame:
    return messages.withColumn("message_id", message_id(F.col("role"), F.col("content")))


def positional_ids(messages: DataFrame) -> DataFrame:
    """Ids that also depend on the length of the history before the message."""
    before = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    return messages.withColumn("message_id", hash_prefix(F.concat_ws("|", before.cast("string"), "role", "content"), 12))


def last_messages(messages: DataFrame) -> DataFrame:
    """``session_id, last_role, last_content, last_user``."""
    by = F.struct("turn")
    return messages.groupBy("session_id").agg(F.max_by("role", by).alias("last_role"), F.max_by("content", by).alias("last_content"), F.max_by("content", F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))


def replace_session(messages: DataFrame, session_id: str, new: DataFrame) -> DataFrame:
    return messages.where(F.col("session_id") != session_id).unionByName(new.where(F.col("session_id") == session_id))


def sessions_of(sessions: DataFrame, username: str) -> DataFrame:
    return sessions.where(F.col("username") == username).orderBy(F.col("created_at").desc(), "id")


def rate(ratings: DataFrame, new: DataFrame) -> DataFrame:
    """Ratings after new ones: the latest of a session, message and user stays."""
    return latest(ratings.unionByName(new), ["session_id", "message_id", "username"], "rated_at", "positive")


def with_ratings(messages: DataFrame, ratings: DataFrame, username: Column) -> DataFrame:
    """Messages with the user's rating; null without."""
    own = ratings.where(F.col("username") == username).select("session_id", "message_id", F.col("positive").alias("rated"))
    return messages.join(own, ["session_id", "message_id"], "left")


def citations(answers: DataFrame, key: str, content: str, chunks: str = "chunks") -> DataFrame:
    """``key, pos, idx, chunk``: citations ``[ID:n]`` and ``##n$$`` with the chunk each points to; those out of range go."""
    marks = F.regexp_extract_all(content, F.lit(r"\[ID:\s*(\d+)\]|##(\d+)\$\$"), F.lit(0))
    rows = answers.select(key, F.col(chunks).alias("_c"), F.posexplode(marks).alias("pos", "_m"))
    rows = rows.withColumn("idx", F.regexp_replace("_m", r"\D", "").try_cast("int"))
    return rows.where((F.col("idx") >= 0) & (F.col("idx") < F.size("_c"))).select(key, "pos", "idx", F.get("_c", F.col("idx")).alias("chunk"))


def snippet(c: Column, n: int = 400) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def completion_json(answer: Column, chunks: Column) -> Column:
    return F.to_json(F.struct(F.lit(0).alias("code"), F.struct(answer.alias("answer"), F.struct(chunks.alias("chunks")).alias("reference")).alias("data")))


_CHUNK = "struct<chunk_id:string,id:string,content:string,content_with_weight:string,document_id:string,doc_id:string,document_name:string,docnm_kwd:string,image_id:string,img_id:string,similarity:double>"


def completion_chunks(json: Column) -> Column:
    """Chunks of a completion, whose reference is an array or an object with one; names by their first present alias."""
    reference = F.coalesce(F.get_json_object(json, "$.data.reference"), F.get_json_object(json, "$.reference"))
    chunks = F.coalesce(F.when(F.ltrim(reference).startswith("["), F.from_json(reference, f"array<{_CHUNK}>")), F.from_json(reference, f"struct<chunks:array<{_CHUNK}>>")["chunks"])
    pick = lambda x, *names: F.coalesce(*[x[n] for n in names])
    return F.transform(chunks, lambda x: F.struct(
        pick(x, "chunk_id", "id").alias("chunk_id"), pick(x, "content", "content_with_weight").alias("content"), pick(x, "document_id", "doc_id").alias("document_id"),
        pick(x, "document_name", "docnm_kwd").alias("document_name"), pick(x, "image_id", "img_id").alias("image_id"), F.coalesce(x["similarity"], F.lit(0.0)).alias("similarity"),
    ))


def render_kind(content: Column) -> Column:
    """How a chunk is shown: an HTML table, a pipe table (two piped lines or more), or plain."""
    piped = F.size(F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x).startswith("|")))
    return F.when(F.lower(content).contains("<table"), "html").when(piped >= 2, "pipes").otherwise("plain")


def pipe_rows(content: Column) -> Column:
    """Cells of each row of a pipe table, separator rows left out."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^[|:\- ]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))
