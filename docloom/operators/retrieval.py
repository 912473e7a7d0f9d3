"""Hybrid retrieval over chunks for many questions at once.

Questions are a table ``query_id, question, vector, dataset_id, is_admin, department``. Each stage is one DataFrame plan:
access filter first, then nearest neighbours by cosine and BM25, each cut to its top ``k``, min-max scaled within the question,
merged by a full outer join, weighted, cut at a threshold, ranked. Questions meet chunks by an equi-join on the dataset, whose
smaller side Spark broadcasts if its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.functions.vectors import dot, min_max, norm
from docloom.operators.acl import visible_to
from docloom.shared import written

TOP, SPREAD, WEIGHT, THRESHOLD = 8, 6, 0.3, 0.2
#: Distinct terms of all questions that a plan may name; beyond, they are joined.
MOST_TERMS = 20_000
WEIGHTS = (0.0, 0.2, 0.3, 0.5, 0.7, 1.0)


def _may_see(q: DataFrame, c: DataFrame) -> Column:
    return visible_to(q["q_dataset"], q["q_admin"], q["q_department"], c)


def _asked(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select("query_id", F.col("dataset_id").alias("q_dataset"), F.col("is_admin").alias("q_admin"), F.col("department").alias("q_department"), *more)


def top_k(scored: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each question, ties to the smaller id; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn(queries: DataFrame, chunks: DataFrame, k: int = TOP * SPREAD) -> DataFrame:
    """``query_id, id, score, rank``: exact cosine; empty, zero and missing vectors don't take part."""
    q = _asked(queries, F.col("vector").alias("q_vector")).where("size(q_vector) > 0").withColumn("q_norm", norm(F.col("q_vector"))).where("q_norm > 0")
    c = chunks.select("id", "dataset_id", "department", "scope", "status", "embedding").where("size(embedding) > 0")
    c = c.withColumn("c_norm", norm(F.col("embedding"))).where("c_norm > 0")
    met = c.join(q, _may_see(q, c) & (F.size("embedding") == F.size("q_vector")))
    cosine = dot(F.col("embedding"), F.col("q_vector")) / (F.col("c_norm") * F.col("q_norm"))
    return top_k(met.select("query_id", "id", cosine.alias("score")), k)


def bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP * SPREAD, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, id, score, rank``: chunks that share a term with the question.

    N, document frequencies and mean length are of all chunks, before any access filter; a chunk gives its length and its distinct terms, which
    are summed up where it is read. Frequencies are then counted of the chunks alone that a question may see. Scores are rounded to
    nine digits before ranking, as a sum's last digits depend on the order in which terms arrive.
    """
    asked = _asked(queries, F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "q_dataset", "q_admin", "q_department", "term").agg(F.count("*").alias("qtf"))
    own = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    kept = ["id", "dataset_id", "department", "scope", "status"]

    def terms(rows: DataFrame, once: bool) -> DataFrame:
        """A posting for each term of the questions that a chunk has, each occurrence or ``once``, and one without a term, for its length."""
        words = rows.select(*kept, tokens(F.col("content")).alias("words"))
        length = F.array(F.lit(None).cast("string"))
        named = F.filter("words", lambda w: w.isin(own) if own else F.lit(False)) if len(own) <= MOST_TERMS else F.col("words")
        out = words.select(*kept, F.size("words").alias("dl"), F.explode(F.concat(F.array_distinct(named) if once else named, length)).alias("term"))
        if len(own) <= MOST_TERMS:
            return out
        wanted = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"))).withColumnRenamed("term", "_t")
        return out.join(wanted, F.col("term").eqNullSafe(F.col("_t")), "left_semi")  # too many for the plan: all words meet the terms

    def counted(rows: DataFrame) -> DataFrame:
        return terms(rows, False).groupBy(*kept, "dl", "term").agg(F.count("*").alias("tf"))

    if chunks.groupBy("id").count().where("count > 1").isEmpty():
        every = terms(chunks, True).withColumn("tf", F.lit(1))
    else:  # rows of one id, tags and length are one chunk
        every = counted(chunks)
    every = every.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("length"))
    # A row for each of the questions' terms, which all get the totals of the row without one: a filter of it would read the chunks again.
    total = lambda c: F.sum(F.when(F.col("term").isNull(), F.col(c))).over(Window.partitionBy(F.lit(0)))
    q = asked.join(every.select("term", "df", total("n").alias("n"), (total("length") / total("n")).alias("avgdl")), "term")
    viewers = asked.select("q_dataset", "q_admin", "q_department").distinct()
    tf = counted(chunks.join(F.broadcast(viewers), _may_see(viewers, chunks), "left_semi")).where("term is not null")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = tf.join(q, (tf["term"] == q["term"]) & _may_see(q, tf))
    return top_k(met.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")), k)


def scaled(hits: DataFrame, name: str) -> DataFrame:
    """Min-max within each question; a list whose scores are all alike (or of one hit) gets 0.5."""
    w = Window.partitionBy("query_id")
    value = min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    return hits.select("query_id", "id", value.alias(name), F.col("rank").alias(f"{name}_rank"))


def merged(queries: DataFrame, chunks: DataFrame, top: int = TOP, texts: DataFrame | None = None) -> DataFrame:
    """``query_id, id, vec, bm25`` and both ranks: what fusing needs, whatever the weight. ``texts``: the same chunks without
    vectors, where those are kept apart, so that BM25 doesn't read vectors."""
    return combined(knn(queries, chunks, top * SPREAD), bm25(queries, chunks if texts is None else texts, top * SPREAD))


def combined(neighbours: DataFrame, matches: DataFrame) -> DataFrame:
    """Both lists of hits scaled, and joined by question and chunk; a chunk that one of them lacks has 0 there."""
    v, t = scaled(neighbours, "vec"), scaled(matches, "bm25")
    return v.join(t, ["query_id", "id"], "full_outer").withColumns({"vec": F.coalesce("vec", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})


def fuse(hits: DataFrame, weight: Column, top: int = TOP, threshold: float = THRESHOLD, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted sum, cut at the threshold before rounding, ranked: score, then place among neighbours, then among BM25 hits."""
    score = (1 - weight) * F.col("vec") + weight * F.col("bm25")
    hits = hits.withColumn("score", score).where(F.col("score") >= threshold)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("similarity", F.bround("score", 4))


def retrieve(queries: DataFrame, chunks: DataFrame, top: int = TOP, weight: float = WEIGHT, threshold: float = THRESHOLD, texts: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, content, document_id, document_name, image_id, similarity``."""
    return _with_texts(fuse(merged(queries, chunks, top, texts), F.lit(weight), top, threshold), chunks if texts is None else texts)


def retrieve_kept(queries: DataFrame, vectors, postings, texts: DataFrame, top: int = TOP, weight: float = WEIGHT, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """The same from a ``VectorIndex`` and a ``PostingsIndex`` of the chunks: no vector is read but those of the cells searched, and no text
    but those of ``texts`` that are shown. Neighbours are those among 240 candidates or more, or, ``exact``, all."""
    hits = combined(vectors.search(queries, top * SPREAD, exact=exact), postings.search(queries, top * SPREAD))
    # The hits are written, so that Spark sees how few they are before it decides whether texts are shuffled.
    best = fuse(hits, F.lit(weight), top, threshold).select("query_id", "rank", "id", "similarity")
    return _with_texts(written(best, "hits"), texts)


def _with_texts(best: DataFrame, texts: DataFrame) -> DataFrame:
    best = best.select("query_id", "rank", "id", "similarity")
    named = texts.select("id", "content", "document_id", "document_name")
    return best.join(named, "id").select("query_id", "rank", F.col("id").alias("chunk_id"), "content", "document_id", "document_name", F.lit(None).cast("string").alias("image_id"), "similarity")


def sweep(queries: DataFrame, chunks: DataFrame, weights: tuple[float, ...] = WEIGHTS, top: int = TOP, texts: DataFrame | None = None) -> DataFrame:
    """``weight, query_id, id, rank, similarity``: hits are found once and fused again for each weight."""
    hits = merged(queries, chunks, top, texts).withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return fuse(hits, F.col("weight"), top, by=("weight", "query_id")).select("weight", "query_id", "id", "rank", "similarity")


def sweep_metrics(hits: DataFrame, queries: DataFrame, chunks: DataFrame, weights: tuple[float, ...] = WEIGHTS, judged: DataFrame | None = None) -> DataFrame:
    """A row for each weight: mean precision and recall proxies over all questions (also those without hits), F1 of the means,
    mean judge scores over those parsed (-1 without any), and the mean of the known scores."""
    from docloom.functions.metrics import f1, mean_known

    sizes = chunks.groupBy("dataset_id").agg(F.count("*").alias("total"))
    every = queries.join(sizes, "dataset_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    own = hits.groupBy("weight", "query_id").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") > 0.5).alias("good"))
    rows = every.join(own, ["weight", "query_id"], "left").fillna(0, ["n", "good"])
    rows = rows.withColumns({"p": F.when(F.col("n") == 0, 0.0).otherwise(F.col("good") / F.col("n")), "r": F.when(F.col("total") == 0, 0.0).otherwise(F.col("n") / F.col("total"))})
    if judged is None:
        rows = rows.withColumns({"faithfulness": F.lit(-1.0), "relevancy": F.lit(-1.0)})
    else:
        rows = rows.join(judged.select("weight", "query_id", "faithfulness", "relevancy"), ["weight", "query_id"], "left").fillna(-1.0, ["faithfulness", "relevancy"])
    known = lambda c: F.coalesce(F.avg(F.when(F.col(c) >= 0, F.col(c))), F.lit(-1.0)).alias(c)
    out = rows.groupBy("weight").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), known("faithfulness"), known("relevancy"))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumn("combined", mean_known(F.col("precision"), F.col("recall"), F.col("faithfulness"), F.col("relevancy")))


def best_weight(rows: DataFrame) -> DataFrame:
    return rows.where("combined >= 0").orderBy(F.col("combined").desc(), "weight").limit(1)


def paraphrase_overlap(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """For ``pairs(pair_id, a, b)`` of questions: ids that both found, size of the union, and the Jaccard overlap."""
    from docloom.functions.metrics import jaccard

    ids = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))  # top rows of a question only
    none = F.array().cast("array<string>")
    out = pairs.join(ids.select(F.col("query_id").alias("a"), F.col("ids").alias("ids_a")), "a", "left").join(ids.select(F.col("query_id").alias("b"), F.col("ids").alias("ids_b")), "b", "left")
    out = out.withColumns({"ids_a": F.coalesce("ids_a", none), "ids_b": F.coalesce("ids_b", none)})
    return out.select("pair_id", F.array_intersect("ids_a", "ids_b").alias("both"), F.size(F.array_union("ids_a", "ids_b")).alias("n_union"), jaccard(F.col("ids_a"), F.col("ids_b")).alias("jaccard"))


def context_block(hits: DataFrame, first: int = 0, empty: str = "(no documents found)") -> DataFrame:
    """``query_id, context``: ``[ID:i] text`` blocks in rank order, numbered from ``first``."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))
    blocks = F.transform("c", lambda x, i: F.concat(F.lit("[ID:"), (i + first).cast("string"), F.lit("] "), F.trim(x["content"])))
    return rows.select("query_id", F.when(F.size("c") == 0, F.lit(empty)).otherwise(F.array_join(blocks, "\n\n")).alias("context"))
