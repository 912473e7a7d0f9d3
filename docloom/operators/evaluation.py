"""Judging and evaluation: scores from judge output, summaries, exports. Model calls are column functions that callers plug in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.edits import token_edits
from docloom.functions.metrics import char_edits, rate, word_count
from docloom.functions.text import is_blank, normalise_ws, token_line, tokens


def parse_judge(raw: Column) -> Column:
    """``score, reason, is_error`` of judge output: from the first ``{`` to the last ``}``; score 0 where absent, clamped to
    0..1; -1 and an error where it isn't JSON."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    fine = F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull()
    score = F.coalesce(F.get_json_object(body, "$.score").try_cast("double"), F.lit(0.0))
    return F.struct(F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(-1.0).alias("score"), F.when(fine, F.coalesce(F.get_json_object(body, "$.reason"), F.lit(""))).alias("reason"), (~fine).alias("is_error"))


def overlap_judge(a: Column, b: Column) -> Column:
    """Stand-in for a judge model: share of the distinct tokens of ``a`` that ``b`` has."""
    own = F.array_distinct(tokens(a))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(b))) / F.size(own))


def extractive_answer(context: Column, n: int = 200) -> Column:
    """Stand-in for an answering model: the beginning of the context."""
    return F.left(context, F.lit(n))


def judge_context(hits: DataFrame) -> DataFrame:
    """Contexts of each question for the judge, trimmed, numbered from 1."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))
    return rows.select("query_id", F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(x["content"]))), "\n\n").alias("context"))


def evaluate(queries: DataFrame, hits: DataFrame, answer=extractive_answer, judge=overlap_judge) -> DataFrame:
    """A row for each question: answer, number of chunks, faithfulness to the context, relevancy to the question."""
    ctx = judge_context(hits).join(hits.groupBy("query_id").agg(F.count("*").cast("int").alias("chunk_count")), "query_id")
    rows = queries.select("query_id", "question").join(ctx, "query_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    rows = rows.withColumn("answer", F.when(F.col("chunk_count") > 0, answer(F.col("context"))))
    got = F.col("answer").isNotNull()
    return rows.select(
        F.col("query_id").cast("int").alias("id"), "answer", "chunk_count", F.when(got, judge(F.col("answer"), F.col("context"))).alias("faithfulness"),
        F.when(got, judge(F.col("question"), F.col("answer"))).alias("relevancy"), F.when(~got, F.lit("no chunks")).alias("error"),
    )


def row_average(faithfulness: Column, relevancy: Column, error: Column) -> Column:
    bad = faithfulness.isNull() | relevancy.isNull() | error.isNotNull() | (faithfulness < 0) | (relevancy < 0)
    return F.when(bad, -1.0).otherwise((faithfulness + relevancy) / 2)


def summary(results: DataFrame) -> DataFrame:
    """One row: mean scores over results that have one and no error (-1 without any), numbers of good and failed results."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("error").isNull() & (F.col(c) >= 0), F.col(c))), F.lit(-1.0)).alias(f"mean_{c}")
    return results.agg(mean("faithfulness"), mean("relevancy"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_error"))


def ocr_metrics(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with cer, wer, lengths and edits; a blank side gives an error row."""
    r, h = F.col(reference), F.col(hypothesis)
    blank = is_blank(r) | is_blank(h)
    rows = pairs.withColumn("_words", token_line(r))  # of the reference, for edits and length
    rows = rows.withColumns({"char_edits": char_edits(r, h), "word_edits": token_edits(F.col("_words"), token_line(h)), "ref_chars": F.char_length(normalise_ws(r)), "ref_words": word_count(F.col("_words"))}).drop("_words")
    rows = rows.withColumns({"cer": rate(F.col("char_edits"), F.col("ref_chars")), "wer": rate(F.col("word_edits"), F.col("ref_words"))})
    own = ["char_edits", "word_edits", "ref_chars", "ref_words", "cer", "wer"]
    return rows.withColumns({**{c: F.when(~blank, F.col(c)) for c in own}, "error": F.when(blank, F.lit("both texts are required"))})


def csv_field(c: Column) -> Column:
    """Quoted only where a comma, quote or line break needs it."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def csv_lines(results: DataFrame) -> DataFrame:
    """``id, line`` of the evaluation's export; scores with two decimals, blank below 0."""
    two = lambda c: F.when(F.col(c) >= 0, F.format_string("%.2f", F.col(c))).otherwise("")
    return results.select("id", F.concat_ws(",", F.col("id").cast("string"), csv_field(F.col("question")), csv_field(F.col("answer")), F.col("chunk_count").cast("string"), two("faithfulness"), two("relevancy"), csv_field(F.col("error"))).alias("line"))


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: a Markdown table of a report (rows of a summary, in order)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = rows.select(F.struct(*order, cells.alias("_line")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("x"))
    return body.select(F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda e: e["_line"]), "\n")).alias("markdown"))
