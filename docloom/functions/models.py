"""Hooks for outside models: embedding, answering, judging, OCR, conversion. Each is a column function that a caller can replace;
the stand-ins here are deterministic and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let, tokens

Embed = Callable[[Column], Column]
#: Converts a file's bytes to another format (such as DOCX to PDF) outside of this engine.
Convert = Callable[[Column], Column]


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Stand-in for an embedding model: counts of token hashes; empty for a text without tokens."""
    slots = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.size(own) - F.size(F.array_remove(own, d))).cast("float"))
    return let(slots, lambda own: F.when(F.size(own) == 0, F.array().cast("array<float>")).otherwise(counts(own)))


def embed_chunks(chunks: DataFrame, embed: Embed = hashed_embedding) -> DataFrame:
    """Chunks with vectors; a model's failure is an empty vector, which leaves the chunk to BM25 alone."""
    return chunks.withColumn("embedding", F.coalesce(embed(F.col("content")), F.array().cast("array<float>")))


def embed_questions(questions: DataFrame, embed: Embed = hashed_embedding) -> DataFrame:
    return questions.withColumn("vector", F.coalesce(embed(F.col("question")), F.array().cast("array<float>")))
