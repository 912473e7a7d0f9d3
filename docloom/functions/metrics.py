"""Quality metrics as expressions: error rates, overlaps, means of what is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.edits import text_edits, token_edits
from docloom.functions.text import normalise_ws, token_line


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def mean_known(*scores: Column) -> Column:
    """Mean of the scores that are 0 or more; -1 without any."""
    known = F.filter(F.array(*scores), lambda x: x >= 0)
    return F.when(F.size(known) == 0, -1.0).otherwise(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.bround(F.size(F.array_intersect(a, b)) / union, 4))


def char_edits(reference: Column, hypothesis: Column) -> Column:
    return text_edits(normalise_ws(reference), normalise_ws(hypothesis))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    return token_edits(token_line(reference), token_line(hypothesis))


def word_count(line: Column) -> Column:
    """Words of a line that has one blank between two."""
    return F.when(line == "", 0).otherwise(F.char_length(line) - F.char_length(F.replace(line, F.lit(" "))) + 1)


def rate(edits: Column, length: Column) -> Column:
    return F.when(length == 0, 0.0).otherwise(F.bround(edits / length, 4))
