"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import langid, mixing, pieces, pii, simhash_dedup
from docloom.llm.common import discard, stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; prototypes are learnt from the documents of this stage. Null and empty texts go; repeated
    rows stay rows; other columns stay; of no documents there are none. Cases: see ``langid.accepted``."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; of repeated rows one. Cases: see
    ``simhash_dedup.drop_near_duplicates``."""
    return simhash_dedup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew. Cases: see ``pii.redacted``."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once, or up to three times. Ties in source, size and id are
    ordered by the text, so reruns agree whatever the splits. Cases: see ``mixing.mixed``."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids, exact`` of each row; ``exact``: decoding the ids gave the text again. Null and empty texts have no ids;
    repeated rows stay rows; other columns go; of no documents there are no rows."""
    return pieces.encoded(docs, pieces.load(pieces.default_model()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Fingerprints, prototypes, transducers and encoding can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return docs
