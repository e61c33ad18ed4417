"""A corpus made ready for training, in stages: each takes the documents that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import decontaminate, mixing, near_dup, token_frames, toxicity
from tagweave.llm.queries import read, tokenizer_path
from tagweave.llm.shared import bounded_batches, durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The executors keep memory of one stage in the next ones: so all of them take texts to Python in batches of bounded bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model learns from the labels of the given documents.

    A null text scores as an empty one. Repeated rows stay or go together, an empty table gives no rows, texts may have any
    length; without labels all stay. Other columns pass through, whatever their names.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id")))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates, once; documents without words are near each
    other only as copies. Nulls in any column, empty tables and long texts are as near_dup.keep_one() says."""
    return near_dup.keep_one(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; repeated rows stay or go together; an empty benchmark
    leaves all. The columns of docs come out as they are, those with the names of results too."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass that the mix takes it in, whose text is the words taken. Documents without words are
    never taken; a null source is a source; repeated rows have a place each; an empty table gives no rows."""
    return mixing.mix_documents(docs)


@in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' documents: doc_id, start, n_tokens, ids_crc32. Rows of one doc_id follow by their texts, null doc_ids
    come first, null texts are empty; an empty table gives no shards and no rows."""
    return token_frames.tokenised(spark, docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_frames", write_tokens),
]

#: Hashing, learning and drawing stages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
