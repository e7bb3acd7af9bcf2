"""From raw documents to a mixed, tokenised corpus in five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.llm import bpe, langid, mixing, overlap, substring
from prismara.llm._shared import done, shared_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of the documents' own languages doesn't reject, as they are.

    Null, empty and letterless texts have no language and go. Ties between languages don't matter here; repeated rows
    stay or go together, very long texts are judged whole, an empty table stays empty, and other columns aren't looked at.
    """
    return langid.accepted(docs, langid.fit(docs, learns=F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, as it is, of each group of near duplicates: those linked by a Jaccard similarity of 0.8 or more of
    shingles of five words.

    The least doc_id stays, null last; of rows alike in id and text one. Null is as empty, and texts without words
    are one group; very long texts are compared whole; an empty table stays empty; other columns aren't looked at.
    """
    return overlap.deduplicate(docs, shingle=5, similarity=(4, 5))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 35 words that occur anywhere else; n_chars follows the text.

    Every row stays, its text perhaps empty; null stays null, with null n_chars. A repeated row's windows are repeats.
    Very long texts are taken whole, an empty table stays empty, and other columns aren't looked at.
    """
    return substring.without_repeated(docs, window=35).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its schedule.

    A null source is a source; null and empty texts have no words and stay once; rows alike in id, text and source
    are one, with all their copies; a very long text spans several blocks; an empty table stays empty; other columns
    aren't looked at.
    """
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, digests of its ids and of what they decode to.

    Null is as empty, which has no tokens. Rows come out as they come in; very long texts are encoded whole; an empty
    table stays empty; other columns than the four that are kept aren't looked at.
    """
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed),
    ("byte_bpe", encoded),
]

#: Fingerprints, indexes and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last by way of a table in the shared folder, which the next one's takes the place of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared_table(stage(spark, docs, sf_dir), name)
        done(before)
    return STAGES[-1][1](spark, docs, sf_dir)
