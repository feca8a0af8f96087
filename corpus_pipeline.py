"""The corpus pipeline over `documents`: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, repeats
from tidemark.llm.common import read, stored
from tidemark.llm.queries import VOCABULARY
from tidemark.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels beside the documents.

    A null text counts as empty, and stays or goes by the score of an empty text; repeated rows share a decision; without labels, or
    with labels of one class only, nothing tells good from bad and the scores are one constant; an empty table stays empty.
    """
    ship(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row with the smallest doc_id, one of them where rows repeat it.

    Texts without words, null ones too, are linked with nothing and stay, each row of them; null ids go last; an empty table
    stays empty.
    """
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that occur more than once; n_chars follows.

    All rows stay. A null text becomes empty; repeated rows of 200 bytes and more lose their whole text; bytes of a character that a
    cut splits are dropped; an empty table stays empty.
    """
    ship(spark)
    return repeats.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words, null ones too, have size 0 and are not taken; a null source is one of its own, last; of rows with
    equal id and text as many are taken as bring the source nearest to its target; an empty table stays empty.
    """
    ship(spark)
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars with n_tokens, token ids and the hash of the text that the ids decode to.

    A null or empty text has no tokens and decodes to the empty text; other columns are carried, but those named like these
    outputs, or `decoded`, give way; an empty table stays empty.
    """
    ship(spark)
    made = bpe.encode(docs, VOCABULARY, outputs=("n_tokens", "ids", "decoded"), keep=[c for c in docs.columns if c != "text"])
    return made.withColumn("decoded_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256)).drop("decoded")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("source_mixing", source_mixing),
    ("tokenize", tokenize),
]

#: A trained classifier, MinHash groups and a tokenizer are beyond SQL; tests compare each stage's rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
