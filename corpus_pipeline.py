"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns what the next one reads: the columns of documents, but for the last stage, which
returns the pieces of the packed sequences. A stage's result is written before the next
begins, which drops the tables that the one before has left in the shared folder.

Edge cases, in all stages: columns beyond those of documents are not read, whatever their
names; a table without rows yields none; null texts are empty.

SQL cannot express the learned rules, the groups or the tokens, so there is no SQL for
the result; the tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm import packing, quality_rules, shared, similar_sets, source_mixing, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
#: Bytes that 50 words of prose have at least, one in a hundred spans of them aside.
PASSAGE = 240

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def after_the_last(stage: Stage) -> Stage:
    """``stage`` without the tables of the stages before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.release(__name__)
        with shared.owned(__name__):
            return stage(spark, docs, sf_dir)

    return run_stage


@after_the_last
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects. Texts without words
    and null ones fail the base rule; rows with a null key or source stay if their text does;
    repeated rows are judged alike; without labels of both kinds only the base rule counts."""
    judged = quality_rules.judge(docs.select(*COLUMNS), shared.table(spark, sf_dir, "labels"), with_text=True)
    return judged.where("kept").select(*COLUMNS)


@after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a Jaccard similarity of 0.8 or more
    of the sets of shingles of five words, found by SimHash fingerprints in BK-trees.
    That of the smallest key stays, and of rows repeated with one key a single one. Texts
    without words are one group."""
    return similar_sets.keep_one(docs.select(*COLUMNS), words=5, similarity=0.8)


@after_the_last
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of PASSAGE bytes that occur more than
    once; characters that a cut leaves incomplete go too. Null texts become empty ones."""
    cut = suffix_dedup.dedup(docs.select(*COLUMNS), length=PASSAGE, keep=("lang", "source"), as_text=True, small=24 << 20)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@after_the_last
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share asks, in the order of training. A null
    source is a source; texts without words weigh nothing."""
    return source_mixing.in_training_order(docs.select(*COLUMNS))


@after_the_last
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents at their places in sequences of 4096 tokens; each copy of
    a document is packed, and an empty text is its end token."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixing),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.stash(docs, name)
    return docs
