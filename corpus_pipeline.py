"""Documents to packed training sequences in five stages, each reading what the one before wrote.

All stages take whole texts of any length and any type of doc_id, keep columns that they don't
know, and give no rows for an empty table. A null text counts as empty: all empty texts are copies of
one another, of which one stays, and that one is packed as a single end token. Rows that repeat both doc_id and text are copies; rows that repeat a doc_id with
another text are documents of their own. Of copies the longest text, then the smallest doc_id
stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dossierflow.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from dossierflow.llm.registry import table
from dossierflow.llm.store import keep

#: tokenizer file and length of the packed sequences
TOKENIZER, CAPACITY = public_tokenizers.path("byte_bpe_50k.json"), 2048

# SQL can't express the first stage (a trained model); tests compare run() with plain Python
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; a null text is scored as an empty one."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by similarity from 0.8 on one stays: the smallest doc_id,
    a null one last. Texts without words are no one's near copies."""
    return jaccard_join.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; so do documents that mostly consist of them."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces placed in sequences; an empty one is a piece of one token."""
    return packing.pack(docs, TOKENIZER, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents: one row for each piece of a document that stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
