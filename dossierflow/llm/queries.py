"""One query for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dossierflow.llm import (
    collocations,
    decontamination,
    exact_dedup,
    html_extraction,
    jaccard_join,
    oracles,
    packing,
    secrets,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    whitening,
)
from dossierflow.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["QUERIES", "ORACLES"]


@query("op1_packing")
def op1_packing(spark, sf_dir):
    """All documents as pieces packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query("op2_substring_dedup", oracles.SUBSTRING_DEDUP)
def op2_substring_dedup(spark, sf_dir):
    """Every document without passages of 35 words and more that stand anywhere else."""
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3_decontamination(spark, sf_dir):
    """Words of every document that lie in windows of benchmark items."""
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    scored = toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_sentences", F.size("sentences").cast("long")).drop("sentences")


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    """Secrets of every document: fixed patterns and learnt formats."""
    return secrets.find(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join", oracles.JACCARD_JOIN)
def op7_ngram_jaccard_join(spark, sf_dir):
    """Links between documents whose sets of five-word n-grams are similar from 0.8 on."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    """Every document in one of 24 contiguous shards of equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    """Every document without strings of 100 bytes and more that start earlier."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n_cp,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size,
           row_number() OVER w = 1 AS kept,
           h AS text_sha256
    FROM d
    WINDOW w AS (PARTITION BY h ORDER BY n_cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def op10_exact_dedup(spark, sf_dir):
    """What becomes of every document when equal texts are kept once."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11_simhash(spark, sf_dir):
    """Fingerprint of every document and the component of fingerprints within three bits that it is in."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_collocations", oracles.COLLOCATIONS)
def op12_collocations(spark, sf_dir):
    """The 2,000 best collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
