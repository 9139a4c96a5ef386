"""A corpus from raw documents to packed training sequences.

``STAGES`` are applied in order, each to all that the one before has kept. All
but the last return the columns of ``documents``.

Defined results: a null or empty text is not toxic by its words, but fails the plain
quality rules; repeated rows, and rows without an id, are documents of their own to
the toxicity and quality stages, and the near-duplicate stage keeps one of each group
of copies; further columns are carried along, whatever their names, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from judgelens.llm import minhash_dedup, mixing, packing, quality, toxicity
from judgelens.llm.common import table
from judgelens.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the multiple-instance model calls toxic."""
    return toxicity.harmless_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the plain rules or diverge from every language reference."""
    return quality.good_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group (five-word shingles)."""
    return minhash_dedup.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; documents it does not take are left out."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_bad),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# A trained model, tokenizer ids and seeded draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
