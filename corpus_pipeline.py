"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir), where docs is what its predecessor kept. All but the last return documents with all
their columns; the last returns one row a document with digests of its ids and of the bytes that they decode to.

In every stage whole texts count, rows with a null id are documents like others, columns of any name pass through, and an
empty table gives an empty table. What a stage does with other odd rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm.bpe import token_digests
from riskpanel.llm.common import shared_folder, table, without, written
from riskpanel.llm.contamination import contamination
from riskpanel.llm.neardup import near_duplicates
from riskpanel.llm.pii import mask
from riskpanel.llm.quality import keep_good

#: SQL cannot express the trained stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on these documents, does not reject.

    Null, empty and blank texts are rejected. Repeated rows stay or go together; a score on the threshold stays.
    """
    return keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Texts without words are in no group and stay. Rows that repeat the least id with its text stay too; a row with a null
    id goes if its group has an id, and stays if it has none.
    """
    return without(docs, near_duplicates(docs).filter("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate.

    Null and empty texts have no words and stay. Repeated rows stay or go together. With an empty benchmark all stay; its
    null texts contaminate nothing. A share of hit words on the limit goes.
    """
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked.

    Null texts stay null and empty ones empty. Of spans that overlap, the first gives the mask. Repeated rows stay.
    """
    return mask(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows are repeated.
    """
    import public_tokenizers
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; each stage's documents are written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
