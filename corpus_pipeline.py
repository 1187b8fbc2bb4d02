"""A training-corpus pipeline over documents, each stage written and reread as the next one's input.

Quality rules, near-duplicate removal, removal of repeated passages, mixing of the sources, tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join, quality_rules, sentencepiece_bpe, source_mixing, suffix_dedup
from spanloom.llm.runtime import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Bytes of a repeated passage. Of the sequences of 51 words in the test documents 99.7 % are longer (median 314), so nearly every
#: passage of more than 50 words that stands elsewhere too holds such a string.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules accept, judged each by its own text.

    Null and empty texts fail the rules. Rows of null doc_id are judged too; repeated rows share their verdict. An empty
    table, or one without labels, gives what the rules alone accept.
    """
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similar texts connect, the document of the smallest id, null last.

    Of repeated rows one stays; different texts of one doc_id count by themselves. Texts without a word all stay.
    """
    return jaccard_join.distinct_documents(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE_BYTES bytes and more that stand elsewhere too; those left without a word go, null texts too."""
    out = suffix_dedup.without_repeats(docs, PASSAGE_BYTES).where(F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))) > 0)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within the shards. Null sources are one source, the last; an empty table gives none."""
    return source_mixing.mixed_documents(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, the end id last, and the SHA-256 of the text decoded from them. Null text counts as empty."""
    from public_tokenizers import path

    return sentencepiece_bpe.encode_documents(docs, path("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: Trees, min-hashes and token merges have no form in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared checkpoint folder, so that none runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = checkpointed(docs) if k < len(STAGES) - 1 else docs
    return docs
