"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`; the last one returns a row of token digests per
document.

Defined cases, in every stage: rows are told apart by id and text, so equal ids with different texts are judged each
for itself; a null text is handled as an empty one, a null language or source is a value of its own, a null id is an id
that comes last among near duplicates; texts of any length are handled whole; extra columns pass through; an empty
table gives an empty one. What becomes of blank texts and of repeated rows is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm.bpe import digest_documents
from ledgerlink.llm.common import cut, documents
from ledgerlink.llm.decontaminate import drop_contaminated
from ledgerlink.llm.line_dedup import remove_repeated_lines
from ledgerlink.llm.minhash import drop_near_duplicates
from ledgerlink.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Blank texts have too few words and go; repeated rows and ties are judged alike."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; n_chars follows the text. Repeated rows are one occurrence; a text may end up empty."""
    out = remove_repeated_lines(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (five words, 0.8).

    Blank texts stay; a null id is never the least unless the group has no other; of rows equal in id and text one stays.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Blank texts hold none; repeated rows are judged alike."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every row. Blank texts have their own tokens, empty ones none."""
    return digest_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", decontaminate), ("tokens", tokens)]

#: Robust estimates and token merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
