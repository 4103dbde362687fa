"""The corpus pipeline: its stages, in order, and a run over all of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waygrid.llm.common import read_table, saved, tokenizer_path

#: SQL can't express the third stage (signatures by hierarchical Poisson processes, classes).
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    from waygrid.llm.quality_rules import clean_documents

    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another document keeps."""
    from waygrid.llm.line_dedup import dedup_lines

    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    from waygrid.llm.near_dedup import first_of_each

    return first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of sources that fall short of their target repeat, others thin out."""
    from waygrid.llm.source_mix import mixed_documents

    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and hashes of the ids and of what they decode to."""
    import public_tokenizers

    from waygrid.llm.byte_bpe import encode_documents

    return encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage{k}")
    return docs
