"""The op queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waygrid.llm import oracles
from waygrid.llm.common import read_table, tokenizer_path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.sharding import shard_digest

    return shard_digest(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.line_dedup import dedup_digest

    return dedup_digest(read_table(spark, sf_dir, "documents"))


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.near_dedup import near_digest

    return near_digest(read_table(spark, sf_dir, "documents"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from waygrid.llm.vector_search import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.passage_dedup import dedup_passages

    return dedup_passages(read_table(spark, sf_dir, "documents"), keep_text=False)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from waygrid.llm.byte_bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.token_files import token_file_digest

    return token_file_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.quality_rules import quality_digest

    return quality_digest(read_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygrid.llm.source_mix import mix_documents

    return mix_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_bag_minhash, op4_vector_search, op5_token_counts, op6_passage_dedup, op7_byte_bpe, op8_token_files, op9_quality_rules, op10_source_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": oracles.OP2, "op9_quality_rules": oracles.OP9, "op10_source_mix": oracles.OP10}
