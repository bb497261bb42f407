"""The queries p8 to p10 over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import mixing, mojibake, tokenizer
from docloom.session import read_table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_column(read_table(spark, sf, "documents"), "doc_id", "text")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokenizer.encode_column(read_table(spark, sf, "documents"), "doc_id", "text", counts_only=True, keep=["source"])
    return mixing.mixture(sizes, read_table(spark, sf, "mix_targets"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(spark, sf)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixed(spark, sf), read_table(spark, sf, "mix_targets"))


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore_texts(read_table(spark, sf, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_restored(spark, sf).select("doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p9_mixture, p9_shares, p10_found, p10_restored)}
SQL: dict[str, str] = {}
