"""Queries of the corpus operators over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import table
from . import bytebpe, language, mixing


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytebpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].select("doc_id", "source", "tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "documents"), table(spark, d, "lang_names")).select("doc_id", "lang").distinct()


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), table(spark, d, "lang_names"))


QUERIES = {
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}

ORACLES: dict[str, str] = {}
