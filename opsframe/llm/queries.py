"""The operators applied to the given tables: one query each, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import (
    ann,
    chat,
    exact_dedup,
    filter_audit,
    licenses,
    minhash,
    mixing,
    packing,
    periodic,
    pii,
    token_count,
    toxicity,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.piece_digests(packing.pack(_table(spark, sf_dir, "documents"), path))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the row of each that stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.span_digest(pii.personal_data(_table(spark, sf_dir, "documents"), with_text=False))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the entries that were active when it was fetched."""
    pages = _table(spark, sf_dir, "pages")
    captures, entries = (spark.sql(sql.replace("from pages", "from {pages}"), pages=pages) for sql in (url_filter.CAPTURES, url_filter.ENTRIES))
    return url_filter.url_filter(captures, entries, "page_id")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates."""
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that documents or parts of them are."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a period in the words of every document, some of them planted."""
    docs = periodic.with_planted_runs(_table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.periodic_runs(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as examples, read back from them."""
    turns = chat.with_control_turns(_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lexical_packing, op2_cross_polytope, op3_source_mix, op4_token_counts, op5_exact_dedup,
        op6_personal_data, op7_url_filter, op8_minhash_dedup, op9_licenses, op10_toxicity,
        op11_periodic_runs, op12_filter_audit, op13_chat_examples,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_minhash_dedup": minhash.SQL,
    "op9_licenses": licenses.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_chat_examples": chat.SQL,
}
