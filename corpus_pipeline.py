"""The pipeline over documents: each stage applies one operator to all rows the one before kept.

1. toxicity: documents predicted toxic go.
2. exact dedup: of equal texts one row stays.
3. near dedup: of linked texts one row stays.
4. mixing: sources are brought to their targets; a document is repeated whole as often
   as the mix takes it whole, and the words it takes once more follow as rows of their own.
5. packing: what is left in windows of tokens, one row per piece.

All stages but the last return the columns of documents. Null texts count as empty;
null doc_ids and repeated rows are rows of their own; an empty table gives no piece.

A stage's rows are written before the next stage is called. What a stage has settled
for itself goes when the next one begins, so the disk holds that of one stage only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import exact_dedup, minhash, mixing, packing, toxicity
from opsframe.llm.common import SPACE
from opsframe.sources.durable import discard, discard_folders, recorded, settle

COLUMNS = ("text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.json"


_SETTLED: dict[str, list[str]] = {}  # by application, what the stage before has settled


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_folders(spark, _SETTLED.pop(spark.sparkContext.applicationId, []))
        with recorded() as paths:
            made = function(spark, docs, sf_dir)
        _SETTLED[spark.sparkContext.applicationId] = paths
        return made

    return run_stage


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", *COLUMNS)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(toxicity.toxicity(docs, labels, *COLUMNS).where("predicted = 0"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _documents(exact_dedup.exact_groups(docs, *COLUMNS).where("kept"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return _documents(minhash.one_of_each(docs, *COLUMNS))


def _words(start: Column, end: Column) -> Column:
    """The words from ``start`` on and before ``end``, with one blank between them."""
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    return F.array_join(F.slice(words, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int")), " ")


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, with repeats."""
    begin, end = F.col("from_word"), F.col("to_word")
    none = F.array().cast("array<string>")
    more = (
        F.when(begin.isNull(), none)
        .when(begin < end, F.array(_words(begin, end)))
        .otherwise(F.array(_words(F.lit(0), end), _words(begin, F.col("size"))))
    )
    taken = F.concat(F.array_repeat("text", F.col("passes").cast("int")), F.filter(more, lambda t: t != ""))
    rows = mixing.mix(docs, "text", "lang", "n_chars", "source").where("taken > 0")
    chosen = rows.select("doc_id", F.explode(taken).alias("text"), "lang", "source", "n_chars")
    return chosen.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_windows),
]

#: Votes of neighbours, minima and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    docs, older = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, function in STAGES[:-1]:
        docs = settle(function(spark, docs, sf_dir))
        if older:
            discard(older)
        older = docs
    return STAGES[-1][1](spark, docs, sf_dir)
