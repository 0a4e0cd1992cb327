"""The corpus pipeline: stages that turn raw documents into token ids.

Each stage takes what its predecessor kept, written and read again, and returns the columns of documents (the last one the
digests of the token ids).  A stage that drops a row drops it for good.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presflow.llm import bpe, language, mixing, near_dedup, suffix_dedup
from presflow.llm.common import cut, id_crc_mod5, tidy
from presflow.session import shared_folder

#: Documents whose language can't be told (no text, no letter) are rejected, and those that are told with less than this score.
LEAST_SCORE = 0.3
#: Similarity of five-word shingles from which documents are near duplicates, in percent.
NEAR_PERCENT = 80
#: Share of tokens that the mixing keeps.
MIX_BUDGET = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the identification rejects: without a text or a letter, or told with a score under LEAST_SCORE.

    Repeated rows are told alike; rows with a null id take part, but nothing is learnt from them.
    """
    told = language.identify(docs, id_crc_mod5(F.col("doc_id")) == 0)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Of rows that share that id one stays, by a hash of its text.  Rows with a null id have no group and stay.
    """
    linked = near_dedup.link(docs, percent=NEAR_PERCENT)
    gone = cut(linked.filter(~F.col("kept")).select("doc_id").distinct())
    repeated = cut(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id").join(gone, "doc_id", "left_anti"))
    single = docs.join(gone.unionByName(repeated), "doc_id", "left_anti").select(docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    again = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns, first.alias("_first")).filter("_first = 1").select(docs.columns)
    return single.unionByName(again)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document with a smaller id holds too; texts of which nothing is left go.

    Rows that share an id do not take from each other, rows with a null id neither take nor lose.
    """
    return suffix_dedup.shorten(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics have their target weights; rows with a null id are drawn by their text."""
    return mixing.drawn(docs, budget=MIX_BUDGET)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text and of what they decode to, a row a document."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]
#: Trained machines, raking and merges can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; every stage's is written as Parquet below ``spark.checkpoint.dir`` and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
