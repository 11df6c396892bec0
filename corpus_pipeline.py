"""Corpus pipeline: language ID, line dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all but the last return
the columns of documents. Documents without a recognised language go; copied lines, and words under
long repeated passages, leave their texts (the row stays, with what is left of the text and its
n_chars); of near duplicates (five-word shingles, similarity NEAR % or more) the one with the smallest
doc_id stays. Stages are written as Parquet
into the shared folder and read again, so a lost executor costs one stage at most.

Rows that share a doc_id are told apart by their text; of a group of near duplicates all rows with the
smallest doc_id stay, and all rows where no doc_id is given. Null texts have no language and go. An empty table gives an empty result at every stage. Columns
beyond those of documents are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.llm import common, lines, minhash, packing, ppm, relative_lz
from normspark.operators.keyed import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = 80


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    held_out = F.coalesce(ppm.remainder("doc_id", 3) == 1, F.lit(False))
    named = ppm.predict(docs, ppm.train(docs.filter(~held_out)))
    return named.filter(F.col("lang_pred") != ppm.NONE).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(lines.line_dedup(docs, keep=COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = minhash.marked(docs, NEAR).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("__k").alias("__f"))
    same = (F.col("__k") == F.col("__f")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = docs.withColumn("__k", minhash.row_key())
    return rows.join(copies.distinct(), same, "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(relative_lz.substring_dedup(docs, keep=COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: tokenizers and the learned language model are beyond SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
