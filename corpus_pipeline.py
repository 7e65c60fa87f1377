"""A corpus pipeline of five operators over ``documents``.

Quality rules reject documents; line dedup takes repeated lines out of texts (a
document that has lost all its lines goes with them); of each group of near
duplicates one document stays; documents that hold a window of a benchmark item go;
the last stage encodes what is left and gives its digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.bpe import round_trip
from tapeworks.llm.common import Packed, new_path
from tapeworks.llm.linededup import dedup_lines
from tapeworks.llm.neardup import near_duplicates
from tapeworks.llm.quality import quality
from tapeworks.llm.queries import BPE_RANKS
from tapeworks.llm.wumanber import find_items


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the log-likelihood ratio rejects."""
    judged = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated windows of three lines; emptied documents go."""
    done = dedup_lines(docs)
    return done.where("n_removed = 0 or n_removed < n_lines").withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest doc_id; rows without a doc_id stay."""
    own = Packed(docs, ("doc_id", "text"))
    kept = near_duplicates(own.df.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return own.back(own.df.join(kept, own.df["doc_id"].eqNullSafe(F.col("_id")), "left_semi"), [])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("size(hits) = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    return round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near-duplicate components and byte-level BPE aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None
