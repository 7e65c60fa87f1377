"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

Words are runs of characters other than blanks and U+0009 to U+000D, A-Z
lower-cased; a document's set holds its distinct shingles of five words (fewer
words: the whole sequence as one).  Documents are linked if 100 * intersection >=
75 * union, and a component is named by the smallest doc_id in it.

Documents of one set are one class from the start (a 128-bit hash of the set), so
exact copies cost one row.  Texts without words, and null texts, have the empty set:
they link with nothing.  A null doc_id is its own component (null) and is kept.
Rows that share a doc_id are one document whose links are those of all its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearlinks
from .common import WordHashes, bounded_batches, column, connected, shingles, written

SHINGLE = 5
PERCENT = 75


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def features(texts: DataFrame, kind: str) -> DataFrame:
    """id, n, set_hash (null if empty), bands, sig of each row of ``texts (id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(words_of(t), hashes, SHINGLE) for t in column(b, "text")]
            mins = nearlinks.minima(sets)
            sig, bands = nearlinks.packed(mins), nearlinks.band_keys(mins)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()), flat, pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "n", "set_hash", "bands", "sig"])

    return texts.mapInArrow(run, f"id {kind}, n long, set_hash string, bands array<long>, sig binary")


def shingle_sets(texts: DataFrame, kind: str) -> DataFrame:
    """(id, shingles) of ``texts (id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(words_of(t), hashes, SHINGLE) for t in column(b, "text")]
            at = np.r_[0, np.cumsum([len(s) for s in sets])]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["id", "shingles"])

    return texts.mapInArrow(run, f"id {kind}, shingles array<long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs (doc_id, text)``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    feats = written(features(texts, kind), "features")
    nonempty = feats.where("id is not null and set_hash is not null")
    # One row per set: the smallest id stands for it.
    first = written(nonempty.groupBy("set_hash").agg(F.min("id").alias("rep")), "sets")
    reps = nonempty.join(first, (feats["set_hash"] == first["set_hash"]) & (feats["id"] == first["rep"]), "left_semi").dropDuplicates(["id", "set_hash"])
    chosen = written(reps.select("id", "n", "bands", "sig"), "chosen")

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(texts.join(ids, "id", "left_semi"), kind)

    linked = nearlinks.classes(chosen, sets_of, percent)
    # Rows that share an id tie the classes of their sets together.
    ties = nonempty.join(first, "set_hash").where("id <> rep").select("id", "rep")
    repeated = feats.groupBy("id").agg(F.count_distinct("set_hash").alias("c")).where("c > 1").select("id")
    if not repeated.isEmpty():
        more = ties.join(repeated, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        linked = connected(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    label = linked.select(F.col("id").alias("rep"), "component")
    of_set = first.join(label, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = feats.select("id", "n", "set_hash").join(of_set, "set_hash", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
