"""Shared plumbing: the shared work folder, materialised tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch handed to Python, so that a worker's memory is bounded.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Entries of a per-worker cache before it is emptied.
CACHE_ENTRIES = 100_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's bytes, without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with the fields of a DDL string after those of ``schema``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


class Packed:
    """A table whose own columns travel as one struct, so that no name of theirs meets one of ours.

    ``df`` has a struct ``in`` of all columns (but those named like what is ``made``, which
    give way) and the ``needed`` ones by their plain names; these are found whatever their
    case, an exact name first.  ``back`` gives the columns their names again.
    """

    def __init__(self, df: DataFrame, needed: tuple[str, ...], made: tuple[str, ...] = ()) -> None:
        names = df.columns
        flat = df.toDF(*[f"c{i}" for i in range(len(names))])

        def at(c: str) -> int:
            found = [i for i, n in enumerate(names) if n == c] or [i for i, n in enumerate(names) if n.lower() == c.lower()]
            if not found:
                raise ValueError(f"no column {c}")
            return found[0]

        places = {c: at(c) for c in needed}
        self.keep = [i for i, n in enumerate(names) if i in places.values() or n.lower() not in made]
        self.names, self.places = [names[i] for i in self.keep], places
        self.df = flat.select(F.struct(*[F.col(f"c{i}") for i in self.keep]).alias("in"), *[F.col(f"c{i}").alias(c) for c, i in places.items()])

    def kind(self) -> T.StructType:
        return self.df.schema["in"].dataType

    def back(self, df: DataFrame, made: list[str], instead: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
        """The own columns under their names and then ``made``; ``instead`` names columns of ``df`` that replace needed ones."""
        replaced = {self.places[c]: new for c, new in (instead or {}).items()}
        left = [(i, n) for i, n in zip(self.keep, self.names, strict=True) if i not in [self.places[c] for c in drop]]
        cols = [F.col(replaced[i]) if i in replaced else F.col(f"in.c{i}") for i, _ in left]
        return df.select(*[c.alias(f"o{k}") for k, c in enumerate([*cols, *[F.col(m) for m in made]])]).toDF(*[n for _, n in left], *made)


def column(batch, name: str) -> list:
    """A string column as UTF-8 bytes (None for null), without decoding."""
    import pyarrow as pa

    col = batch.column(name)
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return col.to_pylist()


class WordHashes(dict):
    """64-bit hash of each word; emptied when full so that its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


#: Odd multiplier of the rolling word combination.
_STEP = np.uint64(0x9E6C63D0876A9A47)


def shingles(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the whole sequence as one."""
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    k_here = min(k, len(w))
    n = len(w) - k_here + 1
    h = w[:n].copy()
    for i in range(1, k_here):
        h *= _STEP
        h += w[i : i + n]
    if k_here < k:
        h += np.uint64(k_here)
    return np.unique(mixed(h))


def connected(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges (a, b)``: rows (id, component), component the smallest id.

    Alternating large-star and small-star steps.  Each step is written to the shared
    folder, so neither lineage nor driver memory grows with the input, and the join on a
    component's centre is one of two plain tables, which a skew join can split.
    Self-loops and repeated edges are harmless; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        # Every neighbour above a node is told of the node's smallest one: each edge tells its upper end.
        large = written(e.join(least, "v").where("u <> m").select("u", F.col("m").alias("v")).distinct(), "large")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for table in (e, least, large):
            drop_path(spark, table.table_path)
        e = after
        if state == seen or state[0] == 0:
            break
        seen = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
