"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters and non-ASCII characters of the lower-cased
text.  A pattern is a window of ten consecutive words of a benchmark item (an item
of fewer words is one window).  Patterns of one length form a group with two
tables.  The shift table tells for each pair of words that ends a position how far
the scan may jump without passing an occurrence: positions whose pair is in no
pattern are skipped over.  Where the shift is zero, the bucket of that pair (the
patterns' suffix) is compared word by word.

The tables of ``PATTERN_WORDS`` words of benchmark at most go to the executors at
once; a larger benchmark is searched in blocks of whole items, each against all
documents, and spans of the blocks are joined by document row.

Null or empty texts have no words.  Null items and items without words match
nothing.  Rows with the same item_id count as one item that has all their windows.
Repeated documents each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packed, bounded_batches, column, extended, written

WINDOW = 10
#: Words of benchmark text whose tables one search holds.
PATTERN_WORDS = 2_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or c in _KEEP else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Group:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[tuple, list[int]]] = {}

    def add(self, words: tuple, item: int) -> None:
        for end in range(self.block, self.length + 1):
            key = b" ".join(words[end - self.block : end])
            jump = self.length - end
            if jump < self.shift.get(key, self.far):
                self.shift[key] = jump
        owners = self.bucket.setdefault(key, {}).setdefault(words, [])
        if item not in owners:
            owners.append(item)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        n, length, far, shift = len(words), self.length, self.far, self.shift.get
        at = length - 1
        pairs = self.block == 2
        while at < n:
            key = words[at - 1] + b" " + words[at] if pairs else words[at]
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            start = at - length + 1
            owners = self.bucket[key].get(tuple(words[start : at + 1]))
            if owners:
                yield start, owners
            at += 1


def groups_of(items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> list[Group]:
    """Search tables for the windows of (number, words) items."""
    groups: dict[int, Group] = {}
    for number, words in items:
        size = min(window, len(words))
        if size:
            g = groups.setdefault(size, Group(size))
            for i in range(len(words) - size + 1):
                g.add(tuple(words[i : i + size]), number)
    return list(groups.values())


def _blocks(benchmark: DataFrame, budget: int) -> Iterator[list[tuple]]:
    """(item_id, words) rows in blocks of about ``budget`` words, one block on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("binary").alias("t")).where("item_id is not null and text is not null").toLocalIterator():
        w = words_of(bytes(r["t"]))
        if w:
            block.append((r["item_id"], w))
            size += len(w)
        if size >= budget:
            yield block
            block, size = [], 0
    if block:
        yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open word spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_HITS = "array<struct<start:int,end:int>>"


def _search(docs: DataFrame, block: list[tuple], window: int, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with n_words, hits array<struct<start, end>> (merged) and items array<string> (sorted)."""
    spark = docs.sparkSession
    names: dict = {}
    items = [(names.setdefault(str(i), len(names)), w) for i, w in block]
    ids = list(names)
    shared = spark.sparkContext.broadcast((items, ids))
    made: dict = {}
    schema = extended(docs.select(*keep).schema, f"n_words long, hits {_HITS}, items array<string>")
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = shared.value
        groups = made.get("groups") or made.setdefault("groups", groups_of(own, window))
        for b in batches:
            n, hits, found = [], [], []
            for text in column(b, "text"):
                words = words_of(text)
                spans, items = [], set()
                for g in groups:
                    for start, owners in g.find(words):
                        spans.append((start, start + g.length))
                        items.update(owners)
                n.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in merged(spans)])
                found.append(sorted(ids[i] for i in items))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(hits, hit_type), pa.array(found, pa.list_(pa.string()))], names=[*keep, "n_words", "hits", "items"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _joined(spans):
    """Union of sorted half-open spans, on native functions."""

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(wider))
        return F.when(x["start"] <= last["end"], joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_HITS), step)


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, budget: int = PATTERN_WORDS) -> DataFrame:
    """Every row of ``docs`` with n_words, hits and items.

    Columns of ``docs`` are kept whatever their names, but for those named like these three.
    """
    bounded_batches(docs.sparkSession)
    made = ["n_words", "hits", "items"]
    own = Packed(docs, ("text",), tuple(made))
    blocks = list(_first_two(_blocks(benchmark, budget)))
    if len(blocks) < 2:
        return own.back(_search(own.df, blocks[0] if blocks else [], window, ["in"]), made)
    base = written(own.df.withColumn("row", F.monotonically_increasing_id()), "docs")
    parts = None
    for block in _blocks(benchmark, budget):
        part = written(_search(base, block, window, ["row"]).where("size(hits) > 0"), "spans")
        parts = part if parts is None else parts.union(part)
    joined = parts.groupBy("row").agg(_joined(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _search(base, [], window, ["in", "row"]).drop("hits", "items")
    out = counted.join(joined, "row", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return own.back(out, made)


def _first_two(blocks: Iterator) -> Iterator:
    for k, b in enumerate(blocks):
        yield b
        if k:
            return


def n_hit(hits) -> object:
    """Words inside any span, of the merged spans."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_items``' result."""
    out = found.select("doc_id", "n_words", n_hit("hits").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def items_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
