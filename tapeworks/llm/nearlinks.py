"""Near-duplicate classes of sets of shingles: b-bit MinHash finds, full sets confirm.

1. Each set gets ``PERMS`` minima.  Bands of ``ROWS`` minima give candidate buckets;
   the low ``BITS`` bits of each minimum are packed into the signature.
2. Sizes of buckets are partial aggregates.  A bucket is cut into chunks, each dealt out
   as a block of its own together with the bucket's first member.
3. Inside a block, equal b-bit values are counted on the packed words and corrected
   for collisions, (match - 2^-b) / (1 - 2^-b).  Pairs at ``CANDIDATE`` or more, far
   below the threshold asked for, join the block's members into spanning trees; only
   the trees' edges leave it, never all pairs.  Members that are joined with the first one
   are done: whatever links with them is in the same component.  Those that aren't are
   cut into chunks of their own, and each of these meets each chunk of the bucket (or all
   chunks meet each other, where most members are left).  So a bucket of n copies costs
   n rows, no block holds more than two chunks, and no link is left out.
4. Components of those edges are groups that hold every link.  The groups' full sets
   are read again and dealt out in the same way; inside a block the sizes of all
   intersections are exact, and again trees of true links leave it.  Their components
   are the classes.

A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS (5e-6 at
0.75) and falls below ``CANDIDATE`` with about 3e-7; no other step loses a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, written

BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
CANDIDATE = 0.55
#: Members of a chunk: of a bucket (signatures), of a group (full sets).
SIGNATURES, SETS = 1024, 512
#: Shingles of a chunk of full sets.
SHINGLES = 1_000_000

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 32, 512, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, 512, dtype=np.uint64).astype(np.uint32)
_STEP = 2048


def minima(sets: list[np.ndarray], perms: int = PERMS) -> np.ndarray:
    """Minimum of each permutation over each non-empty set of 64-bit hashes: (sets, perms) uint32."""
    out = np.full((len(sets), perms), 0xFFFFFFFF, np.uint32)
    a, b = _A[:perms], _B[:perms]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if len(sets) else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(flat), _STEP):
        x, o = flat[at : at + _STEP], owner[at : at + _STEP]
        values = x[:, None] * a + b
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        least = np.minimum.reduceat(values, starts, axis=0)
        out[o[starts]] = np.minimum(out[o[starts]], least)
    return out


def packed(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of the minima, in 64-bit words: (sets, perms * bits / 64)."""
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint64)
    per = 64 // bits
    low = low.reshape(len(mins), mins.shape[1] // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(low, axis=2)


def band_keys(mins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band: (sets, bands) int64."""
    from .common import mixed

    m = mins[:, : bands * rows].astype(np.uint64).reshape(len(mins), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), m.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E6C63D0876A9A47) + m[:, :, r])
    return h.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, perms: int = PERMS, bits: int = BITS) -> np.ndarray:
    """Similarity of packed signatures by bit counts, corrected for chance collisions."""
    d = x ^ y
    for s in (1, 2) if bits == 4 else ():
        d = d | (d >> np.uint64(s))
    ones = np.uint64(0x1111111111111111)
    differ = np.bitwise_count(d & ones).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-bits
    return ((perms - differ) / perms - chance) / (1 - chance)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of spanning trees of the graph whose adjacency ``near(i, others)`` tells, by searching breadth first."""
    left, edges = np.arange(n), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            new = left[hit]
            if len(new):
                edges += [(int(i), int(j)) for j in new]
                todo += new.tolist()
                left = left[~hit]
    return edges


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of each key, of batches sorted by the keys; small neighbouring keys come together, none apart."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def last_key(b) -> tuple:
        return tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        end = last_key(b)
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(b.num_rows, bool)
        for c, v in zip(cols, end, strict=True):
            same &= c == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut and (head := b.slice(0, cut)):
            yield pa.Table.from_batches([*held, head])
            held, rows = [], 0
        elif held and last_key(held[-1]) != end:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(b.slice(cut))
        rows += b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


_BLOCK = ["key", "i", "j"]


def _out(table: pa.Table, bounds: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Edges (a, b) of row numbers, and rows (key, a, no b) of members of cut buckets that aren't joined with the first member."""
    lead, chunks = table.column("lead").to_numpy(), table.column("chunks").to_numpy()
    rest: list[int] = []
    if (chunks > 1).any():
        up = np.arange(table.num_rows)

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return int(x)

        for x, y in pairs:
            up[top(x)] = top(y)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if chunks[lo] > 1 and lead[lo:hi].any():
                done = top(lo + int(lead[lo:hi].argmax()))
                rest += [r for r in range(lo, hi) if top(r) != done]
    a = [x for x, _ in pairs] + rest
    b = pa.array([*[y for _, y in pairs], *[None] * len(rest)], pa.int64())
    ids, key = table.column("id").combine_chunks(), table.column("key").combine_chunks()
    take = pa.array(a, pa.int64())
    return pa.RecordBatch.from_arrays([key.take(take), ids.take(take), ids.take(b)], names=["key", "a", "b"])


def _signature_trees(perms: int) -> Callable:
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return estimate(x, y, perms) >= CANDIDATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _BLOCK):
            bounds = _bounds(table, _BLOCK)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            first = np.repeat(bounds[:-1], np.diff(bounds))
            star = near(sig, sig[first])
            rows = np.arange(table.num_rows)
            pairs = list(zip(first[star & (rows != first)].tolist(), rows[star & (rows != first)].tolist(), strict=True))
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(~star), "right") - 1):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if hi - lo > 2:
                    own = sig[lo:hi]
                    pairs += [(lo + x, lo + y) for x, y in spanning(hi - lo, lambda i, others, own=own: near(own[others], own[i]))]
            yield _out(table, bounds, pairs)

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over slices of the shared shingles."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[starts, len(flat)])
    shared = np.repeat(counts > 1, counts)
    column_of = np.cumsum(counts > 1) - 1
    column_of = np.repeat(column_of, counts)[shared]
    owner = owner[shared]
    out = np.zeros((m, m), np.float32)
    width = 4096
    edges = np.searchsorted(column_of, np.arange(0, (column_of[-1] if len(column_of) else -1) + 1 + width, width))
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        if lo < hi:
            part = np.zeros((m, width), np.float32)
            part[owner[lo:hi], column_of[lo:hi] - k * width] = 1
            out += part @ part.T
    return out


def set_trees(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning trees of the links 100 * intersection >= percent * union."""
    m = len(sets)
    if m == 2:
        return [(0, 1)] if _similar(sets[0], sets[1], percent) else []
    if m <= 8:
        return spanning(m, lambda i, others: np.array([_similar(sets[i], sets[j], percent) for j in others], bool))
    common = intersections(sets)
    size = np.array([len(s) for s in sets], np.float64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        c = common[i, others].astype(np.float64)
        return 100 * c >= percent * (size[i] + size[others] - c)

    return spanning(m, near)


def _exact_trees(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _BLOCK):
            bounds = _bounds(table, _BLOCK)
            col = table.column("shingles").combine_chunks()
            values, at = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy()
            at = at - at[0]
            pairs = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 1:
                    pairs += [(lo + x, lo + y) for x, y in set_trees([values[at[r] : at[r + 1]] for r in range(lo, hi)], percent)]
            yield _out(table, bounds, pairs)

    return run


def trees(members: DataFrame, keep: list[str], find: Callable, size: int, name: str) -> DataFrame:
    """Edges (a, b) of spanning trees of each bucket of ``members (key, id, chunks, first, ...)``, by blocks of chunks.

    ``first`` is the bucket's first id; ``size``: members of a chunk.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    key, kind = kinds["key"], kinds["id"]
    schema = f"key {key}, a {kind}, b {kind}"
    columns = ["key", "i", "j", "id", "chunks", "lead", *keep]
    chunk = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    chunks = F.col("chunks")
    own = F.when(chunks > 1, chunk(chunks)).otherwise(F.lit(0))
    lead = F.col("id") == F.col("first")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(find, schema)

    at = F.explode(F.when(lead & (chunks > 1), upto(chunks)).otherwise(F.array(own)))
    found = written(dealt(members.withColumn("lead", lead).withColumn("i", at).withColumn("j", F.lit(-1))), f"{name}-trees")
    edges = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select("key", F.col("a").alias("id")).distinct()
    if rest.isEmpty():
        return edges
    left = written(rest.groupBy("key").agg(F.count("*").alias("left")), f"{name}-left")
    cut = members.where(chunks > 1).join(left, "key").withColumn("lead", F.lit(False)).withColumn("own", own)
    most = F.col("left") > chunks * size / 3
    # Where most are left: each member once with each chunk, i up to j.
    k = F.explode(upto(chunks))
    full = cut.where(most).withColumn("k", k).withColumn("i", F.least("own", "k")).withColumn("j", F.greatest("own", "k"))
    # Else: those that are left by chunks of their own (i), all members by theirs (j).
    parts = F.ceil(F.col("left") / F.lit(size))
    few = cut.where(~most)
    those = few.join(rest, ["key", "id"], "left_semi").withColumn("i", chunk(parts)).withColumn("j", k)
    all_ = few.withColumn("i", F.explode(upto(parts))).withColumn("j", F.col("own"))
    every = full.select(*columns).unionByName(those.select(*columns)).unionByName(all_.select(*columns))
    more = written(dealt(every).where("b is not null").select("a", "b"), f"{name}-more")
    return edges.union(more)


def weak_edges(features: DataFrame, perms: int = PERMS) -> DataFrame:
    """Edges (a, b) of trees of pairs that may be similar, of ``features (id, bands, sig)``."""
    keys = features.select("id", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    sizes = written(sizes.select("key", F.ceil(F.col("n") / F.lit(SIGNATURES)).cast("int").alias("chunks"), "first"), "buckets")
    members = keys.join(sizes.hint("merge"), "key").join(features.select("id", "sig").hint("merge"), "id")
    return trees(members, ["sig"], _signature_trees(perms), SIGNATURES, "weak")


def classes(features: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 75, perms: int = PERMS) -> DataFrame:
    """(id, component) of every id that has a link.

    ``features``: id, n (set size), bands, sig; ids distinct, sets not empty, and
    cheap to read again.  ``sets_of(ids)`` gives (id, shingles) for a table of ids.
    """
    kind = features.schema["id"].dataType.simpleString()
    # Groups only have to hold every link, so they may be found by 64-bit hashes of the ids, which are lighter to move.
    short = F.col("id") if kind == "bigint" else F.xxhash64("id")
    weak = connected(weak_edges(features.select(short.alias("id"), "bands", "sig"), perms))
    weak = weak.select(F.col("id").alias("_h"), F.col("component").alias("group"))
    members = written(features.select("id", "n", short.alias("_h")).join(weak.hint("merge"), "_h").select("id", "n", "group"), "groups")
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(SETS), F.sum("n") / F.lit(SHINGLES))).cast("int")
    sizes = written(members.groupBy("group").agg(chunks.alias("chunks"), F.min("id").alias("first")), "sizes")
    placed = members.join(sizes, "group").select("id", F.col("group").alias("key"), "chunks", "first")
    sets = sets_of(members.select("id")).join(placed, "id")
    return connected(trees(sets, ["shingles"], _exact_trees(percent), SETS, "links"))
