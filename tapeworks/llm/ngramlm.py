"""Language-model scores from an Elias-Fano n-gram trie.

Tokens: words (runs of characters other than blanks and U+0009 to U+000D, A-Z
lower-cased), then one end.  Training documents are those whose crc32 of the
doc_id as text is not 2 modulo 7; all their n-grams are counted, nothing is pruned.

The trie's order is one more than the number of its weights ``mu`` (three here: words,
pairs, triples).  It is cut into shards by the first word.  In a shard, level one is the
monotone sequence of first words' hashes; each further level is the monotone sequence of
(parent's index, successor's hash).  The upper part of a level's Elias-Fano code holds its
monotone pointers: the zeros at which each parent's successors begin and end.  A gram is
found from its first word down: the index found in one level is the context whose
successors the next is searched for, and nothing outside that context's span is read.
Beside each level lie the quantised smoothed probabilities, a(c, w) = n(c, w) / (n(c) + mu)
as -log2 in steps of 1/1024, which interpolation completes with the share that is left to
the shorter context.  Levels are files in the shared folder that workers map into memory.

    p(w | c) = a(c, w) + mu / (n(c) + mu) * p(w | c without its first word)
    p(w) = (n(w) + 1) / (N + 1 * (V + 1))

n(c) of a longer context is read back from its own a.  At a text's begin the context is
the begin, which occurs once a text.  Words are counted first, exactly, in shards by the
word's hash; then each task counts its grams and sends a small trie to each shard.  A word
with more than ``hot`` training tokens is spread over n / hot shards by its successor, which
counting and reading both take from the word's count.

Null texts count as empty (one token, the end).  A null doc_id counts as an empty
text, so its row trains.  Words are told apart by 64-bit hashes, successors within a
context by 32 bits.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, column, new_path, scan_bytes, written
from .eliasfano import Sequence, from_buffer, sequence, to_bytes

#: Weight of the next lower order, for pairs and for triples; the trie's order is one more than their number.
MU = (200.0, 20.0)
#: Training tokens after a word that one shard takes; a more frequent word is spread over more.
HOT = 1 << 16
#: Bits that tell a context's successors apart.
BITS = 32
#: Tokens that a worker counts, or scores, at a time.
COUNT_TOKENS, SCORE_TOKENS = 4_000_000, 1_000_000
#: Bytes of input for each shard.
SHARD_BYTES = 4 << 20
MODULUS, HELD = 7, 2

# None holds what a word may hold.
_END = xxhash.xxh64_intdigest(b" end ")
_BEGIN = xxhash.xxh64_intdigest(b" begin ")
_AFTER = xxhash.xxh64_intdigest(b" after ")
_LOW = np.uint64((1 << BITS) - 1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def held_out(doc_id):
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % MODULUS) == HELD


def _local(path: str) -> str | None:
    """The path for open(), if the folder is mounted here."""
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith(("file:", "/")) else None


def save(path: str, data: bytes) -> None:
    """Write a file so that it is there whole or not at all; a repeated task writes the same bytes."""
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        own = f"{local}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, local)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_output_stream(at) as f:
            f.write(data)


def load(path: str) -> dict[str, np.ndarray] | None:
    """A file's arrays, mapped into memory where the folder is mounted; None if there is no such file."""
    if local := _local(path):
        if not os.path.exists(local):
            return None
        with open(local, "rb") as f:
            return from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return from_buffer(store.open_input_file(at).read_buffer())


# ---- grams


def padded(docs: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts (word hashes with the end), each after its begin and filled up behind; where each text's next one begins."""
    front, back = np.array([_BEGIN], np.uint64), np.full(order - 2, _AFTER, np.uint64)
    parts = [x for d in docs for x in (front, d, back)]
    return np.concatenate(parts), np.cumsum([len(d) + order - 1 for d in docs])


def windows(x: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct words, and the numbers of them in each window of ``order`` words of a text: as many as it has tokens."""
    vocab, of = np.unique(x, return_inverse=True)
    whole = np.ones(len(x), bool)
    for back in range(1, order):
        whole[ends - back] = False
    at = np.flatnonzero(whole)
    return vocab, [of[at + i] for i in range(order)]


def distinct(cols: list[np.ndarray], size: int, inverse: bool = False):
    """Columns of the distinct rows in order, each one's count and, if asked for, the row of each; numbers below ``size``."""
    bits = max(1, int(size - 1).bit_length())
    if bits * len(cols) <= 63:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key = (key << bits) | c
        found = np.unique(key, return_inverse=inverse, return_counts=True)
        mask = (1 << bits) - 1
        rows = [(found[0] >> (bits * (len(cols) - 1 - i))) & mask for i in range(len(cols))]
    else:  # prefixes are numbered first, so that a key fits
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            _, first, key = np.unique((key << 31) | c, return_index=True, return_inverse=True)
        found = np.unique(key, return_inverse=inverse, return_counts=True)
        rows = [c[first] for c in cols]
    return (rows, found[-1], found[1]) if inverse else (rows, found[-1])


def prefixes(rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each length, the rows at which a new prefix of that length begins; rows are in order."""
    new = np.zeros(len(rows[0]), bool)
    new[:1] = True
    out = []
    for c in rows:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(np.flatnonzero(new))
    return out


def _by(of: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each distinct value."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return (x for x in np.split(order, cuts) if len(x))


# ---- counting


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes of small numbers, all the lowest ones first: mostly zeros, which a shuffle compresses."""
    return np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _numbers(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _word_blocks(x: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    vocab, n = np.unique(x, return_counts=True)
    of = (vocab % np.uint64(shards)).astype(np.int64)
    for rows in _by(of):
        yield int(of[rows[0]]), to_bytes({"key": vocab[rows], "n": n[rows].astype(np.int64)})


def _gram_blocks(docs: list[np.ndarray], reader: Reader) -> Iterator[tuple[int, bytes]]:
    """(shard, bytes) of the small tries of whole documents: level 0 has words' hashes, each level its nodes' numbers of children."""
    order = reader.m.order
    vocab, cols = windows(*padded(docs, order), order)
    rows, n = distinct(cols, len(vocab))
    to = reader.shard(vocab, reader.context_counts(vocab), rows[0], rows[1])
    for at in _by(to):
        own = [c[at] for c in rows]
        starts = prefixes(own)
        block = {"k0": vocab[own[0][starts[0]]], "n": _planes(n[at])}
        for level in range(1, order):
            block[f"k{level}"] = (vocab[own[level][starts[level]]] & _LOW).astype(np.uint32)
            block[f"r{level}"] = _planes(np.diff(np.r_[np.searchsorted(starts[level], starts[level - 1]), len(starts[level])]))
        yield int(to[at[0]]), to_bytes(block)


def _in_blocks(make):
    """An Arrow function: ``make`` turns lists of documents' word hashes into (shard, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, data in make(held):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

        for b in batches:
            for text in column(b, "text"):
                held.append(np.r_[hashes.of(words_of(text)), np.uint64(_END)])
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


# ---- building


def word_shard(blocks: list[dict]) -> tuple[bytes, int, int]:
    """File of a shard of words; how many, and the sum of their counts."""
    key, of = np.unique(np.concatenate([b["key"] for b in blocks]), return_inverse=True)
    n = np.bincount(of, np.concatenate([b["n"] for b in blocks])).astype(np.int64)
    return to_bytes(Sequence.build(key >> np.uint64(1), 1 << 63).parts("words") | {"n": n}), len(key), int(n.sum())


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * 1024).astype(np.uint16)


def gram_shard(blocks: list[dict], reader: Reader) -> tuple[bytes, int, int]:
    """File of a shard of grams, level by level; how many longest ones, and the sum of their counts."""
    m = reader.m
    first, node = np.unique(np.concatenate([b["k0"] for b in blocks]), return_inverse=True)
    parts = Sequence.build(first >> np.uint64(1), 1 << 63).parts("level0")
    leaves = np.concatenate([_numbers(b["n"]) for b in blocks])
    children = [np.concatenate([_numbers(b[f"r{i}"]) for b in blocks]) for i in range(1, m.order)]
    above, parents = reader.context_counts(first), len(first)
    for level in range(1, m.order):
        node = np.repeat(node, children[level - 1])
        key = np.concatenate([b[f"k{level}"] for b in blocks]).astype(np.uint64)
        key |= node.astype(np.uint64) << np.uint64(BITS)
        key, node = np.unique(key, return_inverse=True)
        under = node
        for deeper in children[level:]:
            under = np.repeat(under, deeper)
        n = np.bincount(under, leaves)
        p = n / (above[(key >> np.uint64(BITS)).astype(np.int64)] + m.mu[level - 1])
        parts |= Sequence.build(key, parents << BITS).parts(f"level{level}") | {f"code{level}": quantised(p)}
        above, parents = n, len(key)
    return to_bytes(parts), parents, int(leaves.sum())


def _build(path: str, name: str, make):
    def run(pdf):
        import pandas as pd

        shard = int(pdf["shard"].iloc[0])
        data, size, n = make([from_buffer(x) for x in pdf["data"]])
        save(f"{path}/{name}-{shard}", data)
        return pd.DataFrame({"shard": [shard], "size": [size], "n": [n]})

    return run


class Model:
    """Where a trie is, its weights, and its totals: tokens N, distinct words V."""

    def __init__(self, path: str, shards: int, mu: tuple[float, ...] = MU, hot: int = HOT, tokens: int = 0, words: int = 0) -> None:
        if not mu:
            raise ValueError("a trie has pairs at least")
        self.path, self.shards, self.mu, self.order, self.hot = path, shards, tuple(mu), len(mu) + 1, hot
        self.tokens, self.words = tokens, words


def train(docs: DataFrame, shards: int | None = None, mu: tuple[float, ...] = MU, hot: int = HOT) -> Model:
    """The trie of all texts of ``docs``, written to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if not shards:
        size = scan_bytes(docs)
        if size > 1 << 55:  # Spark's way to say that it doesn't know
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(16, size // SHARD_BYTES)
    model = Model(new_path(spark, "trie"), shards, mu, hot)
    texts = docs.select("text")

    def built(blocks, name: str, make) -> DataFrame:
        sent = texts.mapInArrow(_in_blocks(blocks), "shard int, data binary")
        return written(sent.groupBy("shard").applyInPandas(_build(model.path, name, make), "shard int, size long, n long"), name)

    totals = built(lambda held: _word_blocks(np.concatenate(held), shards), "words", word_shard).agg(F.sum("size"), F.sum("n")).first()
    model.words, model.tokens = totals[0] or 0, totals[1] or 0
    built(lambda held: _gram_blocks(held, Reader(model)), "grams", lambda blocks: gram_shard(blocks, Reader(model)))
    return model


# ---- reading


class Reader:
    """Looks words and grams up in a model's files, each opened when it is first needed."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self._files: dict[str, object] = {}

    def _file(self, name: str):
        if name not in self._files:
            a = load(f"{self.m.path}/{name}")
            if a is None:
                self._files[name] = None
            elif name.startswith("words"):
                self._files[name] = (sequence(a, "words"), a["n"])
            else:
                self._files[name] = [(sequence(a, f"level{i}"), a.get(f"code{i}")) for i in range(self.m.order)]
        return self._files[name]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Training count of each word hash."""
        out = np.zeros(len(words), np.int64)
        of = (words % np.uint64(self.m.shards)).astype(np.int64)
        for rows in _by(of):
            if f := self._file(f"words-{of[rows[0]]}"):
                at = f[0].find(words[rows] >> np.uint64(1))
                out[rows[at >= 0]] = f[1][at[at >= 0]]
        return out

    def context_counts(self, words: np.ndarray) -> np.ndarray:
        """Training count of each word as a context; the beginning has that of the end."""
        return self.counts(np.where(words == np.uint64(_BEGIN), np.uint64(_END), words))

    def shard(self, vocab: np.ndarray, count: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Shard of each gram by the numbers of its first two words; ``count`` of words as contexts."""
        s = np.uint64(self.m.shards)
        spread = np.exp2(np.ceil(np.log2(np.maximum(1, count / self.m.hot)))).astype(np.uint64)
        return (((vocab % s)[first] + (vocab[second] & (spread - np.uint64(1))[first])) % s).astype(np.int64)

    def grams(self, vocab: np.ndarray, count: np.ndarray, rows: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        """Stored probability (0: none) of each distinct prefix of two words and more, found from the first word down."""
        pairs = starts[1]
        of = self.shard(vocab, count, rows[0][pairs], rows[1][pairs])
        out = [np.zeros(len(s), np.float64) for s in starts[1:]]
        up = [np.searchsorted(starts[i - 1], starts[i], "right") - 1 for i in range(1, len(starts))]
        where = [of]
        for i in range(1, len(up)):
            where.append(where[-1][up[i]])
        for level_rows in zip(*map(_by, where), strict=True):
            levels = self._file(f"grams-{of[level_rows[0][0]]}")
            if not levels:
                continue
            # Indices in the level above of this shard's prefixes, by their number.
            words, back = np.unique(rows[0][pairs[level_rows[0]]], return_inverse=True)
            node = levels[0][0].find(vocab[words] >> np.uint64(1))[back]
            for i, mine in enumerate(level_rows):
                if i:
                    node = node[np.searchsorted(level_rows[i - 1], up[i][mine])]
                known = np.flatnonzero(node >= 0)
                succ = vocab[rows[i + 1][starts[i + 1][mine[known]]]] & _LOW
                sequence_, code = levels[i + 1]
                at = sequence_.find((node[known].astype(np.uint64) << np.uint64(BITS)) | succ)
                node = np.full(len(mine), -1, np.int64)
                node[known] = at
                hit = known[at >= 0]
                out[i][mine[hit]] = np.exp2(code[at[at >= 0]] / -1024.0)
        return out

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of documents given as word hashes with the end."""
        m = self.m
        sizes = np.array([len(d) for d in docs])
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        vocab, cols = windows(*padded(docs, m.order), m.order)
        rows, _, back = distinct(cols, len(vocab), inverse=True)
        starts = prefixes(rows)
        count = self.counts(vocab)
        unit = (count + 1.0) / (m.tokens + (m.words + 1.0))
        own = count.copy()
        own[vocab == np.uint64(_BEGIN)] = self.counts(np.array([_END], np.uint64))
        stored = self.grams(vocab, own, rows, starts)
        place = np.arange(len(back)) - np.repeat(begins, sizes)
        word = cols[1]
        p = unit[word]
        above = own[rows[0][starts[0]]].astype(np.float64)
        parent = np.searchsorted(starts[0], np.arange(len(rows[0])), "right") - 1
        for i, a in enumerate(stored):  # i words of the context stand before the pair's
            number = np.searchsorted(starts[i + 1], np.arange(len(rows[0])), "right") - 1
            share = m.mu[i] / (above + m.mu[i])
            at = back[: len(back) - i]
            longer = a[number[at]] + share[parent[at]] * p[i:]
            p = np.r_[p[:i], np.where(place[i:] >= i, longer, p[i:])]
            n = np.zeros(len(a))
            n[number] = above[parent]
            above, parent = a * (n + m.mu[i]), number
        total = lambda x: np.add.reduceat(x, begins)
        return total((count > 0)[word].astype(np.int64)), total(np.log10(unit)[word]), total(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hashes = Reader(model), WordHashes()
        ids: list = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            known, base, own = reader.score(held)
            n = pa.array([len(d) for d in held], pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), n, pa.array(known, pa.int64()), pa.array([model.tokens] * len(held), pa.int64()), pa.array(base), pa.array(own)], names=names)

        size = 0
        for b in batches:
            ids.append(b.column("doc_id"))
            for text in column(b, "text"):
                held.append(np.r_[hashes.of(words_of(text)), np.uint64(_END)])
                size += len(held[-1])
            if size >= SCORE_TOKENS:
                yield out()
                ids, held, size = [], [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, shards: int | None = None, mu: tuple[float, ...] = MU, hot: int = HOT) -> DataFrame:
    """Train on the documents that aren't held out and score all of them."""
    docs = docs.select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), shards, mu, hot)
    out = score(docs, model)
    return out.withColumn("held_out", held_out(F.col("doc_id")))
