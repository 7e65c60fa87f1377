"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its pieces are short; leaves are encoded on their own and
neighbours are joined.  A join re-encodes only a window around the seam, which grows
until the tokens outside it are proved to be those of the whole text:

* an end of the window is a *certain* boundary of the pattern, which no match can cross
  whatever stands on either side; or
* it lies inside a run of letters or of digits (one match of the pattern, however long),
  and the re-encoded tokens meet those outside at a common boundary where the two tokens
  on either side stay apart when encoded together.  A row of tokens of one match is its
  encoding if, and only if, that holds for each two neighbours.

So a text without blanks needs no wider windows than others.  Decoding concatenates the
bytes of halves up the same kind of tree.

Null texts count as empty; an empty text has no ids.  Every row gives one row, repeated
rows too; an empty table gives an empty one.  Of the table's other columns those with the
names of the result give way, the rest is kept (``encode``, ``decode``).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, extended

#: Characters of a leaf (ids when decoding), and of the first window on each side of a seam.
LEAF = 256
WINDOW = 64
#: The characters that Unicode calls white space.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a file of ranks, once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """s: white space, L: letter, N: number, o: other; empty where versions of Unicode don't agree."""
    if c in _SPACES:
        return "s"
    old, new = (x if x in "LN" else "o" for x in (unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]))
    return new if old == new and unicodedata.ucd_3_2_0.category(c) != "Cn" else ""


def certain(text: str, at: int) -> bool:
    """A match of the pattern ends or starts here in any context.

    Every alternative of the pattern is an optional blank and a run of one kind
    without white space, an apostrophe and letters, or a run of white space only, so
    none holds a white space after another character, or two kinds side by side but
    for a letter after an apostrophe.
    """
    if at <= 0 or at >= len(text):
        return True
    a, b = kind(text[at - 1]), kind(text[at])
    if b == "s":
        return a != "s"
    return bool(a and b) and a != "s" and a != b and text[at - 1] != "'"


def _near(text: str, seam: int, step: int, width: int) -> int | None:
    """The nearest certain boundary on one side of a seam, at most ``width`` away."""
    return next((p for p in range(seam + step, seam + step * (width + 1), step) if certain(text, p)), None)


def window_ends(text: str, seam: int, first: int = WINDOW) -> tuple[int, int]:
    """The nearest certain boundaries around a seam, looked for in growing windows."""
    if certain(text, seam):
        return seam, seam
    lo = hi = None
    width = first
    while lo is None or hi is None:
        lo = _near(text, seam, -1, width) if lo is None else lo
        hi = _near(text, seam, 1, width) if hi is None else hi
        width *= 2
    return lo, hi


class Tree:
    """Encodes and decodes with one set of ranks."""

    def __init__(self, enc, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.enc, self.leaf, self.window = enc, max(leaf, 2), window
        self.joins = self.widest = 0
        self._apart: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Two tokens stay as they are when their bytes are encoded together."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= 1 << 16:
                self._apart.clear()
            both = self.enc.decode_single_token_bytes(a) + self.enc.decode_single_token_bytes(b)
            known = self._apart[a, b] = list(self.enc._encode_single_piece(both)) == [a, b]
        return known

    def _places(self, ids: list[int], at: int, upto: int) -> list[int]:
        """Byte offsets of the ends of ids that begin at ``at``, as far as ``upto``."""
        out = []
        for i in ids:
            at += len(self.enc.decode_single_token_bytes(i))
            if at > upto:
                break
            out.append(at)
        return out

    def _in_run(self, text: str, seam: int, left: list[int], right: list[int]) -> bool:
        """Join inside a run of letters or digits; False if that isn't where the seam is, and nothing is done."""
        run = kind(text[seam])
        if run not in ("L", "N"):
            return False
        width = self.window
        while True:
            lo, hi = _near(text, seam, -1, width), _near(text, seam, 1, width)
            if lo is not None and hi is not None:
                return False
            a, b = seam - width if lo is None else lo, seam + width if hi is None else hi
            # A few letters more, since what begins the run may belong to a contraction.
            if any(kind(c) != run for c in text[max(0, a - 4) if lo is None else max(a, seam - width) + 4 : b]) or lo is not None and seam - lo < 8:
                return False
            made = self.enc.encode_ordinary(text[a:b])
            middle, end = len(text[a:seam].encode()), len(text[a:b].encode())
            ends = self._places(made, 0, end)
            at_left, at_right = 0, len(made)
            cut_left = cut_right = None
            if lo is None:
                back, at = {}, middle
                for n, i in enumerate(reversed(left)):
                    at -= len(self.enc.decode_single_token_bytes(i))
                    if at <= 0:
                        break
                    back[at] = len(left) - n - 1
                for i, x in enumerate(ends[:-1]):
                    if x in back and x <= middle and self.apart(left[back[x] - 1], made[i + 1]):
                        at_left, cut_left = i + 1, back[x]
                        break
            else:
                cut_left = len(left) - len(self.enc.encode_ordinary(text[a:seam]))
            if hi is None:
                ahead = {x: n + 1 for n, x in enumerate(self._places(right, middle, end))}
                for i in range(len(ends) - 2, -1, -1):
                    x = ends[i]
                    if x < middle:
                        break
                    if x in ahead and ahead[x] < len(right) and self.apart(made[i], right[ahead[x]]):
                        at_right, cut_right = i + 1, ahead[x]
                        break
            else:
                cut_right = len(self.enc.encode_ordinary(text[seam:b]))
            if cut_left is not None and cut_right is not None and at_left < at_right:
                self.widest = max(self.widest, b - a)
                left[cut_left:] = made[at_left:at_right]
                del right[:cut_right]
                return True
            width *= 2

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text from the ids of its halves."""
        if len(text) <= self.leaf:
            return self.enc.encode_ordinary(text)
        seam = len(text) // 2
        left, right = self.encode(text[:seam]), self.encode(text[seam:])
        self.joins += 1
        if not certain(text, seam) and not self._in_run(text, seam, left, right):
            lo, hi = window_ends(text, seam, self.window)
            self.widest = max(self.widest, hi - lo)
            off_left, off_right = len(self.enc.encode_ordinary(text[lo:seam])), len(self.enc.encode_ordinary(text[seam:hi]))
            left[len(left) - off_left :] = self.enc.encode_ordinary(text[lo:hi])
            del right[:off_right]
        left += right
        return left

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, by concatenation up the tree."""
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _check_pattern(pattern: str) -> None:
    import public_tokenizers

    if pattern != public_tokenizers.PATTERN:
        raise ValueError("certain() is proved for public_tokenizers.PATTERN only")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column ``ids array<int>`` of each whole text."""
    _check_pattern(pattern)
    bounded_batches(docs.sparkSession)
    schema = docs.drop("ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(encoding(ranks_path, pattern), leaf)
        for b in batches:
            ids = [tree.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return docs.drop("ids").mapInArrow(run, extended(schema, "ids array<int>"))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column ``decoded binary`` of the ids (null: empty)."""
    bounded_batches(docs.sparkSession)
    schema = docs.drop("decoded").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(encoding(ranks_path, pattern), leaf)
        for b in batches:
            out = [tree.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return docs.drop("decoded").mapInArrow(run, extended(schema, "decoded binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Encode and decode each text in one pass and keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256, exact.

    One pass, since ids of all texts between two Python stages would cross the JVM twice.
    """
    _check_pattern(pattern)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        tree = Tree(enc, leaf)
        digits = [str(i) for i in range(enc.max_token_value + 1)]
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                t = t or ""
                ids = tree.encode(t)
                back = tree.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t.encode()))
            n, a, d, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
