"""Token counts: batch encoding inside Arrow functions that return lengths only.

Whole texts are encoded in batches of about equal UTF-8 bytes, at most ``ENCODE_BYTES``
each.  Texts longer than ``LONG_BYTES`` are split at safe boundaries first (a blank after
a character that is not white space, which no pre-token crosses), into pieces of about
that size, whose lengths add up to that of the whole; without such a boundary a text
stays whole.  Added special tokens are handled as the library does by default: their
strings hold no blank, so no cut falls inside one.

Null texts count as empty: no bytes, no tokens.  Every row gives one row, repeated rows
too; an empty table gives an empty one.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, column

#: UTF-8 bytes of one batch that the tokenizer gets, and of a text from which it is split.
ENCODE_BYTES, LONG_BYTES = 1 << 20, 1 << 16


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for special in t.get_added_tokens_decoder().values():
        if special.lstrip or special.rstrip or " " in special.content:
            raise ValueError("an added token reaches over a blank; parts would not add up")
    return t


def pieces(text: bytes, size: int = LONG_BYTES) -> list[bytes]:
    """Parts of a long text of about ``size`` bytes, each but the first beginning with the blank it is cut at."""
    out, at = [], 0
    while len(text) - at > size:
        # Bytes below 0x80 are characters of their own; what stands before the blank must not be white space of any kind.
        end = text.find(b" ", at + size)
        while end > 0 and not (0x20 < text[end - 1] < 0x7F):
            end = text.find(b" ", end + 1)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def balanced(sizes: list[int], budget: int = ENCODE_BYTES) -> list[tuple[int, int]]:
    """Bounds of batches of neighbours of about equal bytes, as few as the budget allows (an item above it is a batch)."""
    total = sum(sizes)
    share = total / max(1, -(-total // budget))
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and (held + n > budget or held + n / 2 > share):
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes))] if sizes else []


def lengths(parts: list[bytes], path: str, budget: int = ENCODE_BYTES) -> list[int]:
    """Tokens of each part."""
    t, out = tokenizer(path), []
    for lo, hi in balanced([len(p) for p in parts], budget):
        out += [len(x) for x in t.encode_batch_fast([p.decode() for p in parts[lo:hi]], add_special_tokens=False)]
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in column(b, "text")]
            split = [pieces(x) for x in texts]
            each = np.array(lengths([p for ps in split for p in ps], path), np.int64)
            n = np.add.reduceat(each, np.cumsum([0, *[len(ps) for ps in split[:-1]]])) if split else each
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
