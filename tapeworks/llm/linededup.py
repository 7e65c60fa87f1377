"""Line dedup by overlapping windows of three lines.

Lines are what stands between line feeds; those of white space only (blanks,
U+0009 to U+000D) are not counted.  Each three consecutive counted lines are a
window; a document of one or two is one window.  A window's 128-bit hash is looked
up over the whole table: its first occurrence (smallest doc_id, null last, then the
hash of the text, then position) stays and each later one is covered.  Covered
positions of a document are merged, those lines go, and the rest is joined again.

Windows are written once, grouped with a partial aggregate (a window that a third
of the rows share arrives as one row per task), and only repeated ones are joined
back.  Null texts stay null; texts without counted lines stay as they are.  Rows of
the same doc_id and text are judged alike, as one document; rows of the same doc_id
and another text are documents of their own.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packed, bounded_batches, column, extended, written

LINES = 3


def counted(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the indices of those that aren't white space only."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def windows(text: bytes, k: int = LINES) -> list[bytes]:
    """The windows of a text, in order."""
    lines, at = counted(text)
    size = min(k, len(at))
    return [b"\n".join([lines[j] for j in at[i : i + size]]) for i in range(len(at) - size + 1)] if size else []


def without(text: bytes, starts: list[int], k: int = LINES) -> tuple[bytes, int]:
    """The text without the lines of the windows that begin at ``starts``, and how many lines went."""
    lines, at = counted(text)
    size = min(k, len(at))
    gone = {at[j] for i in starts for j in range(i, i + size)}
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]), len(gone)


def _spread(docs: DataFrame, k: int) -> DataFrame:
    """A row for each window: h1, h2 (128 bits), doc_id, key, i."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, row, at = [], [], [], []
            for r, text in enumerate(column(b, "text")):
                for i, w in enumerate(windows(text, k) if text else ()):
                    h = xxhash.xxh128_intdigest(w)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & (1 << 64) - 1) - (1 << 63))
                    row.append(r)
                    at.append(i)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), b.column("doc_id").take(take), b.column("key").take(take), pa.array(at, pa.int32())], names=["h1", "h2", "doc_id", "key", "i"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, key long, i int")


def dedup_lines(docs: DataFrame, k: int = LINES) -> DataFrame:
    """Every row of ``docs`` with ``text`` after removal, n_lines (counted, before) and n_removed.

    Columns of ``docs`` are kept whatever their names, but for those named n_lines and n_removed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = Packed(docs, ("doc_id", "text"), ("n_lines", "n_removed"))
    docs = own.df
    spread = written(_spread(docs, k), "windows").select("h1", "h2", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "i").alias("at"))
    # Written, so that the join is one of two plain tables, which a skew join can split where a window is very frequent.
    repeated = written(spread.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("at").alias("first")).where("c > 1").drop("c"), "repeated")
    later = spread.join(repeated, ["h1", "h2"]).where("not (at <=> first)")
    gone = later.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.key").alias("_k")).agg(F.sort_array(F.collect_set("at.i")).alias("gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left").select("in", "text", "gone")
    schema = extended(docs.select("in").schema, "new_text string, n_lines long, n_removed long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, removed = [], [], []
            for text, starts in zip(column(b, "text"), b.column("gone").to_pylist(), strict=True):
                n.append(len(counted(text)[1]) if text else 0)
                text, less = without(text, starts, k) if starts else (text, 0)
                texts.append(text)
                removed.append(less)
            yield pa.RecordBatch.from_arrays([b.column("in"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["in", "new_text", "n_lines", "n_removed"])

    return own.back(joined.mapInArrow(run, schema), ["n_lines", "n_removed"], {"text": "new_text"})


#: The same rows in SQL: doc_id, n_lines, n_removed, text (documents whose rows have distinct doc_ids).
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS p
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, x, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines WHERE regexp_matches(x, '[^\x09-\x0D\x20]')),
win AS (
  SELECT doc_id, i, n,
         x || CASE WHEN n > 1 THEN chr(10) || lead(x) OVER w ELSE '' END || CASE WHEN n > 2 THEN chr(10) || lead(x, 2) OVER w ELSE '' END AS t
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT doc_id, i, n, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k
  FROM win WHERE i + least(n, 3) <= n),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(least(n, 3))) AS i FROM ranked WHERE k > 1),
marked AS (
  SELECT l.doc_id, l.x, l.p, c.i IS NOT NULL AS is_counted, g.i IS NOT NULL AS is_gone
  FROM lines l LEFT JOIN counted c ON l.doc_id = c.doc_id AND l.p = c.p LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.i = c.i)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(m.t, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(count(*) FILTER (is_counted) AS BIGINT) AS n_lines, CAST(count(*) FILTER (is_gone) AS BIGINT) AS n_removed,
         string_agg(x, chr(10) ORDER BY p) FILTER (NOT is_gone) AS t
  FROM marked GROUP BY doc_id) m USING (doc_id)"""
