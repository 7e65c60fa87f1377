"""Quality rules on native functions: base rules, then a hashed n-gram log-likelihood ratio.

Words are runs of characters other than blanks and U+0009 to U+000D.  Hashed word
unigrams and bigrams of trusted documents and of the whole corpus give two
multinomials with add-``ALPHA`` smoothing over ``BUCKETS`` buckets.  A document's
verdict is the mean over its n-grams of log(trusted / raw): it is kept if that is
at least the threshold.  The threshold is one number for the table, the mean of
the trusted documents' own scores less ``SIGMAS`` standard deviations, so every
document is judged by the same rule and no sampling noise enters.

Raw counts cover every row, trusted counts every row whose label is of quality 1 and not
toxic.  What is collected is bounded, 2 * BUCKETS counts; the join with the labels is
Spark's choice, a broadcast only below its threshold, and where both sides are shuffled a
Bloom filter of the ids keeps other texts out of the shuffle.  Without any trusted row the
ratio is 0 and base rules decide alone.

Null text: no words, so base_failed.  Null ids are never trusted but still judged.
Repeated rows are judged alike.  A text without n-grams has score 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Packed, drop_path, written

BUCKETS = 8192
ALPHA = 1.0
SIGMAS = 4.0
MIN_WORDS = 50

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def with_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with _words and _h, the 64-bit hashes of the words in order.

    Values that later expressions use more than once are columns of a projection of
    their own: Catalyst keeps such projections apart, so nothing is worked out twice.
    """
    df = df.withColumn("_words", words_of(F.col(text)))
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


#: Up to so many repeated windows are looked up by a scan, more by a sort.
_FEW = 32


def with_repeat_words(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words: words in 3-word windows found twice or more in the text.

    Sorting the windows brings equal ones together.  The positions of windows with
    an equal one, in order, each cover three words less what the next one covers.
    """
    nothing = F.array().cast("array<int>")
    later = lambda a, k: F.slice(a, k, F.greatest(F.size(a), F.lit(1)))
    df = df.withColumn("_win", F.when(F.size("_h") >= 3, F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("_h", i + 1), F.get("_h", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_any", F.size(F.array_distinct("_win")) < F.size("_win"))
    df = df.withColumn("_s", F.when(F.col("_any"), F.sort_array("_win")))
    df = df.withColumn("_d", F.array_distinct(F.filter(F.zip_with("_s", later(F.col("_s"), 2), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())))
    few = F.filter(F.transform("_win", lambda w, i: F.when(F.array_contains("_d", w), i)), lambda i: i.isNotNull())
    df = df.withColumn("_p", F.when(F.col("_any") & (F.size("_d") > _FEW), F.sort_array(F.transform("_win", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    pairs = F.zip_with("_p", later(F.col("_p"), 2), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
    many = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    df = df.withColumn("_at", F.when(~F.col("_any"), nothing).when(F.size("_d") <= _FEW, few).otherwise(many))
    covers = F.zip_with("_at", later(F.col("_at"), 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.when(F.size("_at") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(covers, F.lit(0).cast("long"), lambda x, y: x + y)))
    return df.drop("_win", "_any", "_s", "_d", "_p", "_at")


def with_base(df: DataFrame) -> DataFrame:
    """``df`` with n_words and the four counts of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.regexp(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    return with_repeat_words(df).drop("_lines")


def _pair(buckets: int):
    return lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))


def grams(buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams and bigrams of _h; a null where the last word has no bigram."""
    after = F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1)))
    return F.concat(F.transform("_h", lambda a: F.pmod(a, F.lit(buckets)).cast("int")), F.zip_with("_h", after, _pair(buckets)))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a trusted label."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "100GB")
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_id"))
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")


def _counts(docs: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs in the n-grams of ``docs``."""
    out = [0] * buckets
    for r in with_hashes(docs).select(F.explode(grams(buckets)).alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _log_ratios(raw: list[int], good: list[int], alpha: float) -> list[float]:
    buckets = len(raw)
    if not sum(good):
        return [0.0] * buckets
    a, b = sum(good) + alpha * buckets, sum(raw) + alpha * buckets
    return [math.log((g + alpha) / a) - math.log((r + alpha) / b) for g, r in zip(good, raw, strict=True)]


def score(weights: list[float]) -> Column:
    """Mean weight of the n-grams of _h; 0 without any."""
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    size = len(weights)
    after = F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1)))
    each = F.zip_with("_h", after, lambda a, b: F.get(table, F.pmod(a, F.lit(size)).cast("int")) + F.coalesce(F.get(table, _pair(size)(a, b)), F.lit(0.0)))
    return F.when(F.size("_h") == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / F.greatest(2 * F.size("_h") - 1, F.lit(1)))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, sigmas: float = SIGMAS) -> DataFrame:
    """Every row of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    Columns of ``docs`` that have one of these names give way to them; others are kept whatever their names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    own = Packed(docs, ("doc_id", "text"), tuple(made))
    plain = own.df.select("doc_id", "text")
    good = written(trusted(plain, labels).select("text"), "trusted")
    weights = _log_ratios(_counts(plain, buckets), _counts(good, buckets), alpha)
    scored = with_hashes(good).select(score(weights).alias("s"))
    m = scored.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d"), F.count("*").alias("n")).first()
    drop_path(docs.sparkSession, good.table_path)
    least = m["m"] - sigmas * m["d"] if m["n"] else -math.inf
    out = with_base(with_hashes(own.df.select("in", "text"))).withColumn("llr", score(weights))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(F.col("llr") >= F.lit(least)))
    # A filter on a column made here must not be pushed below the projections that make it, which would repeat their work for each use.
    fence = F.explode(F.array(F.struct(*made))).alias("_q")
    return own.back(out.select("in", fence).select("in", "_q.*"), made)
