"""URL filters on native functions: host rules first, then pattern rules by their rarest token.

Host rules: a rule ``(host, path)`` fits its host and all subdomains if the url's
path starts with the rule's; of the rules that fit, the longest decides.

Pattern rules are regular expressions with literal tokens that any match must hold.
Each is filed under the one of its tokens that is rarest in the table's urls.  The
tokens of a url fetch the rules filed under them, and only those run their regular
expression.  A url is blocked if a fetched rule matches, else allowed.

Up to ``LITERALS`` rules are a hash table of literals in the plan, and no row is
shuffled; more are a table that tokens are joined with.  A null url, or one without
``://``, has an empty host and path; its tokens are still looked at.  Repeated rows are
judged alike; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Packed

#: Rules that may stand in the plan as literals.
LITERALS = 4096

#: Rules of the contract: (host, path, verdict).
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Pattern rules: (name, literal tokens that every match holds, regular expression on the lower-cased url).
PATTERN_RULES = [
    ("ad-server", ["ads"], r"[/.]ads[/.]"),
    ("ad-click", ["adclick"], r"[/?&]adclick\b"),
    ("banner", ["banners"], r"/banners/"),
    ("casino", ["casino"], r"\bcasino\b"),
    ("poker", ["poker"], r"\bpoker\b"),
    ("porn", ["porn"], r"\bporn\b"),
    ("xxx", ["xxx"], r"\.xxx[/:?#]|\bxxx\b"),
    ("pharma", ["viagra"], r"\bviagra\b"),
    ("login", ["login"], r"/login([/?#]|$)"),
    ("cart", ["cart", "checkout"], r"/cart/checkout\b"),
    ("calendar", ["calendar", "ical"], r"/calendar/.*\bical\b"),
    ("session", ["jsessionid"], r";jsessionid="),
    ("phpsession", ["phpsessid"], r"[?&]phpsessid="),
    ("cgi", ["cgi", "bin"], r"/cgi-bin/"),
    ("print", ["print", "view"], r"[?&]view=print\b"),
    ("tag-index", ["tag", "page"], r"/tag/[^/]+/page/\d+"),
    ("archive-index", ["wp", "json"], r"/wp-json/"),
    ("feed", ["feed", "rss"], r"/feed/rss\b"),
]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null; ties: the first listed."""
    rules = HOST_RULES if rules is None else rules
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: len(r[0] + r[1]))
    for h, p, verdict in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased url."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def rarest_tokens(pages: DataFrame, rules) -> dict[str, str]:
    """For each rule's name its token in the fewest urls (ties: alphabetical). The result is bounded by the rules."""
    wanted = sorted({t for _, tokens, _ in rules for t in tokens})
    tokens = pages.select(F.explode(tokens_of(F.col("url"))).alias("t"))
    few = tokens.where(F.col("t").isin(wanted)) if len(wanted) <= LITERALS else tokens.join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string"), "t", "left_semi")
    count = {r["t"]: r["count"] for r in few.groupBy("t").count().collect()}
    return {name: min(tokens, key=lambda t: (count.get(t, 0), t)) for name, tokens, _ in rules}


def fetched_rules(tokens: Column, rules, index: dict[str, str]) -> Column:
    """Rules filed under any of the tokens: array<struct<token, n, name, regex>>."""
    size = 1
    while size < 2 * len(rules):
        size *= 2
    buckets: list[list] = [[] for _ in range(size)]
    for n, (name, _, regex) in enumerate(rules):
        t = index[name]
        buckets[zlib.crc32(t.encode()) % size].append(F.struct(F.lit(t).alias("token"), F.lit(n).alias("n"), F.lit(name).alias("name"), F.lit(regex).alias("regex")))
    kind = "array<struct<token:string,n:int,name:string,regex:string>>"
    none = F.array().cast(kind)
    table = F.array(*[F.array(*b).cast(kind) if b else none for b in buckets])
    return F.flatten(F.transform(tokens, lambda t: F.filter(F.get(table, F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(size)).cast("int")), lambda r: r["token"] == t)))


def matched_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, pattern) of the distinct urls that a rule of ``rules (n, name, token, regex)`` matches, the first by n.

    For rule tables of any size: tokens of each different url meet the rules filed under
    them in a join, and only those run their regular expression.
    """
    tokens = urls.select("url").where("url is not null").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    hit = tokens.join(rules, "token").where(F.regexp(F.lower("url"), F.col("regex")))
    return hit.groupBy("url").agg(F.min_by("name", "n").alias("pattern"))


def filter_urls(pages: DataFrame, host_rules=None, pattern_rules=None, literals: int = LITERALS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern (the first pattern rule that matched, else null).

    Rules beyond ``literals`` are a table that is joined (broadcast only if Spark finds it
    small); the result is the same either way.  Columns of ``pages`` are kept whatever
    their names, but for those named like what is made.
    """
    pattern_rules = PATTERN_RULES if pattern_rules is None else pattern_rules
    for _, tokens, regex in pattern_rules:
        re.compile(regex)
        if not tokens:
            raise ValueError("a pattern rule needs a literal token")
    made = ["host", "path", "rule", "verdict", "pattern"]
    own = Packed(pages, ("url",), tuple(made))
    url = F.col("url")
    low = F.lower(F.coalesce(url, F.lit("")))
    index = rarest_tokens(own.df, pattern_rules) if pattern_rules else {}
    out = own.df.select("in", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if not pattern_rules:
        out = out.withColumn("pattern", F.lit(None).cast("string"))
    elif len(pattern_rules) <= literals:
        out = out.withColumn("fetched", fetched_rules(tokens_of(url), pattern_rules, index))
        out = out.withColumn("pattern", F.get(F.array_sort(F.transform(F.filter("fetched", lambda r: F.regexp(low, r["regex"])), lambda r: F.struct(r["n"].alias("n"), r["name"].alias("name")))), F.lit(0))["name"])
    else:
        rows = [(n, name, index[name], regex) for n, (name, _, regex) in enumerate(pattern_rules)]
        rules = own.df.sparkSession.createDataFrame(rows, "n int, name string, token string, regex string")
        out = out.join(matched_by_join(own.df, rules).withColumnRenamed("url", "_u"), F.col("url") == F.col("_u"), "left")
    out = out.withColumn("found", host_rule(F.col("host"), F.col("path"), host_rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return own.back(out.select("in", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "pattern"), made)
