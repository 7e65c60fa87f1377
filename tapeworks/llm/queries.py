"""The thin contract queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary files; a path is looked up when a query runs.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_VOCABULARY = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import dedup_passages

    out = dedup_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_repeated", "n_shared", "n_removed", "n_words_removed", (F.col("n_removed") > 0).alias("changed"), "text")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramlm import score_documents

    return score_documents(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wumanber import digest, find_items

    return digest(find_items(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_VOCABULARY))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    return filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    from .urlfilter import HOST_RULES, PATTERN_RULES

    q = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)})", h + p, v) for h, p, v in order]
    rule = " ".join(f"WHEN {c} THEN {q(r)}" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN {q(v)}" for c, _, v in fits)
    pattern = " OR ".join(f"regexp_matches(lower(coalesce(url, '')), {q(x)})" for _, _, x in PATTERN_RULES)
    return f"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {pattern} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets of rows (id, text) of a table ``texts``, and components of their links.
_LINKED = f"""
w AS (SELECT id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM texts WHERE text IS NOT NULL AND id IS NOT NULL),
sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT p.a, p.b FROM pairs p JOIN sz x ON x.id = p.a JOIN sz y ON y.id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""

_OP2_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id AS id, text FROM documents), {_LINKED}
SELECT t.id AS doc_id, coalesce(sz.n, 0) AS n_shingles, coalesce(comp.component, t.id) AS component_id, t.id = coalesce(comp.component, t.id) AS kept
FROM texts t LEFT JOIN sz ON sz.id = t.id LEFT JOIN comp ON comp.id = t.id"""

_OP7_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iz AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM iz)),
lens AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, lens)),
occ AS (SELECT DISTINCT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON pat.n = win.n AND pat.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(own.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_roundtrip, op2_near_duplicates, op3_quality_rules, op4_html_text, op5_passage_dedup, op6_lm_scores, op7_decontamination, op8_line_dedup, op9_token_counts, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    from .linededup import ORACLE_SQL

    return {"op2_near_duplicates": _OP2_SQL, "op7_decontamination": _OP7_SQL, "op8_line_dedup": ORACLE_SQL, "op10_url_filters": _op10_sql()}
