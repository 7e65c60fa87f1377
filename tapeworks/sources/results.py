"""Reports of small results: JSON, YAML and Markdown, written to any store that Spark knows; runs that can be taken up again."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Rows that a report takes at most; a longer table is no report.
REPORT_ROWS = 10_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    fs, p = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if it isn't there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def rows_of(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows are no report")
    return [r.asDict(recursive=True) for r in rows]


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def to_json(x) -> str:
    return json.dumps(_plain(x), indent=1, sort_keys=True)


def to_yaml(x, indent: int = 0) -> str:
    """Mappings, lists and scalars as YAML; strings stand in quotes."""
    pad = "  " * indent
    if isinstance(x, dict):
        return "".join(f"{pad}{k}:" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(_plain(v))}\n") for k, v in x.items())
    return "".join(f"{pad}-" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(_plain(v))}\n") for v in x)


def to_markdown(rows: list[dict], title: str = "") -> str:
    """A table; numbers with four digits."""
    head = f"## {title}\n\n" if title else ""
    if not rows:
        return f"{head}No rows.\n"
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    names = list(rows[0])
    lines = [f"| {' | '.join(names)} |", f"|{'-|' * len(names)}", *[f"| {' | '.join(cell(r[n]) for n in names)} |" for r in rows]]
    return head + "\n".join(lines) + "\n"


def resumable(spark: SparkSession, path: str, names: Iterable[str], run: Callable[[str], DataFrame]) -> dict[str, list[dict]]:
    """Results of each name; what a run before has written is read, the rest is worked out and written at once."""
    out = {}
    for n in names:
        at = f"{path}/{n}.json"
        text = read_text(spark, at)
        if text is None:
            text = to_json(rows_of(run(n)))
            write_text(spark, at, text)
        out[n] = json.loads(text)
    return out


def phase_report(spark: SparkSession, path: str, phases: dict[str, Callable[[str], DataFrame]], strategies: list[str]) -> str:
    """Results of every phase and strategy, taken up where a run before ended, as one Markdown report beside them."""
    parts = []
    for phase, f in phases.items():
        found = resumable(spark, f"{path}/{phase}", strategies, f)
        parts.append(to_markdown([{"strategy": s, **r} for s in strategies for r in found[s]], phase))
    text = "\n".join(parts)
    write_text(spark, f"{path}/report.md", text)
    return text
