"""A small filter language over signal structs, compiled to columns.

A rule names a signal and an expression: a comparison (``>= 20``), a bare number
(equality), ``passes`` or ``true``, or ``false`` (the rule is off).  ``abs`` before a
comparison takes the absolute value, ``field`` another field than ``value``, and
``seq`` orders stages.  Rules are joined by AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
_EXPR = re.compile(r"(abs\s+)?(<=|>=|==|!=|<|>)?\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


@dataclass(frozen=True)
class Rule:
    signal: str
    op: str  # a comparison, "passes" or "off"
    number: float = 0.0
    absolute: bool = False
    field: str | None = None
    seq: int = 1
    bar: str | None = None
    text: str = ""

    def holds(self, value: float) -> bool:
        """The comparison on a plain number, for state machines."""
        v = abs(value) if self.absolute else value
        return {"<": v < self.number, ">": v > self.number, "<=": v <= self.number, ">=": v >= self.number, "==": v == self.number, "!=": v != self.number}[self.op]


def parse_rule(spec: dict) -> Rule:
    """A rule of its configuration; an expression that can't be read is an error."""
    raw = spec.get("expr")
    common = {"signal": spec["signal"], "field": spec.get("field"), "seq": int(spec.get("seq", 1)), "bar": spec.get("bar"), "text": f"{spec['signal']} {raw}"}
    if isinstance(raw, bool):
        return Rule(op="passes" if raw else "off", **common)
    text = str(raw).strip()
    if text.lower() in ("passes", "true"):
        return Rule(op="passes", **common)
    if text.lower() == "false":
        return Rule(op="off", **common)
    m = _EXPR.fullmatch(text)
    if not m:
        raise ValueError(f"can't read the filter expression {text!r}")
    return Rule(op=m[2] or "==", number=float(m[3]), absolute=bool(m[1]), **common)


def _fields(df: DataFrame, signal: str) -> list[str]:
    kind = df.schema[signal].dataType if signal in df.columns else None
    return kind.fieldNames() if hasattr(kind, "fieldNames") else []


def rule_column(rule: Rule, df: DataFrame) -> Column | None:
    """True where the rule lets a row pass; None if it doesn't apply to the table."""
    have = _fields(df, rule.signal)
    if rule.op == "off" or not have:
        return None
    if rule.op == "passes":
        ok = F.col(f"{rule.signal}.passes")
    else:
        field = rule.field or "value"
        if field not in have:
            return None
        x = F.col(f"{rule.signal}.{field}").cast("double")
        ok = _OPS[rule.op](F.abs(x) if rule.absolute else x, F.lit(rule.number))
    ok = F.coalesce(ok, F.lit(True))
    return ok & ~F.coalesce(F.col(f"{rule.signal}.unavailable"), F.lit(False)) if "unavailable" in have else ok


def compile_rules(rules: list[Rule], df: DataFrame) -> tuple[Column, Column]:
    """(all rules hold, texts of those that don't), in ascending order of their stages."""
    ok, reasons = F.lit(True), []
    for rule in sorted(rules, key=lambda r: r.seq):
        c = rule_column(rule, df)
        if c is not None:
            ok = ok & c
            reasons.append(F.when(~c, F.lit(rule.text)))
    return ok, F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else F.array().cast("array<string>")
