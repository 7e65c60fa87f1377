import pytest
from pyspark.sql import functions as F

from tapeworks.functions.rules import compile_rules, parse_rule


@pytest.mark.parametrize(("expr", "op", "number", "absolute"), [("> 5", ">", 5, False), ("<=-2.5", "<=", -2.5, False), ("7", "==", 7, False), ("!= 0", "!=", 0, False), ("abs >= .5", ">=", 0.5, True), (3, "==", 3, False), ("1e3", "==", 1000, False)])
def test_comparisons(expr, op, number, absolute):
    r = parse_rule({"signal": "s", "expr": expr})
    assert (r.op, r.number, r.absolute) == (op, number, absolute)
    assert r.holds(number) == (op in (">=", "<=", "==")) or absolute


@pytest.mark.parametrize(("expr", "op"), [("passes", "passes"), ("true", "passes"), (True, "passes"), ("false", "off"), (False, "off")])
def test_words(expr, op):
    assert parse_rule({"signal": "s", "expr": expr}).op == op


@pytest.mark.parametrize("expr", ["", "about 5", "> x", "abs", ">> 3", None])
def test_errors(expr):
    with pytest.raises(ValueError):
        parse_rule({"signal": "s", "expr": expr})


def test_columns(spark):
    df = spark.range(6).select("id", F.struct(F.col("id").cast("double").alias("value"), (F.col("id") > 2).alias("passes"), (F.col("id") == 4).alias("unavailable")).alias("s"))

    def kept(*rules):
        ok, why = compile_rules([parse_rule(r) for r in rules], df)
        return [r.id for r in df.where(ok).collect()], {r.id: r.why for r in df.select("id", why.alias("why")).collect()}

    assert kept({"signal": "s", "expr": "passes"})[0] == [3, 5]
    ids, why = kept({"signal": "s", "expr": ">= 2"}, {"signal": "s", "expr": "< 5", "seq": 2})
    assert ids == [2, 3] and why[0] == ["s >= 2"] and why[5] == ["s < 5"] and why[2] == []
    assert kept({"signal": "other", "expr": "> 9"})[0] == list(range(6))
    assert kept({"signal": "s", "expr": "> 9", "field": "absent"})[0] == list(range(6))
    assert kept({"signal": "s", "expr": "false"})[0] == list(range(6))
