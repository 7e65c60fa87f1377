import pytest

import __spark_entry__ as entry
from tapeworks.operators.strategies import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_trades_of_every_strategy(spark, sf, name):
    """Each runs with its own exits."""
    query = entry.queries()["b08_strategy_trades" if name == "donchian_breakout_trend" else f"b08_{name}"]
    out = query(spark, sf)
    assert {"symbol", "entry", "exit", "pnl"} <= set(out.columns)
    out.collect()
