"""Replay on two timeframes, simulation of a predictor's trades, and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exits import TICK
from .replay import COMMISSION, POINT_VALUE, folded, replay


def dual_replay(coarse: DataFrame, fine: DataFrame, freq: str, by: list[str], exits: list[dict] | None = None, max_position: int = 1, expiry: int = 60, fields: tuple[str, ...] = ()) -> DataFrame:
    """Trades whose entries come from coarse bars and whose fills and exits are looked for on fine ones.

    ``coarse`` as for ``replay``; ``fine``: by, ts, day, high, low, close.  Each fine bar
    carries its coarse bar's columns; an order stands from the last fine bar of its
    coarse bar on, so it can be filled in the next one at the earliest.  An equi-join on
    the truncated time maps one to the other.
    """
    bucket = F.window("ts", freq)["start"].cast("timestamp_ntz")
    price = ["side", "entry", "target", "stop", "atr_entry", "slip"]
    signals = sorted({f.split(".")[0] for f in fields})
    own = fine.select(*by, "ts", "day", "high", "low", "close").withColumn("_b", bucket)
    last = F.col("ts") == F.max("ts").over(Window.partitionBy(*by, "_b"))
    rows = own.withColumn("_last", last).join(coarse.select(*by, F.col("ts").alias("_b"), *price, *signals), [*by, "_b"], "left")
    rows = rows.withColumn("side", F.when(F.col("_last"), F.coalesce("side", F.lit(0))).otherwise(0)).withColumn("slip", F.coalesce("slip", F.lit(1)))
    return replay(rows.na.fill(0.0, ["entry", "target", "stop", "atr_entry"]), by, exits, max_position, expiry, fields)


TRADES = "entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, entry double, exit double, reason string, bars int, confidence double, gross double, costs double, pnl double"


class _Predicted:
    """Open trades of one key: cooldown, a cap of positions, an end after so many bars, and one at the change of day."""

    def __init__(self, p: dict) -> None:
        self.p, self.open, self.done, self.i, self.entered, self.day, self.last = p, [], [], -1, None, None, None

    def _close(self, o: dict, b: dict, price: float, why: str, market: bool) -> None:
        slip = self.p["slip_ticks"] if market else 0
        price -= o["side"] * slip * TICK
        gross = o["side"] * (price - o["entry"]) * POINT_VALUE
        costs = 2 * COMMISSION + slip * TICK * POINT_VALUE
        self.done.append((o["ts"], b["ts"], o["side"], o["entry"], price, why, self.i - o["i"], o["confidence"], gross, costs, gross - costs))

    def end_session(self) -> None:
        for o in self.open:
            self._close(o, self.last, self.last["close"], "session_close", True)
        self.open = []

    def bar(self, b: dict) -> None:
        p, self.i = self.p, self.i + 1
        self.last = b
        if self.day is not None and b["day"] != self.day:
            self.end_session()  # at the first close of the day that follows
        self.day = b["day"]
        left = []
        for o in self.open:
            s = o["side"]
            adverse, best = (b["low"], b["high"]) if s > 0 else (b["high"], b["low"])
            if s * (o["stop"] - adverse) >= 0:
                self._close(o, b, o["stop"], "stop", True)
            elif s * (best - o["target"]) >= 0:
                self._close(o, b, o["target"], "target", False)
            elif self.i - o["i"] >= p["horizon"]:
                self._close(o, b, b["close"], "expiry", True)
            else:
                left.append(o)
        self.open = left
        if len(left) >= p["max_position"] or self.entered is not None and self.i - self.entered < p["cooldown"] or b["ahead"] < p["horizon"]:
            return
        up, down = b["p_up"], b["p_down"]
        side = 1 if up >= p["threshold"] and up > down else -1 if down >= p["threshold"] and down > up else 0
        if side:
            self.open.append({"side": side, "ts": b["ts"], "i": self.i, "entry": b["close"], "target": b["close"] + side * p["take_ticks"] * TICK, "stop": b["close"] - side * p["stop_ticks"] * TICK, "confidence": up if side > 0 else down})
            self.entered = self.i

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def predicted_trades(bars: DataFrame, by: list[str], threshold: float = 0.6, take_ticks: int = 8, stop_ticks: int = 6, horizon: int = 300, cooldown: int = 30, max_position: int = 1, slip_ticks: int = 1) -> DataFrame:
    """Trades of class probabilities (p_up, p_down) over bars (by, ts, day, high, low, close): entry at the close, stop before target."""
    p = {"threshold": threshold, "take_ticks": take_ticks, "stop_ticks": stop_ticks, "horizon": horizon, "cooldown": cooldown, "max_position": max_position, "slip_ticks": slip_ticks}
    w = Window.partitionBy(*by)
    ahead = F.count("*").over(w) - F.row_number().over(w.orderBy("ts"))
    rows = bars.select(*by, "ts", "day", "high", "low", "close", "p_up", "p_down", (ahead + 1).alias("ahead"))
    return folded(rows, by, lambda: _Predicted(p), TRADES)


def simulator_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Metrics as simulators report them: Sharpe and Sortino of daily dollars (downside: deviation of losing days), drawdown in percent of the peak where it is deepest."""
    x = F.col("pnl")
    days = trades.groupBy(*by, F.col("entry_ts").cast("date").alias("_d")).agg(F.sum(x).alias("_p"))
    year = math.sqrt(252)
    sd, down = F.stddev_samp("_p"), F.stddev_samp(F.when(F.col("_p") < 0, F.col("_p")))
    daily = days.groupBy(*by).agg(F.count("*").alias("days"), F.when(sd > 0, F.avg("_p") / sd * year).otherwise(0.0).alias("sharpe"), F.when(down > 0, F.avg("_p") / down * year).otherwise(0.0).alias("sortino"))
    w = Window.partitionBy(*by).orderBy("exit_ts", "entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    e = trades.withColumn("_e", F.sum(x).over(w)).withColumn("_peak", F.max("_e").over(w)).withColumn("_dd", F.col("_e") - F.col("_peak"))
    loss = F.sum(F.when(x <= 0, -x))
    whole = e.groupBy(*by).agg(F.count("*").alias("n_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.when(loss > 0, F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)) / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.sum(x).alias("net"), F.min("_dd").alias("_worst"), F.min_by("_peak", F.struct("_dd", "exit_ts", "entry_ts")).alias("_at"))
    out = whole.withColumn("max_drawdown_pct", F.col("_worst") / (F.col("_at") + 1e-9) * 100).drop("_worst", "_at").join(daily, by)
    return out.withColumn("trades_per_day", F.col("n_trades") / F.col("days"))
