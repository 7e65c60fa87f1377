"""Replay of trade intents over bars.

The unit of work is one key (symbol, strategy, parameters): its bars pass in order
through a small state machine, in bounded batches, so only open orders and trades
are carried.  Rules: an order is a limit, never filled on its own bar; its expiry is
looked at first; a filled order is checked for exits on the same bar; with both
prices touched the stop counts; slippage worsens the price of a stop or market exit
and is charged again as cost; at a session's end trades close at the last close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exits import TICK, Position, compile_exits, exit_price

POINT_VALUE, COMMISSION = 5.0, 0.35
TRADES = "entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, entry double, exit double, reason string, bars int, gross double, costs double, pnl double"


def slippage_ticks(atr_high: Column, event: Column) -> Column:
    """3 ticks on an event day, 2 in high volatility, else 1."""
    return F.when(event, 3).when(atr_high, 2).otherwise(1)


def trade_result(side: int, entry: float, exit_: float, market: bool, slip: int) -> tuple[float, float, float]:
    """(exit price, gross, costs) of one contract."""
    if market:
        exit_ -= side * slip * TICK
    costs = 2 * COMMISSION + (slip * TICK * POINT_VALUE if market else 0.0)
    return exit_, side * (exit_ - entry) * POINT_VALUE, costs


class Book:
    """Orders and open trades of one key."""

    def __init__(self, exits: list[dict] | None, max_position: int, expiry: int) -> None:
        self.first_exit = compile_exits(exits) if exits is not None else None
        self.rules = [r for r in exits or [] if r.get("enabled", True)]
        self.max_position, self.expiry = max_position, expiry
        self.orders: list[dict] = []
        self.open: list[tuple[dict, Position]] = []
        self.day, self.last = None, None
        self.done: list[tuple] = []

    def _close(self, o: dict, p: Position, price: float, ts, reason: str, market: bool, slip: int) -> None:
        price, gross, costs = trade_result(p.side, p.fill, price, market, slip)
        self.done.append((o["filled"], ts, p.side, p.fill, price, reason, p.bars, gross, costs, gross - costs))

    def end_session(self) -> None:
        """Everything that is open closes at the last close; orders lapse."""
        if self.last:
            for o, p in self.open:
                self._close(o, p, self.last["close"], self.last["ts"], "session_close", True, self.last["slip"])
        self.open, self.orders = [], []

    def _exit(self, o: dict, p: Position, b: dict) -> bool:
        if self.first_exit:
            why = self.first_exit(p, b)
            if why is None:
                return False
            price, reason, market = exit_price(self.rules, why, p, b)
            self._close(o, p, price, b["ts"], reason, market, b["slip"])
            return True
        adverse, best = (b["low"], b["high"]) if p.side > 0 else (b["high"], b["low"])
        if p.side * (p.stop - adverse) >= 0:
            self._close(o, p, p.stop, b["ts"], "stop", True, b["slip"])
        elif p.side * (best - p.target) >= 0:
            self._close(o, p, p.target, b["ts"], "target", False, b["slip"])
        elif o["age"] >= self.expiry:
            self._close(o, p, b["close"], b["ts"], "expired", True, b["slip"])
        else:
            return False
        return True

    def bar(self, b: dict) -> None:
        if self.day is not None and b["day"] != self.day:
            self.end_session()
        self.day, self.last = b["day"], b
        for o in self.orders:
            o["age"] += 1
        for o, p in self.open:
            o["age"] += 1
            p.bars += 1
        waiting = []
        for o in self.orders:
            if o["age"] > self.expiry:
                continue
            touched = b["low"] <= o["entry"] if o["side"] > 0 else b["high"] >= o["entry"]
            if touched and len(self.open) < self.max_position:
                self.open.append(({**o, "filled": b["ts"]}, Position(o["side"], o["entry"], o["atr"], o["target"], o["stop"])))
            else:
                waiting.append(o)
        self.orders = waiting
        self.open = [x for x in self.open if not self._exit(*x, b)]
        if b["side"] and len(self.open) < self.max_position:
            self.orders.append({"side": int(b["side"]), "entry": b["entry"], "target": b["target"], "stop": b["stop"], "atr": b["atr_entry"], "age": 0})

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def replay(bars: DataFrame, by: list[str], exits: list[dict] | None = None, max_position: int = 1, expiry: int = 12, fields: tuple[str, ...] = ()) -> DataFrame:
    """Trades of intents over bars.

    ``bars``: by, ts, day, high, low, close, side (1, -1 or 0), entry, target, stop,
    atr_entry, slip, and ``fields`` (``signal.field``) that exit rules read.  Without
    ``exits`` the intent's own bracket and expiry decide.
    """
    own = ["ts", "day", "high", "low", "close", "side", "entry", "target", "stop", "atr_entry", "slip"]
    cols = [*[F.col(c) for c in by], *[F.col(c) for c in own], *[F.col(f).alias(f.replace(".", "__")) for f in fields]]
    return folded(bars.select(*cols), by, lambda: Book(exits, max_position, expiry), TRADES)


def folded(rows: DataFrame, by: list[str], make: Callable[[], Any], schema: str) -> DataFrame:
    """Rows of each key in order of ts through a state machine: ``bar(row)``, ``end_session()`` at the key's end, ``take()`` for what it has made.

    Keys run apart; a key's rows come in bounded batches, so only the machine's state is carried.
    """
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "ts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [x.split()[0] for x in schema.split(", ")]
    times = {x.split()[0]: "datetime64[us]" for x in schema.split(", ") if x.split()[1].startswith("timestamp")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None

        def frame(k, made: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(made, columns=names)
            for i, c in enumerate(by):
                out.insert(i, c, k[i])
            return out.astype(times)

        for pdf in batches:
            pdf.columns = [c.replace("__", ".") for c in pdf.columns]
            at = np.flatnonzero(np.r_[True, (pdf[by].iloc[1:].to_numpy() != pdf[by].iloc[:-1].to_numpy()).any(1)]) if len(pdf) else []
            for lo, hi in zip(at, [*at[1:], len(pdf)], strict=False):
                k = tuple(pdf[by].iloc[lo])
                if k != key:
                    if machine:
                        machine.end_session()
                        if made := machine.take():
                            yield frame(key, made)
                    key, machine = k, make()
                for b in pdf.iloc[lo:hi].to_dict("records"):
                    machine.bar(b)
                if made := machine.take():
                    yield frame(key, made)
        if machine:
            machine.end_session()
            if made := machine.take():
                yield frame(key, made)

    return ordered.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + schema)


def first_touch(intents: DataFrame, bars: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """Outcome of brackets within the next ``horizon`` bars, on native windows: reason, bars until it, price.

    ``intents`` are the rows of ``bars`` with side, target and stop; entry is at the
    close. The look-ahead is a frame of fixed length, so its cost is rows times horizon.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(1, horizon)
    path = F.collect_list(F.struct("high", "low", "close")).over(w)
    df = bars.withColumn("_path", path).join(intents.select(*by, "ts", "side", "target", "stop"), [*by, "ts"])

    def step(x: Column, i: Column) -> Column:
        adverse = F.when(F.col("side") > 0, x["low"]).otherwise(x["high"])
        best = F.when(F.col("side") > 0, x["high"]).otherwise(x["low"])
        why = F.when(F.col("side") * (F.col("stop") - adverse) >= 0, "stop").when(F.col("side") * (best - F.col("target")) >= 0, "target")
        return F.struct(why.alias("why"), (i + 1).alias("n"), x["close"].alias("close"))

    steps = F.transform("_path", step)
    hit = F.get(F.filter(steps, lambda s: s["why"].isNotNull()), F.lit(0))
    end = F.element_at(steps, -1)
    df = df.withColumn("_hit", hit).withColumn("_end", F.when(F.size("_path") > 0, end))
    reason = F.coalesce("_hit.why", F.when(F.size("_path") > 0, "expired"))
    price = F.when(F.col("_hit.why") == "stop", F.col("stop")).when(F.col("_hit.why") == "target", F.col("target")).otherwise(F.col("_end.close"))
    return df.select(*by, "ts", "side", reason.alias("reason"), F.coalesce("_hit.n", "_end.n").alias("bars"), price.alias("exit")).where("reason is not null")


class RiskState:
    """Position, realised P&L and halt of one account; checks in order: halt, session, position, signals."""

    def __init__(self, max_position: int = 1, max_loss: float = 150.0, max_signals: int = 10) -> None:
        self.max_position, self.max_loss, self.max_signals = max_position, max_loss, max_signals
        self.reset()

    def reset(self) -> None:
        self.position, self.average, self.realised, self.signals, self.halted = 0, 0.0, 0.0, 0, False

    def allow(self, in_session: bool) -> str | None:
        """None if a new signal may pass, else why not."""
        if self.halted:
            return "halted"
        if not in_session:
            return "session"
        if abs(self.position) >= self.max_position:
            return "position"
        if self.signals >= self.max_signals:
            return "signals"
        self.signals += 1
        return None

    def fill(self, side: int, price: float, n: int = 1) -> None:
        if self.position * side >= 0:
            total = abs(self.position) + n
            self.average = (self.average * abs(self.position) + price * n) / total
            self.position += side * n
        else:
            closed = min(n, abs(self.position))
            self.realised += (price - self.average) * closed * (1 if self.position > 0 else -1)
            self.position += side * n
            if self.position * side > 0:
                self.average = price
        if self.realised <= -self.max_loss:
            self.halted = True


def risk_path(fills: DataFrame, by: list[str], **limits) -> DataFrame:
    """Realised P&L, position and halt of each account and day after each fill (side, px), which starts anew each day."""
    ordered = fills.withColumn("day", F.col("ts").cast("date")).repartition(*by, "day").sortWithinPartitions(*by, "day", "ts")
    keys = [*by, "day"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, RiskState(**limits)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                k = tuple(getattr(r, c) for c in keys)
                if k != key:
                    key = k
                    state.reset()
                if not state.halted:
                    state.fill(int(r.side), float(r.px))
                rows.append((state.position, state.realised, state.halted))
            yield pdf.assign(position=[x[0] for x in rows], realised=[x[1] for x in rows], halted=[x[2] for x in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", position int, realised double, halted boolean"
    return ordered.mapInPandas(run, schema)
