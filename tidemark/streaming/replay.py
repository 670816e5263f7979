"""Replay of frozen signals over a stream of bars, one state machine for each symbol.

Events are bars (``open`` set) and signals (``direction`` set), in one frame.  A symbol holds at most one position.  At each new
bar an open position is closed if its exit time has come, before anything is opened; then signals whose entry time
has passed are skipped as stale; then, if flat, the signal whose entry time is that of the bar is opened at its open.
Repeated ticks of a bar do nothing.  Signals must arrive no later than their bar; bars that arrive late are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Events of the replay and what it reports.
EVENTS = "symbol string, time timestamp, open double, exit_time timestamp, direction int, signal_id string"
REPORT = "symbol string, time timestamp, event string, signal_id string, direction int, price double"
STATE = "last_bar string, pending string, held string"


class Machine:
    """The state of one symbol: the last bar's time, pending signals by entry time and the open position."""

    def __init__(self, last_bar: int | None = None, pending: list | None = None, held: list | None = None):
        self.last_bar, self.pending, self.held = last_bar, pending or [], held

    def signal(self, entry: int, exit_: int, direction: int, name: str) -> None:
        self.pending.append([entry, name, exit_, direction])
        self.pending.sort()

    def bar(self, time: int, price: float) -> list[tuple[int, str, str, int, float]]:
        """(time, event, signal, direction, price) of what a bar leads to."""
        if self.last_bar is not None and time <= self.last_bar:
            return []
        self.last_bar, out = time, []
        if self.held and time >= self.held[2]:
            out.append((time, "close", self.held[1], self.held[3], price))
            self.held = None
        while self.pending and self.pending[0][0] < time:
            _, name, _, direction = self.pending.pop(0)
            out.append((time, "stale", name, direction, price))
        if self.held is None and self.pending and self.pending[0][0] == time:
            self.held = self.pending.pop(0)
            out.append((time, "open", self.held[1], self.held[3], price))
        return out


def micros(t) -> int:
    return int(t.value // 1000)


def run_events(pdf, machine: Machine) -> list[tuple]:
    """Feeds events in order of time, signals before bars."""
    out = []
    pdf = pdf.assign(is_bar=pdf["open"].notna()).sort_values(["time", "is_bar", "signal_id"], kind="stable")
    for t, price, exit_, direction, name, is_bar in zip(pdf["time"], pdf["open"], pdf["exit_time"], pdf["direction"], pdf["signal_id"], pdf["is_bar"], strict=True):
        if is_bar:
            out += machine.bar(micros(t), float(price))
        else:
            machine.signal(micros(t), micros(exit_), int(direction), name)
    return out


def framed(symbol: str, rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame([(symbol, pd.Timestamp(t, unit="us"), *rest) for t, *rest in rows], columns=["symbol", "time", "event", "signal_id", "direction", "price"])
    return out.astype({"direction": "int32", "price": "float64"}) if len(out) else out


def as_events(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars (symbol, date, open) and signals (symbol, entry_timestamp, exit_timestamp, direction, signal_id) as one frame of events."""
    none = lambda kind: F.lit(None).cast(kind)
    a = bars.select("symbol", F.col("date").cast("timestamp").alias("time"), F.col("open").cast("double").alias("open"), none("timestamp").alias("exit_time"), none("int").alias("direction"), none("string").alias("signal_id"))
    b = signals.select("symbol", F.col("entry_timestamp").cast("timestamp").alias("time"), none("double").alias("open"), F.col("exit_timestamp").cast("timestamp").alias("exit_time"), F.col("direction").cast("int").alias("direction"), "signal_id")
    return a.unionByName(b)


def replay_stream(events: DataFrame) -> DataFrame:
    """What happens, from a streaming frame of events; the state outlives micro-batches and restarts."""
    ship(events.sparkSession)

    def step(key, batches, state):
        import pandas as pd

        machine = Machine(*map(json.loads, state.get)) if state.exists else Machine()
        rows = run_events(pd.concat(list(batches)), machine)
        state.update(tuple(json.dumps(x) for x in (machine.last_bar, machine.pending, machine.held)))
        yield framed(key[0], rows)

    return events.groupBy("symbol").applyInPandasWithState(step, REPORT, STATE, "append", "NoTimeout")


def replay(events: DataFrame) -> DataFrame:
    """The same over a table of events: each symbol's history is one run of the machine."""
    ship(events.sparkSession)

    def run(pdf):
        return framed(pdf["symbol"].iloc[0], run_events(pdf, Machine()))

    return events.groupBy("symbol").applyInPandas(run, REPORT)
