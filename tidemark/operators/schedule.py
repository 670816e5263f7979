"""Greedy non-overlapping schedules, return ledgers and reconciliation.

An accepted trade blocks later ones, which no window function expresses; the sorted
starts and ends of a group (one symbol and horizon) are walked once in an Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources.bars import ContractError
from .labels import bps

TOLERANCE = 1e-12


def walk(starts, ends, rejected_extend: bool) -> list[bool]:
    """Which of the intervals, in order of their starts, begin when none taken before (or none at all) is open."""
    taken, until = [], None
    for s, e in zip(starts, ends, strict=True):
        ok = until is None or s >= until
        taken.append(ok)
        if ok:
            until = e
        elif rejected_extend:
            until = max(until, e)
    return taken


def greedy(df: DataFrame, keys: list[str], start: str, busy_until: str, candidate=None, rejected_extend: bool = False) -> DataFrame:
    """Rows accepted in order of ``start``: a candidate is taken unless it starts before the last taken one ends.

    ``rejected_extend`` lets refused candidates block as well.
    """
    ship(df.sparkSession)
    rows = df if candidate is None else df.where(F.coalesce(candidate, F.lit(False)))

    def run(group):
        import pyarrow as pa

        group = group.sort_by([(start, "ascending"), (busy_until, "ascending")])
        starts, ends = (group.column(c).cast(pa.int64()).to_pylist() for c in (start, busy_until))
        return group.filter(pa.array(walk(starts, ends, rejected_extend)))

    return rows.groupBy(*keys).applyInArrow(run, rows.schema)


def by_rows(df: DataFrame, keys: list[str], h: str = "horizon", band: float = 0.0) -> DataFrame:
    """Trades at least max(1, h) rows apart; within ``band`` of one half there is none, and nothing is blocked."""
    candidate = F.abs(F.col("p") - 0.5) >= band if band > 0 else None
    return greedy(df.withColumn("__end", F.col("row_id") + F.greatest(F.lit(1), F.col(h))), keys, "row_id", "__end", candidate).drop("__end")


def replay_signals(df: DataFrame, keys: list[str], threshold: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Signals by time: direction from p >= threshold, none strictly within ``margin`` of one half."""
    if df.where(F.col("exit_timestamp") <= F.col("entry_timestamp")).limit(1).count():
        raise ContractError("an exit is not after its entry")
    taken = greedy(df, keys, "entry_timestamp", "exit_timestamp", F.abs(F.col("p") - 0.5) >= margin)
    fmt = lambda c: F.date_format(c, "yyyy.MM.dd HH:mm")
    return taken.select(*keys, "row_id", fmt("entry_timestamp").alias("entry_time"), fmt("exit_timestamp").alias("exit_time"), F.when(F.col("p") >= threshold, 1).otherwise(-1).alias("direction"), F.concat(F.lit("h"), F.col("horizon"), F.lit("_row"), F.col("row_id")).alias("signal_id"))


def one_position(df: DataFrame, keys: list[str], margin: float = 0.05, rejected_extend: bool = False) -> DataFrame:
    """One position at a time by entry and exit rows; p at the margin abstains."""
    taken = greedy(df, keys, "entry_row_index", "exit_row_index", F.abs(F.col("p") - 0.5) > margin + TOLERANCE, rejected_extend)
    name = F.concat(F.lit("row"), F.col("row_id"), F.lit("_entry"), F.col("entry_row_index"), F.lit("_exit"), F.col("exit_row_index"))
    return taken.withColumn("signal", F.when(F.col("p") > 0.5, 1).otherwise(-1)).withColumn("signal_id", name)


#: Strategies of the ledger; all act on the candidate's active rows.
STRATEGIES = ["candidate", "cash", "always_long", "always_short", "momentum", "trend", "volatility_filtered"]


def ledger(df: DataFrame, keys: list[str], margin: float = 0.05, cost_bps: float = 5.0) -> DataFrame:
    """A row for each decision with the net log return of each strategy.

    ``volatility_filtered`` follows the trend where ``volatility_zscore`` is at most 0 and stays out, free of cost, elsewhere.
    """
    taken = one_position(df, keys, margin).select(*keys, "row_id", "signal", "signal_id")
    all_rows = df.join(taken, [*keys, "row_id"], "left").withColumn("active", F.col("signal").isNotNull())
    ret, cost = F.col("executable_forward_log_return"), bps(cost_bps)
    net = lambda sign: F.when(F.col("active"), sign * ret - cost).otherwise(0.0)
    side = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    calm = F.coalesce(F.col("volatility_zscore") <= 0, F.lit(False))
    return all_rows.select(*keys, "row_id", "active", F.coalesce("signal", F.lit(0)).alias("signal"), F.coalesce("signal_id", F.lit("")).alias("signal_id"), net(F.col("signal")).alias("candidate"), F.lit(0.0).alias("cash"), net(F.lit(1)).alias("always_long"), net(F.lit(-1)).alias("always_short"), net(side("r")).alias("momentum"), net(side("momentum_20")).alias("trend"), F.when(calm, net(side("momentum_20"))).otherwise(0.0).alias("volatility_filtered"), (F.col("active") & calm).alias("calm"))


def benchmarks(df: DataFrame, keys: list[str], margin: float = 0.05, cost_bps: float = 5.0) -> DataFrame:
    """Equity figures of eight strategies over scored rows.

    Seven act on the candidate's active rows, ``full_period`` holds through all rows that don't overlap.  Sharpe ratios are
    annualised by the trades a year that the span of all decisions comes to, over the selected rows alone.
    """
    from .metrics import per_year, strategy

    book = ledger(df, keys, margin, cost_bps).where("active")
    on = {"cash": F.lit(False), "volatility_filtered": F.col("calm")}
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("net"), on.get(s, F.lit(True)).alias("active")) for s in STRATEGIES]))
    long = book.select(*keys, "row_id", pairs.alias("x")).select(*keys, "row_id", "x.strategy", "x.net", "x.active")
    whole = by_rows(df, keys).select(*keys, "row_id", F.lit("full_period").alias("strategy"), (F.col("executable_forward_log_return") - bps(cost_bps)).alias("net"), F.lit(True).alias("active"))
    every = long.unionByName(whole)
    selected = every.groupBy(*keys, "strategy").agg(F.count("*").alias("n_selected"))
    span = df.groupBy(*keys).agg(F.count("*").alias("n_decisions"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    rate = selected.join(span, keys).select(*keys, "strategy", "n_decisions", per_year(F.col("n_selected"), F.col("first"), F.col("last")).alias("per_year"))
    figures = strategy(every, [*keys, "strategy"], per_year=1.0).join(rate, [*keys, "strategy"])
    return figures.withColumn("sharpe", F.col("sharpe") * F.sqrt("per_year")).withColumn("coverage", F.col("trades") / F.col("n_decisions"))


def schedule_violations(schedule: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("entry_row_index")
    s = schedule.withColumn("__before", F.lag("exit_row_index").over(w))
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("entry_row_index") < F.col("__before")).alias("overlaps"), F.count_if(F.col("exit_row_index") <= F.col("entry_row_index")).alias("bad_exit"), F.count_if(F.col("signal") != F.when(F.col("p") > 0.5, 1).otherwise(-1)).alias("bad_direction"))


def reconcile(expected: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: counts of every kind of difference between scheduled and executed trades, and the verdict.

    ``expected`` has signal, signal_id and both timestamps of the active rows (rows without a signal are no trades);
    ``trades`` has signal_id, direction, timestamps, prices, spread_bps, commission, order_id and deal_id.
    """
    def once(df: DataFrame, key: str) -> DataFrame:
        """``df`` with the rows of each key counted before the join."""
        return df.join(df.groupBy(key).agg(F.count("*").alias(f"n_{key}")), key)

    e = once(expected.where("signal <> 0"), "signal_id").select("signal_id", F.col("signal").alias("e_dir"), F.col("entry_timestamp").alias("e_in"), F.col("exit_timestamp").alias("e_out"), F.col("n_signal_id").alias("e_n"))
    t = once(trades, "signal_id").withColumnRenamed("n_signal_id", "t_n")
    spare = lambda c: trades.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"repeated_{c}"))
    j = e.join(t, "signal_id", "full_outer")
    both, bad = F.col("e_n").isNotNull() & F.col("t_n").isNotNull(), lambda c: F.count_if(F.col("t_n").isNotNull() & F.coalesce(c, F.lit(True)))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = j.agg(
        F.count_if(both).alias("matched"), F.count_if(F.col("t_n").isNull()).alias("missing"), F.count_if(F.col("e_n").isNull()).alias("unexpected"),
        F.count_if(F.coalesce(F.col("e_n") > 1, F.lit(False)) | F.coalesce(F.col("t_n") > 1, F.lit(False))).alias("repeated"),
        F.count_if(both & F.coalesce(F.col("e_dir") != F.col("direction"), F.lit(True))).alias("wrong_direction"),
        F.count_if(both & F.coalesce((F.col("e_in") != F.col("entry_timestamp")) | (F.col("e_out") != F.col("exit_timestamp")), F.lit(True))).alias("wrong_time"),
        bad(F.col("exit_timestamp") <= F.col("entry_timestamp")).alias("bad_exit"),
        bad((F.col("entry_price") <= 0) | (F.col("exit_price") <= 0) | ~finite("entry_price") | ~finite("exit_price")).alias("bad_price"),
        bad((F.col("spread_bps") < 0) | ~finite("spread_bps") | ~finite("commission")).alias("bad_cost"),
        bad((F.col("order_id") == "") | (F.col("deal_id") == "")).alias("bad_ticket"),
    )
    out = out.join(F.broadcast(spare("order_id"))).join(F.broadcast(spare("deal_id")))  # one row each
    kinds = [c for c in out.columns if c != "matched"]
    return out.withColumn("verdict", F.when(sum((F.col(c) for c in kinds[1:]), F.col(kinds[0])) == 0, "PASS").otherwise("FAIL"))


def executed(schedule: DataFrame, bars: DataFrame, cost_bps: float = 1.0) -> DataFrame:
    """Trades of a schedule at the open prices of its entry and exit bars."""
    at = lambda name: bars.select("symbol", F.col("row_id").alias(f"{name}_row_index"), F.col("date").alias(f"{name}_time"), F.col("open").alias(f"{name}_price"))
    t = schedule.join(at("entry"), ["symbol", "entry_row_index"]).join(at("exit"), ["symbol", "exit_row_index"])
    key = F.concat_ws("-", "symbol", "horizon", "row_id")
    return t.select("signal_id", F.col("signal").alias("direction"), F.col("entry_time").alias("entry_timestamp"), F.col("exit_time").alias("exit_timestamp"), "entry_price", "exit_price", F.lit(float(cost_bps)).alias("spread_bps"), F.lit(0.0).alias("commission"), F.concat(F.lit("o-"), key).alias("order_id"), F.concat(F.lit("d-"), key).alias("deal_id"))
