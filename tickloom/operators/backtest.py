"""Bar-based backtests over many symbols and parameters at once.

Signals are windows and metrics are aggregates; only the fold over a run's
bars, whose cash refusals depend on its path, is Python: one group per run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import BPS, TAKER_BPS, floor_div

RUN = ["run_id", "symbol_id"]


@dataclass(frozen=True)
class Bar:
    index: int
    open_ticks: int
    close_ticks: int
    long: bool | None = None  # a signal made beforehand, from this and earlier bars only


class Strategy(Protocol):
    """User code: sees one bar at a time and the portfolio, returns (side, qty) intents; they fill at the next open."""

    def on_bar(self, bar: Bar, cash: int, position: int) -> list[tuple[int, int]]: ...


@dataclass
class HoldWhileLong:
    """Holds `qty` while the bar's signal is long, nothing while it is not; does nothing before the signal exists."""

    qty: int

    def on_bar(self, bar: Bar, cash: int, position: int) -> list[tuple[int, int]]:
        if bar.long is None:
            return []
        gap = (self.qty if bar.long else 0) - position
        return [(1, gap)] if gap > 0 else [(2, min(-gap, position))] if gap < 0 else []


@dataclass
class BuySellCycle:
    """Buys `qty` at every `period`-th bar and sells all it holds `hold` bars later; needs no signal."""

    qty: int
    period: int = 5
    hold: int = 3

    def on_bar(self, bar: Bar, cash: int, position: int) -> list[tuple[int, int]]:
        if bar.index % self.period == 0:
            return [(1, self.qty)]
        return [(2, position)] if bar.index % self.period == self.hold and position else []


def sma_signal(bars: DataFrame, fast: Column | int, slow: Column | int, by: list[str], lengths: list[int]) -> DataFrame:
    """Adds `long`: the fast mean is above the slow one; null until the slow window is full.

    Means are compared in integers. A window's sum is the difference of two
    running sums, so a row costs the same for every length. `fast` and `slow`
    may be columns, so one pass serves all parameters; `lengths` are the
    values they take, a small literal list.
    """
    w = W.partitionBy(*by).orderBy("bar_index")
    fast, slow = (x if isinstance(x, Column) else F.lit(x) for x in (fast, slow))
    b = bars.withColumn("_upto", F.sum("close_ticks").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    for n in lengths:
        b = b.withColumn(f"_sum{n}", F.col("_upto") - F.coalesce(F.lag("_upto", n).over(w), F.lit(0)))

    def total(length: Column) -> Column:
        return reduce(lambda rest, n: F.when(length == n, F.col(f"_sum{n}")).otherwise(rest), lengths, F.lit(None).cast("long"))

    b = b.withColumn("long", F.when(F.col("_n") >= slow, total(fast) * slow > total(slow) * fast))
    return b.drop("_upto", "_n", *[f"_sum{n}" for n in lengths])


FOLD = "run_id long, symbol_id int, kind string, bar_index long, side int, qty long, price_ticks long, fee_ticks long, realised_ticks long, cash_ticks long, position long, equity_ticks long, refused long, pending long"


def run_backtests(bars: DataFrame, strategy=lambda qty: HoldWhileLong(qty)) -> DataFrame:
    """Rows of kind bar and trade for each run: intents of the last bar at this open, then the bar is shown, then marked at its close.

    `bars` has run_id, symbol_id, bar_index, open_ticks, close_ticks, long,
    qty and initial_cash. Buys that cost more than the cash, and sells of
    more than is held, are refused and counted. Cost basis is the floored
    average. Runs of fewer than two bars give no rows.
    """
    import pandas as pd

    names = [x.split()[0] for x in FOLD.split(", ")]

    def fold(pdf):
        pdf = pdf.sort_values("bar_index")
        if len(pdf) < 2:
            return pd.DataFrame(columns=names)
        run, symbol = int(pdf["run_id"].iloc[0]), int(pdf["symbol_id"].iloc[0])
        cash, position, basis, refused = int(pdf["initial_cash"].iloc[0]), 0, 0, 0
        player, pending, out = strategy(int(pdf["qty"].iloc[0])), [], []
        for i, o, c, long in zip(pdf["bar_index"].tolist(), pdf["open_ticks"].tolist(), pdf["close_ticks"].tolist(), pdf["long"].tolist(), strict=True):
            for side, qty in pending:
                fee = o * qty * TAKER_BPS // BPS
                if side == 1 and o * qty + fee <= cash:
                    cash -= o * qty + fee
                    basis = (basis * position + o * qty) // (position + qty)
                    position += qty
                    gain = 0
                elif side == 2 and qty <= position:
                    cash += o * qty - fee
                    gain = (o - basis) * qty - fee
                    position -= qty
                    basis = basis if position else 0
                else:
                    refused += 1
                    continue
                out.append((run, symbol, "trade", i, side, qty, o, fee, gain, None, None, None, None, None))
            pending = list(player.on_bar(Bar(i, o, c, None if long is None or long != long else bool(long)), cash, position))
            out.append((run, symbol, "bar", i, None, None, None, None, None, cash, position, cash + position * c, refused, len(pending)))
        return pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names if n != "kind"})

    cols = ["run_id", "symbol_id", "bar_index", "open_ticks", "close_ticks", "long", "qty", "initial_cash"]
    return bars.select(*cols).groupBy(*RUN).applyInPandas(fold, FOLD)


def drawdown(curve: DataFrame) -> DataFrame:
    """Deepest fall from a peak as a percentage of the peak, per run."""
    peak = F.max("equity_ticks").over(W.partitionBy(*RUN).orderBy("bar_index"))
    c = curve.withColumn("peak", peak)
    return c.groupBy(*RUN).agg(F.round(F.coalesce(F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity_ticks")) / F.col("peak"))), F.lit(0.0)) * 100, 6).alias("max_drawdown_pct"))


def bar_returns(curve: DataFrame) -> DataFrame:
    before = F.lag("equity_ticks").over(W.partitionBy(*RUN).orderBy("bar_index"))
    return curve.withColumn("before", before).where("before > 0").select(*RUN, "bar_index", ((F.col("equity_ticks") - F.col("before")) / F.col("before")).alias("ret"))


def risk_ratios(returns: DataFrame) -> DataFrame:
    """Population volatility and mean / volatility per bar; 0 where there are fewer than two returns or none varies."""
    r = returns.groupBy(*RUN).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"))
    sd = F.when(F.col("n") > 1, F.col("sd")).otherwise(0.0)
    return r.select(*RUN, F.round(sd * 100, 6).alias("volatility_per_bar_pct"), F.round(F.when(sd > 0, F.col("mean") / sd).otherwise(0.0), 6).alias("sharpe_per_bar"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Return of buying at bar 1's open all that the cash allows with its fee; the fee's rounding may allow one unit above the closed form."""
    b = bars.groupBy(*RUN).agg(F.min("bar_index").alias("first"), F.max("initial_cash").alias("cash"), F.max_by("close_ticks", "bar_index").alias("last"), F.count("*").alias("n"), F.min_by("open_ticks", F.when(F.col("bar_no") == 1, 0)).alias("entry"))
    q = floor_div(F.col("cash") * BPS, F.col("entry") * (BPS + TAKER_BPS))
    cost = lambda q: F.col("entry") * q + floor_div(F.col("entry") * q * TAKER_BPS, BPS)
    qty = F.when(cost(q + 1) <= F.col("cash"), q + 1).otherwise(q)
    final = F.col("cash") - cost(qty) + qty * F.col("last")
    pct = F.round((final - F.col("cash")) / F.col("cash") * 100, 6)
    return b.select(*RUN, F.when((F.col("n") < 2) | (F.col("entry") <= 0) | (qty <= 0), 0.0).otherwise(pct).alias("buy_and_hold_return_pct"))


def metrics(bars: DataFrame, folded: DataFrame) -> DataFrame:
    """One row of figures per run."""
    curve = folded.where("kind = 'bar'")
    trades = folded.where("kind = 'trade'").groupBy(*RUN).agg(
        F.count("*").alias("trade_count"), F.sum(F.when(F.col("realised_ticks") > 0, 1).otherwise(0)).alias("win_count"), F.sum(F.when(F.col("realised_ticks") != 0, 1).otherwise(0)).alias("closing"),
        F.sum("fee_ticks").alias("fees"), F.min("bar_index").alias("first_trade_bar"),
    )
    last = curve.groupBy(*RUN).agg(F.max_by("equity_ticks", "bar_index").alias("final_equity_ticks"), F.max("refused").alias("refused"), F.max_by("pending", "bar_index").alias("unfilled_at_end"))
    cash = bars.groupBy(*RUN).agg(F.max("initial_cash").alias("initial_cash_ticks"))
    m = cash.join(last, RUN)
    for x in (trades, drawdown(curve), risk_ratios(bar_returns(curve)), buy_and_hold(bars)):
        m = m.join(x, RUN, "left")
    zero = lambda c, t="long": F.coalesce(F.col(c), F.lit(0)).cast(t)
    pnl = F.col("final_equity_ticks") - F.col("initial_cash_ticks")
    ret = F.round(F.when(F.col("initial_cash_ticks") != 0, pnl / F.col("initial_cash_ticks") * 100).otherwise(0.0), 6)
    win = F.when(zero("closing") > 0, F.round(F.col("win_count") / F.col("closing") * 100, 6)).otherwise(0.0)
    return m.select(
        *RUN, "initial_cash_ticks", "final_equity_ticks", pnl.alias("pnl_ticks"), ret.alias("return_pct"), zero("trade_count").alias("trade_count"), zero("win_count").alias("win_count"),
        win.alias("win_rate_pct"), zero("max_drawdown_pct", "double").alias("max_drawdown_pct"), zero("volatility_per_bar_pct", "double").alias("volatility_per_bar_pct"), zero("sharpe_per_bar", "double").alias("sharpe_per_bar"),
        zero("fees").alias("fees_paid_ticks"), "buy_and_hold_return_pct", F.round(ret - F.col("buy_and_hold_return_pct"), 6).alias("excess_return_pct"), "refused", "unfilled_at_end", "first_trade_bar",
    )


def sweep(history: DataFrame, params: DataFrame, minutes: list[int], lengths: list[int], lots: int = 10) -> DataFrame:
    """Bars of every run: symbols x parameters (run_id, minutes, fast, slow, qty). The parameter table is a small literal one; `minutes` and `lengths` are the values it has."""
    from tickloom.operators.bars import research_bars

    made = None
    for m in minutes:
        b = research_bars(history, m).withColumn("minutes", F.lit(m))
        made = b if made is None else made.unionByName(b)
    x = made.join(F.broadcast(params), "minutes")
    w = W.partitionBy(*RUN).orderBy("bar_index")
    x = x.withColumn("bar_no", F.row_number().over(w) - 1).withColumn("initial_cash", F.first("open_ticks").over(w) * lots)
    return sma_signal(x, F.col("fast"), F.col("slow"), RUN, lengths)


def report(m: DataFrame, symbols: DataFrame) -> DataFrame:
    """One readable row per run, money in display units."""
    from tickloom.functions.ticks import format_ticks

    money = lambda c: format_ticks(c, "tick_size_ticks").alias(c.replace("_ticks", ""))
    return m.join(F.broadcast(symbols), "symbol_id").select(
        "run_id", "name", money("initial_cash_ticks"), money("final_equity_ticks"), money("pnl_ticks"), F.format_number("return_pct", 2).alias("return_pct"), "trade_count", "refused", "unfilled_at_end", "first_trade_bar",
        F.lit("fills at the next bar's open, taker fee, whole units, no slippage").alias("fill_model"),
    )


def manifest(params: DataFrame) -> DataFrame:
    """(.., manifest_json, manifest_id): parameters as JSON with sorted keys and the first 16 hex digits of its SHA-256."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(params.columns)]))
    return params.withColumn("manifest_json", text).withColumn("manifest_id", F.substring(F.sha2("manifest_json", 256), 1, 16))
