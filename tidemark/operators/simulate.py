"""Ordered account simulations: one group per run, many runs in parallel.

A run's rows are one instrument's or one panel's sessions, so a group is bounded
by the length of the history, not by the number of runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LEDGER = "run string, event_no int, date date, phase string, event string, price double, cash double, quantity double, receivable double, fee double, equity double"


def _funded(capital: float, shares: int, commission: float, bps: float, liquidate: bool):
    rate = bps / 10_000

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        name, cash, held, owed = rows["run"].iloc[0], capital, 0.0, 0.0
        due: list[tuple] = []
        out: list[tuple] = []

        def note(day, phase, event, price, fee=0.0):
            out.append((name, len(out), day, phase, event, price, cash, held, owed, fee, cash + held * price + owed))

        note(rows["date"].iloc[0], "initial", "initial", rows["open"].iloc[0])
        for r in rows.itertuples(index=False):
            paid = sum(x for day, x in due if day <= r.date)
            if paid:
                cash, owed, due = cash + paid, owed - paid, [d for d in due if d[0] > r.date]
                note(r.date, "open", "payment", r.open)
            if held and r.split != 1:
                held *= r.split
                note(r.date, "open", "split", r.open)
            if held and r.dividend:
                income = held * r.dividend
                owed += income
                due.append((r.pay_date if r.pay_date is not None and r.pay_date == r.pay_date else r.date, income))
                note(r.date, "open", "dividend", r.open)
                if due[-1][0] == r.date:
                    due.pop()
                    cash, owed = cash + income, owed - income
                    note(r.date, "open", "payment", r.open)
            if held and r.sell_next_open:
                cash += held * r.open * (1 - rate) - commission
                held = 0.0
                note(r.date, "open", "sell", r.open, commission)
            if not held and r.buy_next_open:
                need = shares * r.open * (1 + rate) + commission
                if need > cash:
                    note(r.date, "open", "rejected", r.open)
                else:
                    cash, held = cash - need, float(shares)
                    note(r.date, "open", "buy", r.open, commission)
            note(r.date, "close", "mark", r.close)
        if held and liquidate:
            cash += held * r.close * (1 - rate) - commission
            held = 0.0
            note(r.date, "close", "liquidation", r.close, commission)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEDGER.split(", ")])

    return run


def funded_ledger(rows: DataFrame, *, capital: float, shares: int = 1, commission: float = 0.0, bps: float = 0.0, liquidate: bool = False) -> DataFrame:
    """Event ledger of each run (run, date, open, close, split, dividend, pay_date, buy_next_open, sell_next_open).

    In a bar: due payments, split, dividend, sell, buy, close mark.  Long only; a buy
    beyond the cash is ``rejected``, never resized.
    """
    columns = ["run", "date", "open", "close", "split", "dividend", "pay_date", "buy_next_open", "sell_next_open"]
    return rows.select(*columns).groupBy("run").applyInPandas(_funded(capital, shares, commission, bps, liquidate), _LEDGER)


_EQUITY = "run string, date date, equity double, cash double, n_fills int, n_skipped int"


def _portfolio(capital: float, commission: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["run"].iloc[0]
        grid = {c: rows.pivot(index="date", columns="ticker", values=c).sort_index() for c in ("open", "close", "weight", "cost")}
        opens, closes, weights, cost = (grid[c].to_numpy(float) for c in ("open", "close", "weight", "cost"))
        marks = grid["close"].ffill().fillna(0.0).to_numpy(float)
        cash, held, target, out = capital, np.zeros(opens.shape[1]), None, []
        for i, day in enumerate(grid["open"].index):
            fills = skipped = 0
            if target is not None:
                delta = np.where(target != held, target - held, 0.0)
                priced = ~np.isnan(opens[i]) & ~np.isnan(cost[i - 1])
                skipped += int(((delta != 0) & ~priced).sum())
                delta = np.where(priced, delta, 0.0)
                price, rate = np.where(priced, opens[i], 0.0), np.where(priced, cost[i - 1], 0.0)
                for j in np.flatnonzero(delta < 0):
                    cash += -delta[j] * price[j] * (1 - rate[j]) - commission
                    held[j] += delta[j]
                    fills += 1
                buys = np.flatnonzero(delta > 0)
                notional = float((delta[buys] * price[buys] * (1 + rate[buys])).sum())
                scale = min(1.0, max(cash - commission * len(buys), 0.0) / notional) if len(buys) and notional > 0 else 0.0
                for j in buys:
                    if scale == 0:
                        skipped += 1
                        continue
                    cash -= delta[j] * scale * price[j] * (1 + rate[j]) + commission
                    held[j] += delta[j] * scale
                    fills += 1
                target = None
            value = cash + float((held * marks[i]).sum())
            if not np.isnan(weights[i]).all():
                w = np.nan_to_num(weights[i])
                if i + 1 < len(opens):
                    bad = (w > 0) & np.isnan(closes[i])
                    skipped += int(bad.sum())
                    with np.errstate(invalid="ignore", divide="ignore"):
                        target = np.where(bad, held, np.where(w > 0, w * max(value, 0.0) / closes[i], 0.0))
                else:
                    skipped += 1
            out.append((name, day, value, cash, fills, skipped))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _EQUITY.split(", ")])

    return run


def portfolio(rows: DataFrame, *, capital: float, commission: float = 0.0) -> DataFrame:
    """Daily equity of each run from (run, date, ticker, open, close, weight, cost) on a dense grid.

    Weights stand on decision rows only, null elsewhere.  Share targets are fixed at
    the decision's close and filled at the next open, sells first; buys are scaled
    together to the cash.  ``cost`` is the adverse fraction known at the decision;
    an order without a price or a cost is skipped, never free.
    """
    return rows.select("run", "date", "ticker", "open", "close", "weight", "cost").groupBy("run").applyInPandas(_portfolio(capital, commission), _EQUITY)


def paired_trades(rows: DataFrame) -> DataFrame:
    """Closed round trips without cash limits or actions (run, entry, exit, pnl): a buy while flat with the next sell.

    One window pass: the orders of a run alternate once repeats of a side are dropped.
    """
    by = Window.partitionBy("run").orderBy("date")
    orders = rows.where("buy_next_open or sell_next_open").select("run", "date", F.col("open").alias("price"), F.col("buy_next_open").alias("is_buy"))
    turns = orders.withColumn("_was", F.lag("is_buy", 1, False).over(by)).where(F.col("is_buy") != F.col("_was"))
    after = turns.withColumns({"exit": F.lead("date").over(by), "_out": F.lead("price").over(by)})
    return after.where("is_buy and exit is not null").select("run", F.col("date").alias("entry"), "exit", (F.col("_out") - F.col("price")).alias("pnl"))
