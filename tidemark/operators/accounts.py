"""Accounts replayed from logs, evidence joined to orders, and plans between books and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates, screens
from tidemark.operators.windows import by_ticker


def exposure_by_ticker(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Quantity over all owners and its value; a ticker without a price has a null exposure.  Holdings are summed before the join."""
    held = holdings.groupBy("ticker").agg(F.sum("quantity").alias("quantity"))
    return held.join(prices.select("ticker", "price"), "ticker", "left").select("ticker", "quantity", (F.col("quantity") * F.col("price")).alias("exposure"))


def account_fold(events: DataFrame, columns: list[str]) -> DataFrame:
    """The last close-phase event of each account and date (account, date, phase, event_id)."""
    last = events.where("phase = 'close'").groupBy("account", "date").agg(F.max_by(F.struct("event_id", *columns), "event_id").alias("e"))
    return last.select("account", "date", "e.*")


def replayed_equity(prices: DataFrame, trades: DataFrame, *, capital: float, commission: float) -> DataFrame:
    """Cash, quantity and equity of every price row (run, date, close) from the running sums of a trade log (run, date,
    quantity signed, price, cash as recorded after the day).  ``drift`` is the recorded less the replayed cash, null on days without a record."""
    cost = F.col("quantity") * F.col("price") + F.lit(commission)
    daily = trades.groupBy("run", "date").agg(F.sum("quantity").alias("_q"), F.sum(cost).alias("_c"), F.min("cash").alias("_cash"))
    by = Window.partitionBy("run").orderBy("date")
    rows = prices.join(daily, ["run", "date"], "left")
    rows = rows.withColumns({"cash": F.lit(capital) - F.coalesce(F.sum("_c").over(by), F.lit(0.0)), "quantity": F.coalesce(F.sum("_q").over(by), F.lit(0.0))})
    return rows.select("run", "date", "cash", "quantity", (F.col("cash") + F.col("quantity") * F.col("close")).alias("equity"), (F.col("_cash") - F.col("cash")).alias("drift"))


def order_evidence(orders: DataFrame, snapshots: DataFrame, bars: DataFrame) -> DataFrame:
    """orders (id, ticker, date, side) with the broker's fill, the next bar's open, the fill's slippage against it and the
    half spread the order's own bar suggests, both in basis points; ``missing`` names what was not found."""
    after = bars.select("ticker", "date", F.lead("open").over(by_ticker()).alias("next_open"), ((F.col("high") - F.col("low")) / F.col("close") * 5000).alias("modeled_bps"))
    rows = orders.join(snapshots.select("id", "fill"), "id", "left").join(after, ["ticker", "date"], "left")
    sign = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
    missing = screens.reasons(("fill", F.col("fill").isNull()), ("next_open", F.col("next_open").isNull()), ("modeled_cost", F.col("modeled_bps").isNull()))
    return rows.select("id", "ticker", "date", "side", "fill", "next_open", "modeled_bps", (sign * (F.col("fill") / F.col("next_open") - 1) * 10_000).alias("slippage_bps"), missing.alias("missing"))


def on_decisions(book: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of a book on decision sessions; a calendar is a bounded table."""
    return book.join(F.broadcast(decisions.where("decides").select("date")), "date", "left_semi")


def allocation_plan(rows: DataFrame, *, equity: float, band: float = 0.005) -> DataFrame:
    """Orders of a session from (date, ticker, weight, close, held): moves within ``band`` of equity are left out unless they
    close a position; whole shares, sells first, then by ticker.  A row without a positive close, or a null weight, has no order."""
    move = F.col("weight") * equity - F.col("held") * F.col("close")
    leaves = (F.col("weight") == 0) & (F.col("held") > 0)
    shares = F.when(leaves, -F.col("held")).when(F.abs(move) >= band * equity, F.signum(move) * F.floor(F.abs(move) / F.col("close")))
    plan = rows.where("close > 0").select("date", "ticker", shares.alias("shares")).where("shares <> 0").withColumn("side", F.when(F.col("shares") < 0, "sell").otherwise("buy"))
    return plan.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("side"), "ticker")))


def unit_root(rows: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Dickey-Fuller statistic with a constant and one lagged change, from six moments a key; null where it is not defined.

    ``rejects`` compares it with MacKinnon's 5 % response surface, so series of different lengths meet their own value.
    """
    by = Window.partitionBy(key).orderBy(order)
    d = rows.select(key, order, F.col(x).alias("_x"), (F.col(x) - F.lag(x).over(by)).alias("_y"))
    d = d.select(key, "_y", F.lag("_x").over(by).alias("_a"), F.lag("_y").over(by).alias("_b")).dropna(subset=["_y", "_a", "_b"])
    s = lambda p, q: (F.covar_pop(p, q) * F.count("*")).alias(p + q)
    m = d.groupBy(key).agg(F.count("*").alias("n"), *[s(p, q) for p, q in (("_a", "_a"), ("_b", "_b"), ("_y", "_y"), ("_a", "_b"), ("_a", "_y"), ("_b", "_y"))])
    c = F.col
    det = c("_a_a") * c("_b_b") - c("_a_b") * c("_a_b")
    slope = F.try_divide(c("_b_b") * c("_a_y") - c("_a_b") * c("_b_y"), det)
    lagged = F.try_divide(c("_a_a") * c("_b_y") - c("_a_b") * c("_a_y"), det)
    left = c("_y_y") - slope * c("_a_y") - lagged * c("_b_y")
    tau = F.when((c("n") > 3) & (left > 0) & (det > 0), slope / F.sqrt(left / (c("n") - 3) * c("_b_b") / det))
    # fixed values: MacKinnon (2010), constant, 5 %
    critical = -2.86154 - 2.8903 / c("n") - 4.234 / F.pow("n", F.lit(2)) - 40.040 / F.pow("n", F.lit(3))
    return m.select(key, "n", tau.alias("statistic"), critical.alias("critical")).withColumn("rejects", c("statistic") < c("critical"))


def holdout_check(returns: DataFrame, key: str, order: str, lags: int, least: float = 1.645) -> DataFrame:
    """Passed with a positive Sharpe ratio and a robust t of at least ``least``; an undefined one fails."""
    sharpe = returns.groupBy(key).agg(aggregates.sharpe(F.col("log_return")).alias("sharpe"))
    both = aggregates.hac(returns, key, order, lags).select(key, "t").join(sharpe, key)
    tests = (("sharpe", ~F.coalesce(F.col("sharpe") > 0, F.lit(False))), ("t", ~F.coalesce(F.col("t") >= least, F.lit(False))))
    return both.select(key, screens.reasons(*tests).alias("failing")).withColumn("verdict", F.when(F.col("failing") == "", "passed").otherwise("failed"))


def stale_artifacts(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """recorded (artifact, input, digest) against current (input, digest): an artifact is fresh only if every input is there unchanged."""
    j = recorded.join(current.select("input", F.col("digest").alias("_now")), "input", "left").groupBy("artifact")
    n = j.agg(F.count("*").alias("inputs"), F.count_if(F.col("_now").isNull()).alias("gone"), F.count_if(F.col("_now") != F.col("digest")).alias("changed"))
    return n.withColumn("state", F.when(F.col("gone") + F.col("changed") == 0, "fresh").otherwise("stale"))


def replay_verdict(windows: DataFrame, key: str) -> DataFrame:
    """Passed if no window of a replay has an error, an abort or a denial; nulls count as none."""
    bad = F.coalesce(F.col("error"), F.lit(False)) | F.coalesce(F.col("aborted"), F.lit(False)) | (F.coalesce("denials", F.lit(0)) > 0)
    return windows.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(bad).alias("bad")).withColumn("verdict", F.when(F.col("bad") == 0, "passed").otherwise("failed"))


def may_publish(permission: Column) -> Column:
    """Only an explicit true permits."""
    return F.coalesce(permission, F.lit(False))


def capable(declared: Column, capability: Column) -> Column:
    """Whether a declared list names a capability; no list, none."""
    return F.coalesce(F.array_contains(declared, capability), F.lit(False))


def skipped_while_killed(kills: DataFrame, sessions: DataFrame, runs: DataFrame, leases: DataFrame) -> DataFrame:
    """Sessions (profile, session) after the day of a profile's kill (profile, day) up to the calendar's end, with neither a
    run nor a lease (profile, session).  A kill on no session counts from the session before it.

    Sessions with a run or a lease meet the kill as one array per profile, no longer than the calendar, so that the sessions
    left are listed after the last shuffle."""
    days = F.broadcast(sessions.select("date", "session_no"))  # a calendar is a bounded table
    until = sessions.select("date", F.col("session_no").alias("_no"), F.lead("date").over(Window.orderBy("date")).alias("_next"))
    known = until.select("_no", F.explode(F.sequence("date", F.coalesce(F.date_sub("_next", 1), F.col("date")))).alias("day"))
    at = kills.join(F.broadcast(known), "day")
    span = F.broadcast(sessions.agg(F.max("session_no").alias("_last")))
    seen = runs.select("profile", F.col("session").alias("date")).union(leases.select("profile", "session"))
    seen = seen.join(days, "date").groupBy("profile").agg(F.collect_set("session_no").alias("_seen"))
    after = F.sequence(F.col("_no") + 1, F.col("_last"))
    left = F.when(F.col("_seen").isNull(), after).otherwise(F.array_except(after, "_seen"))
    later = at.join(seen, "profile", "left").crossJoin(span).where("_no < _last").select("profile", F.explode(left).alias("session_no"))
    return later.join(days, "session_no").select("profile", F.col("date").alias("session"))


def price_guard(prices: DataFrame, key: str) -> DataFrame:
    """Per key: rows, and counts of missing dates, missing or non-positive closes, and dates that come again."""
    again = F.row_number().over(Window.partitionBy(key, "date").orderBy(F.lit(1))) > 1
    rows = prices.withColumn("_again", again & F.col("date").isNotNull())
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(F.col("close").isNull()).alias("no_close"), F.count_if(F.col("close") <= 0).alias("not_positive"), F.count_if("_again").alias("repeated"))


def dividend_map(actions: DataFrame) -> DataFrame:
    """One row per ticker and ex-date with amount and basis; where a date has several dividends both are null and ``repeats`` tells how many."""
    d = actions.where("kind = 'dividend'").groupBy("ticker", "date").agg(F.count("*").alias("repeats"), F.min("value").alias("_v"), F.min("basis").alias("_b"))
    one = F.col("repeats") == 1
    return d.select("ticker", "date", F.when(one, F.col("_v")).alias("amount"), F.when(one, F.col("_b")).alias("basis"), "repeats")


def promotions(requests: DataFrame, *, most_age: int, least_shadow: int = 20) -> DataFrame:
    """requests (model, evidence, bound, age, shadow): promoted, or the first reason why not.  Ages are in sessions."""
    why = screens.first_reason(("no_evidence", F.col("evidence").isNull()), ("not_bound", ~F.coalesce("bound", F.lit(False))), ("stale_evidence", ~F.coalesce(F.col("age") <= most_age, F.lit(False))), ("short_shadow", ~F.coalesce(F.col("shadow") >= least_shadow, F.lit(False))))
    return requests.withColumn("decision", F.coalesce(why, F.lit("promoted")))


def champions(events: DataFrame) -> DataFrame:
    """The champion after each event (registry, seq, event, model): a promote pushes its model, a rollback pops; a rollback of
    nothing changes nothing.  The stack's top is the last push that reached the present depth, so no stack is kept."""
    order = Window.partitionBy("registry").orderBy("seq")
    step = F.when(F.col("event") == "promote", 1).otherwise(-1)
    rows = events.withColumn("_s", F.sum(step).over(order))
    rows = rows.withColumn("depth", (F.col("_s") - F.least(F.min("_s").over(order), F.lit(0))).cast("int"))
    top = F.last(F.when(F.col("event") == "promote", F.col("model")), ignorenulls=True).over(Window.partitionBy("registry", "depth").orderBy("seq"))
    return rows.withColumn("champion", F.when(F.col("depth") > 0, top)).drop("_s")


def family_verdict(selected: DataFrame, gate: DataFrame, holdout: DataFrame) -> DataFrame:
    """selected (family, ticker) with the verdicts of its gate and holdout check; a missing verdict fails."""
    rows = selected.join(gate.select("ticker", F.col("verdict").alias("_g")), "ticker", "left").join(holdout.select("ticker", F.col("verdict").alias("_h")), "ticker", "left")
    failing = screens.reasons(("gate", F.coalesce(F.col("_g") != "passed", F.lit(True))), ("holdout", F.coalesce(F.col("_h") != "passed", F.lit(True))))
    return rows.select("family", "ticker", failing.alias("failing")).withColumn("verdict", F.when(F.col("failing") == "", "passed").otherwise("failed"))
