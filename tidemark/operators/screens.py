"""Screens and verdicts: rows or groups with the named reasons that refuse them, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import is_true


def reasons(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order, joined by commas; an unknown condition does not hold."""
    return F.array_join(F.filter(F.array(*[F.when(is_true(c), F.lit(n)) for n, c in named]), lambda x: x.isNotNull()), ",")


def first_reason(*named: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(is_true(c), F.lit(n)) for n, c in named])


def pay_date_policy(policy: Column) -> Column:
    """sourced, unbounded or bound_sessions with its number of sessions; null where it is none of them."""
    return F.when(policy.isin("sourced", "unbounded"), policy).when(policy.rlike("^bound_sessions:[1-9][0-9]{0,3}$"), F.lit("bound_sessions"))


def session_label_faults(rows: DataFrame, key: str, session: str) -> DataFrame:
    """Per key: rows whose label is missing, is no midnight, repeats, or lies before the row above; wants ``row_no`` as the order."""
    by = Window.partitionBy(key).orderBy("row_no")
    t = F.col(session)
    marked = rows.withColumns({"_before": F.max(t).over(by.rowsBetween(Window.unboundedPreceding, -1)), "_same": F.count("*").over(Window.partitionBy(key, session))})
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.count_if(t.isNull()).alias("missing"), F.count_if(t != F.date_trunc("day", t)).alias("not_midnight"), F.count_if(t.isNotNull() & (F.col("_same") > 1)).alias("repeated"), F.count_if(t < F.col("_before")).alias("descending"))


def execution_frame_faults(bars: DataFrame) -> DataFrame:
    """Bars that cannot price a fill, each with all its reasons."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.exists(F.array(*prices), lambda x: x.isNull() | F.isnan(x))
    why = reasons(("missing_price", missing), ("not_positive", F.least(*prices) <= 0), ("outside_range", (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))), ("no_volume", F.coalesce(F.col("volume"), F.lit(0.0)) <= 0))
    return bars.withColumn("reasons", why).where("reasons <> ''")


def source_row_check(a: DataFrame, b: DataFrame, sessions: DataFrame, actions: DataFrame, most: float) -> DataFrame:
    """Per ticker of two vendors' bars: rows in one only, rows on no session, closes further apart than ``most``, rows with an action."""
    both = a.select("ticker", "date", F.col("close").alias("x")).join(b.select("ticker", "date", F.col("close").alias("y")), ["ticker", "date"], "full_outer")
    both = both.join(F.broadcast(sessions.select("date", F.lit(True).alias("_open"))), "date", "left").join(actions.select("ticker", "date", F.lit(True).alias("_acted")).distinct(), ["ticker", "date"], "left")
    x, y = F.col("x"), F.col("y")
    return both.groupBy("ticker").agg(F.count_if(y.isNull()).alias("only_first"), F.count_if(x.isNull()).alias("only_second"), F.count_if(F.col("_open").isNull()).alias("no_session"), F.count_if(F.abs(y / x - 1) > most).alias("mismatches"), F.count_if(F.col("_acted")).alias("action_sessions"))


def row_masks(rows: DataFrame, columns: list[str], label: str, *, horizon: int, embargo: int, span: int) -> DataFrame:
    """rows with ``inference`` (all features finite) and ``train`` (and the label too); a horizon or embargo shorter than the
    label's span would leak and is refused."""
    if min(horizon, embargo) < span:
        raise ValueError("horizon and embargo must cover the span until a label is known")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ready = finite(columns[0])
    for c in columns[1:]:
        ready &= finite(c)
    return rows.withColumn("inference", is_true(ready)).withColumn("train", is_true(ready & finite(label)))


def scoreable(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows that two runs predicted and whose label is known; wants label and prediction in both."""
    left = a.select(*key, "label", F.col("prediction").alias("prediction_a"))
    return left.join(b.select(*key, F.col("prediction").alias("prediction_b")), key).where("label is not null and prediction_a is not null and prediction_b is not null")


def executable(quotes: DataFrame, *, most_age: int, widest: float, least_adv: float, share: float, minimum: float) -> DataFrame:
    """Quotes with all reasons against trading on them; wants bid, ask, age, quantity, adv, asset_class, halted."""
    mid = (F.col("bid") + F.col("ask")) / 2
    why = reasons(
        ("class_not_allowed", ~F.col("asset_class").isin("equity", "etf")),
        ("halted", F.col("halted")),
        ("no_bid", F.coalesce("bid", F.lit(0.0)) <= 0),
        ("no_ask", F.coalesce("ask", F.lit(0.0)) <= 0),
        ("crossed", F.col("bid") > F.col("ask")),
        ("stale_quote", F.col("age") > most_age),
        ("future_quote", F.col("age") < 0),
        ("wide_spread", (F.col("ask") - F.col("bid")) / mid > widest),
        ("no_adv", F.col("adv").isNull()),
        ("low_adv", F.col("adv") * mid < least_adv),
        ("large_order", F.col("quantity") > F.col("adv") * share),
        ("below_minimum", F.col("quantity") * mid < minimum),
    )
    return quotes.withColumn("reasons", why).withColumn("eligible", F.col("reasons") == "")


def candidates(reference: DataFrame, bars: DataFrame, sessions: DataFrame, as_of: Column, *, rows: int, least: float) -> DataFrame:
    """Instruments of a reference (instrument_id, symbol, listed, delisted, kind) on a date, with all reasons against them.

    Bars count from the listing on; the last one must be the date's session, at most one of ``rows`` sessions may be
    missing, and the median close must reach ``least``.
    """
    past = sessions.where(F.col("date") <= as_of)
    end = past.agg(F.max("date").alias("_last"), F.max("session_no").alias("_no"))
    known = bars.join(F.broadcast(past), "date").join(reference.select("instrument_id", "listed"), "instrument_id").where("date >= listed")
    recent = known.crossJoin(F.broadcast(end)).where(F.col("session_no") > F.col("_no") - rows)
    per = known.groupBy("instrument_id").agg(F.max("date").alias("last_bar")).join(recent.groupBy("instrument_id").agg(F.count("*").alias("seen"), F.percentile("close", F.lit(0.5)).alias("median_close")), "instrument_id", "left")
    out = reference.join(per, "instrument_id", "left").crossJoin(F.broadcast(end)).withColumn("_same", F.count("*").over(Window.partitionBy("symbol")))
    why = reasons(
        ("not_listed", F.col("listed") > as_of),
        ("delisted", F.col("delisted") <= as_of),
        ("kind_not_allowed", F.col("kind") != "common"),
        ("ambiguous_symbol", F.col("_same") > 1),
        ("no_bars", F.col("last_bar").isNull()),
        ("stale_bar", F.col("last_bar") < F.col("_last")),
        ("missing_sessions", F.coalesce("seen", F.lit(0)) < rows - 1),
        ("low_price", F.col("median_close") < least),
    )
    return out.withColumn("reasons", why).withColumn("eligible", F.col("reasons") == "").select("instrument_id", "symbol", "last_bar", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "median_close", "reasons", "eligible")


def listed_coverage(listings: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol (symbol, listed): bars since the listing, first and last of them; symbols without any stay."""
    b = bars.select(F.col("ticker").alias("symbol"), "date")
    return listings.join(b, ["symbol"], "left").groupBy("symbol", "listed").agg(F.count_if(F.col("date") >= F.col("listed")).alias("bars"), F.min(F.when(F.col("date") >= F.col("listed"), F.col("date"))).alias("first_bar"), F.max("date").alias("last_bar"))


def derivation_differences(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Where a stored selection is not what its inputs give: keys that lack on either side, and columns that differ."""
    a = stored.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = derived.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    why = reasons(("not_derived", F.col("_b").isNull()), ("not_stored", F.col("_a").isNull()), *[(f"{c}_differs", F.col("_a") & F.col("_b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in columns])
    return both.select(key, why.alias("reasons")).where("reasons <> ''")


def staleness(stamps: DataFrame, sessions: DataFrame, now: Column, most: int = 1) -> DataFrame:
    """stamps (id, as_of) with the sessions that began since then, and whether they are more than ``most``."""
    days = F.broadcast(sessions.where(F.col("date") <= now).select(F.col("date").alias("_d")))
    late = stamps.join(days, F.col("_d") > F.col("as_of"), "left").groupBy(*stamps.columns).agg(F.count("_d").alias("sessions_since"))
    return late.withColumn("stale", F.col("sessions_since") > most)


def membership_spans(facts: DataFrame, field: str, active: list[str]) -> DataFrame:
    """(instrument_id, value, active_from, active_to): runs of days on which the value in force, by what had been observed by
    the day's end, was one of ``active``; active_to is open (null) for the last run.

    A fact counts from the later of its two dates; the one in force is then a running maximum, so no instrument meets
    every session.
    """
    known = facts.where(F.col("field") == field).withColumn("day", F.greatest("effective_date", F.to_date("observed_at")))
    order = F.struct("effective_date", "observed_at", "o_orderkey", "value")
    daily = known.groupBy("instrument_id", "day").agg(F.max(order).alias("best"))
    by = Window.partitionBy("instrument_id").orderBy("day")
    state = daily.withColumn("best", F.max("best").over(by.rowsBetween(Window.unboundedPreceding, 0))).select("instrument_id", "day", F.col("best.value").isin(active).alias("on"))
    turns = state.withColumn("_was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on <> _was")
    return turns.withColumn("active_to", F.lead("day").over(by)).where("on").select("instrument_id", F.col("day").alias("active_from"), "active_to")


def members_per_session(spans: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many are active at each session, by running sums of what begins and ends."""
    steps = spans.select(F.col("active_from").alias("day"), F.lit(1).alias("step")).unionByName(spans.where("active_to is not null").select(F.col("active_to").alias("day"), F.lit(-1).alias("step")))
    daily = steps.groupBy("day").agg(F.sum("step").alias("step")).withColumn("session", F.lit(None).cast("date"))
    asks = sessions.select(F.col("date").alias("day"), F.lit(0).cast("long").alias("step"), F.col("date").alias("session"))
    run = F.sum("step").over(Window.orderBy("day", F.col("session").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))  # a row per calendar day
    return daily.unionByName(asks).withColumn("members", run).where("session is not null").select("session", "members")


def latest_concept(facts: DataFrame, field: str, as_of: Column) -> DataFrame:
    """Per instrument: the value of one field in force on a date."""
    seen = facts.where((F.col("field") == field) & (F.col("effective_date") <= as_of) & (F.col("observed_at") < F.date_add(as_of, 1).cast("timestamp")))
    return seen.groupBy("instrument_id").agg(F.max_by("value", F.struct("effective_date", "observed_at", "o_orderkey")).alias("value"))


def misaligned(rows: DataFrame, other: DataFrame, group: str, key: str) -> DataFrame:
    """Groups whose sets of keys differ between two frames, with how many lack on either side."""
    both = rows.select(group, key).distinct().withColumn("_a", F.lit(1)).join(other.select(group, key).distinct().withColumn("_b", F.lit(1)), [group, key], "full_outer")
    return both.groupBy(group).agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second")).where("only_first + only_second > 0")


def order_outcomes(orders: DataFrame) -> DataFrame:
    """Orders beside what the broker showed: resolved states by an allowed list, else unresolved; wants id, quantity, and filled
    and state of the snapshot, null without one."""
    state = first_reason(
        ("missing", F.col("state").isNull()),
        ("unreadable", F.col("filled").isNull()),
        ("overfilled", F.col("filled") > F.col("quantity")),
        ("filled", (F.col("state") == "F") & (F.col("filled") == F.col("quantity"))),
        ("partial", (F.col("filled") > 0) & (F.col("filled") < F.col("quantity"))),
        ("working", F.col("state").isin("O", "P")),
    )
    return orders.withColumn("outcome", F.coalesce(state, F.lit("unresolved")))


def verdict(checks: DataFrame, group: str) -> DataFrame:
    """Passed where every check (name, passed) of a group is known and holds; else the names of those that fail, in order."""
    failing = F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("name")))), ",")
    unknown = F.count_if(F.col("passed").isNull()) > 0
    out = checks.groupBy(group).agg(failing.alias("failing"), unknown.alias("_u"))
    return out.select(group, F.when(F.col("_u"), "unknown").when(F.col("failing") != "", "failed").otherwise("passed").alias("verdict"), "failing")
