"""What is recorded about sources, fills and configurations, and the rules that such records must meet."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import tree_digest
from tidemark.operators.screens import reasons
from tidemark.operators.trials import Refused, TrialLedger, canonical_json, sha256
from tidemark.sources.storage import create_once, exists, read_whole

#: Parameters of a URL that carry a credential, and adjustments of a body.
CREDENTIALS = ("api_key", "api_token", "apikey", "apikeyid", "key", "secret", "token")
ADJUSTMENTS = ("adjusted", "raw", "split")
TERMINAL = ("canceled", "expired", "filled", "rejected", "replaced")


def credential_free(url: Column) -> Column:
    """Whether a URL has neither user information nor a parameter of a credential's name."""
    names = F.transform(F.split(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.lower(F.split(p, "=")[0]))
    return F.parse_url(url, F.lit("USERINFO")).isNull() & ~F.arrays_overlap(names, F.array(*map(F.lit, CREDENTIALS)))


def manifest_faults(manifests: DataFrame, sessions: DataFrame) -> DataFrame:
    """manifests with ``faults``; wants endpoint, fetched_at (an instant), session (a date), adjustment, row_count, sha256.

    A session must be one of the calendar's and have closed, at 16:00 in New York, when it was fetched.
    """
    known = F.broadcast(sessions.select(F.col("date").alias("session"), F.lit(True).alias("_open")))  # a calendar is a bounded table
    closed = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("INTERVAL 16 HOURS"), "America/New_York")
    tests = (
        ("credential", ~credential_free(F.col("endpoint"))),
        ("no_session", F.col("_open").isNull()),
        ("not_closed", F.col("_open").isNotNull() & (closed > F.col("fetched_at"))),
        ("adjustment", ~F.coalesce(F.col("adjustment").isin(*ADJUSTMENTS), F.lit(False))),
        ("row_count", ~F.coalesce(F.col("row_count") >= 0, F.lit(False))),
        ("digest", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
    )
    return manifests.join(known, "session", "left").withColumn("faults", reasons(*tests)).drop("_open")


def assert_reconciled(statuses: DataFrame, named: int = 20) -> DataFrame:
    """statuses (date, status), or ValueError naming the first mismatched dates and their number."""
    bad = statuses.where("status = 'mismatch'")
    first = bad.select(F.col("date").cast("string").alias("d")).orderBy("d").limit(named + 1).collect()
    if first:
        more = f" and more ({bad.count()} in all)" if len(first) > named else ""
        raise ValueError("reconciliation failed: mismatch on " + ", ".join(r.d for r in first[:named]) + more)
    return statuses


def closes_by_day(bars: DataFrame) -> DataFrame:
    """(ticker, date, close) of bars (ticker, t, c) whose instants fall on a New York day; of several a day the last."""
    day = F.to_date(F.from_utc_timestamp("t", "America/New_York"))
    return bars.groupBy("ticker", day.alias("date")).agg(F.max_by("c", "t").alias("close"))


def replay_inputs(bars: DataFrame, sleeves: list[str], end: str) -> DataFrame:
    """(ticker, date, open, close) of the sleeves up to a day; ValueError names sleeves that are missing or lack a price."""
    rows = bars.where(F.col("ticker").isin(sleeves) & (F.col("date") <= F.lit(end).cast("date"))).select("ticker", "date", "open", "close")
    held = {r.ticker: r.bad for r in rows.groupBy("ticker").agg(F.count_if(F.col("open").isNull() | F.col("close").isNull()).alias("bad")).collect()}
    if bad := sorted(t for t in sleeves if held.get(t, 1)):
        raise ValueError("sleeves without rows or prices: " + ", ".join(bad))
    return rows


def by_run_day(runs: DataFrame) -> DataFrame:
    """runs (run_id, started) with their New York day and ``place``: days in order, runs of a day as they began, ties by id."""
    day = F.to_date(F.from_utc_timestamp("started", "America/New_York"))
    order = Window.partitionBy("day").orderBy("started", "run_id")
    return runs.withColumn("day", day).withColumn("place", F.row_number().over(order))


def reconciled_fill(status: Column, filled: Column, price: Column, quantity: Column) -> Column:
    """Struct (status, reconciled, price, problem) of an order from its broker snapshot; a null status is no snapshot.

    ``filled`` and ``price`` are texts.  Only a terminal status reconciles: filled with a positive price and the
    order's quantity, or anything else without a partial fill.
    """
    state, number, paid = F.lower(status), F.try_to_number(filled, F.lit("S9999999999.999999")).cast("double"), F.try_to_number(price, F.lit("S9999999999.999999")).cast("double")
    partial = (filled.isNotNull() & number.isNull()) | (F.coalesce(number, F.lit(0.0)) != 0)
    whole = F.abs(number - quantity) <= F.greatest(1e-9 * F.greatest(F.abs(number), F.abs(quantity)), F.lit(1e-9))

    def told(name: Column, ok: bool, at: Column, problem: Column) -> Column:
        return F.struct(name.alias("status"), F.lit(ok).alias("reconciled"), at.cast("double").alias("price"), problem.alias("problem"))

    none = F.lit(None)
    return (
        F.when(state.isNull(), told(F.lit("no broker record"), False, none, F.lit("no broker snapshot for this order")))
        .when(~state.isin(*TERMINAL), told(F.when(state == "", "unknown").otherwise(state), False, none, F.lit("broker status is not terminal")))
        .when((state != "filled") & partial, told(state, False, none, F.concat(state, F.lit(" after a partial fill"))))
        .when(state != "filled", told(state, True, none, F.lit("")))
        .when(paid.isNull() | number.isNull(), told(state, False, none, F.lit("filled without a numeric price and quantity")))
        .when(paid <= 0, told(state, False, none, F.lit("filled at a non-positive price")))
        .when(~whole, told(state, False, paid, F.lit("filled another quantity")))
        .otherwise(told(state, True, paid, F.lit("")))
    )


def buy_refusals(buys: DataFrame, holdings: DataFrame, *, limit: float, max_age: int) -> DataFrame:
    """(account, ticker, reason) of the buys that must not go on.

    Wants buys (account, ticker, quantity, price, value) and outside and own holdings (account, ticker, quantity, age).  An account
    without any holdings is unknown exposure and refuses all; so does one whose oldest figure is over ``max_age`` days; else a buy is refused
    when all that is then held of the ticker is more than ``limit`` of the account's value.
    """
    known = holdings.groupBy("account").agg(F.max("age").alias("_age"))
    held = holdings.groupBy("account", "ticker").agg(F.sum("quantity").alias("_held"))
    rows = buys.join(known, "account", "left").join(held, ["account", "ticker"], "left")
    after = (F.coalesce("_held", F.lit(0.0)) + F.col("quantity")) * F.col("price")
    why = F.when(F.col("_age").isNull(), "holdings_missing").when(F.col("_age") > max_age, "holdings_stale").when(after > limit * F.col("value"), "concentration")
    return rows.select("account", "ticker", why.alias("reason")).where("reason is not null")


def sizing_class(config: Column, equal_legs: Iterable[str], unscaled: Iterable[str]) -> Column:
    """How a configuration's book, and a random one in its place, is sized."""
    return F.when(config.isin(list(equal_legs)), "equal_legs_vol_target").when(config.isin(list(unscaled)), "equal_weight_unscaled").otherwise("inverse_vol_vol_target")


def cadence(config: Column, weekly: Iterable[str]) -> Column:
    return F.when(config.isin(list(weekly)), "weekly").otherwise("monthly")


def with_robustness(primary: DataFrame, coefficients: list[float]) -> DataFrame:
    """primary cost rows (with impact) under role primary, and each again per other coefficient under role robustness."""
    other = F.explode(F.array(*[F.struct(F.lit("robustness").alias("role"), F.lit(float(c)).alias("impact")) for c in coefficients]))
    rows = primary.select(F.struct(F.lit("primary").alias("role"), F.col("impact").cast("double").alias("impact")).alias("_x"), *[c for c in primary.columns if c != "impact"])
    again = primary.select(other.alias("_x"), *[c for c in primary.columns if c != "impact"])
    return rows.unionByName(again).select("_x.role", "_x.impact", *[c for c in primary.columns if c != "impact"])


def rundown(features: DataFrame) -> DataFrame:
    """(ticker, date, agreement, momentum, regime, volatility, flow): five readings of each ticker's last row with all features.

    Wants close_to_short, sma_spread, volatility (of a day) and relative_volume.
    """
    known = features.dropna(subset=["close_to_short", "sma_spread", "volatility", "relative_volume"])
    last = known.groupBy("ticker").agg(F.max_by(F.struct("date", "close_to_short", "sma_spread", "volatility", "relative_volume"), "date").alias("x")).select("ticker", "x.*")
    up, wide, year, flow = F.col("close_to_short"), F.col("sma_spread"), F.col("volatility") * F.sqrt(F.lit(252.0)), F.col("relative_volume")
    agreement = F.when((up > 0) & (wide > 0), "bullish").when(~(up > 0) & ~(wide > 0), "bearish").otherwise("neutral")
    return last.select(
        "ticker",
        "date",
        agreement.alias("agreement"),
        F.when(up >= 0, "bullish").otherwise("bearish").alias("momentum"),
        F.when(wide >= 0, "bullish").otherwise("bearish").alias("regime"),
        F.when(year > 0.35, "caution").when(year > 0.22, "neutral").otherwise("bullish").alias("volatility"),
        F.when((flow > 1.25) & (up > 0), "bullish").when((flow > 1.4) & (up < 0), "caution").otherwise("neutral").alias("flow"),
    )


def payload(summary: DataFrame, key: str, places: dict[str, int]) -> DataFrame:
    """(key, payload): each row's figures as compact JSON in column order, numbers as texts of so many places; nulls stay."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{places[c]}f", F.round(F.col(c), places[c]) + 0.0) if places[c] else F.round(F.col(c)).cast("long").cast("string")).alias(c) for c in summary.columns if c in places]
    return summary.select(key, F.to_json(F.struct(F.col(key).cast("string").alias(key), *shown), {"ignoreNullFields": "false"}).alias("payload"))


# records that are written once


def publish_inventory(frame: DataFrame, path: str, key: str, text: str) -> dict:
    """Rows as CSV and a receipt, created once, with their number and tree digest as read back; a taken path is refused."""
    spark = frame.sparkSession
    frame.select(key, text).write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    back = spark.read.schema(frame.select(key, text).schema).option("header", True).csv(f"{path}/rows")
    root = tree_digest(back, key, text).first()
    receipt = {"rows": root.n if root else 0, "digest": root.digest if root else sha256("")}
    if not create_once(spark, f"{path}/receipt.json", canonical_json(receipt).encode()):
        raise Refused(f"{path} has a receipt")
    return receipt


def declare_family(spark: SparkSession, path: str, declaration: dict, ledger: TrialLedger) -> dict:
    """The family's one declaration with its hashes; Refused if it was declared before or has trials."""
    family = declaration["family"]
    if not ledger.events().where(F.col("family") == family).isEmpty():
        raise Refused(f"family {family!r} has trials and can't be declared any more")
    record = {"family": family, "declaration": declaration, "declaration_hash": sha256(canonical_json(declaration)), "ledger_head": ledger.head()[1]}
    record["record_hash"] = sha256(canonical_json(record))
    if not create_once(spark, f"{path}/{family}.json", canonical_json(record).encode()):
        raise Refused(f"family {family!r} is declared")
    return record


def declared(spark: SparkSession, path: str, family: str) -> dict:
    """A declaration whose hashes hold."""
    record = json.loads(read_whole(spark, f"{path}/{family}.json"))
    told = record.pop("record_hash")
    if sha256(canonical_json(record)) != told or sha256(canonical_json(record["declaration"])) != record["declaration_hash"]:
        raise Refused(f"the declaration of {family!r} was changed")
    return record | {"record_hash": told}


def write_backfill(spark: SparkSession, path: str, studies: list[dict], number: int) -> dict:
    """Backfill ``number`` (from 1): twice the next power of two of the sum of each study's largest bound, never less than the one before it.

    A study has product, reruns, remembered and chosen; one without finite bounds, or one that isn't approved, is refused.
    """
    before = 0
    if number > 1:
        last = json.loads(read_whole(spark, f"{path}/{number - 1:06d}.json")) if exists(spark, f"{path}/{number - 1:06d}.json") else None
        if last is None:
            raise Refused(f"there is no backfill {number - 1}")
        told = last.pop("sha256")
        if sha256(canonical_json(last)) != told:
            raise Refused(f"backfill {number - 1} was changed")
        before = last["n_backfill"]
    if not studies or any(not s.get("approved") or any(not isinstance(s.get(k), int) for k in ("product", "reruns", "remembered", "chosen")) for s in studies):
        raise Refused("a backfill needs approved studies with finite bounds")
    total = sum(max(s["product"] * s["reruns"], s["remembered"], s["chosen"]) for s in studies)
    record = {"n_backfill": max(before, 2 * (1 << max(0, total - 1).bit_length())), "studies": studies, "status": "complete"}
    record["sha256"] = sha256(canonical_json(record))
    if not create_once(spark, f"{path}/{number:06d}.json", canonical_json(record).encode()):
        raise Refused(f"backfill {number} is written")
    return record
