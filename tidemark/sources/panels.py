"""Panels that are read only if what was recorded about them holds: the research panel, and the sealed one after it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bundles
from tidemark.operators.trials import Refused, TrialLedger, canonical_json, sha256

STATUSES = ("VERIFIED", "EXCLUSIONS")


def data_check(manifest: DataFrame, key: str, research_end: str, status: str = "VERIFIED") -> dict:
    """What a data check records: its status, its input (research end and the digest of every body), and the input's hash.

    One digest per instrument comes to the driver.
    """
    bodies = {str(r[key]): r.digest for r in manifest.select(key, "digest").collect()}
    inputs = {"research_end": research_end, "bodies": bodies}
    return {"status": status, "panel_hash_input": inputs, "panel_hash": sha256(canonical_json(inputs))}


def refusal(check: dict, research_end: str) -> str | None:
    """Why a data check by itself doesn't allow a read; None if it does."""
    inputs = check.get("panel_hash_input") or {}
    if check.get("status") not in STATUSES:
        return "data_check_status"
    if sha256(canonical_json(inputs)) != check.get("panel_hash"):
        return "data_check_hash"
    return "research_end" if inputs.get("research_end") != research_end else None


def bound(rows: DataFrame, manifest: DataFrame, check: dict, key: str, columns: list[str], research_end: str) -> DataFrame:
    """rows up to the research end, refused unless check, manifest and the rows themselves agree on every body's digest.

    The digests are sums over rows, combined in the task; faults are counted before any is named.  The date filter stands directly
    on ``rows``, so a scan below gets it.
    """
    if reason := refusal(check, research_end):
        raise Refused(reason)
    wanted = rows.sparkSession.createDataFrame(sorted(check["panel_hash_input"]["bodies"].items()), f"{key} string, _checked string")
    listed = manifest.select(F.col(key).cast("string").alias(key), F.col("digest").alias("_listed"))
    found = bundles.manifest_of(rows, key, columns).select(F.col(key).cast("string").alias(key), F.col("digest").alias("_found"))
    met = wanted.join(listed, key, "full_outer").join(found, key, "full_outer")
    fault = F.when(~F.col("_checked").eqNullSafe(F.col("_listed")), "manifest_and_data_check_disagree").when(~F.col("_found").eqNullSafe(F.col("_checked")), "body_digest")
    bad = met.select(key, fault.alias("fault")).where("fault is not null").orderBy("fault", key).limit(5).collect()
    if bad:
        raise Refused("; ".join(f"{r.fault}: {r[key]}" for r in bad))
    return rows.where(F.col("date") <= F.lit(research_end).cast("date"))


def research_panel(spark: SparkSession, path: str, check: dict, key: str, columns: list[str], research_end: str) -> DataFrame:
    """The rows of a published bundle (``bundles.publish``) up to the research end."""
    return bound(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest"), check, key, columns, research_end)


def holdout_panel(rows: DataFrame, manifest: DataFrame, check: dict, key: str, columns: list[str], research_end: str, holdout_end: str, ledger: TrialLedger, family: str, config: dict) -> DataFrame:
    """rows up to the holdout's end with ``sealed`` (after the research end).

    Refused unless the family's holdout was started in the ledger for this configuration and has not run: that event, created
    once in shared storage, comes before any plan that may read a sealed row.
    """
    ledger.open_holdout(family, sha256(canonical_json(config)))
    if holdout_end <= research_end:
        raise Refused("the holdout's end precedes the holdout")
    bound(rows, manifest, check, key, columns, research_end)
    until = rows.where(F.col("date") <= F.lit(holdout_end).cast("date"))
    return until.withColumn("sealed", F.col("date") > F.lit(research_end).cast("date"))


def stored_check(spark: SparkSession, path: str) -> dict:
    """A data check from its JSON file."""
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
