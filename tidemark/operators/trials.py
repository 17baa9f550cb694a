"""A trial ledger of numbered commits.

Each event is a file of its own whose number is one more than the last one's; the file is created exclusively, so of
two writers one gets the number and the other reads again and takes the next.  An event's body holds its number
and the hash of the event before it, and is stored beside its own hash.  Readers see a prefix: a file that isn't
wholly written yet is not an event, and no one writes behind it.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bundles import digest
from tidemark.sources.storage import create_once, exists, read_whole

ROLES = ("candidate", "baseline", "control", "holdout")
TERMINALS = ("completed", "failed", "aborted")
_BODY = "seq long, prev_hash string, trial_id string, event_type string, role string, family string, runner string, config string, config_hash string, reason string, sidecar string"
_START = "0" * 64


class Refused(ValueError):
    """An event that the ledger's rules don't allow; nothing was written."""


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class TrialLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, seq: int) -> str:
        return f"{self.path}/events/{seq:012d}.json"

    def head(self, wait: float = 10.0) -> tuple[int, str]:
        """Number and hash of the last event, found by doubling and halving; (0, zeros) of an empty ledger."""
        high = 1
        while exists(self.spark, self._file(high)):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if exists(self.spark, self._file(middle)) else (low, middle)
        if not low:
            return 0, _START
        until = time.monotonic() + wait
        while True:
            try:
                return low, json.loads(read_whole(self.spark, self._file(low)))["record_hash"]
            except (ValueError, KeyError):
                if time.monotonic() > until:
                    raise RuntimeError(f"event {low} was begun and never finished") from None
                time.sleep(0.05)

    def events(self) -> DataFrame:
        """All whole events with ``body`` and ``record_hash``."""
        if not exists(self.spark, self._file(1)):
            return self.spark.createDataFrame([], f"{_BODY}, body string, record_hash string")
        raw = self.spark.read.schema("body string, record_hash string").json(f"{self.path}/events/*.json").where("record_hash is not null and body is not null")
        return raw.select(F.from_json("body", _BODY).alias("e"), "body", "record_hash").select("e.*", "body", "record_hash")

    def faults(self) -> DataFrame:
        """(seq, fault): events whose hash, number or link doesn't hold; by a join, not one sorted group."""
        e = self.events()
        before = e.select((F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("_before"))
        met = e.join(before, "seq", "left")
        link = F.when(F.col("seq") == 1, F.lit(_START)).otherwise(F.col("_before"))
        fault = F.when(F.sha2("body", 256) != F.col("record_hash"), "hash").when(~F.col("prev_hash").eqNullSafe(link), "link")
        return met.select("seq", fault.alias("fault")).where("fault is not null")

    def append(self, event: dict, allowed: Callable[[DataFrame], str | None], tries: int = 100) -> dict:
        """Write the event behind the head if ``allowed(events)`` gives no objection; both are asked again after a lost race."""
        for turn in range(tries):
            seq, prev = self.head()
            if objection := allowed(self.events()):
                raise Refused(objection)
            body = canonical_json(event | {"seq": seq + 1, "prev_hash": prev})
            stored = canonical_json({"body": body, "record_hash": sha256(body)})
            if create_once(self.spark, self._file(seq + 1), stored.encode()):
                return json.loads(body)
            time.sleep(random.random() * 0.02 * (turn + 1))
        raise RuntimeError(f"lost {tries} races for the next event")

    def start(self, config: dict, *, role: str, family: str, runner: str) -> str:
        """The id of a new trial.  A family's holdout is started once."""
        if role not in ROLES:
            raise Refused(f"unknown role {role!r}")
        trial = str(uuid.uuid4())
        text = canonical_json(config)

        def allowed(events: DataFrame) -> str | None:
            spent = role == "holdout" and not events.where((F.col("role") == "holdout") & (F.col("family") == family)).isEmpty()
            return f"the holdout of {family!r} is spent" if spent else None

        self.append({"trial_id": trial, "event_type": "started", "role": role, "family": family, "runner": runner, "config": text, "config_hash": sha256(text), "reason": None, "sidecar": None}, allowed)
        return trial

    def finish(self, trial: str, outcome: str, *, returns: DataFrame | None = None, reason: str | None = None) -> dict:
        """The terminal event of a trial that was started and not finished; a completed one has its returns (session, log_return) beside it,
        with their number, span and digest in the event."""
        if outcome not in TERMINALS:
            raise Refused(f"unknown outcome {outcome!r}")
        if outcome == "completed" and returns is None:
            raise Refused("a completed trial needs its daily returns")
        own = self.events().where(F.col("trial_id") == trial).limit(2).collect()
        if len(own) != 1:
            raise Refused(f"trial {trial} was not started, or is finished")
        sidecar = self._sidecar(trial, returns) if returns is not None else None
        kept = {k: own[0][k] for k in ("trial_id", "role", "family", "runner", "config", "config_hash")}

        def allowed(events: DataFrame) -> str | None:
            return None if events.where(F.col("trial_id") == trial).count() == 1 else f"trial {trial} is finished"

        return self.append(kept | {"event_type": outcome, "reason": reason, "sidecar": sidecar}, allowed)

    def _sidecar(self, trial: str, returns: DataFrame) -> str:
        path = f"{self.path}/returns/{trial}-{uuid.uuid4().hex}"
        returns.select("session", "log_return").write.parquet(path)
        facts = self.spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_if(F.col("log_return").isNull() | F.isnan("log_return") | F.col("session").isNull()).alias("bad"), F.count_distinct("session").alias("sessions"), F.min("session").cast("string").alias("first"), F.max("session").cast("string").alias("last"), digest(["session", "log_return"]).alias("digest")).first()
        if facts.rows == 0 or facts.bad or facts.sessions != facts.rows:
            raise Refused("returns must be finite, one a session and not empty")
        return canonical_json({"path": path, **{k: facts[k] for k in ("rows", "first", "last", "digest")}})

    def returns(self, trial: str) -> DataFrame:
        """The returns of a completed trial, refused unless they are what its event says."""
        row = self.events().where((F.col("trial_id") == trial) & F.col("sidecar").isNotNull()).first()
        if row is None:
            raise Refused(f"trial {trial} has no returns")
        told = json.loads(row.sidecar)
        rows = self.spark.read.parquet(told["path"])
        if rows.agg(digest(["session", "log_return"]).alias("d")).first().d != told["digest"]:
            raise Refused(f"the returns of trial {trial} were changed")
        return rows

    def open_holdout(self, family: str, config_hash: str) -> str:
        """The id of the family's one open holdout trial; Refused if there is none, if it is bound to another configuration, or if it has run."""
        own = self.events().where((F.col("role") == "holdout") & (F.col("family") == family)).select("trial_id", "event_type", "config_hash").limit(3).collect()
        starts = [e for e in own if e.event_type == "started"]
        if len(starts) != 1:
            raise Refused(f"no holdout of {family!r} was started; it stays sealed")
        if starts[0].config_hash != config_hash:
            raise Refused(f"the holdout of {family!r} is bound to another configuration")
        if len(own) > 1:
            raise Refused(f"the holdout of {family!r} has been run")
        return starts[0].trial_id
