"""Sessions skipped while killed: against plain sets, and without a shuffle of the sessions."""

import datetime as dt
import random

import pytest

from tidemark.operators import accounts


@pytest.fixture(scope="module")
def case(spark):
    rng, day = random.Random(3), lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    days = [day(k) for k in range(200) if day(k).weekday() < 5]
    kills = {p: rng.choice(days + [day(3), day(199)]) for p in range(40)}
    runs, leases = ([(rng.choice([*range(45), None]), day(rng.randrange(200))) for _ in range(3000)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "profile int, session date")
    made = accounts.skipped_while_killed(spark.createDataFrame(list(kills.items()), "profile int, day date"), spark.createDataFrame([(d, n) for n, d in enumerate(days, 1)], "date date, session_no int"), frame(runs), frame(leases))
    return made, sorted((p, d) for p, k in kills.items() for d in days if d > k and (p, d) not in {*runs, *leases})


def test_against_sets(case):
    assert sorted((r.profile, r.session) for r in case[0].collect()) == case[1]


def test_sessions_are_listed_after_the_last_shuffle(spark, case):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = case[0].where("true").select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" in plan and "Exchange hashpartitioning" not in plan[: plan.index("Generate explode")]
