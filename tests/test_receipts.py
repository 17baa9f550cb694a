"""Records of sources, families and backfills: what is refused, and what is written once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, receipts
from tidemark.operators.trials import Refused, TrialLedger


def test_credentials_in_urls(spark):
    urls = {"https://host/a?from=1": True, "https://user@host/a": False, "https://host/a?Token=x": False, "https://host/a?x=1&api_key=2": False, "https://host/token?kind=key": True, "https://host/a": True, "https://host/a?token": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.ok for r in df.select("u", receipts.credential_free(F.col("u")).alias("ok")).collect()} == urls


def test_a_session_closes_at_four_in_new_york(spark):
    day, digest = dt.date(2024, 7, 3), "0" * 64
    rows = [(i, "https://host/a", at, s, "raw", 1, digest) for i, (at, s) in enumerate([(dt.datetime(2024, 7, 3, 20, 0), day), (dt.datetime(2024, 7, 3, 19, 59), day), (dt.datetime(2024, 7, 5), dt.date(2024, 7, 4)), (dt.datetime(2024, 7, 5), None)])]
    rows.append((4, None, None, day, None, None, None))
    manifests = spark.createDataFrame(rows, "id int, endpoint string, fetched_at timestamp, session date, adjustment string, row_count int, sha256 string")
    got = {r.id: r.faults for r in receipts.manifest_faults(manifests, spark.createDataFrame([(day,)], "date date")).collect()}
    assert got == {0: "", 1: "not_closed", 2: "no_session", 3: "no_session", 4: "adjustment,row_count,digest"}


def test_mismatches_are_named(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), "mismatch" if i % 2 else "reconciled") for i in range(60)]
    df = spark.createDataFrame(rows, "date date, status string")
    with pytest.raises(ValueError, match="2024-01-02, 2024-01-04.* and more .30 in all."):
        receipts.assert_reconciled(df)
    with pytest.raises(ValueError, match="mismatch on 2024-01-02$"):
        receipts.assert_reconciled(df.where("date < DATE '2024-01-04'"))
    assert receipts.assert_reconciled(df.where("status = 'reconciled'")).count() == 30


def test_replay_inputs_and_dividends_refuse(spark):
    b = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 1.0), ("b", dt.date(2024, 1, 1), 1.0, None), ("c", dt.date(2024, 2, 1), 1.0, 1.0)], "ticker string, date date, open double, close double")
    assert receipts.replay_inputs(b, ["a"], "2024-01-31").count() == 1
    with pytest.raises(ValueError, match="b, c, d"):
        receipts.replay_inputs(b, ["a", "b", "c", "d"], "2024-01-31")
    actions = b.select("ticker", "date", F.lit("dividend").alias("kind"), F.col("open").alias("value"))
    with pytest.raises(ValueError, match="one instrument"):
        joins.dividends_only(actions)
    assert joins.dividends_only(actions.where("ticker = 'a'")).count() == 1


def test_family_is_declared_once_and_before_its_trials(spark, tmp_path):
    ledger, path = TrialLedger(spark, str(tmp_path / "ledger")), str(tmp_path / "families")
    record = receipts.declare_family(spark, path, {"family": "f", "lags": 5}, ledger)
    assert receipts.declared(spark, path, "f") == record and record["ledger_head"] == "0" * 64
    with pytest.raises(Refused, match="is declared"):
        receipts.declare_family(spark, path, {"family": "f", "lags": 6}, ledger)
    ledger.start({}, role="candidate", family="g", runner="test")
    with pytest.raises(Refused, match="has trials"):
        receipts.declare_family(spark, path, {"family": "g"}, ledger)
    file = tmp_path / "families" / "f.json"
    file.write_text(file.read_text().replace('"lags":5', '"lags":4'))
    with pytest.raises(Refused, match="was changed"):
        receipts.declared(spark, path, "f")


def test_backfills_are_numbered_and_never_shrink(spark, tmp_path):
    path = str(tmp_path / "backfill")
    study = {"product": 10, "reruns": 3, "remembered": 7, "chosen": 12, "approved": True}
    assert receipts.write_backfill(spark, path, [study, study], 1)["n_backfill"] == 128
    assert receipts.write_backfill(spark, path, [study], 2)["n_backfill"] == 128
    for studies, number, why in (([study], 2, "is written"), ([study], 4, "no backfill 3"), ([], 3, "approved"), ([{**study, "approved": False}], 3, "approved"), ([{**study, "chosen": None}], 3, "finite")):
        with pytest.raises(Refused, match=why):
            receipts.write_backfill(spark, path, studies, number)
    file = tmp_path / "backfill" / "000002.json"
    file.write_text(file.read_text().replace('"n_backfill":128', '"n_backfill":4'))
    with pytest.raises(Refused, match="was changed"):
        receipts.write_backfill(spark, path, [study], 3)


def test_fills(spark):
    rows = [(None, None, None), ("", "1", "1"), ("Filled", "10", "2.5"), ("filled", "9", "2.5"), ("filled", "10", "0"), ("filled", "nan", "1"), ("filled", None, "1"), ("rejected", None, None), ("expired", "0", None), ("canceled", "3", None), ("canceled", "?", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status string, filled string, price string")
    got = [tuple(r.x) for r in df.select("i", receipts.reconciled_fill(F.col("status"), F.col("filled"), F.col("price"), F.lit(10.0)).alias("x")).orderBy("i").collect()]
    assert [x[1] for x in got] == [False, False, True, False, False, False, False, True, True, False, False]
    assert got[2] == ("filled", True, 2.5, "") and got[3][2:] == (2.5, "filled another quantity") and got[1][0] == "unknown"


def test_one_key_of_a_bundle(spark, tmp_path):
    from tidemark.operators import bundles

    rows = spark.createDataFrame([(t, dt.date(2024, 1, 1) + dt.timedelta(i), i) for t in "ab" for i in range(5)], "ticker string, date date, volume long")
    path = str(tmp_path / "b")
    bundles.publish(rows, path, "ticker", ["date", "volume"])
    got = bundles.load_one(spark, path, "ticker", "a", ["date", "volume"])
    assert got.count() == 5 and "EqualTo(ticker,a)" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(LookupError, match="'c' is not in the bundle"):
        bundles.load_one(spark, path, "ticker", "c", ["date", "volume"])
    rows.where("ticker = 'a' and volume = 1").write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="a: rows,digest"):
        bundles.load_one(spark, path, "ticker", "a", ["date", "volume"])
    assert bundles.load_one(spark, path, "ticker", "b", ["date", "volume"]).count() == 5


def test_random_books_by_class(spark):
    import numpy as np

    from tidemark.operators import sizing

    r = np.random.default_rng(3)
    x = r.normal(0, 0.01, (40, 3)) * [1, 2, 3]
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    returns = spark.createDataFrame([(i, days[i], "abc"[j], float(x[i, j])) for i in range(40) for j in range(3)], "session_no int, date date, ticker string, log_return double").repartition(3)
    picked = returns.select("date", "ticker", (F.col("ticker") != "b").alias("held"))
    decisions = spark.createDataFrame([(d, i % 10 == 9) for i, d in enumerate(days)], "date date, decides boolean")
    kinds = {k: {(w.date, w.ticker): w.weight for w in sizing.random_book(picked, returns, decisions, k, cap=5.0, target=0.1, window=20).collect()} for k in ("equal_weight_unscaled", "equal_legs_vol_target", "inverse_vol_vol_target")}
    for k, book in kinds.items():
        assert {d for d, _ in book} == {days[i] for i in (9, 19, 29, 39)} and all(book[days[i], "b"] == 0 for i in (9, 19, 29, 39)), k
    assert kinds["equal_weight_unscaled"][days[9], "a"] == 2.5
    past = x[20:40]
    vol = past.std(axis=0, ddof=1) * np.sqrt(252)
    assert np.isclose(kinds["equal_legs_vol_target"][days[39], "c"], min(1, 0.1 / vol[2]) / 2)
    legs = np.array([1 / vol[0], 0, 1 / vol[2]])
    risk = (past @ legs).var(ddof=1) * 252
    assert np.allclose([kinds["inverse_vol_vol_target"][days[39], t] for t in "abc"], legs * 0.1 / np.sqrt(risk))
    assert all(v == 0 for (d, _), v in kinds["inverse_vol_vol_target"].items() if d == days[9])
    with pytest.raises(ValueError, match="sizing class"):
        sizing.random_book(picked, returns, decisions, "other", cap=1.0, target=0.1, window=20)


def test_payload_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, -0.001, None), ("b", 0, 2.345, 0.5)], "run string, n long, p double, w double")
    got = [r.payload for r in receipts.payload(df, "run", {"n": 0, "p": 2, "w": 1}).orderBy("run").collect()]
    assert got == ['{"run":"a","n":"3","p":"0.00","w":null}', '{"run":"b","n":"0","p":"2.35","w":"0.5"}']
    rows = spark.createDataFrame([(1, "x"), (2, "y, z")], "id int, name string")
    receipt = receipts.publish_inventory(rows, str(tmp_path / "inv"), "id", "name")
    assert receipt["rows"] == 2 and (tmp_path / "inv" / "receipt.json").exists()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        receipts.publish_inventory(rows, str(tmp_path / "inv"), "id", "name")
