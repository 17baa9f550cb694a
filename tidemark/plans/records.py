"""Queries over decoders and bundles: bodies are built from whole tables, decoded, and compared with the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bundles, decoders
from tidemark.plans.registry import query, rounded
from tidemark.sources import frames as src


def _orders(spark, d):
    return src.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def _listed(*fields):
    """Array of a group's structs, in order of all fields."""
    return F.sort_array(F.collect_list(F.struct(*fields)))


@query("src_14_bar_rows", "sessions", ", b AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE month(date) = 1 AND ticker <> 'Brand#11'), n AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS n FROM b) SELECT ticker, date, open, high, low, close, volume, CASE WHEN n > 1 THEN 'repeated' WHEN date NOT IN (SELECT date FROM sessions) THEN 'no_session' END AS fault FROM n WHERE date < DATE '1998-06-30'")
def _(spark, d):
    b = src.bars(spark, d)
    t = _listed(F.date_format("date", "yyyy-MM-dd").alias("t"), *[F.col(n).alias(n[0]) for n in ("open", "high", "low", "close", "volume")])
    pages = b.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.to_json(F.struct(t.alias("bars"))).alias("body"))
    again = pages.where((F.month("month") == 1) & (F.col("ticker") != "Brand#11"))
    return decoders.bar_rows(pages.union(again), src.sessions_of(spark, b), F.lit("1998-06-30 19:59:00").cast("timestamp"))


@query("src_15_filing_rows", "", "SELECT o_custkey AS cik, o_orderkey::VARCHAR AS accession, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed, (CAST(o_orderdate AS DATE)::TIMESTAMP + to_hours((8 + o_orderkey % 12)::INT)) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS accepted FROM orders")
def _(spark, d):
    at = F.date_format(F.col("day").cast("timestamp") + F.make_dt_interval(hours=(8 + F.col("o_orderkey") % 12).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    names = ["accessionNumber", "form", "filingDate", "acceptanceDateTime"]
    x = _listed(F.col("o_orderkey").cast("string").alias(names[0]), F.col("o_orderstatus").alias(names[1]), F.date_format("day", "yyyy-MM-dd").alias(names[2]), at.alias(names[3]))
    g = _orders(spark, d).groupBy(F.col("o_custkey").alias("cik")).agg(x.alias("x"))
    recent = F.struct(*[F.col(f"x.{n}").alias(n) for n in names])
    pages = g.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))
    f = decoders.filing_rows(pages)
    return f.withColumn("accepted", F.col("accepted").cast("timestamp_ntz"))


@query("src_16_fact_rows", "", "SELECT o_custkey AS cik, o_orderstatus AS taxonomy, o_orderpriority AS concept, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'shares' END AS unit, CAST(o_orderdate AS DATE) AS period_end, o_totalprice AS value, CAST(o_orderdate AS DATE) + 30 AS filed, (o_orderkey % 3)::VARCHAR AS form FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    o = _orders(spark, d).select(F.col("o_custkey").alias("cik"), "o_orderstatus", "o_orderpriority", F.when(k % 2 == 0, "USD").otherwise("shares").alias("unit"), F.struct(F.col("day").cast("string").alias("end"), F.col("o_totalprice").alias("val"), F.date_add("day", 30).cast("string").alias("filed"), (k % 3).cast("string").alias("form")).alias("v"))
    nested = lambda key, v: F.map_from_entries(F.collect_list(F.struct(F.col(key), v)))
    g = o.groupBy("cik", "o_orderstatus", "o_orderpriority", "unit").agg(F.collect_list("v").alias("v"))
    g = g.groupBy("cik", "o_orderstatus", "o_orderpriority").agg(F.struct(nested("unit", F.col("v")).alias("units")).alias("v"))
    g = g.groupBy("cik", "o_orderstatus").agg(nested("o_orderpriority", F.col("v")).alias("v"))
    g = g.groupBy("cik").agg(nested("o_orderstatus", F.col("v")).alias("facts"))
    return decoders.fact_rows(g.select("cik", F.to_json(F.struct("facts")).alias("body")))


@query("src_17_mapping_rows", "", "SELECT p_partkey::VARCHAR AS job, CASE WHEN p_partkey % 31 = 0 THEN 'error' WHEN p_partkey % 9 = 0 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 9 <> 0 THEN 'F' || p_partkey || '-' || h END AS figi, CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 9 <> 0 THEN p_brand END AS ticker FROM part, range(1, 3) t(h) WHERE h = 1 OR (p_size > 40 AND p_partkey % 31 <> 0 AND p_partkey % 9 <> 0)")
def _(spark, d):
    k = F.col("p_partkey")
    hit = lambda n: F.struct(F.concat(F.lit("F"), k, F.lit(f"-{n}")).alias("figi"), F.col("p_brand").alias("ticker"))
    hits = F.when((k % 31 != 0) & (k % 9 != 0), F.when(F.col("p_size") > 40, F.array(hit(1), hit(2))).otherwise(F.array(hit(1))))
    answer = F.struct(hits.alias("data"), F.when((k % 9 == 0) & (k % 31 != 0), "No identifier found.").alias("warning"), F.when(k % 31 == 0, "Invalid job.").alias("error"))
    p = src.table(spark, d, "part").select(k, F.struct(k.cast("string").alias("job"), answer.alias("answer")).alias("p"))
    g = p.groupBy(F.floor(k / 100).alias("batch")).agg(F.collect_list("p").alias("p"))
    return decoders.mapping_rows(g.select(F.col("p.job").alias("jobs"), F.to_json("p.answer").alias("body")))


@query("src_18_observation_rows", "vintages", " SELECT series, date, realtime_start, realtime_end, CASE WHEN day(realtime_start) % 5 <> 0 THEN value END AS value FROM vintages")
def _(spark, d):
    v = src.vintages(spark, d)
    text = [F.date_format(n, "yyyy-MM-dd").alias(n) for n in ("realtime_start", "realtime_end", "date")]
    one = _listed(*text, F.when(F.dayofmonth("realtime_start") % 5 == 0, ".").otherwise(F.col("value").cast("string")).alias("value"))
    pages = v.groupBy("series", F.col("date").alias("_m")).agg(F.to_json(F.struct(one.alias("observations"))).alias("body"))
    return decoders.observation_rows(pages)


@query("src_19_factor_rows", "bars", ", m AS (SELECT ticker AS dataset, last_day(date) AS month_end, count(*) AS n, max(day(date)) AS k FROM bars GROUP BY 1, 2), r AS (SELECT dataset, month_end, 'Count' AS factor, CASE WHEN k <> 28 THEN (n + 0.25::DOUBLE) / 100 END AS value FROM m UNION ALL SELECT dataset, month_end, 'Last', CASE WHEN k <> 27 THEN -k / 100.0::DOUBLE END FROM m) SELECT dataset, month_end, factor, round(value, 9) AS value FROM r")
def _(spark, d):
    m = src.bars(spark, d).groupBy(F.col("ticker").alias("dataset"), F.date_format("date", "yyyyMM").alias("month")).agg(F.count("*").alias("n"), F.max(F.dayofmonth("date")).alias("k"))
    line = F.concat(F.col("month"), F.lit(",  "), F.when(F.col("k") == 28, "-99.99").otherwise(F.concat(F.col("n"), F.lit(".25"))), F.lit(","), F.when(F.col("k") == 27, "-999").otherwise(F.concat(F.lit("-"), F.col("k"))))
    g = m.groupBy("dataset").agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("t"))
    files = g.select("dataset", F.concat(F.lit("This file has monthly rows.\n\n,Count,Last\n"), F.col("t"), F.lit("\n\n  Annual\n,Count,Last\n1995, 1.0, 2.0\n199613, 7.0, 7.0\n")).alias("text"))
    return rounded(decoders.factor_rows(files), 9)


@query("src_20_action_rows", "actions", " SELECT ticker, date, kind, CASE WHEN kind = 'split' AND day(date) = 2 THEN NULL ELSE value END AS value, CASE WHEN kind = 'dividend' AND day(date) % 2 = 0 THEN 'as_paid' END AS basis FROM actions")
def _(spark, d):
    a, day = src.actions(spark, d), F.dayofmonth("date")
    text = F.col("date").cast("string").alias("date")
    div = F.when(F.col("kind") == "dividend", F.struct(text, F.col("value").cast("string").alias("value"), F.when(day % 2 == 0, "USD").otherwise("EUR").alias("currency")))
    spl = F.when(F.col("kind") == "split", F.struct(text, F.when(day == 2, "2.0/0").otherwise(F.concat((F.col("value") * 3).cast("string"), F.lit("/3.000"))).alias("split")))
    return decoders.action_rows(a.groupBy("ticker").agg(F.to_json(F.collect_list(div)).alias("dividends"), F.to_json(F.collect_list(spl)).alias("splits")))


_HOLD = "WITH h AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 10 = 0 THEN 'CASH' ELSE 'S' || o_orderkey % 50 END AS symbol, (o_orderkey % 9)::DOUBLE + 0.5::DOUBLE AS quantity, 1000 + o_orderkey % 1000 + 0.5::DOUBLE AS value FROM orders)"


def _export(spark, d, header, line, footer):
    """One file a customer: a preamble, a header line, a line an order, a blank line and a footer."""
    g = _orders(spark, d).groupBy(F.col("o_custkey").alias("file")).agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("t"))
    return g.select(F.col("file").cast("string").alias("file"), F.concat(F.lit(f"Brokerage export\n\n{header}\n"), F.col("t"), F.lit(f"\n\n{footer}\n")).alias("text"))


def _holdings(spark, d):
    k = F.col("o_orderkey")
    symbol = F.when(k % 10 == 0, "FUND**").otherwise(F.concat(F.lit("S"), k % 50))
    line = F.concat(F.lit("Z"), F.col("o_custkey"), F.lit(","), symbol, F.lit(',"Made up, Inc.",'), k % 9, F.lit('.5,"$1,'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit('.50"'))
    return _export(spark, d, "Account Number,Symbol,Description,Quantity,Current Value", line, "Not an offer, see terms")


@query("src_25_positions", "", _HOLD + " SELECT substr(sha256('salt' || 'Z' || c), 1, 16) AS account, symbol, CASE WHEN symbol <> 'CASH' THEN sum(quantity) END AS quantity, sum(value) AS value FROM h GROUP BY c, symbol")
def _(spark, d):
    return decoders.positions(_holdings(spark, d), "salt")


@query("src_26_history", "", "SELECT o_custkey::VARCHAR AS file, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'YOU BOUGHT, CASH' ELSE 'DIVIDEND' END AS action, CASE WHEN o_orderkey % 7 <> 0 THEN 'S' || o_orderkey % 50 END AS symbol, (o_orderkey % 9)::DOUBLE AS quantity, -(o_orderkey % 1000 + 0.25::DOUBLE) AS amount FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    action = F.when(F.col("o_orderstatus") == "F", '"YOU BOUGHT, CASH"').otherwise("DIVIDEND")
    line = F.concat_ws(",", F.date_format("day", "MM/dd/yyyy"), action, F.when(k % 7 != 0, F.concat(F.lit("S"), k % 50)).otherwise(""), (k % 9).cast("string"), F.concat(F.lit("-$"), k % 1000, F.lit(".25")))
    return decoders.history(_export(spark, d, "Run Date,Action,Symbol,Quantity,Amount", line, "Date downloaded 01/02/2020"))


@query("src_27_block_rows", "", "SELECT o_custkey::VARCHAR AS file, count(*)::BIGINT AS lines, 5 AS least, 5 AS most FROM orders GROUP BY 1")
def _(spark, d):
    n = F.size("cells")
    return decoders.block_rows(_holdings(spark, d), "account number").groupBy("file").agg(F.count("*").alias("lines"), F.min(n).alias("least"), F.max(n).alias("most"))


# bundles

_DIG = "sum(('0x' || substr(md5({0}), 1, 15))::UBIGINT::HUGEINT)::VARCHAR"
_MAN = "man AS (SELECT o_custkey AS id, count(*)::BIGINT AS rows, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, " + _DIG.format("o_orderkey || '|' || CAST(o_orderdate AS DATE)::VARCHAR || '|' || o_orderstatus") + " AS digest FROM orders GROUP BY 1)"
_BUNDLE = ["o_orderkey", "date", "o_orderstatus"]


def _bundle(spark, d):
    return src.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderstatus")


@query("src_06_manifest", "", "WITH " + _MAN + " SELECT * FROM man")
def _(spark, d):
    return bundles.manifest_of(_bundle(spark, d), "id", _BUNDLE)


@query("dq_04_bundle_differences", "", "WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS least, max(CASE WHEN o_orderkey % 29 = 0 AND o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS changed FROM orders GROUP BY 1) SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 13 = 0 THEN 'unlisted' ELSE 'digest' END AS faults FROM o WHERE (id % 11 = 0) <> (id % 13 = 0) OR (id % 11 <> 0 AND id % 13 <> 0 AND changed = 1)")
def _(spark, d):
    b, i = _bundle(spark, d), F.col("id")
    found = b.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 29 == 0, "P").otherwise(F.col("o_orderstatus")))
    return bundles.differences(bundles.manifest_of(b.where(i % 13 != 0), "id", _BUNDLE), bundles.manifest_of(found.where(i % 11 != 0), "id", _BUNDLE), "id")


@query("src_08_resolved", "", "WITH m AS (SELECT o_custkey AS id, count(*) AS n, min('b/' || o_orderkey) AS path FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN path END AS path FROM customer LEFT JOIN m ON id = c_custkey")
def _(spark, d):
    m = src.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.concat(F.lit("b/"), F.col("o_orderkey")).alias("path"))
    return bundles.resolved(src.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), m, "id")
