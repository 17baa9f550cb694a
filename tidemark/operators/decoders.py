"""Rows from vendors' bodies: nested JSON, parallel arrays, tables inside a text.

Each decoder takes a frame with one body per row (a page, a file), so bodies are decoded in parallel; a body is
bounded by its endpoint's page.  A body that is null or does not parse gives no rows and is listed by ``undecodable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.orders import NEW_YORK

BARS = "bars array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>"
FILINGS = "filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>>>"
FACTS = "facts map<string,map<string,struct<units:map<string,array<struct<`end`:string,val:double,filed:string,form:string>>>>>>"
MAPPING = "array<struct<data:array<struct<figi:string,ticker:string>>,warning:string,error:string>>"
OBSERVATIONS = "observations array<struct<realtime_start:string,realtime_end:string,date:string,value:string>>"
DIVIDENDS = "array<struct<date:string,value:string,currency:string>>"
SPLITS = "array<struct<date:string,split:string>>"


def undecodable(pages: DataFrame, schema: str, part: str) -> DataFrame:
    """Pages whose body has no ``part``."""
    return pages.where(F.from_json("body", schema)[part].isNull())


def bar_rows(pages: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Bars of pages (ticker, body) whose session had closed (16:00 New York) by the cut-off; ``fault`` marks dates that
    come twice for a ticker and dates that are no session."""
    b = pages.select("ticker", F.explode(F.from_json("body", BARS)["bars"]).alias("b"))
    rows = b.select("ticker", F.col("b.t").try_cast("date").alias("date"), *[F.col(f"b.{n[0]}").alias(n) for n in ("open", "high", "low", "close", "volume")])
    closed = F.to_utc_timestamp(F.col("date").cast("timestamp") + F.expr("INTERVAL 16 HOURS"), NEW_YORK)
    rows = rows.where(closed <= cutoff).withColumn("_n", F.count("*").over(Window.partitionBy("ticker", "date")))
    rows = rows.join(F.broadcast(sessions.select("date", F.lit(True).alias("_open"))), "date", "left")  # a calendar is a bounded table
    return rows.withColumn("fault", F.when(F.col("_n") > 1, "repeated").when(F.col("_open").isNull(), "no_session")).drop("_n", "_open")


def filing_rows(pages: DataFrame) -> DataFrame:
    """Filings of pages (cik, body) from parallel arrays; acceptance is a New York wall clock, returned in UTC."""
    recent = F.from_json("body", FILINGS)["filings"]["recent"]
    zipped = F.arrays_zip(*[recent[n].alias(n) for n in ("accessionNumber", "form", "filingDate", "acceptanceDateTime")])
    f = pages.select("cik", F.explode(zipped).alias("f"))
    accepted = F.to_utc_timestamp(F.col("f.acceptanceDateTime").try_cast("timestamp_ntz").cast("timestamp"), NEW_YORK)
    return f.select("cik", F.col("f.accessionNumber").alias("accession"), "f.form", F.col("f.filingDate").try_cast("date").alias("filed"), accepted.alias("accepted"))


def fact_rows(pages: DataFrame) -> DataFrame:
    """Facts of pages (cik, body): taxonomy, concept and unit are keys of nested objects."""
    f = pages.select("cik", F.explode(F.from_json("body", FACTS)["facts"]).alias("taxonomy", "v"))
    f = f.select("cik", "taxonomy", F.explode("v").alias("concept", "v")).select("cik", "taxonomy", "concept", F.explode("v.units").alias("unit", "v"))
    f = f.select("cik", "taxonomy", "concept", "unit", F.explode("v").alias("v"))
    return f.select("cik", "taxonomy", "concept", "unit", F.col("v.end").try_cast("date").alias("period_end"), F.col("v.val").alias("value"), F.col("v.filed").try_cast("date").alias("filed"), "v.form")


def mapping_rows(batches: DataFrame) -> DataFrame:
    """One row per hit of each job in batches (jobs, body); a job without a hit is one row with its status (missing: the
    body has no answer for it)."""
    pairs = F.arrays_zip(F.col("jobs").alias("job"), F.from_json("body", MAPPING).alias("answer"))
    p = batches.select(F.explode(pairs).alias("p")).select("p.job", "p.answer")
    status = F.when(F.col("answer.error").isNotNull(), "error").when(F.col("answer.warning").isNotNull(), "not_found").when(F.size("answer.data") > 0, "found").otherwise("missing")
    return p.select("job", status.alias("status"), F.explode_outer("answer.data").alias("d")).select("job", "status", "d.figi", "d.ticker")


def observation_rows(pages: DataFrame) -> DataFrame:
    """Vintages of pages (series, body); a value '.', or one that is no number, is missing."""
    o = pages.select("series", F.explode(F.from_json("body", OBSERVATIONS)["observations"]).alias("o"))
    dates = [F.col(f"o.{n}").try_cast("date").alias(n) for n in ("date", "realtime_start", "realtime_end")]
    return o.select("series", *dates, F.col("o.value").try_cast("double").alias("value"))


def action_rows(pages: DataFrame) -> DataFrame:
    """Actions of pages (ticker, dividends, splits): a split 'new/old' is a ratio; a dividend has a basis only in USD."""
    d = pages.select("ticker", F.explode(F.from_json("dividends", DIVIDENDS)).alias("a"))
    d = d.select("ticker", F.col("a.date").try_cast("date").alias("date"), F.lit("dividend").alias("kind"), F.col("a.value").try_cast("double").alias("value"), F.when(F.col("a.currency") == "USD", "as_paid").alias("basis"))
    s = pages.select("ticker", F.explode(F.from_json("splits", SPLITS)).alias("a"))
    new, old = [F.get(F.split("a.split", "/"), i).try_cast("double") for i in (0, 1)]
    return d.unionByName(s.select("ticker", F.col("a.date").try_cast("date").alias("date"), F.lit("split").alias("kind"), F.try_divide(new, old).alias("value"), F.lit(None).cast("string").alias("basis")))


def factor_rows(files: DataFrame) -> DataFrame:
    """Monthly factors of files (dataset, text): the first run of lines 'yyyymm,percent,...' under its header line.

    Values become fractions, -99.99 and -999 are missing, and a month is labelled by its last day.
    """
    lines = F.split("text", "\r?\n")
    monthly = lambda x: x.rlike(r"^\s*[0-9]{6}\s*,")
    f = files.select("dataset", lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", monthly), F.lit(True)).cast("int")).where("at > 0")
    f = f.withColumn("rest", F.slice("lines", F.col("at"), F.size("lines")))
    f = f.withColumn("stop", F.array_position(F.transform("rest", monthly), F.lit(False)).cast("int"))
    block = F.when(F.col("stop") > 0, F.slice("rest", F.lit(1), F.col("stop") - 1)).otherwise(F.col("rest"))
    rows = f.select("dataset", F.split(F.get("lines", F.col("at") - 2), ",").alias("names"), F.explode(block).alias("line")).withColumn("cells", F.split("line", ","))
    rows = rows.select("dataset", "names", F.trim(F.get("cells", F.lit(0))).alias("month"), F.posexplode("cells").alias("i", "x")).where("i > 0")
    value = F.trim("x").try_cast("double")
    percent = F.when(~value.isin(-99.99, -999.0), value)
    return rows.select("dataset", F.last_day(F.expr("try_to_timestamp(concat(month, '01'), 'yyyyMMdd')").cast("date")).alias("month_end"), F.trim(F.get("names", F.col("i"))).alias("factor"), (percent / 100).alias("value"))


def block_rows(files: DataFrame, first_header: str) -> DataFrame:
    """Lines of the block whose header begins with ``first_header`` (any case), up to a blank line or the end, of files
    (file, text): (file, header, cells), with header names in lower case.  A quoted cell may hold commas."""
    names = F.transform("lines", lambda x: F.lower(F.ltrim(x)).startswith(first_header.lower()))
    f = files.select("file", F.split("text", "\r?\n").alias("lines")).withColumn("at", F.array_position(names, F.lit(True)).cast("int")).where("at > 0")
    f = f.withColumn("rest", F.slice("lines", F.col("at") + 1, F.size("lines"))).withColumn("stop", F.array_position(F.transform("rest", lambda x: F.trim(x) == ""), F.lit(True)).cast("int"))
    block = F.when(F.col("stop") > 0, F.slice("rest", F.lit(1), F.col("stop") - 1)).otherwise(F.col("rest"))
    return f.select("file", _cells(F.lower(F.get("lines", F.col("at") - 1))).alias("header"), F.explode(block).alias("line")).select("file", "header", _cells(F.col("line")).alias("cells"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.regexp_replace(x, '"', "")))


def cell(name: str) -> Column:
    """The cell under a header name; null where the block has no such column or the line is too short."""
    return F.nullif(F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1), F.lit(""))


def money(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("decimal(18,2)")


def positions(files: DataFrame, salt: str) -> DataFrame:
    """Positions by account of holdings exports; sweep funds (marked '**') become one CASH row an account.  Accounts are
    replaced by a salted digest."""
    account = F.sha2(F.concat(F.lit(salt), cell("account number")), 256).substr(1, 16)
    symbol = cell("symbol")
    rows = block_rows(files, "account number").where(symbol.isNotNull())
    rows = rows.select(account.alias("account"), F.when(symbol.endswith("**"), "CASH").otherwise(symbol).alias("symbol"), cell("quantity").try_cast("decimal(18,4)").alias("quantity"), money(cell("current value")).alias("value"))
    return rows.groupBy("account", "symbol").agg(F.when(F.col("symbol") != "CASH", F.sum("quantity").cast("double")).alias("quantity"), F.sum("value").cast("double").alias("value"))


def history(files: DataFrame) -> DataFrame:
    """Activity lines of history exports, dated MM/dd/yyyy; lines without a date are footers."""
    day = F.expr("try_to_timestamp(get(cells, cast(array_position(header, 'run date') as int) - 1), 'MM/dd/yyyy')").cast("date")
    rows = block_rows(files, "run date").withColumn("date", day).where("date IS NOT NULL")
    return rows.select("file", "date", cell("action").alias("action"), cell("symbol").alias("symbol"), cell("quantity").try_cast("double").alias("quantity"), money(cell("amount")).cast("double").alias("amount"))
