"""Queries of the study tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import study as Y
from tidemark.sources.ticks import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
THRESHOLDS = {1996: 0.8, 1997: 0.85, 1998: 0.9}
COSTS = {"none": 0.0, "low": 1.25, "high": 2.5}
TRADES = "t AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice / 1000 - 150 AS r, o_custkey AS k FROM orders)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def trades(spark, sf_dir) -> DataFrame:
    """Orders as a stand-in for trades: symbol, ts, r (result), k."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000 - 150).alias("r"), F.col("o_custkey").alias("k"))


def days(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg((F.sum("r") + F.count("*") * 400).alias("equity"))


DAYS = f"{TRADES}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(r) + count(*) * 400 AS equity FROM t GROUP BY ALL)"


@query("""SELECT unnest(['event_id', 'value', 'props']) AS "column", unnest([avg(CASE WHEN event_id IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN value IS NULL OR isnan(value) THEN 1.0 ELSE 0 END), avg(CASE WHEN props IS NULL THEN 1.0 ELSE 0 END)]) AS share FROM events""")
def null_shares(spark, sf_dir):
    return Y.null_shares(table(spark, sf_dir, "events"), ["event_id", "value", "props"])


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return Y.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {TRADES} SELECT symbol, ts, round(r, 6) AS r, k FROM t WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1997-01-01'")
def time_slice(spark, sf_dir):
    return rounded(Y.time_slice(trades(spark, sf_dir), "ts", "1996-03-01", "1997-01-01"))


@query(f"WITH {TRADES} SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean FROM t WHERE year(ts) IN (1996, 1998) GROUP BY symbol")
def year_list(spark, sf_dir):
    return rounded(Y.of_years(trades(spark, sf_dir), "ts", [1996, 1998]).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean")))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def column_exclusion(spark, sf_dir):
    return Y.without(table(spark, sf_dir, "customer"), ["*nation*", "c_acct*"])


@query(f"WITH {TRADES}, s AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s FROM t WHERE year(ts) < 1998 GROUP BY symbol) SELECT symbol, ts, k, round(greatest(least((r - m) / s, 1.5), -1.5), 6) AS r FROM t JOIN s USING (symbol)")
def standardised_clipped(spark, sf_dir):
    return rounded(Y.standardised(trades(spark, sf_dir), ["r"], ["symbol"], F.year("ts") < 1998, 1.5)).select("symbol", "ts", "k", "r")


@query(f"WITH {TRADES} SELECT symbol, ts, k, round(CASE WHEN k % 3 = 0 THEN r END, 6) AS r FROM t")
def gate_masking(spark, sf_dir):
    return rounded(Y.gated(trades(spark, sf_dir), F.col("k") % 3 == 0, ["r"])).select("symbol", "ts", "k", "r")


@query(f"WITH {DAYS}, i AS (SELECT symbol, day FROM (SELECT DISTINCT symbol FROM d) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day)) SELECT symbol, day, round(equity, 6) AS equity FROM i LEFT JOIN d USING (symbol, day)")
def reindexed_days(spark, sf_dir):
    d = days(spark, sf_dir)
    index = d.select("symbol").distinct().withColumn("day", F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))))
    return rounded(Y.reindexed(d, index, ["symbol", "day"]), 6)


@query(f"WITH {DAYS} SELECT a.symbol, a.day, round(a.equity, 6) AS equity, round(b.equity, 6) AS r_equity FROM d a LEFT JOIN d b ON b.symbol = a.symbol AND b.day = a.day + 7")
def shifted_join(spark, sf_dir):
    d = days(spark, sf_dir)
    return rounded(Y.joined_later(d.withColumn("day", F.col("day").cast("timestamp_ntz")), d.withColumn("day", F.col("day").cast("timestamp_ntz")), ["symbol"], "day", "7 DAYS", ["equity"]).withColumn("day", F.col("day").cast("date")), 6)


@query(f"WITH {DAYS} SELECT day, round(a.equity, 6) AS urgent, round(b.equity, 6) AS low FROM (SELECT * FROM d WHERE symbol = '1-URGENT') a JOIN (SELECT * FROM d WHERE symbol = '5-LOW') b USING (day)")
def inner_align(spark, sf_dir):
    d = days(spark, sf_dir)
    one = lambda s, c: d.where(F.col("symbol") == s).select("day", F.col("equity").alias(c))
    return rounded(one("1-URGENT", "urgent").join(one("5-LOW", "low"), "day"), 6)


@query(f"WITH {TRADES} SELECT symbol, year(ts) AS year, count(*) AS n, CASE year(ts) WHEN 1996 THEN 0.8 WHEN 1997 THEN 0.85 WHEN 1998 THEN 0.9 ELSE 0.95 END::DOUBLE AS threshold FROM t GROUP BY ALL")
def year_thresholds(spark, sf_dir):
    n = trades(spark, sf_dir).groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return Y.looked_up(n, F.col("year").cast("int"), THRESHOLDS, "threshold", 0.95)


@query(f"WITH {TRADES}, c AS (SELECT unnest(['none', 'low', 'high']) AS scenario, unnest([0.0, 1.25, 2.5])::DOUBLE AS cost) SELECT symbol, scenario, count(*) AS n, round(avg(r - cost), 6) AS mean FROM t CROSS JOIN c GROUP BY ALL")
def cost_scenarios(spark, sf_dir):
    s = Y.scenarios(trades(spark, sf_dir), COSTS)
    return rounded(s.groupBy("symbol", "scenario").agg(F.count("*").alias("n"), F.avg(F.col("r") - F.col("cost")).alias("mean")))


@query(f"WITH {TRADES}, f AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS fold), p AS (SELECT fold, CASE WHEN year(ts) = fold THEN 'test' WHEN ts >= make_date(fold, 1, 1) - INTERVAL 90 DAYS THEN 'validation' ELSE 'train' END AS part, r FROM t JOIN f ON year(ts) <= fold) SELECT fold, part, count(*) AS n, round(sum(r), 6) AS total FROM p GROUP BY ALL")
def folds_expanding(spark, sf_dir):
    return rounded(Y.expanding_folds(trades(spark, sf_dir), "ts", 1996, 2001).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("r").alias("total")), 6)


@query(f"WITH {TRADES} SELECT CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 'dev' ELSE 'oos' END AS half, year(ts) % 2 = 0 AS even, count(*) AS n, round(avg(r), 6) AS mean FROM t GROUP BY ALL")
def dev_window(spark, sf_dir):
    return rounded(Y.halves(trades(spark, sf_dir), "ts", "1997-01-01").groupBy("half", "even").agg(F.count("*").alias("n"), F.avg("r").alias("mean")))


def _sums(period: str):
    def run(spark, sf_dir):
        return rounded(Y.period_sums(trades(spark, sf_dir), "ts", "r", ["symbol"], period), 6)

    QUERIES[f"{period}ly_sums"] = run
    ORACLES[f"{period}ly_sums"] = f"WITH {TRADES} SELECT symbol, CAST(date_trunc('{period}', ts) AS DATE) AS {period}, round(sum(r), 6) AS total, count(r) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM t GROUP BY ALL"


for _period in ("year", "month"):
    _sums(_period)


@query(f"WITH {TRADES} SELECT symbol, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS low, round(max(r), 6) AS high FROM t GROUP BY symbol")
def result_summary(spark, sf_dir):
    return rounded(Y.summary(trades(spark, sf_dir), "r", ["symbol"]))


@query("WITH g AS (SELECT l_partkey, sum(l_extendedprice) AS gain FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(gain, 2) AS gain, round(gain / (SELECT sum(gain) FROM g), 9) AS share FROM g ORDER BY g.gain DESC, l_partkey LIMIT 25")
def gain_shares(spark, sf_dir):
    return Y.shares(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", 25).select("l_partkey", F.round("gain", 2).alias("gain"), F.round("share", 9).alias("share"))


@query(f"WITH {TRADES}, q AS (SELECT symbol, quantile_cont(r, 0.9) AS q FROM t GROUP BY symbol) SELECT symbol, ts, k, round(r, 6) AS r FROM t JOIN q USING (symbol) WHERE r >= q")
def top_decile(spark, sf_dir):
    return rounded(Y.above_quantile(trades(spark, sf_dir), "r", 0.9, ["symbol"])).select("symbol", "ts", "k", "r")


@query(f"WITH {DAYS}, x AS (SELECT *, ln(equity / lag(equity) OVER (PARTITION BY symbol ORDER BY day)) AS lr FROM d) SELECT symbol, day, round(CASE WHEN count(lr) OVER w = 21 THEN stddev_samp(lr) OVER w * sqrt(252) END, 6) AS volatility FROM x WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")
def daily_volatility(spark, sf_dir):
    return rounded(Y.daily_volatility(days(spark, sf_dir), "equity", ["symbol"], "day").select("symbol", "day", "volatility"))


@query(f"WITH {DAYS}, x AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY day) - 1 AS dd FROM d), s AS (SELECT symbol, arg_min(equity, day) AS a, arg_max(equity, day) AS b, CAST(max(day) - min(day) AS INTEGER) AS days, min(dd) AS m FROM x GROUP BY symbol) SELECT symbol, days, round(pow(b / a, 365.0 / days) - 1, 6) AS cagr, round(m, 6) AS max_drawdown, round((pow(b / a, 365.0 / days) - 1) / abs(m), 6) AS mar FROM s")
def curve_statistics(spark, sf_dir):
    return rounded(Y.curve(days(spark, sf_dir), "equity", ["symbol"], "day"))


@query(f"WITH {TRADES}, y AS (SELECT symbol, year(ts) AS y, stddev_samp(r) AS drift, avg(r) AS score FROM t GROUP BY ALL) SELECT symbol, count(*) AS n, round(avg(drift), 6) AS drift, round(avg(score), 6) AS score, round(corr(drift, score), 6) AS correlation FROM y GROUP BY symbol")
def drift_correlation(spark, sf_dir):
    y = trades(spark, sf_dir).groupBy("symbol", F.year("ts").alias("y")).agg(F.stddev_samp("r").alias("drift"), F.avg("r").alias("score"))
    return rounded(Y.drift_against(y, "drift", "score", ["symbol"]))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def key_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
