"""Queries over the shared tables, one or more per operator, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import rff, subspace
from tidewright.operators import clean, grassmann, ipca, moments, nn, portfolio, ridge, rolling, series, summaries, universe
from tidewright.sources import synthetic
from tidewright.sources.panel import index_returns, market_month, predictions, read, read_signals, supplier_month

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINES = """
p0 AS (SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS rev, round(avg(l_quantity), 8) AS qty,
    round(avg(l_discount), 8) AS disc, round(avg(l_tax), 8) AS tax, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS mcap FROM lineitem GROUP BY 1, 2),
panel AS (SELECT *, rev / lag(rev) OVER s - 1 AS ret, round((ln(rev) - ln(lag(rev) OVER s)) / 10, 8) AS lret FROM p0 WINDOW s AS (PARTITION BY permno ORDER BY month)),
m0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS rev, round(avg(l_quantity), 8) AS qty, round(avg(l_discount), 8) AS disc,
    round(avg(l_tax), 8) AS tax, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS mcap, round(stddev_samp(l_quantity), 8) AS vol FROM lineitem GROUP BY 1),
market AS (SELECT *, round(rev / lag(rev) OVER (ORDER BY month) - 1, 8) AS returns FROM m0),
pred AS (SELECT permno, month, lret AS y_true, round(disc - 0.05, 8) AS y_pred FROM panel WHERE lret IS NOT NULL)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = (f"WITH {LINES}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {LINES} {sql}") if "lineitem" not in sql else sql
        return f

    return add


def rounded(df: DataFrame, n: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if kind == "double" and c not in skip else F.col(c) for c, kind in df.dtypes))


# Portfolios


def _quantile_sql(mean: str, where: str = "") -> str:
    cells = ", ".join(f"max(CASE WHEN portfolio = {i} THEN ret END) AS p{i}" for i in range(1, 6))
    outer = ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(1, 6))
    return f"""WITH b AS (SELECT month, lret, mcap, least(greatest(ceil(row_number() OVER (PARTITION BY month ORDER BY qty, permno) / count(*) OVER (PARTITION BY month) * 5), 1), 5) AS portfolio
        FROM panel WHERE lret IS NOT NULL AND qty IS NOT NULL), g AS (SELECT month, portfolio, {mean} AS ret FROM b {where} GROUP BY 1, 2), w AS (SELECT month, {cells} FROM g GROUP BY 1)
        SELECT month, {outer}, round(p5 - p1, 6) AS spread FROM w"""


@query(_quantile_sql("avg(lret)"))
def quantile_portfolios_ew(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.quantile_portfolios(supplier_month(spark, d), "qty", "lret", n=5)[1])


@query(_quantile_sql("sum(mcap * lret) / sum(mcap)", "WHERE mcap > 0"))
def quantile_portfolios_vw(spark, d):
    return rounded(portfolio.quantile_portfolios(supplier_month(spark, d), "qty", "lret", n=5, weight="mcap")[1])


@query("SELECT permno, month, y_true, y_pred, round(1.0 / count(*) OVER (PARTITION BY month), 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY y_pred DESC, permno) AS rn FROM pred WHERE y_pred > 0) WHERE rn <= 20")
def long_only_topn(spark, d):
    return rounded(portfolio.long_only(predictions(spark, d), 20), 8)


@query("SELECT permno, month, y_true, y_pred, round(1.0 / count(*) OVER (PARTITION BY month), 8) AS weight FROM pred WHERE y_pred > 0.001")
def long_only_all(spark, d):
    return rounded(portfolio.long_only(predictions(spark, d), None, 0.001), 8)


def _directional_sql(gross: str, weight: str) -> str:
    return f"""WITH g AS (SELECT permno, month, y_true, y_pred, sign(y_pred)::DOUBLE AS position, y_pred * y_true AS raw_signal_return, {gross} AS gross_signal FROM pred WHERE y_pred <> 0),
        w AS (SELECT *, {weight} AS weight FROM g WHERE gross_signal > 0)
        SELECT permno, month, y_true, y_pred, position, round(raw_signal_return, 8) AS raw_signal_return, round(raw_signal_return * 100, 8) AS raw_signal_return_pct, round(gross_signal, 8) AS gross_signal,
        round(weight, 8) AS weight, round(weight * y_true, 8) AS contribution, round(weight * y_true * 100, 8) AS contribution_pct FROM w"""


_ABS = "sum(abs(y_pred)) OVER (PARTITION BY month)"


@query(_directional_sql(_ABS, "y_pred / gross_signal"))
def directional_scaled(spark, d):
    return rounded(portfolio.directional(predictions(spark, d)), 8)


@query(_directional_sql(_ABS, "y_pred"))
def directional_raw(spark, d):
    return rounded(portfolio.directional(predictions(spark, d), normalize=False), 8)


@query(_directional_sql("sum(abs(sign(y_pred))) OVER (PARTITION BY month)::DOUBLE", "position / gross_signal * 2"))
def directional_sign(spark, d):
    return rounded(portfolio.directional(predictions(spark, d), weighting="equal_weight_sign", gross=2.0), 8)


_PORT = "WITH r AS (SELECT month, sum(y_pred * y_true) / sum(abs(y_pred)) AS ret FROM pred WHERE y_pred <> 0 GROUP BY 1)"


def _port(spark, d):
    return portfolio.portfolio_returns(portfolio.directional(predictions(spark, d)))


@query(f"{_PORT} SELECT month, round(ret, 8) AS ret FROM r")
def portfolio_monthly_returns(spark, d):
    return rounded(_port(spark, d), 8)


_CUM = "c AS (SELECT month, ret, product(1 + ret) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS cum FROM r), k AS (SELECT *, max(cum) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS peak FROM c)"


@query(f"{_PORT}, {_CUM} SELECT month, round(ret, 6) AS ret, round(cum, 6) AS cum, round(peak, 6) AS peak, round(cum / peak - 1, 6) AS drawdown FROM k")
def cumulative_curve(spark, d):
    return rounded(portfolio.cumulative(_port(spark, d)))


_PERF = "round(avg(ret) * 12, 6) AS ann_return, round(stddev_samp(ret) * sqrt(12), 6) AS ann_vol, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) END, 6) AS sharpe, round(min(cum / peak - 1), 6) AS max_drawdown, round(avg((ret > 0)::INT), 6) AS hit_rate"


@query(f"{_PORT}, {_CUM} SELECT {_PERF} FROM k")
def portfolio_performance(spark, d):
    return rounded(portfolio.performance(_port(spark, d)))


@query(f"""WITH s AS (SELECT permno, month, lret AS y_true, rff, round(disc - 0.05 + seed * (tax - 0.04) * rff, 8) AS y_pred FROM panel, (VALUES (1), (2), (3)) v(seed), (VALUES (1), (2)) x(rff) WHERE lret IS NOT NULL),
    e AS (SELECT permno, month, rff, min(y_true) AS y_true, avg(y_pred) AS y_pred FROM s GROUP BY ALL),
    r AS (SELECT rff, month, sum(y_pred * y_true) / sum(abs(y_pred)) AS ret FROM e WHERE y_pred <> 0 GROUP BY 1, 2),
    c AS (SELECT *, product(1 + ret) OVER (PARTITION BY rff ORDER BY month ROWS UNBOUNDED PRECEDING) AS cum FROM r), k AS (SELECT *, max(cum) OVER (PARTITION BY rff ORDER BY month ROWS UNBOUNDED PRECEDING) AS peak FROM c)
    SELECT rff, {_PERF} FROM k GROUP BY rff""")
def seed_ensemble_perf(spark, d):
    seeds = spark.range(1, 4).select(F.col("id").cast("int").alias("seed")).crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("rff")))  # six rows
    rows = supplier_month(spark, d).filter("lret is not null").crossJoin(F.broadcast(seeds))
    rows = rows.select("permno", "month", "rff", F.col("lret").alias("y_true"), F.round(F.col("disc") - 0.05 + F.col("seed") * (F.col("tax") - 0.04) * F.col("rff"), 8).alias("y_pred"))
    mean = portfolio.ensemble(rows, ["permno", "month", "rff"])
    gross = Window.partitionBy("rff", "month")
    port = mean.filter("y_pred <> 0").withColumn("weight", F.col("y_pred") / F.sum(F.abs("y_pred")).over(gross))
    return rounded(portfolio.performance(portfolio.portfolio_returns(port, ["rff", "month"]), by=["rff"]))


# Series


@query("""SELECT month, round(qty - disc, 6) AS dfy, round(ln(rev) - ln(mcap), 6) AS dp, round(ln(mcap) - ln(lag(rev) OVER (ORDER BY month)), 6) AS dy,
    CAST(replace(printf('%.2f', rev), ',', '') AS DOUBLE) AS prices, TRY_CAST('x' || n AS DOUBLE) AS broken, returns FROM market""")
def derived_predictors(spark, d):
    m = market_month(spark, d)
    return m.select(
        "month", F.round(F.col("qty") - F.col("disc"), 6).alias("dfy"), F.round(series.log_ratio(F.col("rev"), F.col("mcap")), 6).alias("dp"),
        F.round(series.log_ratio(F.col("mcap"), F.lag("rev").over(Window.orderBy("month"))), 6).alias("dy"), F.regexp_replace(F.format_number("rev", 2), ",", "").cast("double").alias("prices"),
        F.expr("try_cast('x' || n as double)").alias("broken"), "returns",
    )


@query("SELECT permno, month, round(ret, 6) AS ret FROM panel")
def pct_change_returns(spark, d):
    return supplier_month(spark, d).select("permno", "month", F.round(series.pct_change("rev", "month", ("permno",)), 6).alias("ret"))


@query("""SELECT month, round(z, 6) AS qty FROM (SELECT month, row_number() OVER (ORDER BY month) AS rn, CASE WHEN count(qty) OVER w >= 36 THEN (qty - avg(qty) OVER w) / stddev_samp(qty) OVER w END AS z
    FROM market WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)) WHERE rn > 36""")
def expanding_zscore(spark, d):
    return rounded(series.skip_first(series.zscore(market_month(spark, d).select("month", "qty"), ["qty"]), 36))


@query("SELECT month, round(CASE WHEN count(returns) OVER w = 12 THEN returns / stddev_samp(returns) OVER w END, 5) AS returns FROM market WINDOW w AS (ORDER BY month ROWS 11 PRECEDING)")
def rolling_vol_scale(spark, d):
    return rounded(series.volatility_scaled(market_month(spark, d).select("month", "returns"), ["returns"]), 5)


@query("""SELECT month, round(z, 6) AS qty, round(v, 5) AS returns FROM (SELECT month, row_number() OVER (ORDER BY month) AS rn, CASE WHEN count(qty) OVER w >= 36 THEN (qty - avg(qty) OVER w) / stddev_samp(qty) OVER w END AS z,
    CASE WHEN count(returns) OVER l = 12 THEN returns / stddev_samp(returns) OVER l END AS v FROM market WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING), l AS (ORDER BY month ROWS 11 PRECEDING)) WHERE rn > 36""")
def volatility_standardised(spark, d):
    rows = series.standardised(market_month(spark, d).select("month", "qty", "returns"), ["qty"], "returns")
    return rows.select("month", F.round("qty", 6).alias("qty"), F.round("returns", 5).alias("returns"))


_NBER = [(dt.date(1996, 3, 1), dt.date(1996, 9, 1)), (dt.date(1999, 1, 1), dt.date(1999, 6, 1))]


@query("""SELECT month, round(CASE WHEN count(returns) OVER w = 6 THEN avg(returns) OVER w END, 6) AS ma6, CASE WHEN month BETWEEN DATE '1996-03-01' AND DATE '1996-09-01' OR month BETWEEN DATE '1999-01-01' AND DATE '1999-06-01' THEN 1 ELSE 0 END AS recession
    FROM market WINDOW w AS (ORDER BY month ROWS 5 PRECEDING)""")
def forecast_ma6_recession(spark, d):
    rows = market_month(spark, d).select("month", series.rolling(F.avg, "returns", "month", 6, 6).alias("ma6"))
    return rounded(series.in_intervals(rows, spark.createDataFrame(_NBER, "peak date, trough date"), name="recession"))


_REG = "CASE WHEN vol >= 14.45 THEN 1 WHEN vol <= 14.35 THEN -1 ELSE 0 END"


@query(f"SELECT month, {_REG} AS regime, coalesce(lag({_REG}) OVER (ORDER BY month), 0) AS regime_lag FROM market")
def vol_regime_features(spark, d):
    r = market_month(spark, d).select("month", series.regime(F.col("vol"), 14.45, 14.35).alias("regime"))
    return r.withColumn("regime_lag", F.coalesce(F.lag("regime").over(Window.orderBy("month")), F.lit(0)))


@query(f"SELECT {_REG} AS regime, round(avg(returns), 6) AS mean, round(stddev_samp(returns), 6) AS sd, count(returns) AS n, round(avg(returns) / stddev_samp(returns), 5) AS ratio FROM market GROUP BY 1")
def regime_performance(spark, d):
    m = market_month(spark, d).withColumn("regime", series.regime(F.col("vol"), 14.45, 14.35))
    g = m.groupBy("regime").agg(F.avg("returns").alias("mean"), F.stddev_samp("returns").alias("sd"), F.count("returns").alias("n"))
    return g.select("regime", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", F.round(F.try_divide("mean", "sd"), 5).alias("ratio"))


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1) SELECT month, returns, price FROM market ASOF LEFT JOIN o ON market.month >= o.day")
def asof_vol_index(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return series.asof(market_month(spark, d).select("month", "returns"), o, "month", "day", "price")


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1) SELECT month, returns, price FROM market JOIN o ON market.month = o.day")
def exact_date_join(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return market_month(spark, d).select("month", "returns").join(o, "month")


# Cleaning

_HOLES = "SELECT permno, month, CASE WHEN (permno * 7 + year(month) * 12 + month(month)) % 11 = 0 THEN NULL ELSE qty END AS qty, CASE WHEN (permno + month(month)) % 10 < 7 THEN NULL ELSE disc END AS sparse, lret, rev, mcap, 1.0::DOUBLE AS flat FROM panel"


def _holes(spark, d):
    n = F.col("permno") * 7 + F.year("month") * 12 + F.month("month")
    return supplier_month(spark, d).select("permno", "month", F.when(n % 11 != 0, F.col("qty")).alias("qty"), F.when((F.col("permno") + F.month("month")) % 10 >= 7, F.col("disc")).alias("sparse"), "lret", "rev", "mcap", F.lit(1.0).alias("flat"))


@query(f"WITH h AS ({_HOLES}) SELECT round(avg((qty IS NULL)::INT), 8) AS qty, round(avg((sparse IS NULL)::INT), 8) AS sparse, round(avg((lret IS NULL)::INT), 8) AS lret FROM h")
def nan_share(spark, d):
    return rounded(clean.null_shares(_holes(spark, d), ["qty", "sparse", "lret"]), 8)


@query(f"WITH h AS ({_HOLES}) SELECT permno, month, round(coalesce(qty, 0) + coalesce(disc2, 0), 6) AS total, qty IS NOT NULL AND disc2 IS NOT NULL AND lret IS NOT NULL AS finite FROM (SELECT *, CASE WHEN permno % 4 > 0 THEN rev / 1000 END AS disc2 FROM h)")
def packed_rows(spark, d):
    """Characteristics as one array, with NaN, infinities and NULLs told by the mask; the array's sum stands for it here."""
    h = _holes(spark, d).withColumn("r", F.when(F.col("permno") % 4 > 0, F.col("rev") / 1000))
    rows = clean.packed_rows(h, ["qty", "r"], "lret")
    return rows.select("permno", "month", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), 6).alias("total"), "finite")


@query(f"WITH h AS ({_HOLES}) SELECT permno, month, qty, lret, rev, mcap, flat FROM h")
def nan_share_drop(spark, d):
    return clean.drop_sparse_columns(_holes(spark, d), 0.6, ("permno", "month"))


@query(f"WITH h AS ({_HOLES}), m AS (SELECT month, median(qty) AS q, median(sparse) AS s FROM h GROUP BY 1) SELECT permno, month, round(coalesce(qty, q, (SELECT median(qty) FROM h)), 6) AS qty, round(coalesce(sparse, s, (SELECT median(sparse) FROM h)), 6) AS sparse FROM h JOIN m USING (month)")
def fill_median_global(spark, d):
    return rounded(clean.fill_missing(_holes(spark, d).select("permno", "month", "qty", "sparse"), ["qty", "sparse"]))


@query(f"""WITH h AS ({_HOLES}), m AS (SELECT month, median(qty) AS q, median(sparse) AS s FROM h GROUP BY 1),
    g AS (SELECT *, median(q) OVER w AS gq, median(s) OVER w AS gs FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT permno, month, round(coalesce(qty, q, gq), 6) AS qty, round(coalesce(sparse, s, gs), 6) AS sparse FROM h JOIN g USING (month)""")
def fill_median_past_only(spark, d):
    return rounded(clean.fill_missing(_holes(spark, d).select("permno", "month", "qty", "sparse"), ["qty", "sparse"], past_only=True))


def _pairs_sql(f: str, name: str, columns: list[str], diagonal: bool) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i if diagonal else i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({f}({a}, {b}), 6) AS {name} FROM panel" for a, b in pairs)


@query(_pairs_sql("corr", "corr", ["qty", "disc", "tax", "lret"], False))
def corr_pairs(spark, d):
    return rounded(clean.correlations(supplier_month(spark, d), ["qty", "disc", "tax", "lret"]))


@query(_pairs_sql("covar_samp", "cov", ["qty", "disc", "tax", "lret"], True))
def cov_matrix(spark, d):
    return rounded(clean.covariances(supplier_month(spark, d), ["qty", "disc", "tax", "lret"]))


@query(f"WITH h AS ({_HOLES}), c AS (SELECT abs(corr(rev, mcap)) AS c FROM h) SELECT x FROM c, (VALUES ('qty'), ('lret'), ('rev'), ('mcap')) v(x) WHERE x NOT IN ('rev') OR c <= 0.98")
def flat_and_collinear_drop(spark, d):
    """rev and mcap are nearly collinear; rev goes (of equal NULL shares the higher mean correlation, else the first), and flat has no spread."""
    h = _holes(spark, d).withColumn("rev", F.when((F.col("permno") != 1) | F.col("rev").isNull(), F.col("rev")))
    kept = clean.drop_flat_and_collinear(h, ["qty", "lret", "rev", "mcap", "flat"])
    return spark.createDataFrame([(c,) for c in kept], "x string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS factor, round(abs(corr({c}, lret)), 6) AS strength, count(*) FILTER ({c} IS NOT NULL AND lret IS NOT NULL) AS n FROM panel" for c in ("qty", "disc", "tax", "n", "mcap")))
def factor_relevance(spark, d):
    p = supplier_month(spark, d).withColumn("n", F.col("n").cast("double"))
    return rounded(clean.factor_relevance(p, ["qty", "disc", "tax", "n", "mcap"], "lret"))


@query("""WITH t AS (SELECT permno FROM panel WHERE year(month) > (SELECT max(year(month)) FROM panel) - 3 GROUP BY 1 ORDER BY count(*) DESC, permno LIMIT 20),
    r AS (SELECT * FROM panel SEMI JOIN t USING (permno) WHERE year(month) > (SELECT max(year(month)) FROM panel) - 3),
    f AS (SELECT factor FROM (SELECT 'qty' AS factor, coalesce(abs(corr(qty, lret)), 0) AS s FROM r UNION ALL SELECT 'mcap', coalesce(abs(corr(mcap, lret)), 0) FROM r UNION ALL SELECT 'tax', coalesce(abs(corr(tax, lret)), 0) FROM r) ORDER BY s DESC, factor LIMIT 1)
    SELECT permno, month, lret, factor, CASE factor WHEN 'qty' THEN qty WHEN 'mcap' THEN mcap ELSE tax END AS value FROM r, f""")
def compact_subset(spark, d):
    s = clean.compact_subset(supplier_month(spark, d), ["qty", "mcap", "tax"], "lret", 1, 20, 3)
    return s.select("permno", "month", "lret", F.lit(s.columns[-1]).alias("factor"), F.col(s.columns[-1]).alias("value"))


@query("""WITH r AS (SELECT permno, month, lead(lret) OVER (PARTITION BY permno ORDER BY month) AS y, qty, disc FROM panel), k AS (SELECT * FROM r WHERE y IS NOT NULL)
    SELECT permno, month, y, qty, disc, dense_rank() OVER (ORDER BY permno) - 1 AS i_idx, dense_rank() OVER (ORDER BY month) - 1 AS t_idx FROM k""")
def model_panel(spark, d):
    return clean.model_panel(supplier_month(spark, d).select("permno", "month", "lret", "qty", "disc"), "lret")


@query("SELECT CASE WHEN month <= DATE '1999-12-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(month) AS first, max(month) AS last FROM panel GROUP BY 1")
def train_test_split(spark, d):
    parts = zip(("train", "test"), clean.split(supplier_month(spark, d), "1999-12-01"), strict=True)
    a, b = (p.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last")) for name, p in parts)
    return a.unionByName(b)


@query("""WITH t AS (SELECT * FROM panel WHERE month <= DATE '1999-12-01'), s AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(disc) AS md, stddev_pop(disc) AS sd FROM t),
    b AS (SELECT quantile_cont((qty - mq) / sq, 0.01) AS lq, quantile_cont((qty - mq) / sq, 0.99) AS hq, quantile_cont((disc - md) / sd, 0.01) AS ld, quantile_cont((disc - md) / sd, 0.99) AS hd FROM t, s)
    SELECT permno, month, round(least(greatest((qty - mq) / sq, lq), hq), 6) AS qty, round(least(greatest((disc - md) / sd, ld), hd), 6) AS disc FROM panel, s, b WHERE month > DATE '1999-12-01'""")
def normalize_clip(spark, d):
    train, test = clean.split(supplier_month(spark, d).select("permno", "month", "qty", "disc"), "1999-12-01")
    return rounded(clean.normalise(train, test, ["qty", "disc"])[1])


@query("""WITH r AS (SELECT permno, month, tax AS prc, n AS shrout, lret AS ret_adj FROM panel WHERE permno % 2 = 0)
    SELECT p.permno, p.month, p.qty, r.ret_adj AS ret, round(abs(prc) * shrout, 6) AS mcap FROM panel p LEFT JOIN r USING (permno, month)""")
def merge_mcap(spark, d):
    p = supplier_month(spark, d)
    r = p.filter("permno % 2 = 0").select("permno", "month", F.col("tax").alias("prc"), F.col("n").alias("shrout"), F.col("lret").alias("ret_adj"))
    return rounded(clean.merge_returns(p.select("permno", "month", "qty", "ret", "mcap"), r, "left"), skip=("ret", "qty"))


_SPELLS = "f AS (SELECT permno, min(month) AS first FROM panel GROUP BY 1), spells AS (SELECT permno, CAST(first + to_months((permno % 6)::INT) AS DATE) AS start, CASE WHEN permno % 3 = 0 THEN NULL ELSE CAST(first + to_months((permno % 6)::INT + 24) AS DATE) END AS ending FROM f)"


def _spells(panel):
    first = panel.groupBy("permno").agg(F.min("month").alias("first"))
    start = F.add_months("first", (F.col("permno") % 6).cast("int"))
    return first.select("permno", start.alias("start"), F.when(F.col("permno") % 3 != 0, F.add_months(start, 24)).alias("ending"))


@query(f"WITH {_SPELLS} SELECT p.permno, month, lret, start, ending FROM panel p JOIN spells s ON p.permno = s.permno AND month >= start AND (ending IS NULL OR month <= ending)")
def pit_membership_join(spark, d):
    p = supplier_month(spark, d).select("permno", "month", "lret")
    return clean.members(p, _spells(p))


@query("""WITH e AS (SELECT permno, max(month) AS month FROM panel WHERE permno % 5 = 0 GROUP BY 1), x AS (SELECT p.permno, p.month, -p.disc AS dlret FROM panel p JOIN e USING (permno, month))
    SELECT p.permno, p.month, lret, dlret, round(CASE WHEN lret IS NULL AND dlret IS NULL THEN NULL ELSE (1 + coalesce(lret, 0)) * (1 + coalesce(dlret, 0)) - 1 END, 8) AS ret_adj FROM panel p LEFT JOIN x USING (permno, month)""")
def delisting_returns(spark, d):
    p = supplier_month(spark, d)
    last = p.filter("permno % 5 = 0").groupBy("permno").agg(F.max_by("disc", "month").alias("disc"), F.max("month").alias("month"))
    rows = p.select("permno", "month", "lret").join(last.select("permno", "month", (-F.col("disc")).alias("dlret")), ["permno", "month"], "left")
    return rows.withColumn("ret_adj", F.round(clean.compound("lret", "dlret"), 8))


_MSF = "msf AS (SELECT permno, month AS date, lret AS ret, tax AS prc FROM panel)"


def _msf(spark, d):
    p = supplier_month(spark, d)
    last = p.filter("permno % 5 = 0").groupBy("permno").agg(F.max_by("disc", "month").alias("disc"), F.max("month").alias("dlstdt"))
    return p.select("permno", F.col("month").alias("date"), F.col("lret").alias("ret"), F.col("tax").alias("prc")), _spells(p), last.select("permno", "dlstdt", (-F.col("disc")).alias("dlret"))


@query(f"""WITH {_SPELLS}, {_MSF}, dl AS (SELECT permno, max(month) AS date, -max_by(disc, month) AS dlret FROM panel WHERE permno % 5 = 0 GROUP BY 1)
    SELECT msf.permno, msf.date, ret, prc, dlret, round(CASE WHEN ret IS NOT NULL OR dlret IS NOT NULL THEN (1 + coalesce(ret, 0)) * (1 + coalesce(dlret, 0)) - 1 END, 8) AS ret_adj, msf.date AS yyyymm
    FROM msf JOIN spells s ON msf.permno = s.permno AND msf.date >= s.start AND (s.ending IS NULL OR msf.date <= s.ending) LEFT JOIN dl ON dl.permno = msf.permno AND dl.date = msf.date
    WHERE msf.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def index_returns_adjusted(spark, d):
    """Returns of members, delistings compounded, between two dates."""
    r = index_returns(*_msf(spark, d), start="1996-01-01", end="1999-12-31")
    return r.withColumn("ret_adj", F.round("ret_adj", 8))


@query(f"WITH {_SPELLS}, {_MSF} SELECT msf.permno, msf.date, ret, prc, msf.date AS yyyymm FROM msf JOIN spells s ON msf.permno = s.permno AND msf.date >= s.start AND (s.ending IS NULL OR msf.date <= s.ending) WHERE msf.date >= DATE '1997-03-15'")
def index_returns_plain(spark, d):
    """The same without delistings and without an end."""
    returns, spells, _ = _msf(spark, d)
    return index_returns(returns, spells, start="1997-03-15")


@query("""SELECT permno, month AS yyyymm, qty FROM panel WHERE permno % 7 <> 0 AND NOT (permno % 3 = 1 AND month(month) = 2) AND month BETWEEN DATE '1995-06-01' AND DATE '2000-05-01'""")
def signal_panel(spark, d):
    """A panel with months as yyyymm, some without a key or with no month."""
    raw = supplier_month(spark, d).select(F.when(F.col("permno") % 7 != 0, F.col("permno")).alias("permno"), F.when((F.col("permno") % 3 == 1) & (F.month("month") == 2), "n/a").otherwise(F.date_format("month", "yyyyMM")).alias("yyyymm"), "qty")
    return read_signals(raw, "1995-06-01", "2000-05-15")


@query("SELECT permno, month, lret FROM panel SEMI JOIN (SELECT month FROM market WHERE returns > 0) USING (month)")
def semi_join_months(spark, d):
    return supplier_month(spark, d).select("permno", "month", "lret").join(market_month(spark, d).filter("returns > 0").select("month"), "month", "left_semi").select("permno", "month", "lret")


_NEXT = "n AS (SELECT month, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT month FROM panel))"


@query(f"WITH u AS (SELECT month, permno FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mcap DESC, permno) AS rn FROM panel) WHERE rn <= 10), {_NEXT}, v AS (SELECT next AS month, permno FROM u JOIN n USING (month)) SELECT permno, month, lret FROM panel SEMI JOIN v USING (month, permno)")
def universe_topn(spark, d):
    p = supplier_month(spark, d)
    return universe.within(p.select("permno", "month", "lret"), universe.previous_month(universe.by_market_cap(p, top_n=10), p)).select("permno", "month", "lret")


@query("""WITH c AS (SELECT month, permno, sum(n) OVER (PARTITION BY month ORDER BY n DESC, permno ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY month) AS total FROM panel)
    SELECT month, permno FROM c WHERE before / total < 0.5""")
def universe_share(spark, d):
    return universe.by_market_cap(supplier_month(spark, d).withColumn("cap", F.col("n").cast("double")), "cap", top_share=0.5)


@query("WITH s AS (SELECT DISTINCT month FROM panel) SELECT a.month AS test_month, b.month FROM s a JOIN s b ON b.month >= a.month - INTERVAL 6 MONTH AND b.month < a.month")
def rolling_train_windows(spark, d):
    return rolling.training_windows(supplier_month(spark, d), 6)


@query("SELECT permno % 3 AS g, count(lret) AS n, round(avg(lret), 6) AS mean, round(stddev_samp(lret), 6) AS sd, min(lret) AS lo, round(quantile_cont(lret, 0.25), 6) AS q1, round(quantile_cont(lret, 0.5), 6) AS q2, round(quantile_cont(lret, 0.75), 6) AS q3, max(lret) AS hi FROM panel GROUP BY 1")
def describe_profile(spark, d):
    return rounded(summaries.describe(supplier_month(spark, d).withColumn("g", F.col("permno") % 3), "lret", ["g"]), 6, skip=("lo", "hi"))


@query("SELECT o.o_orderpriority AS priority, c.c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o JOIN customer c ON c_custkey = o_custkey GROUP BY ALL")
def orders_by_segment(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Moments and factor models

_Z = "z AS (SELECT month, lret AS y, qty - 25 AS a, (disc - 0.05) * 100 AS b, permno FROM panel WHERE lret IS NOT NULL)"


def _z(spark, d):
    return supplier_month(spark, d).filter("lret is not null").select("permno", "month", F.col("lret").alias("y"), (F.col("qty") - 25).alias("a"), ((F.col("disc") - 0.05) * 100).alias("b"))


@query(f"WITH {_Z} SELECT month, count(*) AS n, round(sum(y), 6) AS sy, round(sum(y * y), 6) AS yy, round(sum(a * y), 5) AS ay, round(sum(b * y), 5) AS \"by\", round(sum(a * a), 4) AS aa, round(sum(a * b), 4) AS ab, round(sum(b * b), 4) AS bb FROM z GROUP BY 1")
def month_moments(spark, d):
    m = moments.month_moments(_z(spark, d), ["a", "b"])
    return m.select("month", "n", F.round("sy", 6).alias("sy"), F.round("yy", 6).alias("yy"), *(F.round(F.col("b")[i], 5).alias(x) for i, x in enumerate(("ay", "by"))), *(F.round(F.col("a")[i], 4).alias(x) for i, x in enumerate(("aa", "ab", "bb"))))


@query(f"WITH {_Z} SELECT month, count(*) AS n, round(avg(a * y), 10) AS qa, round(avg(b * y), 10) AS qb, round(avg(a * a), 9) AS waa, round(avg(a * b), 9) AS wab, round(avg(b * b), 9) AS wbb FROM z GROUP BY 1")
def managed_portfolios(spark, d):
    m = moments.managed_portfolios(_z(spark, d), ["a", "b"])
    return m.select("month", "n", *(F.round(F.col("q")[i], 10).alias(x) for i, x in enumerate(("qa", "qb"))), *(F.round(F.col("w")[i], 9).alias(x) for i, x in enumerate(("waa", "wab", "wbb"))))


_G = (0.6, 0.8)
_W2 = [float(v) for v in rff.frequencies(2, 1, 0.2, 4)[:, 0]]
_FSTEP = f"{_Z}, f AS (SELECT month, sum(({_G[0]} * a + {_G[1]} * b) * y) / sum(({_G[0]} * a + {_G[1]} * b) ** 2) AS f FROM z GROUP BY 1)"


@query(f"WITH {_FSTEP} SELECT month, round(f, 8) AS factor FROM f")
def ipca_factor_step_k1(spark, d):
    m = moments.collect(moments.month_moments(_z(spark, d), ["a", "b"]), 2)
    f = ipca.factor_step(np.array(_G)[:, None], m)[0]
    return spark.createDataFrame([(t, round(float(v), 8)) for t, v in zip(m.months, f, strict=True)], "month date, factor double")


@query(f"""WITH {_FSTEP}, s AS (SELECT sum(f * f * a * a) AS aa, sum(f * f * a * b) AS ab, sum(f * f * b * b) AS bb, sum(f * a * y) AS ay, sum(f * b * y) AS bys FROM z JOIN f USING (month))
    SELECT round((bb * ay - ab * bys) / (aa * bb - ab * ab), 6) AS ga, round((aa * bys - ab * ay) / (aa * bb - ab * ab), 6) AS gb FROM s""")
def ipca_gamma_step_k1(spark, d):
    m = moments.collect(moments.month_moments(_z(spark, d), ["a", "b"]), 2)
    g = ipca.gamma_step(ipca.factor_step(np.array(_G)[:, None], m), m)[:, 0]
    return spark.createDataFrame([(round(float(g[0]), 6), round(float(g[1]), 6))], "ga double, gb double")


@query(f"WITH {_FSTEP} SELECT permno, month, round(({_G[0]} * a + {_G[1]} * b) * (SELECT avg(f) FROM f), 8) AS y_pred FROM z")
def ipca_predict_mean_factor(spark, d):
    z = _z(spark, d)
    m = moments.collect(moments.month_moments(z, ["a", "b"]), 2)
    gamma = np.array(_G)[:, None]
    model = ipca.Model(gamma, ipca.factor_step(gamma, m), m.months, free=1)
    return ipca.predict(z, ["a", "b"], model).select("permno", "month", F.round("y_pred", 8).alias("y_pred"))


@query("SELECT round(1 - sum((y_true - y_pred) ** 2) / sum(y_true ** 2), 6) AS zero, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS mean FROM pred")
def oos_r2(spark, d):
    p = predictions(spark, d)
    return portfolio.oos_r2(p).select(F.round("r2", 6).alias("zero")).crossJoin(portfolio.oos_r2(p, benchmark="mean").select(F.round("r2", 6).alias("mean")))  # one row each


@query("SELECT month, round(CASE WHEN sum(y_true ** 2) > 0 THEN 1 - sum((y_true - y_pred) ** 2) / sum(y_true ** 2) END, 6) AS r2 FROM pred GROUP BY 1")
def monthly_oos_r2(spark, d):
    return rounded(portfolio.oos_r2(predictions(spark, d), by=["month"]))


@query(f"WITH {_Z} SELECT permno, month, y, round(sin({_W2[0]!r} * a + {_W2[1]!r} * b), 8) + 0.0 AS f_000, round(cos({_W2[0]!r} * a + {_W2[1]!r} * b), 8) + 0.0 AS f_001, 1.0::DOUBLE AS const FROM z")
def rff_panel_features(spark, d):
    return rounded(rff.with_intercept(rff.expand_panel(_z(spark, d), ["a", "b"], 0.2, 1, 4)), 8)


@query(f"""WITH {_Z}, u AS (SELECT month, permno FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mcap DESC, permno) AS rn FROM panel) WHERE rn <= 10),
    n AS (SELECT month, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT month FROM panel)), v AS (SELECT next AS month, permno FROM u JOIN n USING (month) WHERE next IS NOT NULL),
    t AS (SELECT v.month AS test_month, z.* FROM v JOIN z ON z.permno = v.permno AND z.month >= v.month - INTERVAL 12 MONTH AND z.month < v.month)
    SELECT test_month, month, count(*) AS n, round(sum(a * y), 5) AS ay, round(sum(b * y), 5) AS "by", round(sum(a * b), 4) AS ab FROM t GROUP BY 1, 2""")
def universe_window_moments(spark, d):
    p = supplier_month(spark, d)
    chosen = universe.previous_month(universe.by_market_cap(p, top_n=10), p)
    m = rolling.universe_moments(_z(spark, d), ["a", "b"], "y", chosen, 12)
    return m.select("test_month", "month", "n", F.round(F.col("b")[0], 5).alias("ay"), F.round(F.col("b")[1], 5).alias("by"), F.round(F.col("a")[1], 4).alias("ab"))


# Timing backtests

_RIDGE1 = """x AS (SELECT month, qty - 25 AS x, returns AS y FROM market WHERE returns IS NOT NULL),
    r AS (SELECT month, x, y, sum(x * y) OVER w / (sum(x * x) OVER w + 1000.0 * 12) AS beta, count(*) OVER w AS k FROM x WINDOW w AS (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
    t AS (SELECT month, abs(beta) AS coefficient_norm, x * beta AS forecast, x * beta * y AS timing_return, y AS market_return FROM r WHERE k = 12)"""


def _x(spark, d):
    return market_month(spark, d).filter("returns is not null").select("month", (F.col("qty") - 25).alias("x"), ((F.col("disc") - 0.05) * 100).alias("v"), F.col("returns").alias("y"))


@query(f"WITH {_RIDGE1} SELECT month, round(coefficient_norm, 9) AS coefficient_norm, round(forecast, 9) AS forecast, round(timing_return, 9) AS timing_return, market_return FROM t")
def ridge_p1(spark, d):
    return rounded(ridge.rolling_ridge(_x(spark, d), ["x"], "y"), 9)


_RIDGE2 = """s AS (SELECT month, y, u, v, sum(u * u) OVER w + {a} AS uu, sum(u * v) OVER w AS uv, sum(v * v) OVER w + {a} AS vv, sum(u * y) OVER w AS uy, sum(v * y) OVER w AS vy, count(*) OVER w AS k FROM x
    WINDOW w AS ({p}ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), b AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS bu, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS bv FROM s WHERE k = 12)"""


@query(f"""WITH x AS (SELECT month, qty - 25 AS u, (disc - 0.05) * 100 AS v, returns AS y FROM market WHERE returns IS NOT NULL), {_RIDGE2.format(a="120.0", p="")}
    SELECT month, round(sqrt(bu * bu + bv * bv), 8) AS coefficient_norm, round(u * bu + v * bv, 8) AS forecast, round((u * bu + v * bv) * y, 8) AS timing_return, y AS market_return FROM b""")
def ridge_p2(spark, d):
    return rounded(ridge.rolling_ridge(_x(spark, d), ["x", "v"], "y", penalty=10.0), 8)


_OMEGA = [float(v) for v in rff.frequencies(2, 1, 0.5, 1)[:, 0]]


@query(f"""WITH o AS (SELECT month, {_OMEGA[0]!r} * (qty - 25) + {_OMEGA[1]!r} * ((disc - 0.05) * 100) AS angle, returns AS y FROM market WHERE returns IS NOT NULL), x AS (SELECT month, y, sin(angle) AS u, cos(angle) AS v FROM o), {_RIDGE2.format(a="12.0", p="")}
    SELECT month, round(sqrt(bu * bu + bv * bv), 8) AS coefficient_norm, round(u * bu + v * bv, 8) AS forecast FROM b""")
def rff_p2_ridge(spark, d):
    rows = _x(spark, d).withColumn("f", rff.rff(["x", "v"], 0.5, 1, 1)).select("month", "y", F.col("f")[0].alias("u"), F.col("f")[1].alias("w"))
    return rounded(ridge.rolling_ridge(rows, ["u", "w"], "y", penalty=1.0).select("month", "coefficient_norm", "forecast"), 8)


_METRICS = """SELECT {k}round(avg(coefficient_norm), 6) AS beta_norm_mean, round(avg(market_return) * 12 / (stddev_samp(market_return) * sqrt(12)), 6) AS market_sharpe, round(avg(timing_return) * 12, 6) AS expected_return,
    round(stddev_samp(timing_return) * sqrt(12), 6) AS volatility, round(1 - sum((market_return - forecast) ** 2) / (var_pop(market_return) * count(*)), 6) AS r2, round(avg(timing_return) * 12 / (stddev_samp(timing_return) * sqrt(12)), 5) AS sr,
    round((avg(timing_return) - avg(market_return) * regr_slope(timing_return, market_return)) * 12 / (stddev_samp(timing_return) * sqrt(12)), 5) AS ir, round(regr_intercept(timing_return, market_return), 6) AS alpha,
    round(coalesce(count(*) FILTER (forecast > 0 AND market_return > 0) / nullif(count(*) FILTER (forecast > 0), 0), 0), 6) AS "precision", round(coalesce(count(*) FILTER (forecast > 0 AND market_return > 0) / nullif(count(*) FILTER (market_return > 0), 0), 0), 6) AS recall,
    round(avg(((forecast > 0) = (market_return > 0))::INT), 6) AS accuracy FROM {t}"""


@query(f"WITH {_RIDGE1} {_METRICS.format(k='', t='t')}")
def timing_metrics(spark, d):
    m = portfolio.timing_metrics(ridge.rolling_ridge(_x(spark, d), ["x"], "y"))
    return m.select(*(F.round(c, 5 if c in ("sr", "ir") else 6).alias(c) for c in m.columns))


@query(f"""WITH x AS (SELECT z, month, qty - 25 AS u, (disc - 0.05) * 100 AS v, returns AS y FROM market, (VALUES (0.01::DOUBLE), (1.0::DOUBLE), (100.0::DOUBLE)) g(z) WHERE returns IS NOT NULL), {_RIDGE2.format(a="z * 12", p="PARTITION BY z ").replace("SELECT month, y, u, v,", "SELECT z, month, y, u, v,")},
    t AS (SELECT z, avg((u * bu + v * bv) * y) / stddev_samp((u * bu + v * bv) * y) * sqrt(12) AS sr FROM b GROUP BY 1) SELECT round(max(sr), 5) AS best_sr FROM t""")
def ridge_baseline_grid(spark, d):
    rows = ridge.penalty_grid(_x(spark, d), ["x", "v"], "y", [0.01, 1.0, 100.0])
    return portfolio.timing_metrics(rows, by=["z"]).agg(F.round(F.max("sr"), 5).alias("best_sr"))


def _sweep_sql() -> str:
    cells = []
    for g in (0.5, 2.0):
        for s in (1, 2, 3):
            a, b = (float(v) for v in rff.frequencies(2, 1, g, s)[:, 0])
            cells.append(f"({g}::DOUBLE, {s}, {a!r}::DOUBLE, {b!r}::DOUBLE)")
    return f"""WITH c(gamma, seed, wa, wb) AS (VALUES {', '.join(cells)}), o AS (SELECT gamma, seed, z, month, wa * (qty - 25) + wb * ((disc - 0.05) * 100) AS angle, returns AS y FROM market, c, (VALUES (1.0::DOUBLE), (1000.0::DOUBLE)) g(z) WHERE returns IS NOT NULL),
        x AS (SELECT gamma, seed, z, month, y, sin(angle) AS u, cos(angle) AS v FROM o), {_RIDGE2.format(a="z * 12", p="PARTITION BY gamma, seed, z ").replace("SELECT month, y, u, v,", "SELECT gamma, seed, z, month, y, u, v,")},
        t AS (SELECT gamma, seed, z, avg((u * bu + v * bv) * y) * 12 AS er, sqrt(avg(sqrt(bu * bu + bv * bv)) ** 2) AS norm FROM b GROUP BY ALL)
        SELECT gamma, z, round(log10(z), 6) AS log_z, round(avg(er), 7) AS expected_return, round(avg(norm), 7) AS beta_norm_mean FROM t GROUP BY 1, 2"""


@query(_sweep_sql())
def sweep_p2_summary(spark, d):
    runs = ridge.sweep(ridge.grid(spark, [0.5, 2.0], [2], [1.0, 1000.0], [1, 2, 3]), _x(spark, d), ["x", "v"], "y")
    m = portfolio.timing_metrics(runs, by=["gamma", "p", "z", "seed"])
    return m.groupBy("gamma", "z").agg(F.avg("expected_return").alias("e"), F.avg("beta_norm_mean").alias("b")).select("gamma", "z", F.round(F.log10("z"), 6).alias("log_z"), F.round("e", 7).alias("expected_return"), F.round("b", 7).alias("beta_norm_mean"))


@query(f"WITH g AS ({_sweep_sql().rstrip()}) SELECT expected_return, beta_norm_mean FROM g WHERE gamma = 2.0 AND z = 1000.0".replace("SELECT gamma, z, round(log10(z), 6) AS log_z, round(avg(er), 7)", "SELECT gamma, z, round(max(er), 7)").replace("round(avg(norm), 7)", "round(max(norm), 7)"))
def sweep_point_best(spark, d):
    """The best run of one point of the grid."""
    runs = ridge.sweep(ridge.grid(spark, [0.5, 2.0], [2], [1.0, 1000.0], [1, 2, 3]), _x(spark, d), ["x", "v"], "y")
    m = portfolio.timing_metrics(runs, by=["gamma", "p", "z", "seed"])
    return rounded(portfolio.best_at(m, {"gamma": 2.0, "z": 1000.0}, ["expected_return", "beta_norm_mean"]), 7)


_DUP = 300


@query(f"""WITH x AS (SELECT month, qty - 25 AS u, (disc - 0.05) * 100 AS v, returns AS y FROM market WHERE returns IS NOT NULL), {_RIDGE2.format(a=f"(1000.0 * 12 / {_DUP})", p="")}
    SELECT month, round(sqrt((bu * bu + bv * bv) / {_DUP}), 9) AS coefficient_norm, round(u * bu + v * bv, 8) AS forecast FROM b""")
def ridge_dual_duplicates(spark, d):
    """600 features on 12 rows, two of them 300 times: as those two with a 300th of the penalty."""
    return ridge.rolling_ridge(_x(spark, d), ["x", "v"] * _DUP, "y", penalty=1000.0).select("month", F.round("coefficient_norm", 9).alias("coefficient_norm"), F.round("forecast", 8).alias("forecast"))


@query(f"WITH {_RIDGE1} {_METRICS.format(k='', t='(SELECT * REPLACE (NULL::DOUBLE AS coefficient_norm) FROM t)')}".replace(" AS accuracy FROM", " AS accuracy, round(1 - sum((market_return - forecast) ** 2) / (var_pop(market_return) * count(*)), 6) AS performance FROM"))
def nn_metrics(spark, d):
    """The metrics of a neural backtest, over the forecasts of ridge_p1."""
    m = portfolio.nn_metrics(ridge.rolling_ridge(_x(spark, d), ["x"], "y"))
    return m.select(*(F.round(c, 5 if c in ("sr", "ir") else 6).alias(c) for c in m.columns))


@query("SELECT dropout::DOUBLE AS dropout, layers, \"window\", width FROM (VALUES (0.1), (0.25), (0.5), (1.0)) a(dropout), (VALUES (1), (2), (4), (8)) b(layers), (VALUES (12), (36), (60)) c(\"window\"), (VALUES (32), (64), (128)) d(width)")
def nn_grid_configs(spark, d):
    return nn.config_grid(spark)


@query()
def rff_dual_ridge_large(spark, d):
    """P = 12,000 features on 12 rows: the dual never forms them."""
    return rounded(ridge.sweep(ridge.grid(spark, [2.0], [12_000], [1000.0], [1, 2]), _x(spark, d), ["x", "v"], "y"))


@query()
def nn_backtest(spark, d):
    configs = spark.createDataFrame([(w, 1, 0.1, 36, 15, 1, a, 16, 2e-3) for w, a in ((8, "tanh"), (16, "gelu"))], "width int, layers int, dropout double, window int, epochs int, seed int, act string, batch int, rate double")
    rows = nn.rolling_nn(configs, series.zscore(_x(spark, d), ["x", "v"], least=12), ["x", "v"], "y")
    return portfolio.nn_metrics(rows, by=["width", "act"])


@query("SELECT l_linenumber AS layers, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS r, printf('T=%d, L=%d', l_linenumber, count(*)) AS label FROM lineitem GROUP BY 1")
def nn_grid_pivot(spark, d):
    """Pivoted means with labels, as of a results grid."""
    rows = read(spark, d, "lineitem")
    wide = rows.groupBy(F.col("l_linenumber").alias("layers")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount"))
    n = rows.groupBy(F.col("l_linenumber").alias("layers")).count()
    return wide.join(n, "layers").select("layers", *(F.round(c, 6).alias(c.lower()) for c in "ANR"), F.format_string("T=%d, L=%d", "layers", "count").alias("label"))


@query("""WITH h AS (SELECT lret, (SELECT min(lret) FROM panel) AS lo, (SELECT max(lret) FROM panel) AS hi FROM panel WHERE lret IS NOT NULL)
    SELECT least(floor((lret - lo) / (hi - lo) * 3), 2)::INT + 1 AS bin, count(*) AS n, round(min(lret), 6) AS lo, round(max(lret), 6) AS hi FROM h GROUP BY 1""")
def hist_stats(spark, d):
    return rounded(summaries.histogram(supplier_month(spark, d), "lret", 3))


@query("""WITH q AS (SELECT permno % 3 AS g, quantile_cont(lret, 0.25) AS q1, quantile_cont(lret, 0.5) AS q2, quantile_cont(lret, 0.75) AS q3 FROM panel GROUP BY 1),
    r AS (SELECT g, q1, q2, q3, lret, lret BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM panel JOIN q ON g = permno % 3 WHERE lret IS NOT NULL)
    SELECT g, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(lret) FILTER (inside), 6) AS low, round(max(lret) FILTER (inside), 6) AS high, count(*) FILTER (NOT inside) AS n_out FROM r GROUP BY ALL""")
def box_stats(spark, d):
    return rounded(summaries.box(supplier_month(spark, d).withColumn("g", F.col("permno") % 3), "lret", ["g"]))


@query("""WITH v AS (SELECT returns::DOUBLE AS v FROM market WHERE returns IS NOT NULL), s AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h, min(v) AS lo, max(v) AS hi FROM v),
    x AS (SELECT lo - h + i * (hi - lo + 2 * h) / 19 AS x, h, n FROM s, range(20) r(i)) SELECT round(x, 6) AS x, round(sum(exp(-(((x - v) / h) ** 2) / 2) / sqrt(2 * pi()) / h) / n, 6) AS density FROM x, v GROUP BY x, n""")
def density_curve(spark, d):
    return rounded(summaries.density(market_month(spark, d), "returns", 20))


@query("""WITH k AS (SELECT year(month) AS year, returns, row_number() OVER (PARTITION BY year(month) ORDER BY month) - 1 AS rn, count(*) OVER (PARTITION BY year(month)) AS n FROM market WHERE returns IS NOT NULL),
    p AS (SELECT year, d, i, ('0x' || substr(md5('7:' || d || ':' || i), 1, 12))::BIGINT % n AS pick FROM (SELECT DISTINCT year, n FROM k), range(200) a(d), range(12) b(i) WHERE i < n),
    m AS (SELECT p.year, d, avg(returns) AS m FROM p JOIN k ON k.year = p.year AND k.rn = p.pick GROUP BY 1, 2),
    q AS (SELECT year, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
    SELECT k.year, count(*) AS n, round(avg(returns), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM k JOIN q ON q.year = k.year GROUP BY 1""")
def bootstrap_interval(spark, d):
    m = market_month(spark, d).filter("returns is not null").withColumn("year", F.year("month"))
    return rounded(summaries.bootstrap_mean(m, "returns", "month", ["year"], draws=200, seed=7))


# Subspaces

_F2 = "q AS (SELECT qty - 25 AS a, (disc - 0.05) * 1000 AS b FROM market), c AS (SELECT avg(a * a) AS a, avg(a * b) AS b, avg(b * b) AS c FROM q), e AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS x, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS y FROM c)"


@query(f"WITH {_F2} SELECT round(exp(-(x / (x + y) * ln(x / (x + y)) + y / (x + y) * ln(y / (x + y)))), 6) AS erank, round(y / x, 6) AS gap_ratio FROM e")
def erank_gap_k2(spark, d):
    rows = market_month(spark, d).orderBy("month").select(F.col("qty") - 25, (F.col("disc") - 0.05) * 1000).collect()  # a row per month
    _, rank, gap = subspace.factor_covariance(np.array([tuple(r) for r in rows]).T)
    return spark.createDataFrame([(round(rank, 6), round(gap, 6))], "erank double, gap_ratio double")


_ANGLE = "g AS (SELECT month, qty - 25 AS a, (disc - 0.05) * 1000 AS b FROM market), h AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM g WINDOW w AS (ORDER BY month)), t AS (SELECT month, CASE WHEN pa IS NOT NULL THEN acos(least(abs(a * pa + b * pb) / sqrt((a * a + b * b) * (pa * pa + pb * pb)), 1)) END AS angle FROM h)"


def _directions(spark, d):
    """(month, direction) of the monthly series; a row per month."""
    rows = market_month(spark, d).orderBy("month").select("month", F.col("qty") - 25, (F.col("disc") - 0.05) * 1000).collect()
    return [(r[0], np.array([[r[1]], [r[2]]])) for r in rows]


@query(f"WITH {_ANGLE} SELECT month, round(angle, 6) AS geodesic, round(sin(angle), 6) AS chordal, round(sqrt(2) * sin(angle), 6) AS projection, round(sqrt(2) * sin(angle) / sqrt(2 * 1 * (2 - 1) / 3.0), 6) AS normalised FROM t WHERE angle IS NOT NULL")
def angle_k1(spark, d):
    g = _directions(spark, d)
    rows = [(t, *(subspace.distance(a, b, x) for x in ("geodesic", "chordal", "projection")), subspace.distance(a, b, "projection") / subspace.random_baseline(2, 1)) for (_, a), (t, b) in zip(g, g[1:], strict=False)]
    return spark.createDataFrame([(t, *(round(v, 6) for v in x)) for t, *x in rows], "month date, geodesic double, chordal double, projection double, normalised double")


@query(f"WITH {_ANGLE} SELECT month, round(sqrt(2) * (sin(angle) - lag(sin(angle)) OVER (ORDER BY month)), 6) AS geodesic_acceleration FROM t")
def diag_acceleration(spark, d):
    g = _directions(spark, d)
    notes = rolling.diagnostics([(x, np.ones((1, 2))) for _, x in g])
    return spark.createDataFrame([(t, round(r["geodesic_acceleration"], 6) if "geodesic_acceleration" in r else None) for (t, _), r in zip(g, notes, strict=True)], "month date, geodesic_acceleration double")


@query("WITH o AS (SELECT month, returns AS f FROM market WHERE month(month) % 2 = 0) SELECT m.month, round(coalesce(o.f, (SELECT avg(f) FROM o)), 8) AS factor FROM market m LEFT JOIN o USING (month)")
def warm_factor_alignment(spark, d):
    rows = market_month(spark, d).orderBy("month").select("month", "returns").collect()  # a row per month
    old = [(t, f) for t, f in rows if t.month % 2 == 0]
    found = rolling.align_warm_factors(np.array([[f for _, f in old]], dtype=float), [t for t, _ in old], [t for t, _ in rows])[0]
    return spark.createDataFrame([(t, round(float(f), 8)) for (t, _), f in zip(rows, found, strict=True)], "month date, factor double")


# One factor and one iteration have a closed form


def _step_sql(train: str, alpha: str = "1.0") -> str:
    """Loadings g -> (ga, gb, f) after one iteration from the start by singular vectors, of training rows tr(g, month, y, a, b)."""
    return f"""tr AS ({train}), q AS (SELECT g, month, avg(a * y) AS qa, avg(b * y) AS qb FROM tr GROUP BY ALL), c AS (SELECT g, sum(qa * qa) AS aa, sum(qa * qb) AS ab, sum(qb * qb) AS bb FROM q GROUP BY g),
        e AS (SELECT g, ab AS va, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) - aa AS vb FROM c), v AS (SELECT g, va / sqrt(va * va + vb * vb) AS va, vb / sqrt(va * va + vb * vb) AS vb FROM e),
        f AS (SELECT g, month, sum((va * a + vb * b) * y) / sum((va * a + vb * b) ** 2) AS f FROM tr JOIN v USING (g) GROUP BY ALL),
        s AS (SELECT g, sum(f * f * a * a) + {alpha} AS aa, sum(f * f * a * b) AS ab, sum(f * f * b * b) + {alpha} AS bb, sum(f * a * y) AS ay, sum(f * b * y) AS bys FROM tr JOIN f USING (g, month) GROUP BY g),
        w AS (SELECT g, (bb * ay - ab * bys) / (aa * bb - ab * ab) * m AS ga, (aa * bys - ab * ay) / (aa * bb - ab * ab) * m AS gb FROM s JOIN (SELECT g, avg(f) AS m FROM f GROUP BY g) USING (g))"""


_TESTS = "t AS (SELECT month AS g FROM (SELECT month, row_number() OVER (ORDER BY month) AS rn FROM (SELECT DISTINCT month FROM z)) WHERE rn > 12)"
_BEFORE = "SELECT g, month, y, a, b FROM t JOIN z ON z.month < g"


@query(f"WITH {_Z}, {_TESTS}, {_step_sql(_BEFORE)} SELECT permno, month, y AS y_true, round(ga * a + gb * b, 7) + 0.0 AS y_pred, CAST(month - INTERVAL 1 MONTH AS DATE) AS train_end FROM z JOIN w ON w.g = z.month")
def ipca_rolling_k1(spark, d):
    """Refits of one iteration each, in tasks."""
    pred, _ = rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=1, min_obs=1, max_iter=0, warm_start=False)
    return pred.select("permno", "month", "y_true", (F.round("y_pred", 7) + 0.0).alias("y_pred"), "train_end")


@query(f"""WITH {_Z}, {_TESTS}, m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM z WHERE month < (SELECT min(g) FROM t)),
    n AS (SELECT permno, month, y, (a - ma) / sa AS a, (b - mb) / sb AS b FROM z, m), {_step_sql(_BEFORE.replace("JOIN z ON z.", "JOIN n ON n."))} SELECT permno, month, round(ga * a + gb * b, 7) + 0.0 AS y_pred FROM n JOIN w ON w.g = n.month""")
def ipca_rolling_frozen_k1(spark, d):
    """The same on characteristics scaled by the first window's mean and deviation."""
    pred, _ = rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=1, min_obs=1, max_iter=0, warm_start=False, normalize="frozen")
    return pred.select("permno", "month", (F.round("y_pred", 7) + 0.0).alias("y_pred"))


@query(f"""WITH {_Z}, {_TESTS}, {_NEXT}, u AS (SELECT next AS g, permno FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mcap DESC, permno) AS rn FROM panel) JOIN n USING (month) WHERE rn <= 10),
    {_step_sql("SELECT u.g, z.month, y, a, b FROM u JOIN t USING (g) JOIN z ON z.permno = u.permno AND z.month < u.g AND z.month >= u.g - INTERVAL 24 MONTH")}
    SELECT z.permno, z.month, round(ga * a + gb * b, 7) + 0.0 AS y_pred FROM z JOIN u ON u.g = z.month AND u.permno = z.permno JOIN w ON w.g = z.month""")
def ipca_rolling_universe_k1(spark, d):
    """The same within the ten largest of the month before, over two years."""
    p = supplier_month(spark, d)
    chosen = universe.previous_month(universe.by_market_cap(p, top_n=10), p)
    pred, _ = rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=1, window=24, min_obs=1, max_iter=0, warm_start=False, universe=chosen)
    return pred.select("permno", "month", (F.round("y_pred", 7) + 0.0).alias("y_pred"))


@query(f"""WITH {_Z}, p(alpha) AS (VALUES (0.01::DOUBLE), (1.0::DOUBLE), (100.0::DOUBLE)), k AS (SELECT DISTINCT permno % 5 AS fold FROM z), {_step_sql("SELECT alpha * 10 + fold AS g, month, y, a, b FROM z, p, k WHERE permno % 5 <> fold", "(SELECT max(alpha) FROM p WHERE alpha * 10 <= g + 1e-9)")}
    SELECT alpha, round(sum((y - (ga * a + gb * b)) ** 2) / count(*), 9) AS mse FROM z, p JOIN w ON true WHERE w.g = alpha * 10 + permno % 5 GROUP BY 1""")
def ipca_cv_k1(spark, d):
    """Cross-validation error over five folds of entities, an iteration each."""
    z = _z(spark, d).withColumn("fold", (F.col("permno") % 5).cast("int"))
    rows = moments.month_moments(z, ["a", "b"], by=("fold",))
    folds = {k: moments.collect(rows.filter(F.col("fold") == k).drop("fold"), 2) for k in range(5)}
    found = ipca.fit_path({k: v for k, v in folds.items() if len(v.n)}, [0.01, 1.0, 100.0], n_factors=1, max_iter=0)
    return spark.createDataFrame([(a, round(float(e), 9)) for a, e in found], "alpha double, mse double")


@query(f"""WITH {_FSTEP}, s AS (SELECT sum(f * f * a * a) AS aa, sum(f * f * a * b) AS ab, sum(f * f * b * b) AS bb, sum(f * a * y) AS ay, sum(f * b * y) AS bys FROM z JOIN f USING (month)),
    g AS (SELECT (bb * ay - ab * bys) / (aa * bb - ab * ab) AS ga, (aa * bys - ab * ay) / (aa * bb - ab * ab) AS gb FROM s), g1 AS (SELECT ga / sqrt(ga * ga + gb * gb) AS ga, gb / sqrt(ga * ga + gb * gb) AS gb FROM g),
    f1 AS (SELECT month, sum((ga * a + gb * b) * y) / sum((ga * a + gb * b) ** 2) AS f FROM z, g1 GROUP BY 1),
    s1 AS (SELECT sum(f * f * a * a) AS aa, sum(f * f * a * b) AS ab, sum(f * f * b * b) AS bb, sum(f * a * y) AS ay, sum(f * b * y) AS bys FROM z JOIN f1 USING (month)),
    g2 AS (SELECT (bb * ay - ab * bys) / (aa * bb - ab * ab) AS ga, (aa * bys - ab * ay) / (aa * bb - ab * ab) AS gb FROM s1), n AS (SELECT sqrt(ga * ga + gb * gb) * sign((SELECT avg(f) FROM f1)) AS n FROM g2)
    SELECT round(ga / n, 6) AS ga, round(gb / n, 6) AS gb, round((ga / n) ** 2, 6) AS statistic FROM g2, n""")
def ipca_two_steps_k1(spark, d):
    """Loadings after two iterations from given ones, and the statistic of the test of the first characteristic."""
    m = moments.collect(moments.month_moments(_z(spark, d), ["a", "b"]), 2)
    model = ipca.fit(m, 1, max_iter=1, tol=0.0, warm=np.array(_G)[:, None])
    stat, _, _ = ipca.test_characteristic(spark, model, 0, draws=2, tasks=1, max_iter=1)
    return spark.createDataFrame([(*(round(float(v), 6) for v in model.gamma[:, 0]), round(stat, 6))], "ga double, gb double, statistic double")


@query(f"""WITH {_Z}, w AS (SELECT month, y, {_G[0]} * a + {_G[1]} * b AS x FROM z), m AS (SELECT month, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM w GROUP BY 1),
    r AS (SELECT *, xy / (xx + 0.5) AS beta FROM m) SELECT round(sum(yy - 2 * beta * xy + beta * beta * xx) / count(*), 7) AS loss FROM r""")
def grassmann_loss_k1(spark, d):
    """The manifold estimator's loss at given loadings."""
    m = moments.collect(moments.month_moments(_z(spark, d), ["a", "b"]), 2)
    return spark.createDataFrame([(round(grassmann.loss_and_gradient(np.array(_G)[:, None], m, 0.5)[0], 7),)], "loss double")


@query()
def ipca_rff_rolling(spark, d):
    """Rolling refits on 24 random features of the ten largest, warm-started, with the diagnostics' rank beside."""
    p = supplier_month(spark, d)
    chosen = universe.previous_month(universe.by_market_cap(p, top_n=10), p)
    return rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=2, window=36, min_obs=60, alpha=100.0, max_iter=50, normalize="rolling", universe=chosen, rff={"n": 24, "gamma": 0.25})[0]


# Estimators without SQL; their values are tested against numpy and known truth


def _panel(spark):
    return synthetic.factor_panel(spark, T=30, N=40, m=4, k=2, seed=3)



@query()
def synthetic_panel(spark, d):
    return _panel(spark)


@query()
def ipca_als_rolling(spark, d):
    z = _z(spark, d)
    return rolling.rolling_factors(z, ["a", "b"], n_factors=1, min_obs=50)[0]


@query()
def ipca_als_diagnostics(spark, d):
    return rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=1, min_obs=50, normalize="rolling")[1]


@query()
def grassmann_rolling(spark, d):
    return rolling.rolling_factors(_z(spark, d), ["a", "b"], n_factors=1, min_obs=50, estimator="grassmann", max_iter=200)[0]


@query()
def ipca_cv_path(spark, d):
    z = _z(spark, d).withColumn("fold", (F.col("permno") % 5).cast("int"))
    rows = moments.month_moments(z, ["a", "b"], by=("fold",))
    folds = {k: moments.collect(rows.filter(F.col("fold") == k).drop("fold"), 2) for k in range(5)}
    found = ipca.fit_path({k: v for k, v in folds.items() if len(v.n)}, [0.01, 1.0, 100.0], n_factors=1, max_iter=200)
    return spark.createDataFrame([(a, float(e)) for a, e in found], "alpha double, mse double")


@query()
def ipca_bootstrap(spark, d):
    m = moments.collect(moments.month_moments(_z(spark, d), ["a", "b"]), 2)
    stat, p, _ = ipca.bootstrap(spark, ipca.fit(m, 1, max_iter=200), row=0, tasks=8)
    return spark.createDataFrame([(stat, p)], "statistic double, p_value double")
