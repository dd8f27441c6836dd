"""Portfolios from scores: quantile sorts, long-only and directional books, their monthly returns and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.schema import require_columns


def month_share(rows: DataFrame, score: str, month: str = "month", id: str = "permno", tasks: int = 1) -> DataFrame:
    """rows with __share: the rank by score within the month, ties broken by id, over the month's count.

    tasks: parts that a month is cut into by its score's approximate quantiles, for months too large for a task; parts are
    ranked apart and shifted by the counts of lower parts, so the ranks are the same.
    """
    if tasks == 1:
        by = Window.partitionBy(month)
        return rows.withColumn("__share", F.row_number().over(by.orderBy(score, id)) / F.count("*").over(by))
    spark, steps = rows.sparkSession, [i / tasks for i in range(1, tasks)]
    found = rows.groupBy(month).agg(F.percentile_approx(score, F.array(*map(F.lit, steps)), 100 * tasks).cast("array<double>").alias("cuts")).collect()
    # a row of `tasks` numbers per month, the same for both uses below
    cuts = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in found], f"__m {rows.schema[month].dataType.simpleString()}, cuts array<double>"))
    part = F.size(F.filter("cuts", lambda c: c < F.col(score)))
    dealt = rows.join(cuts, rows[month] == F.col("__m")).withColumn("__part", part).drop("cuts")
    counts = dealt.groupBy("__m", "__part").agg(F.count("*").alias("__k"))
    whole = Window.partitionBy("__m")
    shift = counts.select(F.col("__m").alias("__month"), F.col("__part").alias("__p"), F.sum("__k").over(whole).alias("__n"), (F.sum("__k").over(whole.orderBy("__part")) - F.col("__k")).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__m", "__part").orderBy(score, id))
    ranked = dealt.withColumn("__own", own).join(F.broadcast(shift), (F.col("__m") == F.col("__month")) & (F.col("__part") == F.col("__p")))
    return ranked.select(*(F.col(f"`{c}`") for c in rows.columns), ((F.col("__own") + F.col("__shift")) / F.col("__n")).alias("__share"))


def quantile_portfolios(
    data: DataFrame, score: str, ret: str, month: str = "month", id: str = "permno", n: int = 10, weight: str | None = None, tasks: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(long, wide): mean returns of n score buckets per month, and a column per bucket with the spread of last and first.

    bucket = clip(ceil(rank / count * n), 1, n), ties in the score broken by id. One exchange on the month, or on the parts
    of a month that `tasks` asks for.
    """
    require_columns(data, [score, ret, month, id, *([weight] if weight else [])])
    if n < 2:
        raise ValueError("at least two portfolios")
    rows = data.dropna(subset=[score, ret, month])
    rows = month_share(rows, score, month, id, tasks)
    rows = rows.withColumn("portfolio", F.least(F.greatest(F.ceil(F.col("__share") * n), F.lit(1)), F.lit(n)).cast("int")).drop("__share")
    if weight:
        rows = rows.filter(F.col(weight) > 0)
        mean = F.sum(F.col(weight) * F.col(ret)) / F.sum(weight)
    else:
        mean = F.avg(ret)
    long = rows.groupBy(month, "portfolio").agg(mean.alias("ret"))
    cells = [F.max(F.when(F.col("portfolio") == i, F.col("ret"))).alias(f"p{i}") for i in range(1, n + 1)]
    wide = long.groupBy(month).agg(*cells).withColumn("spread", F.col(f"p{n}") - F.col("p1"))
    return long, wide


def long_only(pred: DataFrame, top_n: int | None = None, threshold: float = 0.0, month: str = "month", id: str = "permno", score: str = "y_pred") -> DataFrame:
    """Equal weights on predictions over a threshold, of each month's best top_n if given."""
    require_columns(pred, [month, id, score])
    rows = pred.filter(F.col(score) > threshold)
    if top_n is not None:
        best = Window.partitionBy(month).orderBy(F.col(score).desc(), id)
        rows = rows.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= top_n).drop("__rn")
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(month)))


def directional(
    pred: DataFrame, month: str = "month", score: str = "y_pred", ret: str = "y_true", weighting: str = "prediction_scaled",
    normalize: bool = True, gross: float = 1.0, drop_zero: bool = True,
) -> DataFrame:
    """Long-short book by sign of the prediction, weights by prediction or equal, with contributions."""
    require_columns(pred, [month, score, ret])
    if weighting not in ("prediction_scaled", "equal_weight_sign"):
        raise ValueError("weighting must be prediction_scaled or equal_weight_sign")
    if gross <= 0:
        raise ValueError("gross exposure must be positive")
    rows = pred.dropna(subset=[month, score, ret]).withColumn("position", F.signum(score))
    if drop_zero:
        rows = rows.filter("position <> 0")
    by = Window.partitionBy(month)
    rows = rows.withColumn("raw_signal_return", F.col(score) * F.col(ret)).withColumn("raw_signal_return_pct", F.col("raw_signal_return") * 100)
    if weighting == "equal_weight_sign":
        rows = rows.withColumn("gross_signal", F.sum(F.abs("position")).over(by)).filter("gross_signal > 0")
        weight = F.col("position") / F.col("gross_signal") * gross
    else:
        rows = rows.withColumn("gross_signal", F.sum(F.abs(score)).over(by)).filter("gross_signal > 0")
        weight = F.col(score) / F.col("gross_signal") * gross if normalize else F.col(score)
    rows = rows.withColumn("weight", weight)
    return rows.withColumn("contribution", F.col("weight") * F.col(ret)).withColumn("contribution_pct", F.col("contribution") * 100)


def portfolio_returns(port: DataFrame, by: list[str] | None = None, ret: str = "y_true") -> DataFrame:
    return port.groupBy(*(by or ["month"])).agg(F.sum(F.col("weight") * F.col(ret)).alias("ret"))


def cumulative(monthly: DataFrame, month: str = "month", ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """monthly with cum = product of 1 + ret, its running maximum from the first value on, and the drawdown."""
    upto = Window.partitionBy(*(by or [])).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    rows = monthly.withColumn("cum", F.product(1 + F.col(ret)).over(upto))
    rows = rows.withColumn("peak", F.max("cum").over(upto))
    return rows.withColumn("drawdown", F.try_divide("cum", "peak") - 1)


def performance(monthly: DataFrame, month: str = "month", ret: str = "ret", annual: int = 12, by: list[str] | None = None) -> DataFrame:
    """Annual return, volatility and Sharpe ratio (NULL without volatility), largest drawdown and hit rate, a row per group."""
    sd = F.stddev_samp(ret)
    return cumulative(monthly, month, ret, by).groupBy(*(by or [])).agg(
        (F.avg(ret) * annual).alias("ann_return"), (sd * annual**0.5).alias("ann_vol"),
        F.when(sd > 0, F.avg(ret) * annual / (sd * annual**0.5)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )


def ensemble(pred: DataFrame, keys: list[str], score: str = "y_pred", truth: str = "y_true") -> DataFrame:
    """Mean prediction over seeds; n_truths over 1 tells of seeds that disagree on what happened."""
    return pred.groupBy(*keys).agg(F.min(truth).alias(truth), F.avg(score).alias(score), F.countDistinct(truth).alias("n_truths"))


def timing_metrics(results: DataFrame, annual: int = 12, by: list[str] | None = None) -> DataFrame:
    """Metrics of a timing backtest with forecast, timing_return, market_return and coefficient_norm."""
    r = results.dropna(subset=["forecast", "timing_return", "market_return"])
    f, s, m = F.col("forecast"), F.col("timing_return"), F.col("market_return")
    count = lambda c: F.sum(c.cast("double"))
    up, said = m > 0, f > 0
    a = r.groupBy(*(by or [])).agg(
        F.avg("coefficient_norm").alias("beta_norm_mean"), F.avg(m).alias("mm"), F.stddev_samp(m).alias("sm"), F.avg(s).alias("ms"), F.stddev_samp(s).alias("ss"),
        F.regr_slope(s, m).alias("beta"), F.regr_intercept(s, m).alias("alpha"), F.sum((m - f) * (m - f)).alias("res"), (F.var_pop(m) * F.count(m)).alias("tot"),
        count(said & up).alias("tp"), count(said & ~up).alias("fp"), count(~said & up).alias("fn"), count(said == up).alias("right"), F.count("*").alias("n"),
    )
    q = annual**0.5
    kept = [F.col(c) for c in by or []]
    return a.select(
        *kept, "beta_norm_mean", F.try_divide(F.col("mm") * annual, F.col("sm") * q).alias("market_sharpe"), (F.col("ms") * annual).alias("expected_return"),
        (F.col("ss") * q).alias("volatility"), (1 - F.try_divide("res", "tot")).alias("r2"), F.try_divide(F.col("ms") * annual, F.col("ss") * q).alias("sr"),
        F.try_divide((F.col("ms") - F.col("mm") * F.col("beta")) * annual, F.col("ss") * q).alias("ir"), "alpha",
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"), F.try_divide(F.col("right"), F.col("n").cast("double")).alias("accuracy"),
    )


def nn_metrics(results: DataFrame, annual: int = 12, by: list[str] | None = None) -> DataFrame:
    """timing_metrics() of a neural backtest, which has no coefficients, with the R2 once more as `performance`."""
    return timing_metrics(results.withColumn("coefficient_norm", F.lit(None).cast("double")), annual, by).withColumn("performance", F.col("r2"))


def best_at(metrics: DataFrame, point: dict[str, float], columns: list[str]) -> DataFrame:
    """The largest of each of `columns` at one point of a grid; the point's numbers are compared exactly."""
    here = metrics
    for name, value in point.items():
        here = here.filter(F.col(name) == F.lit(value))
    return here.agg(*(F.max(c).alias(c) for c in columns))


def oos_r2(pred: DataFrame, truth: str = "y_true", score: str = "y_pred", benchmark: str = "zero", by: list[str] | None = None) -> DataFrame:
    """Out-of-sample R2 against zero or the mean, pooled or per group; NULL without variation."""
    if benchmark not in ("zero", "mean"):
        raise ValueError("benchmark must be zero or mean")
    y, p = F.col(truth), F.col(score)
    rows = pred.dropna(subset=[truth, score])
    total = F.sum(y * y) if benchmark == "zero" else F.var_pop(y) * F.count(y)
    a = rows.groupBy(*(by or [])).agg(F.sum((y - p) * (y - p)).alias("res"), total.alias("tot"))
    return a.select(*(by or []), F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).alias("r2"))
