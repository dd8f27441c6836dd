"""Edge cases of cleaning, series, universes, portfolios and sources."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import clean, portfolio, ridge, series, universe
from tidewright.schema import assert_unique, nan_to_null, require_columns
from tidewright.sources import panel

M = [dt.date(2020, i, 1) for i in range(1, 13)]


def test_few_entities_and_ties(spark):
    rows = [(M[0], 1, 5.0, 0.1), (M[0], 2, 5.0, 0.2), (M[1], 3, 1.0, 0.3), (M[1], 4, None, 0.9)]
    long, wide = portfolio.quantile_portfolios(spark.createDataFrame(rows, "month date, permno int, s double, r double"), "s", "r", n=2)
    got = {r["month"]: (r["p1"], r["p2"], r["spread"]) for r in wide.collect()}
    assert got[M[0]] == pytest.approx((0.1, 0.2, 0.1)) and got[M[1]] == (None, 0.3, None)
    with pytest.raises(ValueError):
        portfolio.quantile_portfolios(wide, "nope", "p1")


def test_weights_add_up(spark):
    rows = [(M[i % 3], i, (i - 4) / 10.0, 0.01 * i) for i in range(9)]
    pred = spark.createDataFrame(rows, "month date, permno int, y_pred double, y_true double")
    for how in ("prediction_scaled", "equal_weight_sign"):
        g = portfolio.directional(pred, weighting=how, gross=2.0).groupBy("month").agg(F.sum(F.abs("weight")).alias("g")).collect()
        assert all(r["g"] == pytest.approx(2.0) for r in g)
    with pytest.raises(ValueError):
        portfolio.directional(pred, weighting="x")


def test_performance_edges(spark):
    flat = spark.createDataFrame([(m, 0.01) for m in M], "month date, ret double")
    r = portfolio.performance(flat).first()
    assert r["hit_rate"] == 1.0 and r["max_drawdown"] == pytest.approx(0)
    lost = spark.createDataFrame([(M[0], -0.5), (M[1], 0.1)], "month date, ret double")
    assert portfolio.performance(lost).first()["max_drawdown"] == pytest.approx(0)  # the first value is the first peak
    none = spark.createDataFrame([], "month date, ret double")
    assert portfolio.performance(none).first()["ann_return"] is None


def test_fill_past_only_sees_no_future(spark):
    rows = [(M[0], None), (M[1], 2.0), (M[1], 4.0), (M[2], None), (M[3], 10.0), (M[3], None)]
    df = spark.createDataFrame(rows, "month date, x double")
    got = sorted((r["month"], r["x"]) for r in clean.fill_missing(df, ["x"], past_only=True).collect() if r["x"] is not None)
    assert got == [(M[1], 2.0), (M[1], 4.0), (M[2], 3.0), (M[3], 10.0), (M[3], 10.0)]
    whole = [r["x"] for r in clean.fill_missing(df, ["x"]).orderBy("month").collect()]
    assert whole[0] == 4.0


def test_sparse_flat_and_collinear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float((i * 7) % 5), 1.0, None if i % 4 else 1.0) for i in range(20)], "a double, b double, c double, flat double, s double")
    assert "s" not in clean.drop_sparse_columns(df, 0.6).columns
    assert clean.drop_flat_and_collinear(df, ["a", "b", "c", "flat"]) == ["b", "c"]
    with pytest.raises(ValueError):
        clean.drop_sparse_columns(df, 2.0)


def test_merge_needs_unique_keys(spark):
    p = spark.createDataFrame([(1, M[0], 1.0)], "permno int, month date, q double")
    r = spark.createDataFrame([(1, dt.date(2020, 1, 31), 0.1, -2.0, 3.0)], "permno int, month date, ret_adj double, prc double, shrout double")
    assert clean.merge_returns(p, r).first()["mcap"] == 6.0
    with pytest.raises(ValueError):
        clean.merge_returns(p, r.unionAll(r))
    with pytest.raises(ValueError):
        assert_unique(p.unionAll(p), ["permno"])
    with pytest.raises(ValueError):
        require_columns(p, ["x"])


def test_bad_numbers_become_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double"))
    assert df.agg(F.avg("x")).first()[0] == 1.0
    z = spark.createDataFrame([(0.0, -1.0)], "a double, b double").select(series.log_ratio(F.col("a"), F.col("b")).alias("l")).first()
    assert z["l"] is None


def test_gaps_asof_and_intervals(spark):
    df = spark.createDataFrame([(M[0], 1.0), (M[2], 0.0), (M[5], 3.0)], "month date, x double")
    assert [r[0] for r in df.select(series.pct_change("x")).collect()] == [None, -1.0, None]
    right = spark.createDataFrame([(dt.date(2020, 2, 15), 7.0), (M[2], 8.0)], "day date, v double")
    assert [r["v"] for r in series.asof(df, right, "month", "day", "v").orderBy("month").collect()] == [None, 8.0, 8.0]
    spans = spark.createDataFrame([(M[1], M[3]), (M[2], M[2])], "peak date, trough date")
    assert [r["flag"] for r in series.in_intervals(df, spans).orderBy("month").collect()] == [0, 1, 0]


def test_universe_boundaries(spark):
    df = spark.createDataFrame([(M[0], 1, 50.0), (M[0], 2, 30.0), (M[0], 3, 20.0), (M[1], 1, 0.0), (M[1], 2, None)], "month date, permno int, mcap double")
    pick = lambda **k: sorted((r["month"], r["permno"]) for r in universe.by_market_cap(df, **k).collect())
    assert pick(top_share=0.5) == [(M[0], 1)]
    assert pick(top_share=0.51) == [(M[0], 1), (M[0], 2)]
    assert pick(top_n=1) == [(M[0], 1), (M[1], 1)]
    assert pick(top_n=1, is_log=True) == [(M[0], 1), (M[1], 1)]
    nxt = universe.previous_month(universe.by_market_cap(df, top_n=2), df).collect()
    assert {r["month"] for r in nxt} == {M[1]}


def test_sources(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('yyyymm,Index,D12,E12,b/m,tbl,AAA,BAA,lty,ntis,infl,ltr,corpr,svar\n202001,"1,000.0",10,20,.5,.01,.02,.03,.02,.1,.0,.1,.2,.3\n202002,"1,100.0",11,22,.5,.01,.02,.04,.02,.1,.0,.1,.2,.3\nbad,1,1,1,1,1,1,1,1,1,1,1,1,1\n')
    rows = panel.load_predictors(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0]["returns"] == pytest.approx(0.1) and rows[0]["dfy"] == pytest.approx(0.02)
    n = tmp_path / "n.csv"
    n.write_text("peak,trough\n,1854-12-01\n1857-06-01,1858-12-01\n")
    assert panel.load_recessions(spark, str(n)).count() == 1
    path = str(tmp_path / "cache")
    made = []
    for _ in range(2):
        assert panel.load_or_run(spark, path, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    panel.write_table(spark.range(3), str(tmp_path / "x.csv"))
    assert spark.read.csv(str(tmp_path / "x.csv"), header=True).count() == 3


def test_grid_size(spark):
    assert ridge.complexity_grid(spark, 2).select("p").distinct().count() > 60


def test_notebook_source(spark, tmp_path):
    import json

    from tidewright.sources import notebook

    png = "iVBORw0K\nGgo="
    p = tmp_path / "n.ipynb"
    p.write_text(json.dumps({"cells": [
        {"cell_type": "code", "source": ["monthly_r2", ".plot()"], "outputs": [
            {"output_type": "stream", "text": ["OOS R2: -0.0023\n", "Overall OOS R^2 (k=3): 1.5e-2, R2 = 0.5"]},
            {"output_type": "display_data", "data": {"image/png": png, "text/plain": ["<Figure>"]}},
        ]},
        {"cell_type": "code", "source": "x", "outputs": [
            {"output_type": "execute_result", "data": {"text/plain": "OOS R²: +0.25"}},
            {"output_type": "error", "ename": "KeyError", "evalue": "a_b"}, {"output_type": "display_data", "data": {"image/png": [png, "\n"]}},
        ]},
        {"cell_type": "markdown", "source": ["c"]},
        {"cell_type": "code", "source": [], "outputs": []},
    ]}))
    assert [r["r2"] for r in notebook.metrics(spark, str(p)).orderBy("cell", "output", "place").collect()] == [-0.0023, 0.015, 0.25]
    found = notebook.figures(spark, str(p)).orderBy("number").collect()
    assert [(r["cell"], r["output"], r["caption"], r["name"]) for r in found] == [(0, 1, "Monthly OOS R^2", "plot_01_cell0_out1.png"), (1, 2, "Notebook plot 2 (cell 1)", "plot_02_cell1_out2.png")]
    assert bytes(found[0]["content"]).startswith(b"\x89PNG")
    assert len(notebook.write_figures(spark, str(p), str(tmp_path / "f"))) == 2 and (tmp_path / "f" / "plot_01_cell0_out1.png").read_bytes().startswith(b"\x89PNG")
    plain, tex = notebook.report(spark, str(p)), notebook.report(spark, str(p), latex=True)
    assert "Cell 1: KeyError - a_b" in plain and "Overall OOS R^2 (1): -0.0023" in plain and "(figures/plot_01_cell0_out1.png)" in plain
    assert r"KeyError - a\_b" in tex and tex.endswith("\\end{document}\n")


def test_sweep_matches_single_runs(spark):
    import numpy as np

    from tidewright.functions import rff

    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), float(np.sin(i)), float(np.cos(2 * i)) / 10) for i in range(30)]
    df = spark.createDataFrame(rows, "month date, x double, y double")
    got = ridge.sweep(ridge.grid(spark, [1.0], [6], [1.0, 10.0], [3]), df, ["x"], "y").filter("z = 10").orderBy("month").collect()
    phi = rff.expand(np.array([[r[1]] for r in rows]), rff.frequencies(1, 3, 1.0, 3))
    f, _ = ridge.backtest(phi @ phi.T, np.array([r[2] for r in rows]), 10.0, 12)
    assert np.allclose([r["forecast"] for r in got], f[12:])


def test_grid_is_every_run_once(spark):
    from itertools import product

    lists = [0.5, 2.0], [2, 4, 6], [1.0, 10.0], [1, 2, 3]
    got = ridge.grid(spark, *lists)
    assert sorted(tuple(r) for r in got.collect()) == sorted(product(*lists)) and got.rdd.getNumPartitions() == 1
    full = ridge.complexity_grid(spark)
    assert full.count() == full.distinct().count() > 1_900_000


def test_penalties_share_a_decomposition(spark):
    import numpy as np

    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), float(np.sin(i)), float(np.cos(3 * i)), float(np.cos(2 * i)) / 10) for i in range(30)]
    df = spark.createDataFrame(rows, "month date, x double, v double, y double")
    grid = ridge.penalty_grid(df, ["x", "v"], "y", [0.1, 10.0])
    for z in (0.1, 10.0):
        one = ridge.rolling_ridge(df, ["x", "v"], "y", penalty=z).orderBy("month").collect()
        many = grid.filter(F.col("z") == z).orderBy("month").collect()
        assert np.allclose([r["forecast"] for r in one], [r["forecast"] for r in many]) and np.allclose([r["coefficient_norm"] for r in one], [r["coefficient_norm"] for r in many])


def test_asof_over_months(spark):
    days = [dt.date(2000, 1, 5), dt.date(2000, 1, 20), dt.date(2000, 4, 2), dt.date(1999, 12, 31), None]
    left = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d date, i int")
    right = spark.createDataFrame([(dt.date(2000, 1, 1), 1.0), (dt.date(2000, 1, 20), 2.0), (dt.date(2000, 2, 10), 3.0), (dt.date(2000, 3, 1), None), (None, 9.0)], "t date, v double")
    got = {r["i"]: r["v"] for r in series.asof(left, right, "d", "t", "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: None, 4: None}


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.standard_normal(3000), rng.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, n double")
    got = clean.exact_percentiles(df, {"x": [0.0, 0.01, 0.5, 0.99, 1.0], "y": [0.5, 0.25], "n": [0.5]}, accuracy=100)
    assert np.allclose(got["x"], np.quantile(x, [0, 0.01, 0.5, 0.99, 1])) and np.allclose(got["y"], np.quantile(y[np.arange(3000) % 3 > 0], [0.5, 0.25])) and got["n"] == [None]


def test_percentiles_where_last_bits_change_between_passes(spark):
    import numpy as np

    began = time.time()
    late = F.udf(lambda x: x * (1 + 1e-12 * (time.time() - began)), "double").asNondeterministic()
    x = np.random.default_rng(3).integers(1, 9, 500).astype(float)  # many ties
    df = spark.createDataFrame([(float(a),) for a in x], "x double").select(late("x").alias("x"))
    assert np.allclose(clean.exact_percentiles(df, {"x": [0.01, 0.5, 1.0]})["x"], np.quantile(x, [0.01, 0.5, 1.0]))
    z = (x - x.mean()) / x.std()
    got = [r["x"] for r in clean.normalise(df, df, ["x"], (5, 90))[1].collect()]
    assert np.allclose(got, np.clip(z, *np.quantile(z, [0.05, 0.9])))
    ends = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, float("inf"))], "x double")
    assert clean.exact_percentiles(ends, {"x": [0.0, 0.5, 1.0]})["x"] == [float("-inf"), 1.0, float("inf")]


def test_signals_and_index_returns(spark):
    from tidewright.sources import panel

    raw = spark.createDataFrame([(2, "200002", 1.0), (1, "200001", 2.0), (None, "200001", 3.0), (1, "bad", 4.0), (1, "200012", 5.0)], "permno long, yyyymm string, x double")
    assert [(r["permno"], str(r["yyyymm"])) for r in panel.read_signals(raw, "2000-01-15", "2000-06-30").collect()] == [(1, "2000-01-01"), (2, "2000-02-01")]
    day = dt.date
    returns = spark.createDataFrame([(1, day(2000, 1, 31), 0.1), (1, day(2000, 2, 29), None), (2, day(2000, 1, 31), 0.2), (1, day(1990, 1, 31), 0.5)], "permno long, date date, ret double")
    spells = spark.createDataFrame([(1, day(1980, 1, 1), None), (2, day(2000, 2, 1), None)], "permno long, start date, ending date")
    last = spark.createDataFrame([(1, day(2000, 2, 29), -0.5)], "permno long, dlstdt date, dlret double")
    got = panel.index_returns(returns, spells, last, "1995-01-01").collect()
    assert [(r["permno"], str(r["yyyymm"]), r["ret_adj"]) for r in got] == [(1, "2000-01-01", pytest.approx(0.1)), (1, "2000-02-01", -0.5)]
    assert "ret_adj" not in panel.index_returns(returns, spells).columns


def test_folders_and_nested_tables(spark, tmp_path):
    from tidewright.sources import panel

    panel.ensure_dirs(spark, str(tmp_path / "a" / "b"))
    assert (tmp_path / "a" / "b").is_dir()
    one = spark.createDataFrame([(1,)], "x int")
    panel.write_nested({"r1": one, "r2": one}, str(tmp_path / "n"))
    assert sorted(r["run"] for r in spark.read.parquet(str(tmp_path / "n")).collect()) == ["r1", "r2"]


def test_subset_command(spark, tmp_path, monkeypatch):
    from tidewright.plans import subset

    rows = [(i % 4, dt.date(2000 + m // 12, m % 12 + 1, 1), float(m), float(i * m), float(m - i)) for i in range(8) for m in range(30) if i < 4]
    src, out = str(tmp_path / "p"), str(tmp_path / "o.csv")
    spark.createDataFrame(rows, "permno long, month date, ret double, f1 double, f2 double").write.parquet(src)
    subset.main([src, out, "--target", "ret", "--factors", "1", "--ids", "2", "--years", "1"], spark)
    got = spark.read.csv(out, header=True)
    assert got.count() == 12 and len(got.columns) == 4


def test_ranks_of_a_month_in_parts(spark):
    rows = [(dt.date(2000, 1 + i % 2, 1), i, float((i * 37) % 23), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "month date, permno long, s double, r double")
    one = {(r["month"], r["permno"]): r["__share"] for r in portfolio.month_share(df, "s").collect()}
    assert {(r["month"], r["permno"]): r["__share"] for r in portfolio.month_share(df, "s", tasks=7).collect()} == one
    a, b = (portfolio.quantile_portfolios(df, "s", "r", n=4, tasks=k)[1].orderBy("month").collect() for k in (1, 5))
    assert a == b


def test_packed_rows_tell_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.1), (float("nan"), 2.0, 0.1), (1.0, float("inf"), 0.1), (None, 2.0, 0.1), (1.0, 2.0, None)], "a double, b double, y double")
    assert [r["finite"] for r in clean.packed_rows(df, ["a", "b"], "y").collect()] == [True, False, False, False, False]
    assert [r["finite"] for r in clean.packed_rows(df, ["a", "b"]).collect()] == [True, False, False, False, True]
