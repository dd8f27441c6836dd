"""Numerics against independent brute force, and recovery of known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import rff, subspace
from tidewright.operators import grassmann, ipca, moments, nn, ridge, rolling
from tidewright.sources import synthetic

RNG = np.random.default_rng(5)


def stacked(T=15, N=25, m=4, k=2, seed=1):
    d = synthetic.factor_data(T=T, N=N, m=m, k=k, seed=seed, sigma=0.01)
    z, r = d["Z"], d["r"]
    return d, moments.Moments(
        list(range(T)), np.einsum("tnl,tnm->tlm", z, z), np.einsum("tnl,tn->tl", z, r), (r**2).sum(axis=1), np.full(T, float(N)), z.sum(axis=1), r.sum(axis=1)
    )


def test_dual_ridge_is_the_primal():
    x, y = RNG.standard_normal((40, 30)), RNG.standard_normal(40)
    f, norm = ridge.backtest(x @ x.T, y, 3.0, 12)
    for t in (12, 25, 39):
        s = x[t - 12 : t]
        beta = np.linalg.solve(s.T @ s + 36 * np.eye(30), s.T @ y[t - 12 : t])
        assert f[t] == pytest.approx(x[t] @ beta) and norm[t] == pytest.approx(np.linalg.norm(beta))
    many = ridge.backtests(x @ x.T, y, [3.0, 5.0], 12)
    assert np.allclose(many[3.0][0], f, equal_nan=True)


def test_feature_gram_needs_no_features():
    x, omega = RNG.standard_normal((7, 3)), rff.frequencies(3, 50, 2.0, 9)
    phi = rff.expand(x, omega)
    assert np.allclose(phi @ phi.T, rff.gram(x, x, omega))
    with pytest.raises(ValueError):
        rff.frequencies(3, 0, 1.0, 1)


def test_backtests_use_no_later_rows():
    x, y = RNG.standard_normal((30, 4)), RNG.standard_normal(30)
    f, _ = ridge.backtest(x @ x.T, y, 1.0, 12)
    x2, y2 = x.copy(), y.copy()
    x2[21:], y2[20:] = 9.0, 9.0
    g, _ = ridge.backtest(x2 @ x2.T, y2, 1.0, 12)
    assert np.allclose(f[12:21], g[12:21])


def test_gamma_step_is_least_squares_on_rows():
    d, m = stacked()
    f = RNG.standard_normal((2, 15))
    rows = np.concatenate([np.kron(f[:, t], d["Z"][t]) for t in range(15)])
    y = np.concatenate(list(d["r"]))
    full = np.linalg.lstsq(rows, y, rcond=None)[0].reshape(2, 4).T
    assert np.allclose(ipca.gamma_step(f, m), full)
    lasso = ipca.gamma_step(f, m, alpha=10.0, l1_ratio=1.0)
    assert np.allclose(lasso, 0)


def test_als_recovers_the_loadings():
    d, m = stacked(T=60, N=80)
    model = ipca.fit(m, 2, max_iter=500)
    assert subspace.distance(model.gamma, d["W"]) < 0.2
    assert np.allclose(model.gamma.T @ model.gamma, np.eye(2), atol=1e-8)
    ff = model.factors @ model.factors.T
    assert abs(ff[0, 1]) < 1e-8 * abs(ff[0, 0]) + 1e-8 and (model.factors.mean(axis=1) >= 0).all()
    assert 0 < ipca.score(m, model) <= 1
    assert len(ipca.predict_oos(m, model)) == 60


def test_prespecified_factors_stay():
    _, m = stacked()
    psf = RNG.standard_normal((1, 15))
    model = ipca.fit(m, 1, max_iter=50, psf=psf)
    assert model.gamma.shape == (4, 2) and np.allclose(model.factors[1], psf)


def test_grassmann_gradient_and_recovery():
    d, m = stacked(T=40, N=60)
    w = np.linalg.qr(RNG.standard_normal((4, 2)))[0]
    loss, g = grassmann.loss_and_gradient(w, m, 0.3)
    for i, j in ((0, 0), (2, 1), (3, 0)):
        e = np.zeros_like(w)
        e[i, j] = 1e-5
        number = (grassmann.loss_and_gradient(w + e, m, 0.3)[0] - grassmann.loss_and_gradient(w - e, m, 0.3)[0]) / 2e-5
        assert number == pytest.approx(g[i, j], rel=1e-4, abs=1e-6)
    for way in ("svd", "qr"):
        assert subspace.distance(grassmann.fit(m, 2, retraction=way).gamma, d["W"]) < 0.2
    assert subspace.distance(grassmann.evolve(m, 2, 5).gamma, d["W"]) < 0.2
    trust = grassmann.fit(m, 2, optimizer="tr")
    assert subspace.distance(trust.gamma, d["W"]) < 0.2 and np.allclose(trust.gamma.T @ trust.gamma, np.eye(2))
    assert grassmann.loss_and_gradient(trust.gamma, m, 1e-8)[0] <= grassmann.loss_and_gradient(grassmann.fit(m, 2).gamma, m, 1e-8)[0] + 1e-9


def test_normalised_moments():
    d, m = stacked()
    mu, sd = rolling.statistics(m)
    z = (d["Z"] - mu) / sd
    n = rolling.normalised(m, mu, sd)
    assert np.allclose(n.A, np.einsum("tnl,tnm->tlm", z, z)) and np.allclose(n.b, np.einsum("tnl,tn->tl", z, d["r"]))


def test_subspaces():
    a = np.linalg.qr(RNG.standard_normal((6, 2)))[0]
    turn = np.linalg.qr(RNG.standard_normal((2, 2)))[0]
    assert subspace.distance(a, a @ turn) == pytest.approx(0, abs=1e-6)
    e = np.eye(6)
    assert subspace.distance(e[:, :2], e[:, 2:4]) == pytest.approx(2**0.5 * np.pi / 2)
    assert subspace.effective_rank(np.eye(3)) == pytest.approx(3)
    assert subspace.random_baseline(4, 2) == pytest.approx((2 * 2 * 2 / 5) ** 0.5)
    assert np.isnan(subspace.random_baseline(2, 2)) and np.isnan(subspace.random_baseline(2, 0))
    with pytest.raises(ValueError):
        subspace.distance(a, a, "other")


def test_diagnostics_of_a_sequence():
    e = np.eye(4)
    turned = lambda x: np.cos(x) * e[:, :1] + np.sin(x) * e[:, 1:2]
    rows = rolling.diagnostics([(turned(x), np.ones((1, 3))) for x in (0.0, 0.1, 0.4)])
    assert "d_proj" not in rows[0] and rows[1]["grassmann_dist"] == pytest.approx(0.1) and "geodesic_acceleration" not in rows[1]
    assert rows[2]["geodesic_acceleration"] == pytest.approx(2**0.5 * (np.sin(0.3) - np.sin(0.1)))
    known = rolling.align_warm_factors(np.array([[1.0, 3.0]]), ["a", "c"], ["a", "b", "c"])
    assert known.tolist() == [[1.0, 2.0, 3.0]] and rolling.align_warm_factors(np.ones((1, 1)), ["x"], ["a"]) is None


def test_moments_of_many_characteristics(spark):
    p = synthetic.factor_panel(spark, T=5, N=20, m=50, k=1, seed=4)
    chars = [f"char_{i:03d}" for i in range(50)]
    wide = moments.collect(moments.month_moments(p, chars), 50)
    old, moments.MOST_EXPRESSIONS = moments.MOST_EXPRESSIONS, 100
    try:
        plain = moments.collect(moments.month_moments(p, chars), 50)
    finally:
        moments.MOST_EXPRESSIONS = old
    assert wide.months == plain.months and all(np.allclose(getattr(wide, x), getattr(plain, x)) for x in ("A", "b", "yy", "n", "sz", "sy"))


def test_rows_and_moments_fit_alike():
    d, m = stacked(T=8, N=12)
    t, n, size = d["Z"].shape
    got = ipca.fit_rows(d["Z"].reshape(-1, size), d["r"].ravel(), np.repeat(np.arange(t), n), list(m.months), 2, 200, 1e-8, 0.5)
    want = ipca.fit(m, 2, 200, 1e-8, 0.5)
    assert np.allclose(got.gamma @ got.factors, want.gamma @ want.factors, atol=1e-5)


def test_rolling_options(spark):
    p = synthetic.factor_panel(spark, T=20, N=12, m=3, k=1, seed=2)
    chars = [f"char_{i:03d}" for i in range(3)]
    plain = lambda **o: {(r["permno"], r["month"]): r["y_pred"] for r in rolling.rolling_factors(p, chars, n_factors=1, min_obs=30, max_iter=40, **o)[0].collect()}
    assert plain(warm_start=False) == pytest.approx(plain(warm_start=False, window=1000))  # in tasks
    everyone = p.select("month", "permno")
    assert plain(warm_start=False, universe=everyone) == pytest.approx(plain(warm_start=False), rel=1e-6, abs=1e-9)
    few = p.filter("permno < 10005").select("month", "permno")
    assert {k[0] for k in plain(universe=few, window=12)} == set(range(10000, 10005))
    assert plain(universe=few.filter("false")) == {} and plain(intercept=True) != plain()
    holes = p.withColumn("char_000", F.when(F.col("permno") != 10000, F.col("char_000")))
    pred = rolling.rolling_factors(holes, chars, n_factors=1, min_obs=30, max_iter=40)[0]
    assert pred.filter("permno = 10000 and y_pred is not null").count() == 0 and pred.filter("permno = 10000").count() == 8
    for o in ({"normalize": "rolling"}, {"normalize": "frozen"}, {"warm_start": False}, {"estimator": "grassmann"}):
        pred, diag = rolling.rolling_factors(p, chars, n_factors=1, min_obs=30, max_iter=15, window=12, universe=few, rff={"n": 6, "gamma": 0.3}, **o)
        assert pred.count() == 8 * 5 and diag.count() == 8 and pred.filter("y_pred is null").count() == 0
    many, _ = rolling.rolling_factors(p, chars, n_factors=1, min_obs=30, max_iter=5, window=12, universe=few, rff={"n": 300, "gamma": 0.3})  # more features than rows
    assert many.count() == 40
    with pytest.raises(ValueError):
        rolling.rolling_factors(p, chars, rff={"n": 6})
    with pytest.raises(ValueError):
        ipca.predict(p, chars, ipca.Model(np.ones((3, 1)), np.ones((1, 1)), [p.first()["month"]]), mean_factor=False)


def test_bootstrap_hypotheses(spark):
    _, m = stacked(T=20, N=30)
    few = {"draws": 5, "tasks": 2, "max_iter": 10}
    with_ones = ipca.fit(m, 1, 50, psf=np.ones((1, 20)))
    with_other = ipca.fit(m, 1, 50, psf=np.sin(np.arange(20.0))[None, :])
    free = ipca.fit(m, 2, 50)
    for found in (ipca.test_alpha(spark, with_ones, **few), ipca.test_delta(spark, with_other, **few), ipca.test_characteristic(spark, free, 1, **few)):
        assert found[0] >= 0 and 0 <= found[1] <= 1
    for wrong in (lambda: ipca.test_alpha(spark, free), lambda: ipca.test_delta(spark, with_ones), lambda: ipca.test_characteristic(spark, with_ones, 0), lambda: ipca.test_alpha(spark, with_ones, alpha=1.0)):
        with pytest.raises(ValueError):
            wrong()


def test_synthetic_modes():
    base = synthetic.factor_data(T=20, N=40, m=4, k=1, seed=1, missing=0.2, missing_mode="mcar", intercept=True)
    assert (base["Z"][:, :, 0] == 1).all() and 0.1 < (base["Z"][:, :, 1:] == 0).mean() < 0.3 and base["there"].all()
    tail = synthetic.factor_data(T=20, N=400, m=2, k=1, seed=1, missing=0.2, missing_mode="tail", impute="mean")
    full = synthetic.factor_data(T=20, N=400, m=2, k=1, seed=1)
    gone = ~np.isclose(tail["Z"], full["Z"])
    assert np.abs(full["Z"][gone]).mean() > np.abs(full["Z"][~gone]).mean() and 0.1 < gone.mean() < 0.3
    assert np.isfinite(synthetic.factor_data(tail_df=np.inf, z_drift=0.1)["r"]).all()
    with pytest.raises(ValueError):
        synthetic.factor_data(missing_mode="x")


def test_perceptron_grid_and_exact_gelu(spark):
    grid = nn.config_grid(spark)
    assert grid.count() == grid.distinct().count() == 144
    act, slope = nn._ACT["gelu"]
    x = np.linspace(-3, 3, 13)
    assert act(x)[8] == pytest.approx(x[8] * 0.8413447460685429) and np.allclose((act(x + 1e-6) - act(x - 1e-6)) / 2e-6, slope(x))


def test_perceptron_learns_and_validates():
    x = RNG.standard_normal((200, 2))
    y = x[:, 0] * 0.5
    net = nn.Perceptron(2, (16,), "tanh", 0.0, 1).fit(x, y, 80, 32, 1e-2)
    assert ((net.predict(x) - y) ** 2).mean() < 0.02
    with pytest.raises(ValueError):
        nn.Perceptron(2, ())
    assert np.isfinite(nn.Perceptron(2, (4,), "gelu", 1.0).fit(x, y, 1).predict(x)).all()
    assert nn.static_return(np.array([1.0, 1.0]), np.array([0.1, -0.1])) == pytest.approx(-0.01)


def test_rolling_factors(spark):
    p = synthetic.factor_panel(spark, T=24, N=30, m=3, k=1, seed=2)
    chars = [f"char_{i:03d}" for i in range(3)]
    for estimator in ("als", "grassmann"):
        pred, diag = rolling.rolling_factors(p, chars, n_factors=1, estimator=estimator, normalize="frozen", min_obs=30, max_iter=60)
        assert pred.filter("train_end >= month").count() == 0
        assert pred.count() == 12 * 30 and diag.count() == 12
    with pytest.raises(ValueError):
        rolling.rolling_factors(p, chars, estimator="x")


def test_bootstrap_and_cross_validation(spark):
    _, m = stacked(T=30, N=50)
    model = ipca.fit(m, 2, max_iter=200)
    stat, p, draws = ipca.bootstrap(spark, model, row=0, draws=20, tasks=4, max_iter=30)
    assert stat >= 0 and 0 <= p <= 1 and draws.count() == 20
    half = {0: m.part(np.arange(30) < 15), 1: m.part(np.arange(30) >= 15)}
    path = ipca.fit_path(half, [0.1, 1e6], n_factors=1, max_iter=50)
    assert len(path) == 2 and all(np.isfinite(e) for _, e in path)


def test_registered_over_the_whole_panel_with_all_draws(spark, monkeypatch):
    import __spark_entry__ as entry

    queries, data, seen, real = entry.queries(), "/root/testdata/sf0.001", [], ipca.bootstrap
    monkeypatch.setattr(ipca, "bootstrap", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    assert queries["ipca_bootstrap"](spark, data).count() == 1 and seen[0][2].count() == 1000
    keys = lambda name: {(r["permno"], r["month"]) for r in queries[name](spark, data).collect()}
    assert keys("grassmann_rolling") == keys("ipca_als_rolling")
