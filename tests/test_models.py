"""Regressions against dense matrices."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainshift.functions.tail import T_975
from strainshift.operators import mixed as X
from strainshift.operators import regression as G
from strainshift.operators.selection import fit_selection_models
from strainshift.plans import catalog
from strainshift.plans.q_models import part_models, profiled

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import connect  # noqa: E402

SIZES = {"a": 4, "b": 6, "c": 7, "d": 5, "e": 8}
LAMBDAS = (0.0, 0.5, 3.0)


def fixture(seed=11, shift=0.0, sd_group=0.7):
    rng = np.random.default_rng(seed)
    rows, rho = [], -0.9
    for g, n in SIZES.items():
        u = rng.normal(0, sd_group)
        for t in range(n):
            x1 = 3.0 * t + rng.normal(0, 0.5)
            x2 = rho * x1 + rng.normal(0, 0.4)
            y = 1 + 0.8 * x1 + 0.5 * x2 + u + rng.normal(0, 0.3) + (shift if g == "b" else 0)
            rows.append((1, g, float(t), y, rho, x1, x2, x2 - rho * x1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "model_id long, region string, t double, y double, rho double, x1 double, x2 double, z double")


def dense(rows, columns=("x1", "x2")):
    at = {"x1": 5, "x2": 6, "z": 7}
    x = np.array([[1.0, *[r[at[c]] for c in columns]] for r in rows])
    y = np.array([r[3] for r in rows])
    z = np.array([[float(r[1] == g) for g in SIZES] for r in rows])
    return x, y, z


def dense_deviance(rows, lam, reml, columns=("x1", "x2"), offset=None):
    x, y, z = dense(rows, columns)
    if offset is not None:
        y = y - offset
    v = np.eye(len(y)) + lam * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    b = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ b
    q = r @ vi @ r
    n, p = x.shape
    free = n - p if reml else n
    dev = free * np.log(2 * np.pi * q / free) + free + np.linalg.slogdet(v)[1]
    if reml:
        dev += np.linalg.slogdet(a)[1]
    return dev, b, q / free, np.linalg.inv(a) * q / free


def minimise(fn, lo=-12.0, hi=8.0):
    """Smallest value of fn(exp(l)) and fn(0), by grids that close in."""
    best = (fn(0.0), 0.0)
    for _ in range(8):
        grid = np.linspace(lo, hi, 41)
        vals = [fn(np.exp(g)) for g in grid]
        i = int(np.argmin(vals))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
        best = min(best, (vals[i], float(np.exp(grid[i]))))
    return best


@pytest.mark.parametrize("reml", [True, False])
def test_deviance_equals_dense_matrices(spark, reml):
    rows = fixture()
    groups = X.selection_groups(G.model_groups(frame(spark, rows)), ["model_id"])
    lam = groups.withColumn("lam", F.explode(F.array(*[F.lit(v) for v in LAMBDAS])))
    for columns in (["x1", "z"], ["x1"], ["x2"]):
        for r in X.evaluate(lam, ["model_id"], columns, "y", reml).collect():
            dev, b, sigma2, cov = dense_deviance(rows, r["lam"], reml, columns)
            assert r["deviance"] == pytest.approx(dev, abs=1e-9)
            assert r["sigma2"] == pytest.approx(sigma2, rel=1e-10)
            assert [r[f"b_{c}"] for c in columns] == pytest.approx(list(b[1:]), rel=1e-9)
            assert [r[f"var_{c}"] for c in columns] == pytest.approx(list(np.diag(cov)[1:]), rel=1e-9)


def test_reml_fit_equals_dense_search(spark):
    rows = fixture()
    groups = X.selection_groups(G.model_groups(frame(spark, rows)), ["model_id"])
    fit = X.selection_fit(groups, ["model_id"]).first()
    _, lam = minimise(lambda v: dense_deviance(rows, v, True)[0])
    _, b, sigma2, cov = dense_deviance(rows, lam, True)
    assert fit["lam"] == pytest.approx(lam, rel=1e-3)
    assert (fit["delta_beta"], fit["delta_gamma"]) == pytest.approx(tuple(b[1:]), rel=1e-5)
    assert (fit["se_beta"], fit["se_gamma"]) == pytest.approx((cov[1, 1] ** .5, cov[2, 2] ** .5), rel=1e-4)
    assert fit["delta_beta_upper"] - fit["delta_beta"] == pytest.approx(1.959963984540054 * fit["se_beta"])
    # fitted values with predicted group effects
    x, y, z = dense(rows)
    v = np.eye(len(y)) + fit["lam"] * z @ z.T
    u = fit["lam"] * z.T @ np.linalg.inv(v) @ (y - x @ b)
    fits = X.selection_fit(groups, ["model_id"])
    eff = X.group_effects(groups, fits, ["model_id"], ["x1", "z"], "y")
    got = {r["region"]: (r["effect"], r["intercept"]) for r in eff.collect()}
    assert [got[g][0] for g in SIZES] == pytest.approx(list(u), rel=1e-4)
    assert [got[g][1] for g in SIZES] == pytest.approx([b[0] + e for e in u], rel=1e-4)
    rss = X.mixed_rss(eff, ["model_id"], ["x1", "z"], "y").first()["rss"]
    assert rss == pytest.approx(((y - x @ b - z @ u) ** 2).sum(), rel=1e-4)


def test_no_between_variance_equals_least_squares(spark):
    rows = fixture(seed=4, sd_group=0.0)
    means = {g: np.mean([r[3] - 0.8 * r[5] - 0.5 * r[6] for r in rows if r[1] == g]) for g in SIZES}
    flat = [(*r[:3], float(r[3] - means[r[1]] + 1), *r[4:]) for r in rows]
    groups = X.selection_groups(G.model_groups(frame(spark, flat)), ["model_id"])
    fit = X.selection_fit(groups, ["model_id"]).first()
    x, y, _ = dense(flat)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit["lam"] == 0.0
    assert (fit["delta_beta"], fit["delta_gamma"]) == pytest.approx(tuple(b[1:]), rel=1e-9)


def test_lrt_equals_dense_search(spark):
    rows = fixture()
    groups = X.selection_groups(G.model_groups(frame(spark, rows)), ["model_id"])
    got = {r["dropped"]: r["chi2"] for r in X.selection_lrt(groups, ["model_id"]).collect()}
    full = minimise(lambda v: dense_deviance(rows, v, False)[0])[0]
    for dropped, kept in (("x1", "x2"), ("x2", "x1")):
        reduced = minimise(lambda v: dense_deviance(rows, v, False, [kept])[0])[0]
        assert got[dropped] == pytest.approx(reduced - full, rel=1e-4, abs=1e-4)


def test_profile_limits_equal_brute_force(spark):
    rows = fixture()
    groups = X.selection_groups(G.model_groups(frame(spark, rows)), ["model_id"])
    fits = X.selection_fit(groups, ["model_id"])
    full = minimise(lambda v: dense_deviance(rows, v, False)[0])[0]
    est = fits.first()
    limits = {r["effect"]: r for r in X.profile_limits(groups, ["model_id"]).collect()}
    for effect, column, other in (("beta", 5, "x2"), ("gamma", 6, "x1")):
        row = limits[effect]

        def rise(b):
            off = b * np.array([r[column] for r in rows])
            return minimise(lambda v: dense_deviance(rows, v, False, [other], off)[0])[0] - full

        for side, limit in ((-1, row["lower"]), (1, row["upper"])):
            lo, hi = est[f"delta_{effect}"], est[f"delta_{effect}"] + side * 6 * est[f"se_{effect}"]
            for _ in range(25):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if rise(mid) < 3.841458820694124 else (lo, mid)
            assert limit == pytest.approx(lo, abs=0.01 * est[f"se_{effect}"])


def test_ancova_equals_least_squares(spark):
    rows = fixture()
    groups = G.model_groups(frame(spark, rows))
    fit = G.ancova_fit(groups, ["model_id"]).first()
    x, y, z = dense(rows)
    m = np.hstack([z, x[:, 1:]])
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    r = y - m @ b
    df = len(y) - len(SIZES) - 2
    cov = np.linalg.inv(m.T @ m) * (r @ r) / df
    assert (fit["delta_beta"], fit["delta_gamma"]) == pytest.approx(tuple(b[-2:]), rel=1e-10)
    assert fit["df"] == df and fit["rss"] == pytest.approx(r @ r, rel=1e-10)
    assert (fit["se_beta"], fit["se_gamma"]) == pytest.approx((cov[-2, -2] ** .5, cov[-1, -1] ** .5), rel=1e-9)
    assert fit["delta_beta_upper"] == pytest.approx(b[-2] + T_975[df - 1] * cov[-2, -2] ** .5, rel=1e-9)
    levels = G.ancova_intercepts(groups, G.ancova_fit(groups, ["model_id"]), ["model_id"], "region")
    got = {r["region"]: (r["intercept"], r["effect"]) for r in levels.collect()}
    assert [got[g][0] for g in SIZES] == pytest.approx(list(b[:5]), rel=1e-9)
    assert [got[g][1] for g in SIZES] == pytest.approx(list(b[:5] - b[0]), rel=1e-9, abs=1e-9)
    back = G.fitted_rows(frame(spark, rows), levels, ["model_id"], "region")
    assert back.agg(F.sum(F.col("residual") ** 2)).first()[0] == pytest.approx(r @ r, rel=1e-9)


def test_ancova_slopes_ignore_region_levels(spark):
    one = G.ancova_fit(G.model_groups(frame(spark, fixture())), ["model_id"]).first()
    two = G.ancova_fit(G.model_groups(frame(spark, fixture(shift=100.0))), ["model_id"]).first()
    assert (one["delta_beta"], one["delta_gamma"]) == pytest.approx((two["delta_beta"], two["delta_gamma"]), rel=1e-9)


def test_collinear_regressors_are_flagged(spark):
    rows = [(*r[:6], r[4] * r[5], 0.0) for r in fixture()]
    fit = G.ancova_fit(G.model_groups(frame(spark, rows)), ["model_id"]).first()
    assert fit["rank_deficient"] and fit["delta_beta"] is None and fit["rss"] is None


def test_nested_models_and_correlation(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x), float(0.3 * x + rng.normal())) for g, n in SIZES.items() for x in rng.normal(50, 5, n)]
    df = spark.createDataFrame(rows, "region string, x double, s double")
    test = G.nested_f_test(G.group_sums(df, [], "region", ["x"], "s"), [], "x", "s").first()
    z = np.array([[float(r[0] == g) for g in SIZES] for r in rows])
    x, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def rss(m):
        b = np.linalg.lstsq(m, s, rcond=None)[0]
        return ((s - m @ b) ** 2).sum()

    r1, r2, r3 = rss(z), rss(np.hstack([z, x[:, None]])), rss(np.hstack([z, z * x[:, None]]))
    assert (test["rss1"], test["rss2"], test["rss3"]) == pytest.approx((r1, r2, r3), rel=1e-8)
    assert r1 >= r2 >= r3
    n = len(rows)
    assert test["f_12"] == pytest.approx((r1 - r2) / (r2 / (n - 6)), rel=1e-7)
    assert test["f_23"] == pytest.approx(((r2 - r3) / 4) / (r3 / (n - 10)), rel=1e-7)
    corr = {r["region"]: r for r in G.corr_test(df, ["region"], "x", "s").collect()}
    sel = [i for i, r in enumerate(rows) if r[0] == "e"]
    want = np.corrcoef(x[sel], s[sel])[0, 1]
    assert corr["e"]["r"] == pytest.approx(want)
    half = 1.959963984540054 / np.sqrt(len(sel) - 3)
    assert corr["e"]["ci_lower"] == pytest.approx(np.tanh(np.arctanh(want) - half))
    three = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 9.0)], "x double, s double")
    assert G.corr_test(three, [], "x", "s").first()["ci_lower"] is None


def test_regressors_do_not_depend_on_rho_rotation(spark):
    panel = spark.createDataFrame([("a", 3.5, 0.1), ("a", 10.5, 0.2), ("a", 17.5, 0.9), ("b", 10.5, 0.3), ("b", 17.5, 0.4)], "region string, t double, y double")
    rng = np.random.default_rng(1)
    psi = rng.uniform(20, 80, 30)
    control = spark.createDataFrame([(i, float(p)) for i, p in enumerate(psi)], "day_idx int, psi double")
    models = spark.createDataFrame([(1, 0.9, 2.0, 0.2, 0.25, 0.1, 0.75), (2, 0.5, 3.0, 0.16, 0.3, 0.12, 0.6)],
                                   "model_id long, k double, a double, kappa double, beta_w double, gamma_w double, sn double")
    got = {(r["model_id"], r["region"], r["t"]): r for r in G.logit_regressors(models, panel, control).collect()}
    assert len(got) == 10
    large = G.logit_regressors(models, panel, control, panel_rows=2).collect()
    assert {(r["model_id"], r["region"], r["t"]): (r["x1"], r["z"]) for r in large} == {k: (r["x1"], r["z"]) for k, r in got.items()}
    fine = 2800
    for m in models.collect():
        c = m["k"] * (psi / 100) ** m["a"]
        h = np.sqrt((m["kappa"] - m["gamma_w"]) ** 2 + 4 * m["kappa"] * (1 - c) * m["beta_w"] * m["sn"])
        for region, t, _ in panel.collect():
            t0 = 3.5 if region == "a" else 10.5
            mids = t0 + (np.arange(fine) + 0.5) * (t - t0) / fine if t > t0 else np.array([])
            day = np.floor(mids).astype(int)
            x1 = m["kappa"] * m["sn"] * ((1 - c) / h)[day].sum() * (t - t0) / fine
            x2 = -0.5 * ((m["kappa"] - m["gamma_w"]) * (1 / h)[day].sum() * (t - t0) / fine + t - t0)
            r = got[(m["model_id"], region, t)]
            assert r["x1"] == pytest.approx(x1, rel=1e-10, abs=1e-10)
            assert r["x2"] == pytest.approx(x2, rel=1e-10, abs=1e-10)
            assert r["z"] == pytest.approx(r["x2"] - r["rho"] * r["x1"], abs=1e-12)


def test_queries_of_sums_make_no_row_per_cell(spark, sf, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("a row per model and cell")

    monkeypatch.setattr(G, "expand_by", refused)
    for name in ("coord_table", "ancova_effects", "nested_lrt"):
        assert "model_id" in catalog.QUERIES[name](spark, sf).columns, name


def test_nested_design_gives_the_sums_of_its_rows(spark, monkeypatch):
    """One row per model in place of one per model and cell: repeated, null and unknown parameters included."""
    monkeypatch.setattr(G, "STEP_VALUES", 80)  # the rows of a model fall into several steps
    rng = np.random.default_rng(4)
    cells = [(g, 3.5 + 7 * i, float(rng.normal())) for g, n in (("a", 6), ("b", 4), ("c", 1)) for i in range(6 - n, 6)] + [("a", None, 0.3)]
    panel = spark.createDataFrame(cells, "region string, t double, y double")
    control = spark.createDataFrame([(i, None if i == 9 else float(p)) for i, p in enumerate(rng.uniform(20, 80, 35))], "day_idx int, psi double")
    fixed = (0.2, 0.25, 0.1, 0.75)
    models = spark.createDataFrame(
        [(i, float(rng.uniform()), float(rng.uniform(1, 5)), *fixed) for i in range(20) for _ in range(1 + 3 * (i % 7 == 0))]
        + [(30, None, 2.0, *fixed), (31, 0.5, None, *fixed), (None, 0.5, 2.0, *fixed), (None, 0.6, 2.0, *fixed), (32, 0.5, 2.0, None, 0.25, 0.1, 0.75),
           (33, 0.5, 2.0, 0.2, 0.25, 0.1, None), (33, 0.5, 2.0, *fixed), (34, 0.5, 2.0, 0.2, 0.25, 0.1, None), (35, 0.5, 2.0, 0.2, 0.25, None, 0.75), (36, 9e9, 2.0, *fixed)],
        "model_id long, k double, a double, kappa double, beta_w double, gamma_w double, sn double")

    def of(df):
        return {(r["model_id"], r["region"]): r.asDict() for r in df.collect()}

    for cells_seen in (panel, panel.withColumn("y", F.when(F.col("t") > 4, F.col("y")))):
        rows = of(G.model_groups(G.logit_regressors(models, cells_seen, control)))
        nested = G.logit_regressors(models, cells_seen, control, nested=True)
        got = of(G.model_groups(nested, panel=cells_seen))
        assert set(got) == set(rows)
        for key, want in rows.items():
            assert list(got[key]) == list(want)
            assert {c: v is None for c, v in got[key].items()} == {c: v is None for c, v in want.items()}, key
            assert [got[key][c] or 0.0 for c in list(want)[2:]] == pytest.approx(
                [want[c] or 0.0 for c in list(want)[2:]], rel=1e-9, abs=1e-11, nan_ok=True), key


@pytest.mark.parametrize("method,interval", [("lm", "wald"), ("lmer", "wald"), ("lmer", "profile")])
def test_second_step_in_one_call(spark, method, interval):
    rng = np.random.default_rng(6)
    control = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.uniform(20, 80, 100))], "day_idx int, psi double")
    models = spark.createDataFrame([(1, 0.9, 2.0), (2, 0.5, 3.0)], "model_id long, k double, a double")
    cells = [(g, 3.5 + 7 * i) for g in "abc" for i in range(12)]
    shape = {(r["region"], r["t"]): r for r in G.logit_regressors(
        models.filter("model_id = 1"), frame_of(spark, cells, [0.0] * len(cells)), control).collect()}
    level = {"a": -2.0, "b": -1.5, "c": -2.2}
    ys = [float(level[g] + 0.1 * shape[(g, t)]["x1"] - 0.02 * shape[(g, t)]["x2"] + rng.normal(0, 0.05)) for g, t in cells]
    out = fit_selection_models(models, frame_of(spark, cells, ys), control, method, interval)
    est = {r["model_id"]: r for r in out["estimates"].collect()}
    assert est[1]["delta_beta_lower"] < 0.1 < est[1]["delta_beta_upper"]
    assert est[1]["delta_gamma_lower"] < -0.02 < est[1]["delta_gamma_upper"]
    rss = {r["model_id"]: r["s"] for r in out["fitted"].groupBy("model_id").agg(F.sum(F.col("residual") ** 2).alias("s")).collect()}
    assert rss == pytest.approx({m: r["rss"] for m, r in est.items()}, rel=1e-6)
    assert out["fitted"].count() == 2 * len(cells)


def frame_of(spark, cells, ys):
    return spark.createDataFrame([(g, float(t), float(y)) for (g, t), y in zip(cells, ys)], "region string, t double, y double")


def test_second_step_refuses_other_methods(spark):
    with pytest.raises(ValueError, match="method"):
        fit_selection_models(None, None, None, "glm")


def test_group_without_x_variance_costs_no_slope(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(0.3 * x + rng.normal())) for g, n in (("a", 4), ("b", 4)) for x in rng.normal(50, 5, n)] + [("c", 50.0, 15.0)]
    df = spark.createDataFrame(rows, "region string, x double, s double")
    test = G.nested_f_test(G.group_sums(df, [], "region", ["x"], "s"), [], "x", "s").first()
    assert (test["df_12"], test["df_2"], test["df_23"], test["df_3"]) == (1, 5, 1, 4)
    names = sorted({r[0] for r in rows})
    z = np.array([[float(r[0] == g) for g in names] for r in rows])
    x, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def rss(m):
        b = np.linalg.lstsq(m, s, rcond=None)[0]
        return ((s - m @ b) ** 2).sum()

    r2, r3 = rss(np.hstack([z, x[:, None]])), rss(np.hstack([z, z * x[:, None]]))
    assert test["f_23"] == pytest.approx((r2 - r3) / (r3 / 4), rel=1e-7)
    flat = G.nested_f_test(G.group_sums(df.withColumn("x", F.lit(2.0)), [], "region", ["x"], "s"), [], "x", "s").first()
    assert flat["df_12"] == 0 and flat["f_12"] is None and flat["rss2"] == flat["rss1"] == flat["rss3"]


def test_groups_far_apart_are_within_the_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(1, f"g{g}", float(x), float(1000.0 * g + 0.5 * x + rng.normal(0, 0.01))) for g in range(6) for x in rng.normal(0, 1, 12)]
    df = spark.createDataFrame(rows, "model_id int, region string, x1 double, y double")
    groups = X.centred_groups(G.group_sums(df, ["model_id"], "region", ["x1"], "y"), ["model_id"], ["x1"], "y")
    fit = X.random_intercept_fit(groups, ["model_id"], ["x1"], "y").first()
    assert fit["lam"] > 1e8 and fit["sigma2"] == pytest.approx(1e-4, rel=0.6) and fit["b_x1"] == pytest.approx(0.5, abs=0.01)


def test_interaction_coefficients_equal_least_squares(spark):
    rng = np.random.default_rng(12)
    rows = [(g, float(x), float(0.3 * x + rng.normal())) for g, n in (("a", 6), ("b", 9)) for x in rng.normal(50, 5, n)] + [("c", 50.0, 15.0)]
    df = spark.createDataFrame(rows, "region string, x double, s double")
    got = {r["region"]: r for r in G.slopes_by_group(G.group_sums(df, [], "region", ["x"], "s"), [], "region", "x", "s").collect()}
    m = np.array([[r[0] == "a", r[0] == "b", r[0] == "c", (r[0] == "a") * r[1], (r[0] == "b") * r[1]] for r in rows], float)
    y = np.array([r[2] for r in rows])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    df_left = len(y) - 5
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * ((y - m @ b) ** 2).sum() / df_left)
    for k, g in enumerate("ab"):
        r = got[g]
        assert (r["intercept"], r["slope"]) == pytest.approx((b[k], b[3 + k]), rel=1e-7)
        assert (r["se_intercept"], r["se_slope"]) == pytest.approx((se[k], se[3 + k]), rel=1e-7)
        assert r["t_slope"] == pytest.approx(b[3 + k] / se[3 + k], rel=1e-7) and 0 <= r["p_slope"] <= 1 and r["df"] == df_left
    assert got["c"]["slope"] is None and got["c"]["p_slope"] is None


def test_trajectories_reach_the_last_observation(spark, tmp_path):
    """Events over 45 days: every observed point counts."""
    counts = {(d, k): 3 + (d * i * 7) % 11 for d in range(1, 46) for i, k in enumerate(("view", "click", "error"), 2)}
    spark.createDataFrame([(f"2024-01-{1:02d}", d, k) for (d, k), n in counts.items() for _ in range(n)], "day string, d int, event_type string").selectExpr(
        "monotonically_increasing_id() AS event_id", "CAST(date_add(day, d - 1) AS timestamp) AS ts", "1L AS user_id", "event_type", "1.0D AS value",
        "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(40)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    best = {}
    for r in spark.read.parquet(f"{tmp_path}/part.parquet").collect():
        k, a, score = r.p_size / 51, 1 + r.p_partkey % 5 + (r.p_retailprice - 900) / 100, 0.0
        for (d, kind), n in counts.items():
            rate = 0.0021937 + 0.000031741 * d
            expected = {"view": rate * 40000 * math.exp(-0.01 * k * d), "click": 30 * k + rate * 100 * a * d, "error": 20 * a}[kind]
            score += (n - expected) ** 2 / max(expected, max(0.001, min(counts.values())))
        best[r.p_brand] = min(best.get(r.p_brand, (math.inf, 0)), (score, r.p_partkey))
    got = {r.brand: (r.score, r.candidate) for r in catalog.QUERIES["trajectory_score"](spark, str(tmp_path)).collect()}
    assert set(got) == set(best)
    for brand, (score, candidate) in best.items():
        assert got[brand][1] == candidate and abs(got[brand][0] - score) < 1e-3


def test_profile_limits_of_every_part_and_sweep_model(spark, sf):
    """Not only of the best part of each brand."""
    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    got = [(r.model_id, r.effect) for r in catalog.QUERIES["part_profile_ci"](spark, sf).collect()]
    assert sorted(got) == sorted((p, e) for p in parts for e in ("beta", "gamma"))
    fits = {r.model_id for r in catalog.QUERIES["many_model_sweep"](spark, sf).select("model_id").collect()}
    got = [(r.model_id, r.effect) for r in catalog.QUERIES["sweep_profile_ci"](spark, sf).collect()]
    assert sorted(got) == sorted((m, e) for m in fits for e in ("beta", "gamma"))


def test_limits_equal_sql_before_rounding(spark, sf):
    """Converged values, so engines agree far below the digits shown."""
    sql = catalog.ORACLES["part_profile_ci"].replace("round(lower, 3)", "lower").replace("round(upper, 3)", "upper")
    cur = connect(sf).execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in ("model_id", "effect", "lower", "upper")]
    want = {(r[at[0]], r[at[1]]): (r[at[2]], r[at[3]]) for r in cur.fetchall()}
    got = {(r.model_id, r.effect): (r.lower, r.upper) for r in profiled(spark, sf, part_models(spark, sf), 12).collect()}
    assert set(got) == set(want)
    for key, limits in want.items():
        assert got[key] == pytest.approx(limits, abs=1e-6)
