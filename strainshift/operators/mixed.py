"""Random-intercept regressions for many models, from sums per group.

With lambda the ratio of the between-group to the residual variance, every
likelihood is a closed form of the group sizes, the group means and the pooled
within-group cross-products. A model is one row that holds its groups as an array, and
everything is minimised inside the row: lambda is bracketed by a grid, then the slope of the
deviance is bisected, or a golden section closes in on a minimum, in a fixed number of steps.
Column expressions took a hundred times longer for these steps, so a task does them in numpy
for thousands of models at a time; Spark makes the sums, spreads the models and goes on.

For a fixed lambda the deviance is a parabola in each effect, so the effects it allows below
a level are an interval in closed form. A profile limit is the outermost end of these
intervals over all lambda: one more search along lambda, without steps along the effect.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strainshift.functions.labels import chi2_interval
from strainshift.functions.tail import Z_975, chi2_upper_1
from strainshift.session import task_count

# 0 and quarter decades of lambda up to 1e12, the stated bound of the ratio.
COARSE = [0.0] + [10.0 ** (i / 4) for i in range(-16, 49)]
# Halvings of a bracket down to rounding; golden steps that leave 1e-7 of it, so 1e-14 of the bend in the minimum.
HALVINGS, GOLDEN_STEPS, GOLDEN = 50, 34, 0.3819660112501051
# Collinear regressors: relative determinant below this gives no estimates.
RANK_TOLERANCE = 1e-12


def centred_groups(groups: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """Group means about the model mean, with the pooled sums of the model beside them."""
    cols = [*x, y]
    w = f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"
    out = _add(groups, {
        **{f"d_{c}": f"m_{c} - sum(n * m_{c}) {w} / sum(n) {w}" for c in cols},
        **{f"w_{a}_{b}": f"sum(c_{a}_{b}) {w}" for a, b in combinations_with_replacement(cols, 2)},
        "n_rows": f"sum(n) {w}"})
    return out.drop(*[c for c in groups.columns if c.startswith("c_")])


def selection_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """Centred groups of (x1, z, y), with the sums of x2 = z + rho x1 derived from them."""
    return _add(centred_groups(groups, by, ["x1", "z"], "y"), {
        "m_x2": "m_z + rho * m_x1", "d_x2": "d_z + rho * d_x1", "w_x1_x2": "w_x1_z + rho * w_x1_x1",
        "w_x2_x2": "w_z_z + 2 * rho * w_x1_z + rho * rho * w_x1_x1", "w_x2_y": "w_z_y + rho * w_x1_y"})


def _solve(x: list[str], y: str) -> list[dict[str, str]]:
    """SQL of slopes, Q, determinant and inverse for one or two regressors, in two steps."""
    if len(x) == 1:
        (p,) = x
        return [{"_det": f"nullif(a_{p}_{p}, 0)"},
                {f"b_{p}": f"a_{p}_{y} / _det", "_q": f"a_{y}_{y} - a_{p}_{y} * a_{p}_{y} / _det",
                 f"i_{p}": "1 / _det"}]
    p, q = x
    s11, s22, s12 = f"a_{p}_{p}", f"a_{q}_{q}", f"a_{p}_{q}"
    det = f"{s11} * {s22} - {s12} * {s12}"
    return [{"_det": f"CASE WHEN try_divide({det}, {s11} * {s22}) >= {RANK_TOLERANCE} THEN {det} END"},
            {f"b_{p}": f"({s22} * a_{p}_{y} - {s12} * a_{q}_{y}) / _det",
             f"b_{q}": f"({s11} * a_{q}_{y} - {s12} * a_{p}_{y}) / _det",
             f"i_{p}": f"{s22} / _det", f"i_{q}": f"{s11} / _det", "i_cross": f"-{s12} / _det"},
            {"_q": f"a_{y}_{y} - b_{p} * a_{p}_{y} - b_{q} * a_{q}_{y}"}]


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in columns.items()])


def evaluate(rows: DataFrame, by: list[str], x: list[str], y: str, reml: bool) -> DataFrame:
    """Deviance and estimates for each (model, lambda) of centred group rows with ``lam``."""
    cols = [*x, y]
    pairs = list(combinations_with_replacement(cols, 2))
    aggs = ["sum(_v) AS sv", "sum(ln(1 + n * lam)) AS slog", "first(n_rows) AS n_rows", "count(1) AS n_groups"]
    aggs += [f"sum(_v * d_{c}) AS s_{c}" for c in cols]
    aggs += [f"sum(_v * d_{a} * d_{b}) AS s_{a}_{b}" for a, b in pairs]
    aggs += [f"first(w_{a}_{b}) AS w_{a}_{b}" for a, b in pairs]
    out = _add(rows, {"_v": "n / (1 + n * lam)"}).groupBy(*by, "lam").agg(*map(F.expr, aggs))
    out = _add(out, {f"a_{a}_{b}": f"w_{a}_{b} + s_{a}_{b} - s_{a} * s_{b} / sv" for a, b in pairs})
    for step in _solve(x, y):
        out = _add(out, step)
    free = f"(CAST(n_rows AS DOUBLE) - {len(x) + 1 if reml else 0})"
    q = "CASE WHEN _q > 0 THEN _q END"
    extra = " + ln(sv) + ln(_det)" if reml else ""
    level = f"s_{y} / sv" + "".join(f" - b_{c} * s_{c} / sv" for c in x)
    inverse = [*x, "cross"] if len(x) == 2 else x
    return out.selectExpr(
        *by, "lam", "n_rows", "n_groups",
        f"{free} * ln(2 * pi() * {q} / {free}) + {free} + slog{extra} AS deviance",
        f"{q} / {free} AS sigma2", f"{level} AS level", *[f"b_{c}" for c in x],
        *[f"{q} / {free} * i_{c} AS var_{c}" for c in inverse])


class Models:
    """The likelihoods of many models at once: groups of all models in flat arrays, one lambda per model.

    ``at`` gives, per model, sums over groups (s), centred cross-products (a), slopes (b), the
    inverse matrix (i) and the residual sum q; with ``slope`` also h, the derivatives of a.
    Where a model has no value there is NaN.
    """

    def __init__(self, batch: pa.RecordBatch, x: list[str], y: str):
        one = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
        self.x, self.y, self.cols = x, y, [*x, y]
        self.pairs = list(combinations_with_replacement(self.cols, 2))
        groups = batch.column("_g")
        self.starts = groups.offsets.to_numpy()[:-1] - groups.offsets[0].as_py()
        fields = groups.flatten()
        field = lambda c: fields.field(c).to_numpy(zero_copy_only=False)
        self.n, self.d = field("n"), {c: field(f"d_{c}") for c in self.cols}
        self.d |= {(a, b): self.d[a] * self.d[b] for a, b in self.pairs}
        self.owner = np.repeat(np.arange(batch.num_rows), np.diff(groups.offsets.to_numpy()))
        self.w = {(a, b): one(f"w_{a}_{b}") for a, b in self.pairs}
        self.n_rows = one("n_rows")
        self.rho = one("rho") if "rho" in batch.schema.names else None

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def at(self, lam: np.ndarray, slope: bool = False) -> SimpleNamespace:
        lam = lam[self.owner]
        v = self.n / (1 + self.n * lam)
        s = {k: self.total(v * d) for k, d in self.d.items()}
        o, k = self.total(v), self.total(np.log1p(self.n * lam))
        a = {(p, q): self.w[p, q] + s[p, q] - s[p] * s[q] / o for p, q in self.pairs}
        y, r = self.y, SimpleNamespace(o=o, k=k, s=s, a=a)
        if len(self.x) == 1:
            (p,) = self.x
            r.det = np.where(a[p, p] != 0, a[p, p], np.nan)
            r.b, r.i = {p: a[p, y] / r.det}, {p: 1 / r.det}
        else:
            p, q = self.x
            det = a[p, p] * a[q, q] - a[p, q] ** 2
            r.det = np.where(det / (a[p, p] * a[q, q]) >= RANK_TOLERANCE, det, np.nan)
            r.b = {p: (a[q, q] * a[p, y] - a[p, q] * a[q, y]) / r.det, q: (a[p, p] * a[q, y] - a[p, q] * a[p, y]) / r.det}
            r.i = {p: a[q, q] / r.det, q: a[p, p] / r.det, "cross": -a[p, q] / r.det}
        r.q = a[y, y] - sum(r.b[c] * a[c, y] for c in self.x)
        if slope:
            t, u = {k: self.total(v * v * d) for k, d in self.d.items()}, self.total(v * v)
            r.u = u
            r.h = {(p, q): (t[p] * s[q] + s[p] * t[q]) / o - t[p, q] - s[p] * s[q] * u / (o * o) for p, q in self.pairs}
        return r

    def free(self, reml: bool) -> np.ndarray:
        return self.n_rows - (len(self.x) + 1 if reml else 0)

    def deviance(self, r: SimpleNamespace, reml: bool, q: np.ndarray | None = None) -> np.ndarray:
        q, free = r.q if q is None else q, self.free(reml)
        return free * np.log(2 * np.pi * np.where(q > 0, q, np.nan) / free) + free + r.k + (np.log(r.o) + np.log(r.det) if reml else 0)

    def slope(self, lam: np.ndarray, reml: bool) -> np.ndarray:
        """Derivative of the deviance by lambda."""
        r, y = self.at(lam, slope=True), self.y
        dq = r.h[y, y] - 2 * sum(r.b[c] * r.h[c, y] for c in self.x)
        dq = dq + sum((1 if p == q else 2) * r.b[p] * r.b[q] * r.h[p, q] for p, q in combinations_with_replacement(self.x, 2))
        out = self.free(reml) * dq / np.where(r.q > 0, r.q, np.nan) + r.o
        if not reml:
            return out
        if len(self.x) == 1:
            return out - r.u / r.o + r.h[self.x[0], self.x[0]] / r.det
        p, q = self.x
        return out - r.u / r.o + (r.a[q, q] * r.h[p, p] - 2 * r.a[p, q] * r.h[p, q] + r.a[p, p] * r.h[q, q]) / r.det

    def grid(self, values) -> list[np.ndarray]:
        """Each of the values (a list of arrays, from the parts at a lambda) at every lambda of the grid."""
        found = [values(self.at(np.full(len(self.starts), v))) for v in COARSE]
        return [np.array(x) for x in zip(*found)]


def bracket(on_grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid's lambdas beside the least value of each model; NaN without any."""
    best = np.argmin(np.where(np.isnan(on_grid), np.inf, on_grid), 0)
    none, lam = np.isnan(on_grid).all(0), np.array(COARSE)
    return (np.where(none, np.nan, lam[np.maximum(best - 1, 0)]), np.where(none, np.nan, lam[np.minimum(best + 1, len(lam) - 1)]))


def bisected(slope, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a falling value stops to fall; 0 where it rises from there."""
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, lo, mid), np.where(up, mid, hi)
    return np.where(lo > 0, (lo + hi) / 2, lo)


def golden(value, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value in a bracket; NaN counts as beyond everything."""
    def f(at):
        out = value(at)
        return np.where(np.isnan(out), np.inf, out)

    x1, x2 = lo + GOLDEN * (hi - lo), hi - GOLDEN * (hi - lo)
    f1, f2 = f(x1), f(x2)
    for _ in range(GOLDEN_STEPS):
        left = f1 <= f2
        lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
        kept, f_kept = np.where(left, x1, x2), np.where(left, f1, f2)
        probe = np.where(left, lo + GOLDEN * (hi - lo), hi - GOLDEN * (hi - lo))
        f_probe = f(probe)
        x1, x2 = np.where(left, probe, kept), np.where(left, kept, probe)
        f1, f2 = np.where(left, f_probe, f_kept), np.where(left, f_kept, f_probe)
    out = np.minimum(f1, f2)
    return np.where(np.isfinite(out), out, np.nan)


def in_rows(groups: DataFrame, by: list[str], x: list[str], y: str, carry: list[str] = ()) -> DataFrame:
    """One row per model, its groups an array; a model has as many groups as there are regions. The only exchange of a fit."""
    cols = [*x, y]
    group = "named_struct('n', CAST(n AS DOUBLE), " + ", ".join(f"'d_{c}', d_{c}" for c in cols) + ")"
    aggs = [f"sort_array(collect_list({group})) AS _g", "count(1) AS n_groups", "first(n_rows) AS n_rows"]
    aggs += [f"first(w_{a}_{b}) AS w_{a}_{b}" for a, b in combinations_with_replacement(cols, 2)] + [f"first({c}) AS {c}" for c in carry]
    return groups.repartition(task_count(groups.sparkSession), *by).groupBy(*by).agg(*map(F.expr, aggs))


def solved(rows: DataFrame, x: list[str], y: str, keep: list[str], names: list[str], solve) -> DataFrame:
    """The kept columns of ``in_rows`` with what solve(Models) finds for a batch of models, a dict of arrays; NaN is NULL."""
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(n, DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                with np.errstate(all="ignore"):
                    out = solve(Models(batch, x, y))
                columns = [pa.array(out[n], pa.float64(), mask=~np.isfinite(out[n])) for n in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    return rows.mapInArrow(run, schema)


def fit_models(models: Models, reml: bool) -> dict[str, np.ndarray]:
    """lam and the estimates at it."""
    (dev,) = models.grid(lambda r: [models.deviance(r, reml)])
    lam = bisected(lambda at: models.slope(at, reml), *bracket(dev))
    r = models.at(lam)
    sigma2 = np.where(r.q > 0, r.q, np.nan) / models.free(reml)
    return {"lam": lam, "deviance": models.deviance(r, reml), "sigma2": sigma2,
            "level": (r.s[models.y] - sum(r.b[c] * r.s[c] for c in models.x)) / r.o,
            **{f"b_{c}": r.b[c] for c in models.x}, **{f"var_{c}": sigma2 * i for c, i in r.i.items()}}


def _fit_names(x: list[str]) -> list[str]:
    return ["lam", "deviance", "sigma2", "level", *[f"b_{c}" for c in x], *[f"var_{c}" for c in ([*x, "cross"] if len(x) == 2 else x)]]


def best_lambda(rows: DataFrame, by: list[str], x: list[str], y: str, reml: bool) -> DataFrame:
    """Best variance ratio per model, and the deviance there."""
    return random_intercept_fit(rows, by, x, y, reml).select(*by, "lam", F.col("deviance").alias("low_deviance"))


def random_intercept_fit(rows: DataFrame, by: list[str], x: list[str], y: str, reml: bool = True, carry: list[str] = ()) -> DataFrame:
    """y ~ x + (1 | group) per model at its best variance ratio."""
    keep = [*by, "n_rows", "n_groups", *carry]
    return solved(in_rows(rows, by, x, y, carry), x, y, keep, _fit_names(x), lambda models: fit_models(models, reml))


def _effects(fits: DataFrame) -> DataFrame:
    """Both effects with errors and Wald limits; the one of x1 and its variance follow from rho."""
    rho = F.col("rho")
    fits = fits.withColumns({
        "delta_beta": F.col("b_x1") - rho * F.col("b_z"), "delta_gamma": F.col("b_z"),
        "se_beta": F.sqrt(F.col("var_x1") - 2 * rho * F.col("var_cross") + rho * rho * F.col("var_z")),
        "se_gamma": F.sqrt("var_z")})
    return fits.withColumns({
        f"delta_{e}_{lab}": F.col(f"delta_{e}") + s * Z_975 * F.col(f"se_{e}")
        for e in ("beta", "gamma") for lab, s in (("lower", -1), ("upper", 1))})


def selection_fit(rows: DataFrame, by: list[str], reml: bool = True) -> DataFrame:
    """y ~ x1 + x2 + (1 | group) from ``selection_groups``: both effects with Wald limits.

    The fit runs on (x1, z); the effect of x1 and its variance follow from rho.
    """
    return _effects(random_intercept_fit(rows, by, ["x1", "z"], "y", reml, ["rho"]))


def group_effects(rows: DataFrame, fits: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """Predicted group effects, and the level that each group's fitted rows start from."""
    gap = F.col(f"d_{y}") - F.col("level")
    base = F.col(f"m_{y}") - F.col(f"d_{y}") + F.col("level")
    for c in x:
        gap = gap - F.col(f"b_{c}") * F.col(f"d_{c}")
        base = base - F.col(f"b_{c}") * (F.col(f"m_{c}") - F.col(f"d_{c}"))
    shrink = F.col("n") * F.col("lam") / (1 + F.col("n") * F.col("lam"))
    return (rows.join(fits.select(*by, "lam", "level", *[f"b_{c}" for c in x]), by)
            .withColumns({"gap": gap, "effect": shrink * gap, "base": base})
            .withColumn("intercept", F.col("base") + F.col("effect")))


def mixed_rss(effects: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """Residual sum of squares of fitted values that include the group effects."""
    within = F.col(f"w_{y}_{y}")
    for i, a in enumerate(x):
        within = within - 2 * F.col(f"b_{a}") * F.col(f"w_{a}_{y}") \
            + F.col(f"b_{a}") * F.col(f"b_{a}") * F.col(f"w_{a}_{a}")
        for b in x[i + 1:]:
            within = within + 2 * F.col(f"b_{a}") * F.col(f"b_{b}") * F.col(f"w_{a}_{b}")
    left = F.col("gap") - F.col("effect")
    return (effects.withColumn("_within", within).groupBy(*by)
            .agg((F.first("_within") + F.sum(F.col("n") * left * left)).alias("rss")))


X1Z, SIDES = ["x1", "z"], {"lower": -1, "upper": 1}
LIMITS = [f"delta_{e}_{side}" for e in ("beta", "gamma") for side in SIDES]


def residual_sums(m: Models, r: SimpleNamespace) -> list[np.ndarray]:
    """Of the full model, and of those that keep x1 or x2 = z + rho x1 alone."""
    a, rho = r.a, m.rho
    return [r.q, a["y", "y"] - a["x1", "y"] ** 2 / a["x1", "x1"],
            a["y", "y"] - (a["z", "y"] + rho * a["x1", "y"]) ** 2 / (a["z", "z"] + 2 * rho * a["x1", "z"] + rho * rho * a["x1", "x1"])]


def tests_of(m: Models) -> dict[str, np.ndarray]:
    found = m.grid(lambda r: [m.deviance(r, False, q) for q in residual_sums(m, r)])
    full, x1, x2 = (golden(lambda at, k=k: m.deviance(r := m.at(at), False, residual_sums(m, r)[k]), *bracket(g)) for k, g in enumerate(found))
    return {"x1": np.maximum(x2 - full, 0), "x2": np.maximum(x1 - full, 0)}


def selection_lrt(rows: DataFrame, by: list[str]) -> DataFrame:
    """Likelihood-ratio tests of dropping either effect (ML deviances, 1 df)."""
    both = solved(in_rows(rows, by, X1Z, "y", ["rho"]), X1Z, "y", by, ["x1", "x2"], tests_of)
    return (both.selectExpr(*by, "inline(array(named_struct('dropped', 'x1', 'chi2', x1), named_struct('dropped', 'x2', 'chi2', x2)))")
            .withColumns({"p": chi2_upper_1("chi2"), "signif": chi2_interval(F.col("chi2"))}))


def reaches(m: Models, r: SimpleNamespace, level: np.ndarray) -> list[np.ndarray]:
    """Each effect that a lambda allows below the level, from either side, to be minimised; beyond the level, how far it is missed."""
    top = m.n_rows / (2 * np.pi) * np.exp((level - m.n_rows - r.k) / m.n_rows)
    effects = ((r.b["x1"] - m.rho * r.b["z"], r.i["x1"] - 2 * m.rho * r.i["cross"] + m.rho ** 2 * r.i["z"]), (r.b["z"], r.i["z"]))
    return [np.where(r.q <= top, -sign * estimate - np.sqrt(np.maximum(inverse * (top - r.q), 0)), 1e30 * (r.q - top) / top)
            for estimate, inverse in effects for sign in SIDES.values()]


def limits_of(m: Models) -> dict[str, np.ndarray]:
    (dev,) = m.grid(lambda r: [m.deviance(r, False)])
    level = golden(lambda at: m.deviance(m.at(at), False), *bracket(dev)) + Z_975 ** 2
    found = m.grid(lambda r: reaches(m, r, level))
    return {name: -sign * golden(lambda at, k=k: reaches(m, m.at(at), level)[k], *bracket(g))
            for k, (name, sign, g) in enumerate(zip(LIMITS, 2 * [*SIDES.values()], found))}


def profile_limits(rows: DataFrame, by: list[str]) -> DataFrame:
    """95 % limits of both effects by profile likelihood: where the deviance has risen by the chi-square point.

    They are the outermost effects of the likelihood region. A model without a fit has none.
    """
    df = solved(in_rows(rows, by, X1Z, "y", ["rho"]), X1Z, "y", by, LIMITS, limits_of)
    both = ", ".join(f"named_struct('effect', '{e}', 'lower', delta_{e}_lower, 'upper', delta_{e}_upper)" for e in ("beta", "gamma"))
    known = F.when(F.col("lower").isNotNull() & F.col("upper").isNotNull(), "bracketed").otherwise("no fit")
    return df.selectExpr(*by, f"inline(array({both}))").withColumns({"ci_method": F.lit("profile"), "status": known})


def selection_fit_profiled(rows: DataFrame, by: list[str]) -> DataFrame:
    """``selection_fit`` by REML, with profile limits in the place of the Wald ones, from one row per model."""
    names = [*_fit_names(X1Z), *LIMITS]
    fits = solved(in_rows(rows, by, X1Z, "y", ["rho"]), X1Z, "y", [*by, "n_rows", "n_groups", "rho"], names, lambda m: fit_models(m, True) | limits_of(m))
    return _effects(fits.withColumnsRenamed({n: f"_{n}" for n in LIMITS})).withColumns({n: F.col(f"_{n}") for n in LIMITS}).drop(*[f"_{n}" for n in LIMITS])
