"""Many regressions at once, from sums per group."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from strainshift.functions import control as C
from strainshift.functions.labels import significance_code
from strainshift.functions.tail import Z_975, f_upper, t_quantile_975, t_two_sided
from strainshift.operators.expand import ARRAY_ROWS, expand_by, small_table
from strainshift.operators.integral import prefix_integrals, segment_weights
from strainshift.operators.summaries import pearson
from strainshift.session import task_count

# Collinear regressors: relative determinant below this gives no estimates.
RANK_TOLERANCE = 1e-12
# A curve holds two values per period, so fewer of them fit in one array.
CURVES_PER_ARRAY = 2_000
# Values of models times days, or models times cells, that a task works on at once; they fit a core's cache.
STEP_VALUES = 100_000

FIXED_DEFAULTS = {"kappa": C.KAPPA, "beta_w": C.BETA_W, "gamma_w": C.GAMMA_W, "sn": C.SUSCEPTIBLE}


def evaluation_points(panel: DataFrame) -> DataFrame:
    """Distinct times of the panel, numbered in order; one row per period."""
    return panel.select("t").distinct().withColumn("j", F.row_number().over(W.orderBy("t")))


def panel_cells(panel: DataFrame) -> DataFrame:
    """Rows of the panel with the numbers j and j0 of their time and of the first time of their region."""
    points = evaluation_points(panel)
    start = panel.groupBy("region").agg(F.min("t").alias("t0"))
    return (panel.join(start, "region").join(points, "t")
            .join(points.select(F.col("t").alias("t0"), F.col("j").alias("j0")), "t0")
            .select("region", "t", "t0", "j", "j0", "y"))


def logit_regressors(models: DataFrame, panel: DataFrame, control: DataFrame,
                     panel_rows: int = ARRAY_ROWS, nested: bool = False) -> DataFrame:
    """Both regressors for every model and every region-period.

    ``models`` has model_id, k, a and optionally kappa, beta_w, gamma_w and sn;
    ``panel`` has region, t, y; ``control`` has day_idx, psi. The integrals run from
    the first retained time of the region. The only exchange of model rows is the
    first one, by model_id.

    Both regressors follow time closely. ``z = x2 - rho x1``, with one rho per model,
    takes that common part out while it still is exact, so that sums over (x1, z)
    can be solved for the slopes of (x1, x2) without loss.

    ``nested`` leaves a model one row: model_id, rho and ``_p``, both integrals from 0 to every
    time of the panel in order. ``model_groups`` sums it up together with the panel.
    """
    given = {n: F.col(n) if n in models.columns else F.lit(v) for n, v in FIXED_DEFAULTS.items()}
    spread = (models.select("model_id", "k", "a", *[c.alias(n) for n, c in given.items()])
              .repartition(task_count(models.sparkSession), "model_id"))
    if nested:
        return nested_integrals(spread, evaluation_points(panel), control)
    points, cells = evaluation_points(panel), panel_cells(panel)
    fixed = {n: F.col(n) for n in FIXED_DEFAULTS}
    kappa, gap = F.col("kappa"), F.col("kappa") - F.col("gamma_w")
    prefix = prefix_integrals(spread, segment_weights(points, control), {
        "x1": kappa * F.col("sn") * F.col("f1"), "x2": -0.5 * (gap * F.col("f2") + 1)}, fixed)
    curves = prefix.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("j", "x1", "x2"))).alias("_p"))
    # over the whole period the second regressor is close to a multiple of the first
    last = F.element_at("_p", -1)
    ratio = F.try_divide(last["x2"], F.nullif(last["x1"], F.lit(0.0)))
    curves = curves.withColumn("rho", F.coalesce(ratio, F.lit(0.0)))
    return _design_rows(curves, cells, panel.count(), panel_rows)


def _design_rows(curves: DataFrame, cells: DataFrame, n_cells: int, panel_rows: int) -> DataFrame:
    # a panel too large for one array stays distributed and takes up the models instead
    rows = (expand_by(curves, cells, rows=n_cells) if n_cells <= panel_rows
            else expand_by(cells, curves, limit=CURVES_PER_ARRAY))
    here, start_at = F.element_at("_p", F.col("j")), F.element_at("_p", F.col("j0"))
    return (rows.select("model_id", "region", "t", "y", "rho",
                        (here["x1"] - start_at["x1"]).alias("x1"), (here["x2"] - start_at["x2"]).alias("x2"))
            .withColumn("z", F.col("x2") - F.col("rho") * F.col("x1")))


def nested_integrals(spread: DataFrame, points: DataFrame, control: DataFrame) -> DataFrame:
    """``logit_regressors`` in its nested form, for models that are partitioned by model_id.

    A model meets a few thousand days and keeps two numbers per period, so a task takes some
    hundred models at a time through them in numpy; as rows the days cost some fifty times as
    much. The weights are bounded by the calendar. Rows of one model_id add up, as in
    ``prefix_integrals``; they are next to each other in a sorted task, so no model is gathered.
    """
    weights = small_table(segment_weights(points, control)).sort_by("j")
    psi, missing = _numbers(weights.column("psi"))
    weight, j = weights.column("weight").to_numpy(), weights.column("j").to_numpy()
    starts = np.flatnonzero(np.diff(j, prepend=j[:1] - 1))
    periods, step = len(starts), max(1, STEP_VALUES // max(1, len(j)))
    curve = ArrayType(StructType([StructField("x1", DoubleType()), StructField("x2", DoubleType())]))
    schema = StructType([spread.schema["model_id"], StructField("_p", curve), StructField("rho", DoubleType())])

    def integrals(batch):
        """Integrals over each gap between two times, and whether they are known."""
        cols = {c: _numbers(batch.column(c)) for c in ("k", "a", *FIXED_DEFAULTS)}
        k, a, kappa, beta, gamma, sn = (v[:, None] for v, _ in cols.values())
        no_k, no_a, no_kappa, _, no_gamma, no_sn = (n for _, n in cols.values())
        gap = kappa - gamma
        c = k * np.power(psi / 100, a)
        c[:, missing] = 0.0
        c[no_k | no_a] = 0.0
        h = np.sqrt(gap * gap + 4 * kappa * (1 - c) * beta * sn)
        h[~(h > 0)] = np.nan
        values = kappa * sn * ((1 - c) / h), -0.5 * (gap * (1 / h) + 1)
        known = ~(no_kappa | no_sn), ~(no_kappa | no_gamma)
        return [np.where(f[:, None], np.add.reduceat(weight * v, starts, axis=1), 0.0) for v, f in zip(values, known)], known

    def curves(ids, sums, known):
        (x1, x2), rows = (np.cumsum(s, axis=1) for s in sums), len(ids)
        both = known[0] & known[1] & (x1[:, -1] != 0)
        rho = np.where(both, np.divide(x2[:, -1], x1[:, -1], where=both, out=np.zeros(rows)), 0.0)
        fields = [pa.array(x.ravel(), pa.float64(), mask=np.repeat(~f, periods)) for x, f in zip((x1, x2), known)]
        p = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * periods, pa.StructArray.from_arrays(fields, ["x1", "x2"]))
        return pa.RecordBatch.from_arrays([ids, p, pa.array(rho)], schema.names)

    def run(batches):
        held = None  # the last model, until another one follows
        for batch in batches:
            for first in range(0, batch.num_rows if periods else 0, step):
                piece = batch.slice(first, step)
                ids = piece.column("model_id")
                with np.errstate(all="ignore"):
                    sums, known = integrals(piece)
                if held:
                    ids = pa.concat_arrays([held[0], ids])
                    sums, known = ([np.concatenate(x) for x in zip(a, b)] for a, b in zip(held[1:], (sums, known)))
                code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
                at = np.flatnonzero(np.diff(code, prepend=-1))
                ids = ids.take(pa.array(at))
                sums, known = [np.add.reduceat(s, at) for s in sums], [np.logical_or.reduceat(f, at) for f in known]
                if len(at) > 1:
                    with np.errstate(all="ignore"):
                        yield curves(ids[:-1], [s[:-1] for s in sums], [f[:-1] for f in known])
                held = ids[-1:], [s[-1:] for s in sums], [f[-1:] for f in known]
        if held:
            with np.errstate(all="ignore"):
                yield curves(*held)

    return spread.sortWithinPartitions("model_id").mapInArrow(run, schema)


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column as doubles, NULL as NaN, and where it is NULL."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def group_sums(df: DataFrame, by: list[str], group: str, x: list[str], y: str,
               carry: list[str] = ()) -> DataFrame:
    """Size, means and centred cross-products per group (``c_a_b``, ``m_a``).

    ``carry`` names columns that are constant within a model.
    """
    cols = [*x, y]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in carry]]
    aggs += [F.avg(c).alias(f"m_{c}") for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append((F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"c_{a}_{b}"))
    return df.groupBy(*by, group).agg(*aggs)


def model_groups(design: DataFrame, by: list[str] = ("model_id",), panel: DataFrame | None = None,
                 panel_rows: int = ARRAY_ROWS) -> DataFrame:
    """Group sums of a design of ``logit_regressors``; a nested one needs the panel that it was made for."""
    if panel is not None:
        cells = panel_cells(panel)
        n_cells = panel.count()
        if n_cells <= panel_rows and panel.filter("y IS NULL").isEmpty():
            return _nested_groups(design, cells)
        design = _design_rows(design, cells, n_cells, panel_rows)
    return group_sums(design, list(by), "region", ["x1", "z"], "y", carry=["rho"])


def _nested_groups(curves: DataFrame, cells: DataFrame) -> DataFrame:
    """``group_sums`` of the rows of a nested design, which are made and summed some hundred models at a time."""
    cells = small_table(cells).sort_by("region")
    at, at0 = (cells.column(c).to_numpy() - 1 for c in ("j", "j0"))
    y, code = cells.column("y").to_numpy(), cells.column("region").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    regions, n = cells.column("region").combine_chunks().take(pa.array(starts)), np.diff(starts, append=len(code))
    groups, step = len(starts), max(1, STEP_VALUES // max(1, len(code)))
    owner = np.repeat(np.arange(groups), n)
    pairs = list(combinations_with_replacement(("x1", "z", "y"), 2))
    double = [StructField(c, DoubleType()) for c in ("rho", "m_x1", "m_z", "m_y", *[f"c_{a}_{b}" for a, b in pairs])]
    schema = StructType([curves.schema["model_id"], StructField("region", StringType()), StructField("n", LongType()), *double])

    def summed(batch):
        p, rows = batch.column("_p").flatten(), batch.num_rows
        (p1, no_x1), (p2, no_x2) = ([x.reshape(rows, -1) for x in _numbers(p.field(c))] for c in ("x1", "x2"))
        no_x1, no_z = no_x1[:, 0], no_x1[:, 0] | no_x2[:, 0]
        rho = batch.column("rho").to_numpy()
        x1 = p1[:, at] - p1[:, at0]
        x = {"x1": x1, "z": p2[:, at] - p2[:, at0] - rho[:, None] * x1, "y": np.broadcast_to(y, x1.shape)}
        mean = {c: np.add.reduceat(v, starts, axis=1) / n for c, v in x.items()}
        gap = {c: v - mean[c][:, owner] for c, v in x.items()}
        out = {"rho": np.repeat(rho, groups), **{f"m_{c}": v for c, v in mean.items()},
               **{f"c_{a}_{b}": np.add.reduceat(gap[a] * gap[b], starts, axis=1) for a, b in pairs}}
        none = {"x1": no_x1, "z": no_z, "y": np.zeros(rows, bool), "rho": np.zeros(rows, bool)}
        null = {f"m_{c}": f for c, f in none.items()} | {f"c_{a}_{b}": none[a] | none[b] for a, b in pairs} | {"rho": none["rho"]}
        columns = [batch.column("model_id").take(pa.array(np.repeat(np.arange(rows), groups))),
                   regions.take(pa.array(np.tile(np.arange(groups), rows))), pa.array(np.tile(n, rows), pa.int64())]
        columns += [pa.array(out[f.name].ravel(), pa.float64(), mask=np.repeat(null[f.name], groups)) for f in double]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows if groups else 0, step):
                with np.errstate(all="ignore"):
                    yield summed(batch.slice(first, step))

    return curves.mapInArrow(run, schema)


def pooled(groups: DataFrame, by: list[str], x: list[str], y: str, carry: list[str] = ()) -> DataFrame:
    """Within-group cross-products summed over groups."""
    cols = [*x, y]
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), *[F.first(c).alias(c) for c in carry]]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(f"c_{a}_{b}").alias(f"c_{a}_{b}"))
    return groups.groupBy(*by).agg(*aggs)


def ancova_fit(groups: DataFrame, by: list[str]) -> DataFrame:
    """y ~ group + x1 + x2 per model: slopes, standard errors, 95 % limits, RSS.

    ``groups`` holds the sums of (x1, z, y) and rho. Collinear regressors give NULL
    estimates and the flag ``rank_deficient``.
    """
    s = pooled(groups, by, ["x1", "z"], "y", carry=["rho"])
    s11, szz, s1z = F.col("c_x1_x1"), F.col("c_z_z"), F.col("c_x1_z")
    s1y, szy, syy, rho = F.col("c_x1_y"), F.col("c_z_y"), F.col("c_y_y"), F.col("rho")
    s22 = szz + 2 * rho * s1z + rho * rho * s11
    # x2 is z plus a multiple of x1, so both pairs have the same determinant
    bad = F.coalesce(F.try_divide(s11 * szz - s1z * s1z, s11 * s22) < RANK_TOLERANCE, F.lit(True))
    s = (s.withColumns({"rank_deficient": bad, "df": F.col("n") - F.col("n_groups") - 2,
                        "_det": F.when(~bad, s11 * szz - s1z * s1z)})
         .withColumns({"_b1": (szz * s1y - s1z * szy) / F.col("_det"),
                       "delta_gamma": (s11 * szy - s1z * s1y) / F.col("_det")})
         .withColumns({"delta_beta": F.col("_b1") - rho * F.col("delta_gamma"),
                       "rss": syy - F.col("_b1") * s1y - F.col("delta_gamma") * szy})
         .withColumn("_var", F.when(F.col("df") > 0, F.greatest("rss", F.lit(0.0)) / F.col("df")))
         .withColumns({"se_beta": F.sqrt(F.col("_var") * s22 / F.col("_det")),
                       "se_gamma": F.sqrt(F.col("_var") * s11 / F.col("_det")),
                       "_t": t_quantile_975(F.col("df"))}))
    limits = {f"delta_{e}_{lab}": F.col(f"delta_{e}") + sign * F.col("_t") * F.col(f"se_{e}")
              for e in ("beta", "gamma") for lab, sign in (("lower", -1), ("upper", 1))}
    return s.withColumns(limits).select(
        *by, "n", "n_groups", "df", "rank_deficient", "delta_beta", "delta_gamma",
        "se_beta", "se_gamma", *limits, "rss")


def ancova_intercepts(groups: DataFrame, fits: DataFrame, by: list[str], group: str) -> DataFrame:
    """Intercept per group, and its difference to the first group by name."""
    m_x2 = F.col("m_z") + F.col("rho") * F.col("m_x1")
    level = F.col("m_y") - F.col("delta_beta") * F.col("m_x1") - F.col("delta_gamma") * m_x2
    w = W.partitionBy(*by).orderBy(group)
    return (groups.join(fits.select(*by, "delta_beta", "delta_gamma"), by)
            .withColumn("intercept", level)
            .select(*by, group, "delta_beta", "delta_gamma", "intercept",
                    (F.col("intercept") - F.first("intercept").over(w)).alias("effect")))


def fitted_rows(design: DataFrame, levels: DataFrame, by: list[str], group: str) -> DataFrame:
    """Fitted value and residual per row from slopes and group levels."""
    fit = F.col("intercept") + F.col("delta_beta") * F.col("x1") + F.col("delta_gamma") * F.col("x2")
    return (design.join(levels.drop("effect"), [*by, group]).withColumn("fitted", fit)
            .withColumn("residual", F.col("y") - F.col("fitted"))
            .drop("intercept", "delta_beta", "delta_gamma"))


def nested_f_test(groups: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """s ~ group, + x, and group * x: residual sums and both F statistics.

    A group in which x does not vary has a level but no slope of its own.
    """
    sxx, sxy, syy = F.col(f"c_{x}_{x}"), F.col(f"c_{x}_{y}"), F.col(f"c_{y}_{y}")
    mean = F.col(f"m_{x}")
    varied = sxx > RANK_TOLERANCE * (sxx + F.col("n") * mean * mean)
    s = groups.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.count(F.when(varied, 1)).alias("_gx"), F.sum(syy).alias("rss1"),
        F.sum(F.when(varied, sxx)).alias("_xx"), F.sum(F.when(varied, sxy)).alias("_xy"),
        F.sum(syy - F.when(varied, sxy * sxy / sxx).otherwise(0.0)).alias("rss3"))
    s = s.withColumn("rss2", F.col("rss1") - F.coalesce(F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0)))
    n, g, gx, r1, r2, r3 = (F.col(c) for c in ("n", "g", "_gx", "rss1", "rss2", "rss3"))
    zero, none = F.lit(0.0), F.lit(0)
    df_12 = F.when(gx > 0, 1).otherwise(0)
    df_2, df_23, df_3 = n - g - df_12, gx - df_12, n - g - gx
    test = s.select(
        *by, "n", "g", "rss1", "rss2", "rss3",
        df_12.alias("df_12"), df_2.alias("df_2"), df_23.alias("df_23"), df_3.alias("df_3"),
        F.try_divide((r1 - r2) / F.nullif(df_12, none), F.nullif(r2 / F.nullif(df_2, none), zero)).alias("f_12"),
        F.try_divide((r2 - r3) / F.nullif(df_23, none), F.nullif(r3 / F.nullif(df_3, none), zero)).alias("f_23"))
    return test.withColumns({"p_12": f_upper("f_12", "df_12", "df_2"), "p_23": f_upper("f_23", "df_23", "df_3")})


def slopes_by_group(groups: DataFrame, by: list[str], group: str, x: str, y: str) -> DataFrame:
    """Line per group, the coefficients of the full interaction model, with error, t and p.

    The residual variance is that of all groups of a model together.
    """
    sxx, sxy, syy, mean, n = (F.col(c) for c in (f"c_{x}_{x}", f"c_{x}_{y}", f"c_{y}_{y}", f"m_{x}", "n"))
    model = W.partitionBy(*by)  # a row per group
    varied = sxx > RANK_TOLERANCE * (sxx + n * mean * mean)
    slope = F.when(varied, sxy / sxx)
    lines = groups.withColumns({"slope": slope, "_own": syy - F.coalesce(slope * sxy, F.lit(0.0))}).withColumns({
        "intercept": F.col(f"m_{y}") - F.col("slope") * mean,
        "df": (F.sum("n").over(model) - F.count(F.lit(1)).over(model) - F.count("slope").over(model)).cast("long"),
        "_rss": F.sum("_own").over(model)})
    lines = lines.withColumn("_var", F.when(F.col("df") > 0, F.col("_rss") / F.col("df"))).withColumns({
        "se_slope": F.sqrt(F.col("_var") / F.when(varied, sxx)),
        "se_intercept": F.sqrt(F.col("_var") * (1 / n + mean * mean / F.when(varied, sxx)))})
    for c in ("slope", "intercept"):
        lines = lines.withColumn(f"t_{c}", F.try_divide(F.col(c), F.nullif(F.col(f"se_{c}"), F.lit(0.0))))
        lines = lines.withColumn(f"p_{c}", t_two_sided(f"t_{c}", "df"))
    return lines.select(*by, group, "n", "df", "slope", "intercept", *[f"{k}_{c}" for k in ("se", "t", "p") for c in ("slope", "intercept")])


def atanh(r: Column) -> Column:
    return 0.5 * F.ln((1 + r) / (1 - r))


def tanh(z: Column) -> Column:
    return F.tanh(z)


def corr_test(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation per group with Fisher limits, t statistic, p-value and its code.

    Fewer than four pairs give no limits; a perfect correlation gives no statistic.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.groupBy(*by).agg(F.count(F.when(both, 1)).alias("n"), pearson(F.col(x), F.col(y)).alias("r"))
    r, n = F.col("r"), F.col("n")
    usable = (n >= 4) & (F.abs(r) < 1)
    z = F.when(usable, atanh(r))
    half = Z_975 / F.sqrt(F.when(n >= 4, n - 3))
    s = s.withColumn("t_stat", F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r))))
    if by:  # a row per group is few bytes but some hundred steps of a fraction
        s = s.repartition(task_count(df.sparkSession), *by)
    s = s.withColumn("p", t_two_sided("t_stat", n - 2))
    return s.select(
        *by, "n", "r", tanh(z - half).alias("ci_lower"), tanh(z + half).alias("ci_upper"),
        "t_stat", F.when(n > 2, n - 2).alias("df"), "p", significance_code(F.col("p")).alias("code"))


def national_trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
                               F.regr_slope(y, x).alias("slope"),
                               F.regr_intercept(y, x).alias("intercept"),
                               F.regr_r2(y, x).alias("r2"))
