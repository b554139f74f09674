"""The second step as one call: regress logit frequencies on both control integrals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainshift.operators import mixed, regression
from strainshift.session import materialise

ESTIMATES = ["delta_beta", "delta_beta_lower", "delta_beta_upper", "delta_gamma", "delta_gamma_lower", "delta_gamma_upper", "rss"]


def fit_selection_models(models: DataFrame, panel: DataFrame, control: DataFrame, method: str = "lmer",
                         interval: str = "profile") -> dict[str, DataFrame]:
    """Fit every (k, a) row of ``models``; returns the tables ``design``, ``estimates`` and ``fitted``.

    ``method`` is 'lm' (a level per region) or 'lmer' (a random level per region).
    ``interval`` of the latter is 'wald' or 'profile'. ``panel`` has region, t and y,
    where t counts days from the first day of ``control``.
    """
    if method not in ("lm", "lmer"):
        raise ValueError(f"unknown method {method!r}: 'lm' fits a level per region, 'lmer' a random one")
    if interval not in ("wald", "profile"):
        raise ValueError("interval must be 'wald' or 'profile'")
    by = ["model_id"]
    design = regression.logit_regressors(models, panel, control)
    groups = materialise(regression.model_groups(design))
    if method == "lm":
        fits = regression.ancova_fit(groups, by)
        levels = regression.ancova_intercepts(groups, fits, by, "region")
    else:
        rows = materialise(mixed.selection_groups(groups, by))
        fits = materialise((mixed.selection_fit_profiled if interval == "profile" else mixed.selection_fit)(rows, by))
        effects = mixed.group_effects(rows, fits, by, ["x1", "z"], "y")
        levels = effects.select("model_id", "region", (F.col("b_x1") - F.col("rho") * F.col("b_z")).alias("delta_beta"),
                                F.col("b_z").alias("delta_gamma"), "intercept", "effect")
        fits = fits.join(mixed.mixed_rss(effects, by, ["x1", "z"], "y"), by)
    return {"design": design, "estimates": fits.select(*by, *ESTIMATES),
            "fitted": regression.fitted_rows(design, levels, by, "region")}
