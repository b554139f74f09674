"""Scalar transforms between bounded parameters and the real line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical parameter order of every fit table.
CANONICAL_PARAMETERS = (
    "pS", "pE", "pIA", "pISr", "pISd", "beta", "gamma", "exit_rate", "kappa",
    "k", "a", "omega", "p", "rho", "eta", "mu",
)

# The scale on which each parameter is searched.
LOG_PARAMETERS = ("beta", "gamma", "kappa", "a")
LOGIT_PARAMETERS = ("pS", "exit_rate", "k", "omega", "rho", "eta", "mu")
INTERVAL_PARAMETERS = {
    "pE": (0.0, 0.01), "pIA": (0.0, 0.01), "pISr": (0.0, 0.01), "pISd": (0.0, 0.01),
    "p": (0.0, 0.2),
}


def logit(p: Column) -> Column:
    """ln(p/(1-p)) inside ]0,1[; NULL at the bounds and outside."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_ab(x: Column, a: float, b: float, strict: bool = False) -> Column:
    """]a,b[ to the real line; out of range is NULL, or an error when strict."""
    inside = F.when((x > a) & (x < b), F.ln((x - a) / (b - x)))
    if not strict:
        return inside
    message = F.format_string(f"%s is not between {a} and {b}", x.cast("string"))
    return F.when((x < a) | (x > b), F.raise_error(message).cast("double")).otherwise(inside)


def inv_log_ab(y: Column, a: float, b: float) -> Column:
    """The real line to ]a,b[; large values reach b without overflow."""
    return a + (b - a) / (1 + F.exp(-y))


def to_real(name: str, value: Column) -> Column:
    if name in LOG_PARAMETERS:
        return F.when(value > 0, F.ln(value))
    if name in LOGIT_PARAMETERS:
        return logit(value)
    return log_ab(value, *INTERVAL_PARAMETERS[name])


def from_real(name: str, value: Column) -> Column:
    if name in LOG_PARAMETERS:
        return F.exp(value)
    if name in LOGIT_PARAMETERS:
        return inv_logit(value)
    return inv_log_ab(value, *INTERVAL_PARAMETERS[name])


def parameters_in(df: DataFrame) -> list[str]:
    return [c for c in CANONICAL_PARAMETERS if c in df.columns]


def params_to_real(df: DataFrame) -> DataFrame:
    """Move every parameter column of a table to its search scale."""
    return df.withColumns({c: to_real(c, F.col(c)) for c in parameters_in(df)})


def params_from_real(df: DataFrame) -> DataFrame:
    return df.withColumns({c: from_real(c, F.col(c)) for c in parameters_in(df)})


def canonical_order(df: DataFrame) -> DataFrame:
    """Identifying columns first, then the parameters in canonical order."""
    params = parameters_in(df)
    return df.select(*[c for c in df.columns if c not in params], *params)
