"""Row-level operators: filters, derived columns, recoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters that are varied, and the multipliers of each sweep.
SWEEP_MULTIPLIERS = (0.8, 0.9, 1.0, 1.1, 1.2)


def entity_filter(df: DataFrame, column: str, entity: str, rename: dict[str, str]) -> DataFrame:
    """Rows of one entity, with the columns of ``rename`` under their new names."""
    return df.filter(F.col(column) == entity).select(
        *[F.col(f"`{old}`").alias(new) for old, new in rename.items()])


def derive_complement(df: DataFrame, total: str, part: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(total) - F.col(part))


def date_window(df: DataFrame, day: Column, periods: DataFrame, period: str,
                before: int = 7, after: int = 6) -> DataFrame:
    """Days from ``before`` days ahead of the first period to ``after`` past the last.

    ``day`` may be a date or a timestamp: it is compared as it is, so that both
    bounds reach the scan.
    """
    first = periods.agg(F.date_sub(F.min(period), before)).scalar()
    end = periods.agg(F.date_add(F.max(period), after + 1)).scalar()
    return df.filter((day >= first) & (day < end))


def threshold_filter(df: DataFrame, column: str, threshold: float, inclusive: bool = True) -> DataFrame:
    c = F.col(column)
    return df.filter(c >= threshold if inclusive else c > threshold)


def threshold_modes(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows that reach the threshold ('at least') and rows that exceed it ('above'), from one pass."""
    c = F.col(column)
    modes = F.array_compact(F.array(F.when(c >= threshold, "at least"), F.when(c > threshold, "above")))
    return df.withColumn("mode", F.explode(modes))


def converged_filter(df: DataFrame, label: str = "convergence", value: str = "value",
                     success: str = "Successful completion") -> DataFrame:
    return df.filter((F.col(label) == success) & F.col(value).isNotNull())


def drop_na_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in the given columns (any column by default)."""
    return df.dropna(how="any", subset=subset or df.columns)


def split_origin(df: DataFrame, origin: str = "origin") -> dict[str, DataFrame]:
    return {name: df.filter(F.col(origin) == name) for name in ("observed", "best", "replicate")}


def exclude_category(df: DataFrame, column: str, category: str) -> DataFrame:
    """Everything but one category; rows without a category stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) != category))


def exclude_ids(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key).distinct(), key, "left_anti")


def clamp_floor(x: Column, floor: float = 0.0) -> Column:
    """Raise values below the floor; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def cross_sweep(df: DataFrame, defaults: dict[str, Column], upper: dict[str, float]) -> DataFrame:
    """One row per varied parameter and multiplier, the other parameters at default.

    ``upper`` holds the largest admissible value of a parameter, where it has one.
    """
    variants = F.array(*[
        F.struct(F.lit(name).alias("fixed_parm"), F.lit(m).alias("multiplier"))
        for name in defaults for m in SWEEP_MULTIPLIERS])
    out = df.select(*df.columns, *[c.alias(f"default_{n}") for n, c in defaults.items()],
                    F.inline(variants))
    values = {
        name: F.when(F.col("fixed_parm") == name, F.col(f"default_{name}") * F.col("multiplier"))
        .otherwise(F.col(f"default_{name}")) for name in defaults}
    out = out.withColumns(values).drop(*[f"default_{n}" for n in defaults])
    for name, bound in upper.items():
        out = out.filter(F.col(name) <= bound)
    return out


def param_override(df: DataFrame, name_col: str, value_col: str, defaults: dict[str, float]) -> DataFrame:
    """Default parameter columns, with the named one replaced by its value."""
    return df.withColumns({
        name: F.when(F.col(name_col) == name, F.col(value_col)).otherwise(F.lit(default))
        for name, default in defaults.items()})


def recode_param(df: DataFrame, name_col: str, value_col: str, old: str, new: str, scale: float) -> DataFrame:
    """Give one varied parameter another name and scale its values."""
    hit = F.col(name_col) == old
    return df.withColumns({
        value_col: F.when(hit, F.col(value_col) * scale).otherwise(F.col(value_col)),
        name_col: F.when(hit, F.lit(new)).otherwise(F.col(name_col))})
