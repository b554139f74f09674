"""Labels, significance codes and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Optimiser codes and their texts.
CONVERGENCE_TEXT = {
    0: "Successful completion",
    1: "iteration limit had been reached",
    10: "Degeneracy of the Nelder-Mead simplex",
}
# P-value cuts and codes; a value equal to a cut belongs below it.
SIGNIFICANCE_CODES = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."), (1.0, " "))
# P-value cuts and intervals; a value equal to a cut belongs above it.
P_INTERVALS = (
    (0.001, "p < 0.001 (***)"), (0.01, "0.001 < p < 0.01 (**)"),
    (0.05, "0.01 < p < 0.05 (*)"), (1.0, "p > 0.05 ( )"),
)
# Chi-square (1 df) values that cut the same p-values.
CHI2_CUTS = ((10.827566170662733, "p < 0.001 (***)"), (6.634896601021213, "0.001 < p < 0.01 (**)"),
             (3.841458820694124, "0.01 < p < 0.05 (*)"))
ZERO_TOLERANCE = 1.5e-8


def convergence_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, text in CONVERGENCE_TEXT.items():
        out = F.when(code == value, text).otherwise(out)
    return out


def fixed_digits(x: Column, digits: int) -> Column:
    """|x| with a fixed number of decimals, rounded on the exact binary value, halves to even.

    The product with a power of ten is split into two exact parts, so that a value
    just below a half is not taken for the half.
    """
    size, scale = F.abs(x), float(10 ** digits)
    high = size.cast("float").cast("double")
    whole = F.floor(size * scale)
    above = (high * (2 * scale) - (2 * whole + 1)) + (size - high) * (2 * scale)
    up = (above > 0) | ((above == 0) & (whole % 2 == 1))
    units = (whole + F.when(up, 1).otherwise(0)).cast("long")
    if digits == 0:
        return units.cast("string")
    step = F.lit(10 ** digits)
    return F.concat(F.floor(units / step).cast("string"), F.lit("."),
                    F.lpad((units % step).cast("string"), digits, "0"))


def signed_label(x: Column, digits: int = 2) -> Column:
    """'+20' or '-10'; a value that equals zero gets a space for its sign."""
    positive = F.when(F.abs(x) < ZERO_TOLERANCE, " ").otherwise("+")
    return F.concat(F.when(x < 0, "-").otherwise(positive), fixed_digits(x, digits))


def perturbation_label(value: Column, ref: Column) -> Column:
    """'2.25 (-10%)'; the reference value stands without a suffix."""
    percent = signed_label(100 * (value - ref) / ref, 0)
    shown = plain_number(value)
    return F.when(percent == " 0", shown).otherwise(F.concat(shown, F.lit(" ("), percent, F.lit("%)")))


def plain_number(x: Column) -> Column:
    """A number without trailing zeros, at most six decimals."""
    fixed = F.format_string("%.6f", x)
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "")


def significance_code(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for cut, code in reversed(SIGNIFICANCE_CODES):
        out = F.when(p <= cut, code).otherwise(out)
    return F.when(p > 0, out)


def p_interval(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for cut, text in reversed(P_INTERVALS):
        out = F.when(p < cut, text).otherwise(out)
    return out


def chi2_interval(stat: Column) -> Column:
    """The interval of the p-value, read from the test statistic itself."""
    out = F.lit(P_INTERVALS[-1][1])
    for cut, text in reversed(CHI2_CUTS):
        out = F.when(stat > cut, text).otherwise(out)
    return F.when(stat.isNotNull(), out)


def signif(x: Column, digits: int = 3) -> Column:
    """Round to a number of significant digits."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power, 0) / power)


def floor_to(x: Column, step: float) -> Column:
    return F.floor(x / step) * step
