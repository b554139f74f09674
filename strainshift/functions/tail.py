"""Tail probabilities and t quantiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 97.5 % points of Student's t for 1 to 29 degrees of freedom.
T_975 = (
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987,
    2.5705818366147395, 2.4469118511449692, 2.3646242515927844, 2.3060041352041662,
    2.2621571627409915, 2.2281388519649385, 2.2009851600829502, 2.1788128296634177,
    2.1603686564610127, 2.1447866879178044, 2.131449545559323, 2.1199052992210112,
    2.1098155778331806, 2.10092204024096, 2.093024054408263, 2.0859634472658364,
    2.079613844727662, 2.0738730679040147, 2.0686576104190406, 2.063898561628021,
    2.059538552753294, 2.055529438642871, 2.0518305164802833, 2.0484071417952436,
    2.045229642132703,
)
Z_975 = 1.959963984540054


def t_quantile_975(df: Column) -> Column:
    """97.5 % point of Student's t: tabled up to 29, a series in 1/df beyond."""
    z = Z_975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    v = df.cast("double")
    series = F.lit(z)
    for power, term in enumerate(terms, start=1):
        series = series + term / F.pow(v, F.lit(float(power)))
    table = F.array(*[F.lit(x) for x in T_975])
    return (F.when(df < 1, None)
            .when(df <= len(T_975), F.element_at(table, df.cast("int")))
            .otherwise(series))


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for positive z: Stirling's series eight steps up."""
    up = z + 8
    steps = z
    for k in range(1, 8):
        steps = steps * (z + k)
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3.0))) + 1 / (1260 * F.pow(up, F.lit(5.0))) - 1 / (1680 * F.pow(up, F.lit(7.0)))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def _let(body, **named: Column) -> Column:
    """body(row) with each named expression computed once, however often it is used."""
    row = F.struct(*[c.alias(n) for n, c in named.items()])
    return F.element_at(F.transform(F.array(row), body), 1)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for a, b > 0, by its continued fraction.

    The fraction is taken on the side of the mean where it converges fast: a number of
    steps of a few times the root of the larger parameter is enough there.
    """
    def sided(v):
        near = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        share = _let(fraction, p=F.when(near, v["a"]).otherwise(v["b"]), q=F.when(near, v["b"]).otherwise(v["a"]),
                     y=F.when(near, v["x"]).otherwise(1 - v["x"]))
        inside = F.when(near, share).otherwise(1 - share)
        positive = (v["a"] > 0) & (v["b"] > 0)
        return F.when(positive & (v["x"] > 0) & (v["x"] < 1), inside).when(positive & (v["x"] >= 1), 1.0).when(positive & (v["x"] <= 0), 0.0)

    def fraction(v):
        p, q, y = v["p"], v["q"], v["y"]

        def step(state, k):
            m = F.floor((k + 1) / 2)
            add = F.when(k % 2 == 1, m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))).otherwise(
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)))
            # h is the product up to the step before, so that each new factor is computed once
            return F.struct((1 + F.try_divide(add, state["c"])).alias("c"), F.try_divide(F.lit(1.0), 1 + add * state["d"]).alias("d"),
                            (state["h"] * state["c"] * state["d"]).alias("h"))

        first = F.try_divide(F.lit(1.0), 1 - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), F.lit(1.0).alias("h"))
        steps = (40 + 8 * F.sqrt(F.greatest(p, q))).cast("int")
        value = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda state: state["h"] * state["c"] * state["d"])
        front = ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * F.ln(y) + q * F.ln(1 - y)
        return F.exp(front) * value / p

    return _let(sided, x=x, a=a, b=b)


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|)."""
    t, df = _column(t), _column(df)
    v = F.when(df > 0, df)
    return beta_share(v / (v + t * t), v / 2, F.lit(0.5))


def f_upper(f, df1, df2) -> Column:
    """P(F > f)."""
    f, a, b = _column(f), F.when(_column(df1) > 0, _column(df1)), F.when(_column(df2) > 0, _column(df2))
    return F.when(f >= 0, beta_share(b / (b + a * f), b / 2, a / 2))


def chi2_upper_1(x) -> Column:
    """P(chi-square with one degree of freedom > x), the square of a normal."""
    x = F.when(_given(_column(x)), F.greatest(_column(x), F.lit(0.0)))
    return _let(lambda v: _chi2_upper_1(v["x"], v["z"]), x=x, z=F.sqrt(x / 2))


def _chi2_upper_1(x: Column, z: Column) -> Column:
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda state, n: F.struct(
        (state["t"] * x / (2 * n + 1)).alias("t"), (state["s"] + state["t"] * x / (2 * n + 1)).alias("s")), lambda state: state["s"])
    small = 1 - 2 * z / math.sqrt(math.pi) * F.exp(-x / 2) * series
    tail = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda low, n: (n / 2) / (z + low))
    large = F.exp(-x / 2) / (math.sqrt(math.pi) * F.nullif(z + tail, F.lit(0.0)))
    return F.when(x < 6, small).when(x >= 6, large)


def _given(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _column(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")
