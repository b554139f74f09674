"""Control effectiveness, selection and compartment formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the regression step.
KAPPA, BETA_W, GAMMA_W, SUSCEPTIBLE = 0.2, 0.25, 0.1, 0.75
# Best control parameters of the first step.
BEST_K, BEST_A = 0.999219118565425, 3.78253264557306


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def effectiveness(psi, k, a) -> Column:
    """c = k (psi/100)^a; a day without an index value has no control."""
    return F.coalesce(_c(k) * F.pow(_c(psi) / 100, _c(a)), F.lit(0.0))


def speed(c, kappa=KAPPA, beta_w=BETA_W, gamma_w=GAMMA_W, sn=SUSCEPTIBLE) -> Column:
    """H(c), the root shared by both integrands."""
    kappa, beta_w, gamma_w, sn = map(_c, (kappa, beta_w, gamma_w, sn))
    gap = kappa - gamma_w
    return F.sqrt(gap * gap + 4 * kappa * (1 - _c(c)) * beta_w * sn)


def _per_speed(x, h: Column) -> Column:
    """x / H; a root of zero gives NaN, which no later sum can hide."""
    return F.when(h > 0, x / h).otherwise(F.lit(float("nan")))


def transmission_integrand(c, **fixed) -> Column:
    return _per_speed(1 - _c(c), speed(c, **fixed))


def recovery_integrand(c, **fixed) -> Column:
    return _per_speed(F.lit(1.0), speed(c, **fixed))


def selection_coef(delta_beta, delta_gamma, kappa=KAPPA, beta_w=BETA_W, gamma_w=GAMMA_W,
                   sn=SUSCEPTIBLE, form: str = "gradient") -> Column:
    """Selection coefficient per day without control.

    ``gradient`` weighs the recovery effect by half, in line with the fitted
    regressors; ``legacy`` keeps the doubled root of the summary tables.
    """
    db, dg, kappa, gamma_w, sn = map(_c, (delta_beta, delta_gamma, kappa, gamma_w, sn))
    h = speed(0.0, kappa, beta_w, gamma_w, sn)
    if form == "gradient":
        return kappa * db * sn / h - ((kappa - gamma_w) / h + 1) * dg / 2
    if form == "legacy":
        h2 = 2 * h
        return (2 * kappa * db * sn - (kappa - gamma_w + h2) * dg) / h2
    raise ValueError("form must be 'gradient' or 'legacy'")


def selection_gradient(r, mu, sigma, d1=0.0, d2=0.0, d3=0.0, approximate=False) -> Column:
    """Selection in R for a gamma-distributed generation time; NULL where R is 0.

    ``approximate`` uses R - 1 in place of ln R.
    """
    r, mu, sigma, d1, d2, d3 = map(_c, (r, mu, sigma, d1, d2, d3))
    cv2 = F.pow(sigma / mu, F.lit(2.0))
    growth = r - 1 if approximate else F.when(r > 0, F.ln(r))
    power = F.pow(r, cv2)
    return ((d2 - 2 * d3) * (power - 1) * mu / F.pow(sigma, F.lit(2.0))
            + power * (d1 + 2 * (d3 - d2) * growth) / mu)


def r0_from_beta(beta, gamma, exit_rate, omega, p) -> Column:
    beta, gamma, exit_rate, omega, p = map(_c, (beta, gamma, exit_rate, omega, p))
    return beta * (F.try_divide(1 - omega * p, gamma) + F.try_divide(omega * p, exit_rate))


def beta_from_r0(r0, gamma, exit_rate, omega, p) -> Column:
    r0, gamma, exit_rate, omega, p = map(_c, (r0, gamma, exit_rate, omega, p))
    return F.try_divide(r0, F.try_divide(1 - omega * p, gamma) + F.try_divide(omega * p, exit_rate))


def corrected_r0(r0, gamma, exit_rate, omega, p) -> Column:
    """R0 once the lethal share of symptomatic cases is taken into account."""
    r0, gamma, exit_rate, omega, p = map(_c, (r0, gamma, exit_rate, omega, p))
    return F.try_divide(r0 * gamma * (exit_rate + omega * p * (gamma - exit_rate)), gamma * exit_rate)


def reporting_rate(t, rho=None, mu=None, eta=None) -> Column:
    """Constant rate where given, else the line mu + eta t."""
    null = F.lit(None).cast("double")
    rho, mu, eta = (null if x is None else _c(x) for x in (rho, mu, eta))
    return F.coalesce(rho, mu + eta * _c(t))


def initial_state(population, deaths, p_s, p_e, exit_rate, omega, p) -> dict[str, Column]:
    """Compartments at the start, with the infected derived from a death level.

    A parameter of zero that would divide gives NULL, not an error.
    """
    population, deaths, p_s, p_e, exit_rate, omega, p = map(
        _c, (population, deaths, p_s, p_e, exit_rate, omega, p))
    s, e = p_s * population, p_e * population
    isd = F.try_divide(deaths, exit_rate)
    isr = F.try_divide(isd * (1 - p), p)
    ia = F.try_divide((isr + isd) * (1 - omega), omega)
    return {"S": s, "E": e, "IA": ia, "ISr": isr, "ISd": isd,
            "R": population - (s + e + ia + isr + isd),
            "D": F.lit(0.0), "IS_cumul": F.lit(0.0)}


def shares_state(population, p_s, p_e, p_ia, p_isr, p_isd) -> dict[str, Column]:
    """Compartments at the start from given population shares."""
    n = _c(population)
    parts = {"S": p_s, "E": p_e, "IA": p_ia, "ISr": p_isr, "ISd": p_isd}
    out = {name: _c(share) * n for name, share in parts.items()}
    rest = n
    for value in out.values():
        rest = rest - value
    return {**out, "R": rest, "D": F.lit(0.0), "IS_cumul": F.lit(0.0)}
