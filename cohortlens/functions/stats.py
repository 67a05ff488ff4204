"""Closed-form statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96
INF = float("inf")
EPS = 1e-9


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` as a double, with ``default`` where ``den`` is zero."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson(p: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval for a proportion, clipped to [0, 1]; (0, 0) when n is 0."""
    n = n.cast("double")
    denom = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / denom
    spread = z * F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * n)) / n) / denom
    low = F.when(n > 0, F.greatest(centre - spread, F.lit(0.0))).otherwise(0.0)
    high = F.when(n > 0, F.least(centre + spread, F.lit(1.0))).otherwise(0.0)
    return low, high


def prevalence_shift(prob: Column, study: Column, deploy: Column) -> Column:
    """Bayes shift of a probability from the study to a deployment prevalence."""
    pos = prob * deploy / study
    neg = (1 - prob) * (1 - deploy) / (1 - study)
    return pos / (pos + neg)


def ppv(sens: Column, spec: Column, prev: Column, eps: float = 0.0) -> Column:
    hit = sens * prev
    return F.try_divide(hit, hit + (1 - spec) * (1 - prev) + F.lit(eps))


def npv(sens: Column, spec: Column, prev: Column, eps: float = 0.0) -> Column:
    keep = spec * (1 - prev)
    return F.try_divide(keep, keep + (1 - sens) * prev + F.lit(eps))


def number_needed(value: Column) -> Column:
    """1/value, infinite when value is not positive."""
    return F.when(value > 0, F.lit(1.0) / value).otherwise(F.lit(INF))


def likelihood_ratios(sens: Column, spec: Column) -> tuple[Column, Column, Column]:
    """LR+, LR- and their quotient, with explicit infinities."""
    pos = F.when(spec < 1, F.try_divide(sens, 1 - spec)).otherwise(F.lit(INF))
    neg = F.when(spec > 0, F.try_divide(1 - sens, spec)).otherwise(F.lit(INF))
    odds = F.when((neg > 0) & (neg != INF), F.try_divide(pos, neg)).otherwise(F.lit(INF))
    return pos, neg, odds


def likelihood_ratios_eps(sens: Column, spec: Column, eps: float = EPS) -> tuple[Column, Column, Column]:
    """The same three figures with every denominator shifted by ``eps``."""
    pos = sens / (1 - spec + eps)
    neg = (1 - sens) / (spec + eps)
    odds = (sens / (1 - sens + eps)) / ((1 - spec + eps) / (spec + eps))
    return pos, neg, odds


def pu_corrected(auprc: Column, auroc: Column, sens: Column, spec: Column, prec: Column, prior: Column) -> dict[str, Column]:
    """Positive-unlabelled corrections; null unless the prior lies inside (0, 1)."""
    usable = (prior > 0) & (prior < 1)
    fpr = F.greatest(F.lit(0.0), (1 - spec) - prior * sens) / (1 - prior)
    lifted = F.when(prec > 0, prec / (prec + (1 - prec) * (1 - prior))).otherwise(0.0)
    columns = {
        "auprc_pu": F.least(auprc / prior, F.lit(1.0)),
        "auprc_pu_clipped": (auprc / prior > 1).cast("int"),
        "auroc_pu": F.least(
            F.greatest((auroc - 0.5 * prior) / (1 - prior), F.lit(0.5)), F.lit(1.0)
        ),
        "sensitivity_pu": sens,
        "specificity_pu": F.least(F.greatest(1 - fpr, F.lit(0.0)), F.lit(1.0)),
        "precision_pu": F.least(lifted, F.lit(1.0)),
    }
    return {name: F.when(usable, column) for name, column in columns.items()}


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# The published rational approximations of the error function, lowest power last but one.
# Up to 0.46875 in x^2, up to 4 in |x|, beyond in 1 / x^2; numerators end with the highest power.
ERF_NEAR = (
    [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1],
    [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03],
)
ERFC_MIDDLE = (
    [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8],
    [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
     4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03],
)
ERFC_FAR = (
    [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2],
    [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3],
)


def rational(x: Column, coefficients: tuple[list[float], list[float]]) -> Column:
    """Quotient of two polynomials; the denominator begins with x."""
    top, bottom = coefficients
    num, den = x * top[-1], x
    for a, b in zip(top[:-2], bottom[:-1], strict=True):
        num, den = (num + a) * x, (den + b) * x
    return (num + top[-2]) / (den + bottom[-1])


def erfc(x: Column) -> Column:
    """Complementary error function, to about 15 digits of its own size far into the tail."""
    y = F.abs(x)
    square = x * x
    inverse = 1.0 / F.greatest(square, F.lit(1e-300))
    near = 1.0 - x * rational(square, ERF_NEAR)
    middle = F.exp(-square) * rational(y, ERFC_MIDDLE)
    far = F.exp(-square) / y * (1.0 / math.sqrt(math.pi) - inverse * rational(inverse, ERFC_FAR))
    upper = F.when(y <= 4.0, middle).when(y < 27.0, far).otherwise(0.0)
    return F.when(x.isNull() | F.isnan(x), x).when(y <= 0.46875, near).when(x < 0, 2.0 - upper).otherwise(upper)


def normal_upper_tail(z: Column) -> Column:
    """One-sided p of a standard normal statistic."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def chi2_1df_upper_tail(x: Column) -> Column:
    """p of a chi-square statistic with one degree of freedom."""
    return erfc(F.sqrt(x / 2.0))
