"""Standard normal quantile as a Column expression (Wichura 1988, algorithm AS 241, PPND16)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# AS 241 coefficients, constant term first.
CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
CENTRE_LIMIT, CENTRE_SHIFT = 0.425, 0.180625
MIDDLE_LIMIT, MIDDLE_SHIFT = 5.0, 1.6


def _poly(coefficients: tuple[float, ...], x: Column | np.ndarray) -> Column | np.ndarray:
    high_first = list(reversed(coefficients))
    return reduce(lambda acc, c: acc * x + c, high_first[2:], high_first[0] * x + high_first[1])


def qnorm_array(p: np.ndarray) -> np.ndarray:
    """The same for an array of numbers between 0 and 1."""
    q = p - 0.5
    r = CENTRE_SHIFT - q * q
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    m, t = tail - MIDDLE_SHIFT, tail - MIDDLE_LIMIT
    size = np.where(tail <= MIDDLE_LIMIT, _poly(MIDDLE_NUM, m) / _poly(MIDDLE_DEN, m), _poly(TAIL_NUM, t) / _poly(TAIL_DEN, t))
    return np.where(np.abs(q) <= CENTRE_LIMIT, q * _poly(CENTRE_NUM, r) / _poly(CENTRE_DEN, r), np.where(q < 0, -size, size))


def qnorm(p: Column) -> Column:
    """Quantile of p: -inf at 0, inf at 1, NaN outside [0, 1], NULL for NULL."""
    q = p - 0.5
    r = F.lit(CENTRE_SHIFT) - q * q
    centre = q * _poly(CENTRE_NUM, r) / _poly(CENTRE_DEN, r)
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    m, t = tail - MIDDLE_SHIFT, tail - MIDDLE_LIMIT
    size = F.when(tail <= MIDDLE_LIMIT, _poly(MIDDLE_NUM, m) / _poly(MIDDLE_DEN, m)).otherwise(
        _poly(TAIL_NUM, t) / _poly(TAIL_DEN, t)
    )
    return (
        F.when(p.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(p) | (p < 0) | (p > 1), F.lit(float("nan")))
        .when(p == 0, F.lit(float("-inf")))
        .when(p == 1, F.lit(float("inf")))
        .when(F.abs(q) <= CENTRE_LIMIT, centre)
        .when(q < 0, -size)
        .otherwise(size)
    )
