"""The normal distribution as Column expressions: Spark has no erf or probit, and a Python UDF would leave codegen."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's AS241 (PPND16) coefficients, lowest order first, centre, middle and tail.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Hart's rational form of the cumulative distribution as given by West (2005), highest order first.
HART = (
    (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def polynomial(coefficients, x: Column) -> Column:
    """Horner's scheme, lowest order first."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * polynomial(CENTRE[0], r) / polynomial(CENTRE[1], r)
    t = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = polynomial(MIDDLE[0], t - 1.6) / polynomial(MIDDLE[1], t - 1.6)
    tail = polynomial(TAIL[0], t - 5.0) / polynomial(TAIL[1], t - 5.0)
    outer = F.when(t <= 5.0, middle).otherwise(tail) * F.when(q < 0, -1.0).otherwise(1.0)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(outer))


def cdf(x: Column) -> Column:
    """Cumulative standard normal, absolute error under 1e-15."""
    a = F.abs(x)
    near = F.exp(-a * a / 2) * polynomial(HART[0][::-1], a) / polynomial(HART[1][::-1], a)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / math.sqrt(2 * math.pi)
    lower = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - lower).otherwise(lower)


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
