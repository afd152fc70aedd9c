"""Distribution functions as plain column expressions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart (1968) rational form of the normal distribution function, highest power first.
HART_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
            637.333633378831, 793.826512519948, 440.413735824752)

# Wichura (1988) AS 241 inverse normal, lowest power first.
AS241_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
AS241_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
           3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
AS241_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
AS241_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
           2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def horner(x, coefficients):
    """Polynomial in x, highest power first; works on columns, floats and arrays."""
    value = coefficients[0]
    for c in coefficients[1:]:
        value = value * x + c
    return value


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    body = F.exp(-0.5 * a * a)
    near = body * horner(a, HART_NUM) / horner(a, HART_DEN)
    far = body / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x.isNull(), None).when(x > 0, 1.0 - tail).otherwise(tail)


def norm_inv(p: Column) -> Column:
    q = p - 0.5
    s = 0.180625 - q * q
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    r1, r2 = r - 1.6, r - 5.0
    tail = F.when(r <= 5.0, horner(r1, AS241_C[::-1]) / horner(r1, AS241_D[::-1])).otherwise(
        horner(r2, AS241_E[::-1]) / horner(r2, AS241_F[::-1]))
    centre = q * horner(s, AS241_A[::-1]) / horner(s, AS241_B[::-1])
    return (F.when((p <= 0.0) | (p >= 1.0), None).when(F.abs(q) <= 0.425, centre)
            .when(q < 0, -tail).otherwise(tail))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper chi-square tail: exact for one and two degrees of freedom, else by the Wilson-Hilferty cube root with an
    absolute error below 0.005."""
    v = 2.0 / (9.0 * df)
    cube = 1.0 - norm_cdf((F.pow(x / df, F.lit(1.0 / 3.0)) - (1.0 - v)) / F.sqrt(v))
    return F.when(df == 1.0, 2.0 * norm_cdf(-F.sqrt(x))).when(df == 2.0, F.exp(-0.5 * x)).otherwise(cube)


def t_sf(t: Column, df: Column) -> Column:
    """Upper t tail by the Wallace transform to a normal deviate; absolute error below 0.002 for df >= 5."""
    z = F.sqrt(df * F.ln(1.0 + t * t / df)) * (8.0 * df + 1.0) / (8.0 * df + 3.0)
    return F.when(t >= 0, 1.0 - norm_cdf(z)).otherwise(norm_cdf(z))


def f_inv(p: Column, d1: Column, d2: Column) -> Column:
    """Upper F critical value by Paulson's cube-root form; relative error near 1 % for d2 >= 30."""
    a, b, z = 2.0 / (9.0 * d1), 2.0 / (9.0 * d2), norm_inv(p)
    den = (1.0 - b) * (1.0 - b) - z * z * b
    num = (1.0 - a) * (1.0 - b) + z * F.sqrt(a * (1.0 - b) * (1.0 - b) + b * (1.0 - a) * (1.0 - a) - a * b * z * z)
    return F.pow(num / den, F.lit(3.0))


def half_up(x: float) -> int:
    """Round half away from zero for positive x."""
    return int(math.floor(x + 0.5))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Bound a column; missing stays missing."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNull(), None).otherwise(y)


def finite(x: Column) -> Column:
    """True for ordinary numbers, false for missing, NaN and infinities."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
