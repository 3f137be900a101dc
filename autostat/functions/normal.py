"""Standard normal distribution: as Spark expressions and for NumPy arrays.

The Column forms stay in whole-stage codegen, so they may run on every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, double precision), high order first.
TAIL_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SPLIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631000502

# Normal quantile (Wichura 1988, AS 241), low order first: centre, shoulder, far tail.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def polynomial(coefficients, x):
    """Value of a polynomial, highest order first."""
    total = x * coefficients[0] + coefficients[1]
    for c in coefficients[2:]:
        total = total * x + c
    return total


def polynomial_sql(coefficients, x: str) -> str:
    """The same as SQL text; parsed once, it is far cheaper to build than one Column per operation."""
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def _far_fraction(size):
    return size + 1 / (size + 2 / (size + 3 / (size + 4 / (size + 0.65))))


def upper_tail_sql(z: str) -> str:
    size = f"abs({z})"
    bell = f"exp(-0.5D * {z} * {z})"
    near = f"{bell} * {polynomial_sql(TAIL_TOP, size)} / {polynomial_sql(TAIL_BOTTOM, size)}"
    fraction = f"({size} + 1 / ({size} + 2 / ({size} + 3 / ({size} + 4 / ({size} + 0.65D)))))"
    tail = (
        f"CASE WHEN {size} > 37 THEN 0D WHEN {size} < {TAIL_SPLIT!r}D THEN {near} "
        f"ELSE {bell} / {fraction} / {ROOT_TWO_PI!r}D END"
    )
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0 THEN {tail} ELSE 1 - {tail} END"


def upper_tail(z: str) -> Column:
    """P(Z > z) of the column named `z`."""
    return F.expr(upper_tail_sql(z))


def cumulative(z: str) -> Column:
    """P(Z <= z) of the column named `z`."""
    return 1 - F.expr(upper_tail_sql(z))


def two_sided(z: str) -> Column:
    return F.least(F.expr(upper_tail_sql(f"abs({z})")) * 2, F.lit(1.0))


def quantile(p: str) -> Column:
    """z with P(Z <= z) = p, for the column named `p` within (0, 1)."""
    q, r = f"({p} - 0.5D)", f"(0.180625D - ({p} - 0.5D) * ({p} - 0.5D))"
    near, far = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6D)", f"(sqrt(-ln(least({p}, 1 - {p}))) - 5D)"

    def fraction(table, x):
        return f"{polynomial_sql(table[0][::-1], x)} / {polynomial_sql(table[1][::-1], x)}"

    return F.expr(
        f"CASE WHEN abs({q}) <= 0.425D THEN {q} * {fraction(CENTRE, r)} "
        f"WHEN {near} <= 3.4D THEN sign({q}) * {fraction(SHOULDER, near)} ELSE sign({q}) * {fraction(FAR_TAIL, far)} END"
    )


def upper_tail_array(z: np.ndarray) -> np.ndarray:
    """P(Z > z) for a NumPy array."""
    z = np.asarray(z, dtype=float)
    size = np.minimum(np.abs(z), 38.0)
    bell = np.exp(-0.5 * size * size)
    near = bell * polynomial(TAIL_TOP, size) / polynomial(TAIL_BOTTOM, size)
    tail = np.where(size < TAIL_SPLIT, near, bell / _far_fraction(size) / ROOT_TWO_PI)
    return np.where(z > 0, tail, 1 - tail)
