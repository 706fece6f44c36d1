"""The normal distribution, its inverse, and even numbers that follow from keys, as Column expressions and as SQL.

All are plain arithmetic, so that another engine gets the same values from the same text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's approximation of the distribution function in double precision (numerator, denominator, its bounds).
HART_UP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_DOWN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_NEAR, HART_FAR, ROOT_TAU = 7.07106781186547, 37.0, 2.506628274631
# Wichura's algorithm AS 241 for the inverse, lowest power first: middle, tails, far tails.
MIDDLE = (
    [3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
TAIL = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
FAR_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _poly(coefficients: Sequence[float], x: str) -> str:
    """Horner's scheme, highest power first."""
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return _doubles(out)


def _doubles(text: str) -> str:
    """Numbers with a point get an exponent, which makes them doubles in both dialects."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\de.])", r"\1e0", text)


def cdf_sql(z: str) -> str:
    """SQL of the distribution function of a column."""
    x = f"abs({z})"
    near = f"{_poly(HART_UP, x)} / {_poly(HART_DOWN, x)}"
    far = f"1e0 / ({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 0.65e0))))) / {ROOT_TAU!r}e0"
    tail = f"CASE WHEN {x} > {HART_FAR!r}e0 THEN 0e0 ELSE exp(-{x} * {x} / 2e0) * (CASE WHEN {x} < {HART_NEAR!r}e0 THEN {near} ELSE {far} END) END"
    return f"CASE WHEN {z} > 0 THEN 1e0 - ({tail}) ELSE {tail} END"


def inverse_sql(p: str) -> str:
    """SQL of the inverse of the distribution function of a column between 0 and 1; null elsewhere."""
    rational = lambda pair, x: f"{_poly(pair[0][::-1], x)} / {_poly(pair[1][::-1], x)}"
    r = f"sqrt(-ln(CASE WHEN {p} < 0.5e0 THEN {p} ELSE 1e0 - {p} END))"
    tail = f"(CASE WHEN {p} < 0.5e0 THEN -1e0 ELSE 1e0 END) * (CASE WHEN {r} <= 5e0 THEN {rational(TAIL, f'({r} - 1.6e0)')} ELSE {rational(FAR_TAIL, f'({r} - 5e0)')} END)"
    q = f"({p} - 0.5e0)"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {rational(MIDDLE, f'(0.180625e0 - {q} * {q})')} ELSE {tail} END END"


def cdf(z: Column) -> Column:
    """The normal distribution function; null for null."""
    x = F.abs(z)
    poly = lambda cs: _horner(cs, x)
    far = x + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        far = x + F.lit(n) / far
    tail = F.when(x > HART_FAR, 0.0).otherwise(F.exp(-x * x / 2) * F.when(x < HART_NEAR, poly(HART_UP) / poly(HART_DOWN)).otherwise(1 / far / ROOT_TAU))
    return F.when(z.isNotNull(), F.when(z > 0, 1 - tail).otherwise(tail))


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse(p: Column) -> Column:
    """The inverse of the distribution function between 0 and 1; null elsewhere."""
    rational = lambda pair, x: _horner(pair[0][::-1], x) / _horner(pair[1][::-1], x)
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, rational(TAIL, r - 1.6)).otherwise(rational(FAR_TAIL, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * rational(MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail)))


#: Modulus and factors of the generator: products of two numbers under the modulus are longs.
MODULUS, STEP, SPREAD, LAST = 2**31 - 1, 48271, 1566083941, 1812433253


def even(*keys: str, seed: int) -> Column:
    """A number in [0, 1) that follows from keys (whole numbers) and a seed alone, whatever the partitions."""
    mod = lambda x: x % F.lit(MODULUS).cast("long")
    s = F.lit(seed % MODULUS).cast("long")
    for k in keys:
        s = mod(s * STEP + F.pmod(F.col(k).cast("long"), F.lit(MODULUS).cast("long")))
        s = mod(s.bitwiseXOR(F.shiftright(s, 15)) * SPREAD)
    return mod(s.bitwiseXOR(F.shiftright(s, 13)) * LAST) / float(MODULUS)


def even_sql(*keys: str, seed: int) -> str:
    """DuckDB SQL of ``even`` for keys that aren't negative."""
    s = f"{seed % MODULUS}::BIGINT"
    for k in keys:
        s = f"(({s} * {STEP} + {k} % {MODULUS}) % {MODULUS})"
        s = f"((xor({s}, {s} >> 15) * {SPREAD}) % {MODULUS})"
    return f"((xor({s}, {s} >> 13) * {LAST}) % {MODULUS}) / {MODULUS}e0"
