"""Potentials of a point at a distance, blurred by a width."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scale of the intrinsic and of the charge term.
INTRINSIC_SCALE = 47.87764193
CHARGE_SCALE = 14.39964393


def single_gauss(atomic_number: Column, r: Column, blur: Column | float) -> Column:
    """One Gaussian of variance 1 / Z^2 + blur^2; null where Z is 0."""
    blur = F.lit(blur) if not isinstance(blur, Column) else blur
    z = F.when(atomic_number != 0, atomic_number.cast("double"))
    s2 = 1 / (z * z) + blur * blur
    return F.pow(2 * math.pi * s2, F.lit(-1.5)) * F.exp(-r * r / (2 * s2))


def user_gauss(r: Column, amplitude: Column | float, width: Column | float) -> Column:
    a, w = (c if isinstance(c, Column) else F.lit(float(c)) for c in (amplitude, width))
    return a * F.pow(2 * math.pi * w * w, F.lit(-1.5)) * F.exp(-r * r / (2 * w * w))


def five_gauss(a: Column, b: Column, r: Column, blur: float) -> Column:
    """Sum of Gaussians with weights ``a`` and widths ``b`` (arrays of the same length, from a parameter table)."""
    def term(ai: Column, bi: Column) -> Column:
        f = bi / (8 * math.pi**2) + blur**2
        return ai * F.pow(2 * math.pi * f, F.lit(-1.5)) * F.exp(-r * r / f / 2)

    return INTRINSIC_SCALE * F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, t: s + t)


# Coefficients of rational approximations to erf (Cody 1969), from the highest power down.
_ERF_P = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3
)
_ERFC_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
    4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    """The error function for x >= 0 to about 1e-15 (1 from 6 on), as columns."""
    near = x * _horner(x * x, _ERF_P) / _horner(x * x, _ERF_Q)
    middle = 1 - F.exp(-x * x) * _horner(x, _ERFC_P) / _horner(x, _ERFC_Q)
    return F.when(x <= 0.46875, near).when(x < 6, middle).otherwise(F.when(x >= 6, 1.0))


def charge_delta(r: Column, charge: Column, blur: float) -> Column:
    """The charge term: Coulomb without blur, else damped by the error function, 0 beyond distance 3."""
    if blur == 0.0:
        return F.try_divide(CHARGE_SCALE * charge, r)
    width = max(blur, 1e-5)
    near = F.lit(CHARGE_SCALE * math.sqrt(2 / math.pi) / width) * charge
    return F.when(r > 3, 0.0).when(r < 1e-5, near).otherwise(F.try_divide(CHARGE_SCALE * charge, r) * erf(r / (width * math.sqrt(2))))


def read_form_factors(spark: SparkSession, path: str) -> DataFrame:
    """A table of scattering parameters: element STRING (upper case), and for the charges 0, 1 and -1 the arrays a0, b0, ap,
    bp, am, bm of a weight and a width for each Gaussian. ``path``: Parquet, or CSV with a head: element, charge, a1 to a5, b1
    to b5. Elements without a charged set use the neutral one there."""
    t = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    a, b = (F.array(*[F.col(f"{c}{i}").cast("double") for i in range(1, 6)]) for c in "ab")
    one = t.groupBy(F.upper("element").alias("element")).agg(
        *[
            F.max(F.when(F.col("charge") == q, x)).alias(f"{c}{n}") for q, n in ((0, "0"), (1, "p"), (-1, "m")) for c,
            x in (("a", a), ("b", b))
        ]
    )
    return one.select("element", "a0", "b0", *[F.coalesce(c, c[0] + "0").alias(c) for c in ("ap", "bp", "am", "bm")])


def five_gauss_charged(
    neutral: tuple[Column, Column], positive: tuple[Column, Column], negative: tuple[Column, Column], r: Column, charge: Column, blur: float
) -> Column:
    """Linear in the charge between the neutral and the singly charged parameter sets, each with its charge term."""
    zero = five_gauss(*neutral, r, blur)
    delta = charge_delta(r, F.lit(1.0), blur)
    return zero + charge * F.when(
        charge >= 0, five_gauss(*positive, r, blur) + delta - zero
    ).otherwise(zero - five_gauss(*negative, r, blur) + delta)
