"""The normal distribution as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8.
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
DENSITY = 0.3989422804014327


def cdf(z: Column) -> Column:
    t = 1 / (1 + F.lit(P) * F.abs(z))
    poly = F.lit(0.0)
    for b in reversed(B):
        poly = (poly + b) * t
    upper = F.lit(DENSITY) * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {P}e0 * abs({z})))"
    poly = "0e0"
    for b in reversed(B):
        poly = f"(({poly} + {b!r}::DOUBLE) * {t})"
    upper = f"({DENSITY}e0 * exp(-({z}) * ({z}) / 2) * {poly})"
    return f"CASE WHEN ({z}) >= 0 THEN 1 - {upper} ELSE {upper} END"
