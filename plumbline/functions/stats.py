"""Statistics that Spark has no function for.  Normal quantiles run as Arrow UDFs, the rest as column expressions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def probit(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None, na_action="ignore")


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of the discordant counts b and c: min(1, 2 * sum C(n, i) / 2^n), 1 if there are
    none.  Terms follow from each other by a ratio in log space, so large counts do not overflow."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    first = -n.cast("double") * F.log(F.lit(2.0))
    state = F.struct(first.alias("term"), F.exp(first).alias("total"))
    step = lambda s, i: F.struct(
        (s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("term"),
        (s["total"] + F.exp(s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("total"),
    )
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), state, step, lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_corrected(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square p with one degree of freedom; 1 without discordant pairs."""
    root = F.greatest(F.abs(b - c) - 1, F.lit(0)) / F.sqrt(F.nullif((b + c).cast("double"), F.lit(0.0)))
    return F.when(b + c == 0, F.lit(1.0)).otherwise(2 * (1 - normal_cdf(root)))


def clamp_rate(hits: Column, n: Column) -> Column:
    """Rate kept within [1/2n, 1 - 1/2n], so that its probit is finite."""
    return F.least(F.greatest(hits / n, 1 / (2 * n)), 1 - 1 / (2 * n))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)


def ratio(a: Column, b: Column, empty=None) -> Column:
    """a / b, `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a.cast("double") / b)
