"""Agreement statistics from sums and counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, digits: int | None = 4) -> Column:
    """a / b rounded, null where b is 0."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if digits is None else F.round(r, digits)


def pearson(x: Column, y: Column, weight: Column | None = None) -> Column:
    """Pearson's r as an aggregate; null for one row or a constant side. ``weight`` is the number of rows that a row stands for."""
    c = F.when(x.isNotNull() & y.isNotNull(), F.lit(1.0) if weight is None else weight.cast("double"))
    x, y = x.cast("double"), y.cast("double")
    n = F.sum(c)
    top = n * F.sum(c * x * y) - F.sum(c * x) * F.sum(c * y)
    left, right = n * F.sum(c * x * x) - F.sum(c * x) * F.sum(c * x), n * F.sum(c * y * y) - F.sum(c * y) * F.sum(c * y)
    return F.when((n > 1) & (left > 0) & (right > 0), top / F.sqrt(left * right))


def concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Concordant less discordant pairs of rows, given distinct cells (x, y) and their counts, by running counts over sorted values."""
    order = np.lexsort((y, x))
    x, c = x[order], c[order]
    at = np.unique(y[order], return_inverse=True)[1]
    tree = np.zeros(at.max() + 2)

    def below(i: int) -> float:
        total = 0.0
        while i > 0:
            total += tree[i]
            i -= i & -i
        return total

    out = seen = 0.0
    for part in np.split(np.arange(len(x)), np.nonzero(np.diff(x))[0] + 1):
        for k in part:
            under = below(at[k])
            out += c[k] * (under - (seen - below(at[k] + 1)))
        for k in part:
            i, seen = at[k] + 1, seen + c[k]
            while i < len(tree):
                tree[i] += c[k]
                i += i & -i
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str, groups: list[str], count: str | None = None) -> DataFrame:
    """Kendall's tau-b of x and y per group (groups, tau); null for one row or a constant side. Rows with a null are left out.

    Works on the contingency cells, whose number is that of distinct value pairs, never on pairs of rows or cells. ``count``
    names the column of rows that a row stands for.
    """
    n = F.lit(1) if count is None else F.col(count)
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.sum(n).cast("double").alias("c"))
    kinds = dict(df.dtypes)

    def tau(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b, c = (g[k].to_numpy() for k in ("x", "y", "c"))
        n = c.sum()
        n0 = n * (n - 1) / 2
        ties = lambda v: sum(k * (k - 1) / 2 for k in np.bincount(np.unique(v, return_inverse=True)[1], c))
        under = (n0 - ties(a)) * (n0 - ties(b))
        return pd.DataFrame([[*key, concordance(a, b, c) / np.sqrt(under) if n > 1 and under > 0 else None]], columns=[*groups, "tau"])

    return cells.groupBy(*groups).applyInPandas(tau, ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["tau double"]))
