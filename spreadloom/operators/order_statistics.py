"""Order statistics of the last n rows: quantiles, median absolute deviation, rank of the current value.

A sorted window slides along a series: a row goes in and one goes out by binary search, quantiles are read at their
places, and the median of the deviations is found by bisection in the two sorted halves. A row costs about the same
whatever n is. A long series is cut in blocks, each with the n - 1 rows before it, so that no task has all of it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions.columns import ordered

#: Rows of a block, at least; a window takes at most an eighth of a block.
BLOCK = 50_000


def quantile(values: list[float], q: float) -> float:
    """Of sorted values, interpolated between neighbours."""
    at = q * (len(values) - 1)
    low = int(at)
    if low + 1 >= len(values) or at == low:
        return values[low]
    return (low + 1 - at) * values[low] + (at - low) * values[low + 1]


def nth_away(values: list[float], split: int, centre: float, n: int) -> float:
    """The n-th smallest (from 0) distance of sorted values to a centre; those before ``split`` lie below it."""
    low, high = max(0, n + 1 - (len(values) - split)), min(split, n + 1)
    while low < high:  # how many of the n + 1 nearest are below the centre
        m = (low + high) // 2
        if centre - values[split - 1 - m] < values[split + n - m] - centre:
            low = m + 1
        else:
            high = m
    below = centre - values[split - low] if low else -1.0
    above = values[split + n - low] - centre if n + 1 > low else -1.0
    return max(below, above)


def deviation(values: list[float], centre: float) -> float:
    """Median distance of sorted values to a centre."""
    split, m = bisect_left(values, centre), len(values)
    return (nth_away(values, split, centre, (m - 1) // 2) + nth_away(values, split, centre, m // 2)) / 2


def along(x: np.ndarray, n: int, skip: int, quantiles: Sequence[float]) -> np.ndarray:
    """Rows (size, below, same, median, mad, quantiles) for x from ``skip`` on; missing values are in no window."""
    out = np.full((len(x) - skip, 5 + len(quantiles)), np.nan)
    window: list[float] = []
    for i, v in enumerate(x.tolist()):
        if i >= n and x[i - n] == x[i - n]:
            window.pop(bisect_left(window, float(x[i - n])))
        if v == v:
            insort(window, v)
        if i < skip:
            continue
        row = out[i - skip]
        row[0] = len(window)
        if window:
            median = quantile(window, 0.5)
            row[3:] = [median, deviation(window, median), *(quantile(window, q) for q in quantiles)]
        if v == v:
            row[1] = bisect_left(window, v)
            row[2] = bisect_right(window, v) - row[1]
    return out


def rolling_order(df: DataFrame, x: str, n: int, quantiles: dict[str, float], key: str = "symbol", block: int = BLOCK) -> DataFrame:
    """All columns, and of the last n rows: ``n_frame`` (values that aren't missing), ``below`` and ``same`` (of these less
    than, and equal to, the row's value), ``median``, ``mad`` and the named quantiles. Rows of a series are in order of dt;
    null and NaN are missing."""
    size = max(block, 8 * n)
    names, columns, wanted = ["n_frame", "below", "same", "median", "mad", *quantiles], df.columns, list(quantiles.values())
    rows = df.withColumn("_k", F.row_number().over(ordered(key)) - 1)
    own, rest = F.floor(F.col("_k") / size), F.col("_k") % size
    dealt = rows.withColumn("_block", F.explode(F.when(rest >= size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_halo", F.floor(F.col("_k") / size) < F.col("_block"))
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "n_frame int, below int, same int", *[f"{c} double" for c in names[3:]]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_k")
        skip = int(frame["_halo"].sum())
        found = along(frame[x].to_numpy(float, na_value=np.nan), n, skip, wanted)
        out = frame.iloc[skip:][columns].reset_index(drop=True)
        for at, name in enumerate(names):
            out[name] = pd.Series(found[:, at]).astype("Int64") if at < 3 else found[:, at]
        return out

    out = dealt.groupBy(key, "_block").applyInPandas(run, kinds)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names[3:]})
