"""Column expressions that the operators share. None is a user function; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered(key: str | Sequence[str] = "symbol", by: str = "dt") -> WindowSpec:
    """All rows of a series in order; frames are set on top of it."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(by)


def trailing(n: int, key: str | Sequence[str] = "symbol", by: str = "dt") -> WindowSpec:
    """The last n rows of a series, the current one included."""
    return ordered(key, by).rowsBetween(1 - n, 0)


def so_far(key: str | Sequence[str] = "symbol", by: str = "dt") -> WindowSpec:
    return ordered(key, by).rowsBetween(Window.unboundedPreceding, 0)


def whole(key: str | Sequence[str] = "symbol") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def full(value: Column, of: Col, w: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, null until the frame holds n values."""
    return F.when(F.count(col(of)).over(w) >= n, value)


def ratio(a: Col, b: Col) -> Column:
    """a / b; null where b is zero or null."""
    return F.try_divide(col(a), col(b))


def safe(a: Col) -> Column:
    """Missing as null: NaN and infinities too."""
    c = col(a).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def correlation(x: Col, y: Col, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side (the built-in raises there)."""
    x, y = col(x), col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    sd = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return F.when(sd > 1e-15, over(F.covar_pop(x, y)) / sd)


def slope(y: Col, x: Col, w: WindowSpec | None = None) -> Column:
    """Least-squares slope of y on x, over rows where both are present."""
    y, x = col(y), col(x)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return ratio(over(F.covar_pop(y, x)), over(F.var_pop(F.when(y.isNotNull(), x))))


def zscore(x: Col, w: WindowSpec, n: int, ddof: int = 0) -> Column:
    """(x - mean) / sd over a full frame; null where sd is below 1e-12."""
    x = col(x)
    sd = (F.stddev_samp if ddof else F.stddev_pop)(x).over(w)
    return full(F.when(sd > 1e-12, (x - F.avg(x).over(w)) / sd), x, w, n)


def average_rank(x: Col, key: Sequence[str] | str = ()) -> Column:
    """Rank from 1, ties averaged."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.rank().over(Window.partitionBy(*keys).orderBy(col(x))) + (F.count("*").over(Window.partitionBy(*keys, col(x))) - 1) / 2


def clip(x: Col, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Between the bounds; a null stays null, unlike greatest and least alone."""
    out = col(x)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    if low is not None:
        out = F.greatest(out, lit(low))
    if high is not None:
        out = F.least(out, lit(high))
    return F.when(col(x).isNotNull(), out)


def pair_key(x: Col, y: Col) -> Column:
    """Unordered key of two symbols."""
    return F.concat_ws("/", F.least(col(x), col(y)), F.greatest(col(x), col(y)))


def canonical_symbol(s: Col) -> Column:
    """Trimmed and upper case; texts that mean missing become null."""
    s = F.upper(F.trim(col(s)))
    return F.when(~s.isin("", "NAN", "NONE", "NULL"), s)


def to_double(s: Col) -> Column:
    return safe(F.expr(f"try_cast({s} AS DOUBLE)") if isinstance(s, str) else s)


def to_bool(s: Col) -> Column:
    t = F.lower(F.trim(col(s).cast("string")))
    return F.when(t.isin("true", "yes", "on", "1", "y", "t"), True).when(t.isin("false", "no", "off", "0", "n", "f"), False)


def logistic(x: Col) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def inside_score(v: Col, low: Col, high: Col, sharpness: float = 1.0) -> Column:
    """100 inside the band, else falling with the distance in band widths."""
    v, low, high = col(v), col(low), col(high)
    away = F.greatest(low - v, v - high) / F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.when(v.between(low, high), 100.0).otherwise(100 * F.exp(-sharpness * away))


def above_score(v: Col, low: Col, sharpness: float = 1.0) -> Column:
    v, low = col(v), col(low)
    return F.when(v >= low, 100.0).otherwise(100 * F.exp(-sharpness * (low - v) / F.when(low != 0, F.abs(low)).otherwise(F.lit(1.0))))


def below_score(v: Col, high: Col, sharpness: float = 1.0) -> Column:
    v, high = col(v), col(high)
    return F.when(v <= high, 100.0).otherwise(100 * F.exp(-sharpness * (v - high) / F.when(high != 0, F.abs(high)).otherwise(F.lit(1.0))))


def kelly(win_rate: Col, avg_win: Col, avg_loss: Col, fraction: float = 1.0) -> Column:
    """fraction * (p / loss - q / win), not below zero; null losses or wins give zero."""
    p = col(win_rate)
    return F.coalesce(F.greatest(F.lit(0.0), fraction * (ratio(p, avg_loss) - ratio(1 - p, avg_win))), F.lit(0.0))


def vol_target_leverage(vol: Col, target: float, cap: float) -> Column:
    return F.when(col(vol) <= 0.001, F.lit(cap)).otherwise(F.least(F.lit(cap), F.lit(target) / col(vol)))


def ramp_down(x: Col, start: float, end: float, floor: float = 0.0) -> Column:
    """1 up to start, falling to floor at end."""
    return clip(1 - (col(x) - start) / (end - start) * (1 - floor), floor, 1.0)


def trade_cost(notional: Col, shares: Col, adv: Col, per_trade: float = 1.0, per_share: float = 0.005, spread_bps: float = 2.0, slip_bps: float = 1.0, impact: float = 0.1, least: float = 100.0) -> Column:
    n = F.abs(col(notional))
    cost = per_trade + per_share * F.abs(col(shares)) + n * (spread_bps + slip_bps) / 1e4 + impact * n * F.sqrt(F.coalesce(ratio(F.abs(col(shares)), adv), F.lit(0.0)))
    return F.when(n < least, 0.0).otherwise(cost)


def score_label(s: Col) -> Column:
    """A+ from 2.0 down to D."""
    out = F.when(col(s).isNull(), "D")
    for bound, name in ((2.0, "A+"), (1.5, "A"), (1.2, "A-"), (0.9, "B+"), (0.6, "B"), (0.3, "B-"), (0.0, "C")):
        out = out.when(col(s) >= bound, name)
    return out.otherwise("D")


#: Labels from worst to best.
LABELS = ("D", "C", "B-", "B", "B+", "A-", "A", "A+")


def label_rank(label: Col) -> Column:
    return F.array_position(F.array(*map(F.lit, LABELS)), col(label)) - 1
