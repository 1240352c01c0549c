"""Point-in-time features, forward labels, splits, and evaluation. Features use only rows up to their own; labels only
later rows, and are null where these are too few. All (entity, date) rows are computed at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import correlation, full, ordered, ratio, slope, so_far, trailing

#: name -> (look-back rows, function from key to Column): the feature registry.
REGISTRY: dict[str, tuple[int, Callable[[str], Column]]] = {}


def feature(lookback: int) -> Callable:
    def put(f: Callable[[str], Column]) -> Callable[[str], Column]:
        REGISTRY[f.__name__] = (lookback, f)
        return f

    return put


def _ret(k: int, key: str) -> Column:
    return ratio("close", F.lag("close", k).over(ordered(key))) - 1


@feature(1)
def ret_1(key: str) -> Column:
    return _ret(1, key)


@feature(5)
def ret_5(key: str) -> Column:
    return _ret(5, key)


@feature(20)
def ret_20(key: str) -> Column:
    return _ret(20, key)


@feature(20)
def vol_20(key: str) -> Column:
    return full(F.stddev_samp("_r").over(trailing(20, key)), "_r", trailing(20, key), 20)


@feature(60)
def vol_ratio(key: str) -> Column:
    long = trailing(60, key)
    return ratio(vol_20(key), full(F.stddev_samp("_r").over(long), "_r", long, 60))


@feature(20)
def volume_ratio(key: str) -> Column:
    w = trailing(20, key)
    return ratio("volume", full(F.avg("volume").over(w), "volume", w, 20))


def computed(df: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """The named features of bars (key, dt, close, volume): one shuffle and one sort for all."""
    base = df.withColumn("_r", F.ln(ratio("close", F.lag("close").over(ordered(key)))))
    return base.select(key, "dt", *[REGISTRY[n][1](key).alias(n) for n in names])


def z_features(df: DataFrame, z: str = "z", key: str = "pair_id", n: int = 20) -> DataFrame:
    """Of a z series: level, absolute, rolling mean and sd, momentum, AR(1), crossings, acceleration."""
    w, o = trailing(n, key), ordered(key)
    before = F.lag(z).over(o)
    base = df.withColumns({"_b": before, "_x": (F.signum(z) != F.signum(before)).cast("int")})
    return base.select(
        *df.columns, F.abs(z).alias("z_abs"), full(F.avg(z).over(w), z, w, n).alias("z_mean"), full(F.stddev_samp(z).over(w), z, w, n).alias("z_std"), (F.col(z) - F.lag(z, 5).over(o)).alias("z_mom"),
        full(slope(z, "_b", w), "_b", w, n).alias("z_ar1"), full(F.sum("_x").over(w), "_x", w, n).alias("z_crossings"), (F.col(z) - 2 * before + F.lag(z, 2).over(o)).alias("z_accel"),
    )


def forward(n: int, key: str = "pair_id"):
    """The next n rows, without the current one."""
    return ordered(key).rowsBetween(1, n)


def z_labels(df: DataFrame, z: str = "z", key: str = "pair_id", horizon: int = 10, entry: float = 2.0, fraction: float = 0.5) -> DataFrame:
    """Where |z| >= entry: whether it falls to a fraction of itself within the horizon, the gain at its end, and the worst
    move against the position. Null where fewer than ``horizon`` rows follow."""
    w = forward(horizon, key)
    signed = df.withColumn("_s", F.signum(z))
    best = F.when(F.col("_s") > 0, F.min(z).over(w)).otherwise(-F.max(z).over(w))
    worst = F.when(F.col("_s") > 0, F.max(z).over(w)).otherwise(-F.min(z).over(w))
    ok = (F.abs(z) >= entry) & (F.count(z).over(w) == horizon)
    parts = {"reverts": (best <= fraction * F.abs(z)).cast("int"), "gain": F.col("_s") * (F.col(z) - F.lead(z, horizon).over(ordered(key))), "adverse": worst - F.abs(z)}
    return signed.select(*df.columns, *[F.when(ok, v).alias(k) for k, v in parts.items()])


def z_reversion(df: DataFrame, horizon: int, z: str = "z", key: str = "pair_id") -> DataFrame:
    return df.select("*", (F.col(z) - F.lead(z, horizon).over(ordered(key))).alias("fwd_reversion"))


def variance_spike(df: DataFrame, x: str, n: int, key: str = "pair_id") -> DataFrame:
    """Whether the variance of the next n rows is over twice that of the last n."""
    back, ahead = trailing(n, key), forward(n, key)
    ok = (F.count(x).over(back) == n) & (F.count(x).over(ahead) == n)
    return df.select("*", F.when(ok, (ratio(F.var_pop(x).over(ahead), F.var_pop(x).over(back)) > 2).cast("int")).alias("var_spike"))


def time_to_target(df: DataFrame, horizon: int, target: float, entry: float, z: str = "z", key: str = "pair_id") -> DataFrame:
    """Rows until |z| is at the target, at most the horizon (censored)."""
    hits = F.transform(F.collect_list(F.abs(z)).over(forward(horizon, key)), lambda v: v <= target)
    at = F.array_position(hits, True)
    return df.select("*", F.when(F.abs(z) >= entry, F.when(at > 0, at).otherwise(F.lit(horizon))).alias("bars_to_target"))


def chronological_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, purge: int = 0, at: str = "dt") -> DataFrame:
    """Part of each row by the number of its date among all dates; ``purge`` dates before each border belong to none."""
    dates = df.select(at).distinct()
    n = dates.agg(F.count("*").alias("n"))
    numbered = dates.withColumn("rn", F.row_number().over(Window.orderBy(at))).join(F.broadcast(n))  # one row a date
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    part = F.when(F.col("rn") <= a - purge, "train").when(F.col("rn") <= a, None).when(F.col("rn") <= b - purge, "validation").when(F.col("rn") <= b, None).otherwise("test")
    return df.join(numbered.select(at, part.alias("part")), at).where("part IS NOT NULL")


def leakage_audit(df: DataFrame, embargo_days: int, horizon_days: int, label: str, at: str = "dt") -> DataFrame:
    """Per fold of a tagged dataset: order of parts, gap, and share of null labels."""
    end, start = F.max(F.when(F.col("part") == "train", F.col(at))), F.min(F.when(F.col("part") == "test", F.col(at)))
    g = df.groupBy("fold").agg(end.alias("train_end"), start.alias("test_start"), F.avg(F.isnull(label).cast("double")).alias("null_share"))
    gap = F.datediff("test_start", "train_end")
    return g.select("fold", "train_end", "test_start", gap.alias("gap_days"), (gap <= 0).alias("overlaps"), (gap < embargo_days).alias("embargo_broken"), (gap < embargo_days + horizon_days).alias("label_reaches_test"), (F.col("null_share") > 0.3).alias("too_many_nulls"))


def classification_metrics(df: DataFrame, y: str, p: str, keys: list[str], bins: int = 10) -> DataFrame:
    """AUC by rank sums with ties averaged, Brier score, calibration error over equal bins, base rate."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(p)) + (F.count("*").over(Window.partitionBy(*keys, p)) - 1) / 2
    ranked = df.select(*keys, F.col(y).cast("double").alias("y"), F.col(p).alias("p"), rank.alias("rank"), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin"))
    n1 = F.sum("y")
    auc = ratio(F.sum(F.col("y") * F.col("rank")) - n1 * (n1 + 1) / 2, n1 * (F.count("*") - n1))
    main = ranked.groupBy(*keys).agg(F.count("*").alias("n"), auc.alias("auc"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base_rate"))
    per = ranked.groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    ece = per.groupBy(*keys).agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"))
    return main.join(ece, keys)


def information_coefficient(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """Spearman correlation per group and its t."""
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    g = df.select(*keys, rank(y).alias("a"), rank(p).alias("b")).groupBy(*keys).agg(F.count("*").alias("n"), correlation("a", "b").alias("ic"))
    return g.withColumn("t_stat", ratio(F.col("ic") * F.sqrt("n"), F.sqrt(1 - F.col("ic") * F.col("ic"))))


def psi(reference: DataFrame, current: DataFrame, x: str, keys: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index by decile edges of the reference, equal edges once; values outside count nowhere."""
    edges = reference.groupBy(*keys).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(k / bins) for k in range(bins + 1)]))).alias("edges"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        b = df.join(edges, keys).where((F.col(x) >= F.col("edges")[0]) & (F.col(x) <= F.element_at("edges", -1)))
        bin_ = F.greatest(F.lit(1), F.least(F.size("edges") - 1, F.size(F.filter("edges", lambda e: e <= F.col(x)))))
        return b.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias(name))

    both = counted(reference, "r").join(counted(current, "c"), [*keys, "bin"], "full_outer").fillna(0, ["r", "c"])
    w = Window.partitionBy(*keys)
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(w), F.lit(eps))
    parts = both.select(*keys, ((share("c") - share("r")) * F.ln(share("c") / share("r"))).alias("part"))
    out = parts.groupBy(*keys).agg(F.sum("part").alias("psi"))
    return out.withColumn("severity", F.when(F.col("psi") > 0.25, "major").when(F.col("psi") > 0.1, "minor").otherwise("none"))


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Largest gap of the two distribution functions."""
    both = reference.select(*keys, F.col(x).alias("x"), F.lit(1).alias("r"), F.lit(0).alias("c")).union(current.select(*keys, F.col(x).alias("x"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    steps = both.groupBy(*keys, "x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    w, t = so_far(keys, "x"), Window.partitionBy(*keys)
    gap = F.abs(F.sum("r").over(w) / F.sum("r").over(t) - F.sum("c").over(w) / F.sum("c").over(t))
    return steps.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def regression_metrics(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(ratio(e, y))).alias("mape"), F.coalesce(ratio(F.avg(e), F.stddev_pop(e)), F.lit(0.0)).alias("error_sharpe"))


def rolling_folds(dates: DataFrame, train: int, test: int, gap: int = 0, step: int | None = None, expanding: bool = False, at: str = "dt") -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) over the distinct dates: training on a fixed number of dates or
    on all before (expanding), a gap (purge and embargo), then the test. Only whole folds. Dates are one calendar."""
    numbered = dates.select(at).distinct().withColumn("k", F.row_number().over(Window.orderBy(at)) - 1)
    size, by = train + gap + test, step or test
    starts = numbered.agg(F.max("k").alias("last")).where(F.col("last") + 1 >= size).select(F.explode(F.sequence(F.lit(0), F.col("last") + 1 - size, F.lit(by))).alias("start"))
    bounds = {"train_start": F.lit(0) if expanding else F.col("start"), "train_end": F.col("start") + train - 1, "test_start": F.col("start") + train + gap, "test_end": F.col("start") + size - 1}
    out = starts.select((F.col("start") / by).cast("int").alias("fold"), *[v.cast("int").alias(f"{n}_k") for n, v in bounds.items()])
    for n in bounds:
        out = out.join(numbered.select(F.col("k").alias(f"{n}_k"), F.col(at).alias(n)), f"{n}_k")
    return out.select("fold", *bounds)
