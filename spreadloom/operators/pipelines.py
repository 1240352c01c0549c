"""Compositions that a user calls as one job: discovery, walk-forward evaluation, regimes of pairs, fair value, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import clip, full, ordered, ratio, safe, slope, so_far, trailing, zscore
from spreadloom.operators import pairs as p
from spreadloom.operators import sequential as s
from spreadloom.operators.pairs import in_folds
from spreadloom.operators.tables import top_per


def macro_features(macro: DataFrame, factors: list[str], n: int) -> DataFrame:
    """(dt, factor, value, momentum, z, vol, mean, pct): one window for all features of all series, long."""
    long = macro.select("dt", F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])))
    w = trailing(n, "factor")
    below = F.size(F.filter("_frame", lambda v: v <= F.col("value")))
    out = long.select("*", (F.col("value") - F.lag("value", n).over(ordered("factor"))).alias("momentum"), zscore("value", w, n).alias("z"), full(F.stddev_samp("value").over(w), "value", w, n).alias("vol"), full(F.avg("value").over(w), "value", w, n).alias("mean"), F.collect_list("value").over(w).alias("_frame"))
    return out.withColumn("pct", F.when(F.size("_frame") == n, below / F.lit(float(n)))).drop("_frame")


def fundamentals_panel(frames: list[DataFrame], fields: list[str]) -> DataFrame:
    """Frames of different columns as one panel (symbol, dt, fields), numbers coerced, the last of a month."""
    one = frames[0]
    for f in frames[1:]:
        one = one.unionByName(f, allowMissingColumns=True)
    have = [f for f in fields if f in one.columns]
    rows = one.select("symbol", "dt", F.last_day("dt").alias("month"), *[safe(F.col(f).try_cast("double")).alias(f) for f in have])
    return rows.groupBy("symbol", "month").agg(*[F.max_by(f, "dt").alias(f) for f in have])


def regime_features(spread: DataFrame, key: str = "pair_id", x: str = "spread", short: int = 20, long: int = 60) -> DataFrame:
    """Latest volatility ratio, AR(1), |z| and shift of the mean of each pair, and its regime by ordered rules."""
    a, b = trailing(short, key), trailing(long, key)
    d = spread.withColumns({"_b": F.lag(x).over(ordered(key)), "_c": F.col(x) - F.lag(x).over(ordered(key))})
    f = d.select(
        key, "dt", F.count(x).over(b).alias("n"), ratio(F.stddev_samp("_c").over(a), F.stddev_samp("_c").over(b)).alias("vol_ratio"), slope(x, "_b", b).alias("ar1"), F.abs(zscore(x, b, long)).alias("abs_z"),
        F.abs(ratio(F.avg(x).over(a) - F.avg(x).over(b), F.stddev_samp(x).over(b))).alias("shift"),
    )
    last = f.groupBy(key).agg(F.max_by(F.struct("dt", "n", "vol_ratio", "ar1", "abs_z", "shift"), "dt").alias("l")).select(key, "l.*")
    rule = (
        F.when((F.col("n") < long) | F.col("vol_ratio").isNull(), "UNKNOWN").when(F.col("shift") > 2.5, "BROKEN").when((F.col("vol_ratio") > 2) & (F.col("abs_z") > 3), "CRISIS").when(F.col("ar1") > 0.97, "TRENDING").when(F.col("vol_ratio") > 1.5, "HIGH_VOL").otherwise("MEAN_REVERTING")
    )
    return last.withColumn("regime", rule)


def break_report(spread: DataFrame, key: str = "pair_id", x: str = "spread") -> DataFrame:
    """CUSUM range over sqrt(n), where it is largest, and severity."""
    w = Window.partitionBy(key)
    c = spread.withColumn("_s", ratio(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w))).withColumn("_c", F.sum("_s").over(so_far(key)))
    g = c.groupBy(key).agg(((F.max("_c") - F.min("_c")) / F.sqrt(F.count("_s"))).alias("stat"), F.max_by("dt", F.struct(F.round(F.abs("_c"), 9), "dt")).alias("break_dt"))
    return g.withColumn("severity", F.when(F.col("stat") > 4, "CRITICAL").when(F.col("stat") > 3, "MAJOR").when(F.col("stat") > 1.63, "MINOR").otherwise("NONE"))


def fair_values(pairs: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Per pair and window of last rows: log regression, fair y, latest z (sample sd), band; and the mean z over windows."""
    age = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("dt").desc()))
    rows = pairs.select("pair_id", F.ln("x").alias("lx"), F.ln("y").alias("ly"), age.alias("age")).withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where("age <= window")
    g = rows.groupBy("pair_id", "window").agg(F.count("*").alias("n"), slope("ly", "lx").alias("beta"), F.avg("ly").alias("my"), F.avg("lx").alias("mx"), F.var_samp("ly").alias("vy"), F.covar_samp("lx", "ly").alias("c"), F.max(F.when(F.col("age") == 1, F.col("lx"))).alias("x1"), F.max(F.when(F.col("age") == 1, F.col("ly"))).alias("y1"))
    fair = F.col("my") + F.col("beta") * (F.col("x1") - F.col("mx"))
    sd = F.sqrt(F.greatest(F.col("vy") - F.col("beta") * F.col("c"), F.lit(0.0)))
    z = g.where("n = window").select("pair_id", "window", "beta", F.exp(fair).alias("fair_y"), ratio(F.col("y1") - fair, sd).alias("z"), F.exp(fair - 1.96 * sd).alias("low"), F.exp(fair + 1.96 * sd).alias("high"))
    return z.withColumn("ensemble_z", F.avg("z").over(Window.partitionBy("pair_id")))


def candidates(series: DataFrame, value: str, low: float, most: int | None = None, alpha: float = 0.2, least: int = 30, groups: DataFrame | None = None) -> DataFrame:
    """Families by correlation, by distance and within clusters (symbol, cluster), the best of each pair, all screened
    by Engle-Granger; ``most`` of those that pass, by quality, if given."""
    every = p.all_pairs(series, value)
    corr = p.pair_correlation(every, low, least=least)
    found = corr.where("is_candidate").select("pair_id", F.lit("correlation").alias("family"), F.abs("corr").alias("quality"))
    found = found.unionByName(p.price_distance(every).where("score >= 0.2").select("pair_id", F.lit("distance").alias("family"), F.col("score").alias("quality")))
    if groups is not None:
        of = lambda leg: groups.select(F.col("symbol").alias(leg), "cluster")
        inside = corr.where(F.abs("corr") >= 0.8 * low).join(of("sym_x"), "sym_x").join(of("sym_y"), ["sym_y", "cluster"])
        found = found.unionByName(inside.select("pair_id", F.lit("cluster").alias("family"), F.abs("corr").alias("quality")))
    # of equal quality: correlation before cluster, then distance
    place = F.array_position(F.array(*map(F.lit, ("correlation", "cluster", "distance"))), F.col("family"))
    best = top_per(found, ["pair_id"], [F.col("quality").desc(), place], 1).drop("place")
    tested = s.pair_tests(every.join(best.select("pair_id"), "pair_id", "left_semi"), least=least).select("pair_id", "eg_p")
    passed = best.join(tested, "pair_id").where(F.coalesce(F.col("eg_p") <= alpha, F.lit(False)))
    return passed if most is None else passed.orderBy(F.col("quality").desc(), "pair_id").limit(most)


def walk_forward(pairs: DataFrame, folds: DataFrame, entry: float, exit_: float) -> DataFrame:
    """Per pair and fold: hedge and z fitted on the train part alone, episodes on the test part, their count and pnl."""
    tagged = in_folds(pairs, folds).withColumn("pair_id", F.concat_ws("@", "pair_id", "fold"))
    train = tagged.where("part = 'train'")
    hedge = p.static_hedge(train)
    fit = p.spread(train, hedge).groupBy("pair_id").agg(F.avg("spread").alias("m"), F.stddev_samp("spread").alias("sd"))
    test = p.spread(tagged.where("part = 'test'"), hedge).join(fit, "pair_id").select("pair_id", "dt", ratio(F.col("spread") - F.col("m"), "sd").alias("z"))
    done = s.trade_episodes(test, entry, exit_, 6.0, 30).where("event <> 'OPEN'")
    g = test.select("pair_id").distinct().join(done.groupBy("pair_id").agg(F.count("*").alias("n_trades"), F.sum("pnl_z").alias("pnl_z")), "pair_id", "left")
    return g.select(F.split("pair_id", "@")[0].alias("pair_id"), F.split("pair_id", "@")[1].cast("int").alias("fold"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.coalesce("pnl_z", F.lit(0.0)).alias("pnl_z"))


def decisions(candidates_: DataFrame, verdicts: DataFrame, regimes: DataFrame) -> DataFrame:
    """Weighted score of the evidence and the decision, ranked."""
    j = candidates_.join(verdicts.select("pair_id", "verdict"), "pair_id", "left").join(regimes.select("pair_id", "regime"), "pair_id", "left")
    score = 0.5 * clip("quality", 0.0, 1.0) + F.when(F.col("verdict") == "PASS", 0.3).when(F.col("verdict") == "WARN", 0.15).otherwise(0.0) + F.when(F.col("regime") == "MEAN_REVERTING", 0.2).otherwise(0.0)
    d = j.withColumn("score", score)
    out = d.withColumn("decision", F.when(F.col("regime").isin("BROKEN", "CRISIS"), "REJECTED").when(F.col("score") >= 0.75, "PORTFOLIO_READY").when(F.col("score") >= 0.5, "WATCHLIST").when(F.col("score") >= 0.25, "RESEARCH_ONLY").otherwise("REJECTED"))
    return ranked(out, F.round("score", 9), "pair_id")


def ranked(df: DataFrame, score: Column, key: str, cells: int = 1000) -> DataFrame:
    """``rank`` by a score of a few units, falling, and the key: the rank within a cell of the score after the sizes of the
    cells above; without score: last."""
    cell = F.coalesce(F.floor(score * cells), F.lit(-(2**62))).alias("_cell")
    own = df.select("*", cell)
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_cell").count().select("_cell", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_above"))  # as many rows as the range of scores has cells
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(score.desc(), key))
    return own.withColumn("_in", inside).join(F.broadcast(sizes), "_cell").select(*df.columns, (F.col("_above") + F.col("_in")).cast("int").alias("rank"))


def uncorrelated(df: DataFrame, columns: list[str], bound: float) -> list[str]:
    """Columns without those that vary not at all or correlate with an earlier kept one above the bound."""
    from pyspark.ml.stat import Correlation

    from spreadloom.operators.scoring import vectors

    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    moving = [c for c in columns if sd[c]]
    if len(moving) < 2:
        return moving
    m = Correlation.corr(vectors(df.select(*moving), moving), "features").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(moving)):
        if all(abs(m[i, j]) <= bound for j in kept):
            kept.append(i)
    return [moving[i] for i in kept]


def calibrated(df: DataFrame, score: str, label: str, fit_on: Column, method: str = "isotonic") -> DataFrame:
    """The rows where ``fit_on`` doesn't hold, with a calibration of a score, isotonic or sigmoid, that is fitted on the
    other rows whose label is known."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from spreadloom.operators.scoring import vectors

    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    known, rest = df.where(fit_on & y.isNotNull()), df.where(~F.coalesce(fit_on, F.lit(False)))
    if method == "isotonic":
        model = IsotonicRegression(isotonic=True).fit(known.select(x.alias("features"), y.alias("label")))
        return model.transform(rest.withColumn("features", x)).withColumnRenamed("prediction", "calibrated").drop("features")
    model = LogisticRegression(maxIter=50).fit(vectors(known.select(x.alias("_x"), y.alias("label")), ["_x"]))
    scored = model.transform(vectors(rest.withColumn("_x", x), ["_x"]))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("calibrated"))


def calibration_errors(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(n, brier, ece, mce): mean squared error, and mean and largest gap of probability and share over equal bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.where(F.col(label).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("m"), F.abs(F.avg(p) - F.avg(label)).alias("gap"), F.sum(F.pow(F.col(p) - F.col(label), 2)).alias("square"))
    return per.agg(F.sum("m").alias("n"), (F.sum("square") / F.sum("m")).alias("brier"), (F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"), F.max("gap").alias("mce"))


def importances(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, gain) of a random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    from spreadloom.operators.scoring import vectors

    data = vectors(df.where(F.col(label).isNotNull()), columns).withColumn("label", F.col(label).cast("double"))
    model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=7).fit(data)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, gain double")


def portfolio_kpis(legs: DataFrame, equity: float) -> DataFrame:
    n = F.col("notional")
    return legs.agg(F.sum(F.abs(n)).alias("gross"), F.sum(n).alias("net"), (F.sum(F.abs(n)) / equity).alias("leverage"), F.countDistinct("pair").alias("n_pairs"), F.count_if(n > 0).alias("n_long"), F.count_if(n < 0).alias("n_short"))
