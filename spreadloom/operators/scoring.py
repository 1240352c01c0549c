"""Universe scoring, verdicts, macro regimes, and the jobs that use pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import Col, col, correlation, ordered, ratio
from spreadloom.operators.tables import cumulated, ranked


def validated(metrics: DataFrame, tests: DataFrame, stability: DataFrame, least_n: int = 252, corr: float = 0.6, p: float = 0.1, low: float = 2.0, high: float = 120.0, ratios: DataFrame | None = None) -> DataFrame:
    """FAIL if a hard test fails, WARN if a soft one, else PASS; a missing p-value passes and is counted. With ``ratios``
    (pair_id, vr), a variance ratio of 1 or more, which is no mean reversion, is a soft failure; a missing one passes."""
    c = F.col
    j = metrics.join(tests.drop("n"), "pair_id").join(stability, "pair_id", "left")
    rules = [
        ("correlation", True, c("corr") >= corr, c("corr")), ("adf", True, c("adf_p") <= p, c("adf_p")), ("engle_granger", True, c("eg_p") <= p, c("eg_p")), ("half_life", True, c("half_life").between(low, high), c("half_life")),
        ("history", True, c("n_obs") >= least_n, c("n_obs").cast("double")), ("spread_sd", True, c("spread_vol") >= 1e-8, c("spread_vol")), ("hurst", False, c("hurst") <= 0.45, c("hurst")), ("stability", False, c("stability") >= 0.6, c("stability")),
        ("kpss", False, c("kpss_p") > 0.05, c("kpss_p")), ("johansen", False, c("johansen_ok"), c("trace0")),
    ]
    if ratios is not None:
        j = j.join(ratios.select("pair_id", "vr"), "pair_id", "left")
        rules.append(("variance_ratio", False, c("vr") < 1, c("vr")))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(n in ("adf", "engle_granger", "variance_ratio"))).alias("passed"), F.lit(h).alias("is_hard"), v.alias("value")) for n, h, ok, v in rules])
    out = j.select("pair_id", rows.alias("tests"), sum(v.isNull().cast("int") for _, _, _, v in rules).alias("n_tests_missing"))
    failed = lambda hard: F.size(F.filter("tests", lambda t: ~t["passed"] & (t["is_hard"] == hard)))
    return out.withColumn("verdict", F.when(failed(True) > 0, "FAIL").when(failed(False) > 0, "WARN").otherwise("PASS"))


def macro_shocks(macro: DataFrame, factors: list[str], windows: tuple[int, ...], least: float, most: int) -> DataFrame:
    """Changes over k rows in sd of such changes, the largest of each factor and window."""
    long = macro.select("dt", F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("v")) for f in factors])))
    o = Window.partitionBy("factor").orderBy("dt")
    lagged = long.select("factor", "dt", *[(F.col("v") - F.lag("v", k).over(o)).alias(f"c{k}") for k in windows])
    changes = lagged.select("factor", "dt", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("chg")) for k in windows])))
    z = changes.withColumn("z", ratio("chg", F.stddev_samp("chg").over(Window.partitionBy("factor", "k")))).where(F.abs("z") >= least)
    return z.withColumn("place", F.row_number().over(Window.partitionBy("factor", "k").orderBy(F.abs("z").desc(), "dt"))).where(F.col("place") <= most)


def macro_regimes(macro: DataFrame, growth: str, inflation: str) -> DataFrame:
    """Label of each date from z scores over its history so far. One macro table is one series."""
    e = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    z = lambda c: ratio(F.col(c) - F.avg(c).over(e), F.stddev_pop(c).over(e))
    g, i = F.col("growth_z"), F.col("inflation_z")
    label = F.when(g.isNull() | i.isNull(), "unknown").when((g > 0.5) & (i <= 0.5), "growth").when((g < -0.5) & (i > 0.5), "stagflation").when(i > 0.5, "inflation").when(g < -0.5, "recession").otherwise("neutral")
    return macro.select("dt", z(growth).alias("growth_z"), z(inflation).alias("inflation_z")).withColumn("regime", label)


def horizon_percentiles(df: DataFrame, value: str, days: tuple[int, ...], key: str = "symbol") -> DataFrame:
    """Share of history within n days of the last date at or below the last value."""
    w = Window.partitionBy(key)
    h = df.select(key, F.col(value).alias("v"), F.datediff(F.max("dt").over(w), "dt").alias("age"), F.max_by(value, "dt").over(w).alias("last"))
    rows = h.withColumn("days", F.explode(F.array(*map(F.lit, days)))).where("age <= days")
    return rows.groupBy(key, "days").agg((100 * F.avg((F.col("v") <= F.col("last")).cast("double"))).alias("percentile"))


def group_statistics(meta: DataFrame, score: str) -> DataFrame:
    """Mean score by sector and by tag, in one scan."""
    rows = meta.select(F.col(score).alias("s"), F.explode(F.concat(F.array(F.struct(F.lit("sector").alias("dim"), F.col("sector").alias("name"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("dim"), t.alias("name"))))).alias("g"))
    return rows.groupBy("g.dim", "g.name").agg(F.count("*").alias("n"), F.avg("s").alias("mean"))


def similarity(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Cosine, mapped to 0..1, and 1 / (1 + distance) of standardised metric vectors, for all pairs of profiles."""
    long = df.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in metrics])))
    w = Window.partitionBy("k")
    z = long.select("id", "k", ratio(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)).alias("v"))
    a, b = z.select(F.col("id").alias("a"), "k", F.col("v").alias("x")), z.select(F.col("id").alias("b"), "k", F.col("v").alias("y"))
    x, y = F.col("x"), F.col("y")
    out = a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.sum(x * y).alias("xy"), F.sqrt(F.sum(x * x)).alias("xx"), F.sqrt(F.sum(y * y)).alias("yy"), F.sqrt(F.sum((x - y) * (x - y))).alias("d"))
    return out.select("a", "b", ((ratio("xy", F.col("xx") * F.col("yy")) + 1) / 2).alias("cosine"), (1 / (1 + F.col("d"))).alias("euclid"))


def corrected_p(df: DataFrame, p: str, key: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg p-values. Equal p-values are corrected alike, so the work is on distinct ones: ranks
    by ranges, and the least from the right within a range and over the ranges to its right."""
    own = df.select(key, F.col(p).alias("p"))
    counts = own.groupBy("p").agg(F.count("p").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    raw = cumulated(counts, "p").crossJoin(F.broadcast(total)).withColumn("raw", F.col("p") * F.col("all") / F.col("upto"))
    right = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = raw.groupBy("range").agg(F.min("raw").alias("least")).select("range", F.min("least").over(right).alias("beyond"))  # one row a range
    inside = F.min("raw").over(Window.partitionBy("range").orderBy(F.col("p").desc()))
    done = raw.join(F.broadcast(beyond), "range").select("p", F.least(F.lit(1.0), F.col("p") * F.col("all")).alias("bonferroni"), F.least(F.lit(1.0), inside, F.col("beyond")).alias("bh"))
    return own.join(done, "p", "left").select(key, "p", "bonferroni", "bh")


def distance_score(v: Col, tolerance: float, most: float, shape: float) -> Column:
    a = F.abs(col(v))
    return F.when(a <= tolerance, 100.0).when(a >= most, 0.0).otherwise(100 * (1 - F.pow((a - tolerance) / (most - tolerance), shape)))


def learned_ranges(df: DataFrame, score: str, params: list[str], top: float, key: str) -> DataFrame:
    """[q25, q75] of each parameter among the best rows by score: the top share, at least ten."""
    best = ranked(df, F.col(score), key).where(F.col("rank") <= F.greatest(F.lit(10), F.floor(F.col("n_ranked") * top)))
    long = best.select(F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("v")) for p in params])))
    return long.groupBy("param").agg(F.percentile("v", 0.25).alias("low"), F.percentile("v", 0.75).alias("high"))


def return_decomposition(df: DataFrame, price: str, earnings: str, key: str = "symbol") -> DataFrame:
    """Total return, growth of earnings and of the multiple between the first and last date; null unless all are positive."""
    g = df.groupBy(key).agg(*[f(c, "dt").alias(n) for n, f, c in (("p0", F.min_by, price), ("p1", F.max_by, price), ("e0", F.min_by, earnings), ("e1", F.max_by, earnings))])
    ok = (F.col("p0") > 0) & (F.col("e0") > 0) & (F.col("e1") > 0)
    grow = lambda a, b: F.when(ok, b / a - 1)
    return g.select(key, grow(F.col("p0"), F.col("p1")).alias("total"), grow(F.col("e0"), F.col("e1")).alias("earnings"), grow(F.col("p0") / F.col("e0"), F.col("p1") / F.col("e1")).alias("rerating"))


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def partial_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """-P_ij / sqrt(P_ii P_jj) of the inverse correlation matrix: the matrix is a distributed aggregate, k by k at its end."""
    import numpy as np
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(vectors(df, columns), "features").first()[0].toArray()
    inverse = np.linalg.pinv(m)
    d = np.sqrt(np.diag(inverse))
    rows = [(a, b, float(-inverse[i, j] / (d[i] * d[j]))) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, partial double")


def clusters(bars: DataFrame, k: int) -> DataFrame:
    """Clusters of symbols by power iteration on the similarity (1 + corr) / 2 of their returns."""
    from pyspark.ml.clustering import PowerIterationClustering

    r = bars.select("symbol", "dt", F.ln(ratio("vwap", F.lag("vwap").over(ordered()))).alias("r")).where("r IS NOT NULL")
    names = bars.select("symbol").distinct().withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol")).cast("long"))  # one row a symbol
    a, b = r.select(F.col("symbol").alias("sa"), "dt", F.col("r").alias("x")), r.select(F.col("symbol").alias("sb"), "dt", F.col("r").alias("y"))
    edges = a.join(b, "dt").where("sa < sb").groupBy("sa", "sb").agg(((1 + F.coalesce(correlation("x", "y"), F.lit(0.0))) / 2).alias("weight"))
    ids = edges.join(names.select(F.col("symbol").alias("sa"), F.col("id").alias("src")), "sa").join(names.select(F.col("symbol").alias("sb"), F.col("id").alias("dst")), "sb")
    found = PowerIterationClustering(k=k, maxIter=20, weightCol="weight").assignClusters(ids.select("src", "dst", "weight"))
    return found.join(names, "id").select("symbol", "cluster")


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(dt, scores) of the standardised columns."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    v = vectors(df, columns)
    v = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(v).transform(v)
    return PCA(k=k, inputCol="scaled", outputCol="pca").fit(v).transform(v).select("dt", vector_to_array("pca").alias("scores"))


def trained_scores(data: DataFrame, columns: list[str], label: str, train_end: str) -> DataFrame:
    """(pair_id, dt, probability, action) of rows after ``train_end``, by a logistic model of rows up to it. Rows with
    missing features get a neutral 0.5."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    known = data.where(F.col(label).isNotNull())
    train = vectors(known.where(F.col("dt") <= F.lit(train_end).cast("date")), columns).withColumn("label", F.col(label).cast("double"))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(train)
    later = data.where(F.col("dt") > F.lit(train_end).cast("date")).select("pair_id", "dt", *columns)
    good = model.transform(vectors(later, columns)).select("pair_id", "dt", vector_to_array("probability")[1].alias("p"))
    out = later.select("pair_id", "dt").join(good, ["pair_id", "dt"], "left").select("pair_id", "dt", F.coalesce("p", F.lit(0.5)).alias("probability"))
    return out.withColumn("action", F.when(F.col("probability") >= 0.6, "take").when(F.col("probability") <= 0.4, "skip").otherwise("neutral"))


def tree_scores(data: DataFrame, columns: list[str], label: str, train_end: str, trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """(model, pair_id, dt, probability) of rows after ``train_end`` with all features, by a random forest and by boosted trees
    of the rows up to it."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    end = F.lit(train_end).cast("date")
    known = vectors(data.where(F.col(label).isNotNull() & (F.col("dt") <= end)), columns).withColumn("label", F.col(label).cast("double"))
    later = vectors(data.where(F.col("dt") > end).select("pair_id", "dt", *columns), columns)
    models = {
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed), "boosting": GBTClassifier(maxIter=trees, maxDepth=depth - 1, seed=seed)
    }
    out = [m.fit(known).transform(later).select(F.lit(name).alias("model"), "pair_id", "dt", vector_to_array("probability")[1].alias("probability")) for name, m in models.items()]
    return out[0].unionByName(out[1])


def block_bootstrap(df: DataFrame, r: str, key: str, replicates: int, block: int, seed: int = 42) -> DataFrame:
    """Per series: observed mean and the 5 and 95 % quantiles of means of resampled blocks. Draws are hashes of (series,
    replicate, block place), so that a task run again draws the same."""
    o = ordered(key)
    rows = df.select(key, F.col(r).alias("r"), F.floor((F.row_number().over(o) - 1) / block).cast("int").alias("blk"))
    per = rows.groupBy(key, "blk").agg(F.sum("r").alias("s"), F.count("*").alias("m"))
    n = per.groupBy(key).agg(F.count("*").alias("n_blocks"), (F.sum("s") / F.sum("m")).alias("observed"))
    draws = n.select(key, "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select(key, "n_blocks", "rep", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("place"))
    draws = draws.withColumn("blk", F.pmod(F.xxhash64(F.lit(seed), key, "rep", "place"), "n_blocks").cast("int"))
    means = draws.join(per, [key, "blk"]).groupBy(key, "rep").agg((F.sum("s") / F.sum("m")).alias("mean"))
    q = means.groupBy(key).agg(F.percentile("mean", 0.05).alias("low"), F.percentile("mean", 0.95).alias("high"))
    return n.join(q, key).select(key, "observed", "low", "high", (F.col("low") > 0).alias("is_positive"))


def matrices(cells: DataFrame, key: str, n_rows: int, n_cols: int) -> DataFrame:
    """(key, matrix array<array<double>>) from (key, r, c, v); cells not given are null."""
    m = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * n_cols + F.col("c")).alias("at"), F.col("v").alias("v")))).alias("m"))
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda c: F.try_element_at("m", (r * n_cols + c).cast("int")))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), row).alias("matrix"))


def matrix_cells(m: DataFrame, key: str) -> DataFrame:
    """(key, r, c, v) of every cell."""
    return m.select(key, F.posexplode("matrix").alias("r", "row")).select(key, "r", F.posexplode("row").alias("c", "v"))


def matrix_statistics(m: DataFrame, key: str) -> DataFrame:
    return matrix_cells(m, key).groupBy(key).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.sum(F.when(F.col("r") == F.col("c"), F.col("v"))).alias("trace"))


def factor_regression(data: DataFrame, key: str, y: str, factors: list[str]) -> DataFrame:
    """(key, factor, n, beta, t, r2, marginal_r2) of a regression with constant of y on the factors, for each key. The
    moments are one aggregate with partial sums; a key's small system is solved from its row. Factors that are constant
    or all but equal to an earlier one (correlation over 0.98) are left out of their key."""
    names = [*factors, y]
    sums = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]]
    sums += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    whole_rows = data.dropna(subset=names)
    moments = whole_rows.groupBy(key).agg(*sums)
    kind = data.schema[key].dataType.simpleString()

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(factors)
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                s = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) * row["n"]
                use: list[int] = []
                for i in range(k):
                    if s[i, i] > 1e-12 and all(abs(s[i, j]) <= 0.98 * (s[i, i] * s[j, j]) ** 0.5 for j in use):
                        use.append(i)
                free = row["n"] - len(use) - 1
                if not use or free < 3 or s[k, k] <= 0:
                    continue
                explained = lambda at: float(s[at, k] @ np.linalg.solve(s[np.ix_(at, at)], s[at, k])) if at else 0.0
                inverse = np.linalg.inv(s[np.ix_(use, use)])
                beta, r2 = inverse @ s[use, k], explained(use)
                error = (s[k, k] - r2) / free
                for place, i in enumerate(use):
                    rest = [j for j in use if j != i]
                    out.append((row[key], factors[i], row["n"], beta[place], beta[place] / (error * inverse[place, place]) ** 0.5, r2 / s[k, k], (r2 - explained(rest)) / s[k, k]))
            yield pd.DataFrame(out, columns=[key, "factor", "n", "beta", "t", "r2", "marginal_r2"])

    return moments.mapInPandas(solved, f"{key} {kind}, factor string, n long, beta double, t double, r2 double, marginal_r2 double")


def covariance_variants(returns: DataFrame, share: float, ridge: float) -> DataFrame:
    """(a, b, sample, shrunk, oas, ridge) of returns (symbol, dt, ret): shrunk to the mean variance by a stated share and by
    the oracle-approximating share, and with a ridge of a share of the mean variance. The traces are one aggregate."""
    one = returns.select("dt", F.col("symbol").alias("a"), F.col("ret").alias("ra"))
    two = returns.select("dt", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    c = one.join(two, "dt").where("a <= b").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("sample"), F.count("*").alias("n"))
    own = F.col("a") == F.col("b")
    k = c.agg(F.count_if(own).cast("double").alias("p"), F.max("n").cast("double").alias("rows"), F.sum(F.when(own, F.col("sample"))).alias("tr"), F.sum(F.col("sample") ** 2 * F.when(own, 1).otherwise(2)).alias("tr2"))
    top = (1 - 2 / F.col("p")) * F.col("tr2") + F.col("tr") ** 2
    rho = F.least(F.lit(1.0), top / ((F.col("rows") + 1 - 2 / F.col("p")) * (F.col("tr2") - F.col("tr") ** 2 / F.col("p"))))
    one_row = k.select((F.col("tr") / F.col("p")).alias("mu"), rho.alias("rho"))
    on = lambda v: F.when(own, v * F.col("mu")).otherwise(0.0)
    v = F.col("sample")
    return c.crossJoin(F.broadcast(one_row)).select("a", "b", "sample", ((1 - share) * v + on(F.lit(share))).alias("shrunk"), ((1 - F.col("rho")) * v + on(F.col("rho"))).alias("oas"), (v + on(F.lit(ridge))).alias("ridge"))
