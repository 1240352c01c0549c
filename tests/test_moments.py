"""Regressions, distances, components and importance from moments against numpy, with gaps, constants and ties."""

import numpy as np
import pandas as pd
import pytest

from spreadloom.operators import importance as imp
from spreadloom.operators import moments as mo
from spreadloom.operators import scoring as sc

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    out = []
    for key, n, shift in (("p", 120, 0.0), ("q", 80, 1e4), ("short", 6, 0.0), ("flat", 60, 0.0), ("twin", 60, 0.0)):
        a = rng.normal(size=n) + shift
        f = pd.DataFrame({"symbol": key, "dt": pd.date_range("2020-01-01", periods=n), "a": a, "b": 0.5 * a + rng.normal(size=n), "c": 3 * rng.normal(size=n) - shift})
        if key == "flat":
            f["b"] = 2.0
        if key == "twin":
            f["b"] = 3 * f["a"]
        f["y"] = 2 * f["a"] - f["b"] + 0.3 * rng.normal(size=n)
        out.append(f)
    f = pd.concat(out, ignore_index=True)
    f.loc[[5, 40, 130], "b"] = np.nan
    f.loc[7, "a"] = np.inf
    return f


@pytest.fixture(scope="module")
def rows(spark, table):
    shuffled = table.sample(frac=1, random_state=2)
    return spark.createDataFrame(shuffled).repartition(5)


def whole(table, key, columns=COLS):
    f = table[table.symbol == key]
    return f[np.isfinite(f[columns]).all(axis=1)]


def keyed(df, *columns):
    return {(r.symbol, r.dt.date() if hasattr(r.dt, "date") else r.dt): [r[c] for c in columns] for r in df.collect()}


def test_distances(table, rows):
    got = keyed(mo.distances(rows, "symbol", COLS), "distance")
    rolled = keyed(mo.rolling_distances(rows, "symbol", COLS, 30), "distance")
    n = 0
    for key in table.symbol.unique():
        f = whole(table, key)
        v = f[COLS].to_numpy()
        n += len(f)
        for i, dt in enumerate(f.dt):
            d = got[key, dt.date()][0]
            if key in ("flat", "twin"):
                assert d is None
            else:
                e = v[i] - v.mean(0)
                assert abs(d - np.sqrt(e @ np.linalg.inv(np.cov(v, rowvar=False)) @ e)) < 1e-6
            r = rolled[key, dt.date()][0]
            if i < 30 or key in ("flat", "twin"):
                assert r is None
            else:
                e = v[i] - v[i - 30 : i].mean(0)
                assert abs(r - np.sqrt(e @ np.linalg.inv(np.cov(v[i - 30 : i], rowvar=False)) @ e)) < 1e-5
    assert len(got) == len(rolled) == n


def test_rolling_components_equal_refitting(table, rows):
    got = keyed(mo.rolling_components(rows, "symbol", COLS, 25, 2), "explained", "ratio", "residual_sd")
    for key in table.symbol.unique():
        f = whole(table, key)
        v = f[COLS].to_numpy()
        for i, dt in enumerate(f.dt):
            explained, ratio, sd = got[key, dt.date()]
            if i < 24:
                assert explained is None and ratio is None and sd is None
                continue
            w = v[i - 24 : i + 1] - v[i - 24 : i + 1].mean(0)
            _, s, t = np.linalg.svd(w, full_matrices=False)
            left = w - w @ t[:2].T @ t[:2]
            assert np.allclose(explained, (s**2 / (s**2).sum())[:2], atol=1e-7) and abs(ratio - sum(explained)) < 1e-9 and abs(sd - left.std()) < 1e-5
    alone = keyed(mo.rolling_components(rows, "symbol", COLS, 25, 9), "explained")
    assert all(e is None or len(e) == 2 for (e,) in alone.values())


def test_elastic_nets_meet_their_conditions(table, rows):
    data = rows.where("symbol <> 'q'")
    for l1 in (0.0, 0.5, 1.0):
        got = {}
        for r in mo.elastic_net(data, "symbol", "y", COLS, [0.01, 0.2, 50.0], l1, "2030-01-01").collect():
            got.setdefault((r.symbol, r.penalty), {})[r.feature] = r
        assert {k for k, _ in got} == {"p", "short", "flat", "twin"}
        for (key, penalty), of in got.items():
            f = whole(table, key, [*COLS, "y"])
            x, y = f[COLS].to_numpy(), f["y"].to_numpy()
            sd = x.std(0)
            z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
            w = np.array([of[c].weight for c in COLS])
            pull = z.T @ (y - y.mean() - z @ w) / len(y) - penalty * (1 - l1) * w  # the gradient of the smooth part
            for j in range(3):
                if sd[j] == 0:
                    assert w[j] == 0
                elif w[j] == 0:
                    assert abs(pull[j]) <= penalty * l1 + 1e-8
                else:
                    assert abs(pull[j] - penalty * l1 * np.sign(w[j])) < 1e-6
            fit = of["a"].intercept + x @ np.array([of[c].coefficient for c in COLS])
            assert abs(of["a"].r2 - (1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6 and of["a"].n == len(y)
    assert all(r.weight == 0 for r in mo.elastic_net(data, "symbol", "y", COLS, [50.0], 1.0, "2030-01-01").collect())
    assert mo.elastic_net(data.limit(0), "symbol", "y", COLS, [1.0], 0.5, "2030-01-01").count() == 0


def test_training_never_sees_later_rows(rows):
    with pytest.raises(ValueError, match="2020-04-29"):
        mo.elastic_net(rows, "symbol", "y", COLS, [1.0], 0.5, "2020-03-01")


def test_scores_of_later_rows(rows):
    model = mo.elastic_net(rows.where("symbol = 'p'"), "symbol", "y", COLS, [0.01], 0.0, "2030-01-01")
    of = {r.feature: r for r in model.collect()}
    got = mo.linear_scores(rows, model, "symbol", COLS).collect()
    assert len(got) == rows.count() and all(r.score is None for r in got if r.symbol != "p")
    r = next(r for r in got if r.symbol == "p" and r.b == r.b and abs(r.a) < 1e9)
    assert abs(r.score - of["a"].intercept - sum(of[c].coefficient * r[c] for c in COLS)) < 1e-9


def test_a_permutation_is_one_and_doesnt_depend_on_partitions(spark):
    data = pd.DataFrame({"k": [*range(400), 7, 7], "x": np.arange(402) % 90, "y": 1})
    first = imp.permuted(spark.createDataFrame(data).repartition(7), ["k"], ["x"], 1)
    again = imp.permuted(spark.createDataFrame(data.iloc[::-1]).coalesce(1), ["k"], ["x"], 1)
    other = imp.permuted(spark.createDataFrame(data), ["k"], ["x"], 2)
    as_rows = lambda d: sorted((r.k, r.x, r.other_x) for r in d.collect())
    assert as_rows(first) == as_rows(again) != as_rows(other)
    assert sorted(r[2] for r in as_rows(first)) == sorted(data.x) and sum(a == b for _, a, b in as_rows(first)) < 40


def test_importance_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    data = spark.createDataFrame(pd.DataFrame({"k": range(600), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > 0).astype(int)}))
    score = lambda d: d.selectExpr("*", "1 / (1 + exp(-3 * a)) AS p")
    got = {r.feature: r for r in imp.permutation_importance(data, ["k"], ["a", "b"], "y", score, 3).collect()}
    assert got["a"].accuracy == 1.0 and 0.4 < got["a"].accuracy_drop < 0.6 and got["a"].brier_rise > 0.2
    assert abs(got["b"].accuracy_drop) < 1e-12 and abs(got["b"].brier_rise) < 1e-12 and got["b"].accuracy_sd == 0


def test_trees_learn_a_rule_of_the_past(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.uniform(-1, 1, size=(n, 2))
    days = pd.date_range("2020-01-01", periods=n).date
    data = spark.createDataFrame(pd.DataFrame({"pair_id": "p", "dt": days, "u": x[:, 0], "v": x[:, 1], "y": ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)}))
    got = sc.tree_scores(data, ["u", "v"], "y", "2020-10-31").join(data, ["pair_id", "dt"]).toPandas()
    assert set(got.model) == {"forest", "boosting"} and str(got.dt.min()) > "2020-10-31"
    assert ((got.probability >= 0.5) == (got.y == 1)).groupby(got.model).mean().min() > 0.8
