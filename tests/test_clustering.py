"""Clusters by medoids against a plain version, known clusters, and silhouettes against their definition."""

import numpy as np
import pytest

from spreadloom.operators import clustering as cl


def frame(spark, corr):
    names = [f"s{i:02d}" for i in range(len(corr))]
    rows = [(names[i], names[j], None if np.isnan(corr[i, j]) else float(corr[i, j])) for i in range(len(corr)) for j in range(i + 1, len(corr))]
    return names, spark.createDataFrame(rows, "sym_x string, sym_y string, corr double")


def plain(names, d, ks, rounds=20):
    d = np.round(d, 9)
    n = len(names)
    total = lambda v: round(float(v), 9)
    centres = [min(range(n), key=lambda i: (total(d[i].sum()), i))]
    while len(centres) < min(max(ks), n):
        centres.append(min((i for i in range(n) if i not in centres), key=lambda i: (-min(d[i][c] for c in centres), i)))
    out = {}
    for k in (k for k in ks if k <= len(centres)):
        medoids = set(centres[:k])
        for _ in range(rounds):
            of = {i: i if i in medoids else min(medoids, key=lambda c: (d[i][c], c)) for i in range(n)}
            new = set()
            for m in medoids:
                own = [i for i in range(n) if of[i] == m]
                new.add(min(own, key=lambda i: (total(sum(d[i][j] for j in own if j != i)), i)))
            if new == medoids:
                break
            medoids = new
        out[k] = of
    return out


def silhouette(d, of, i):
    groups = {}
    for j, m in of.items():
        if j != i:
            groups.setdefault(m, []).append(d[i][j])
    outer = min((np.mean(v) for m, v in groups.items() if m != of[i]), default=None)
    if outer is None:
        return None
    inner = np.mean(groups[of[i]]) if of[i] in groups else None
    return 0.0 if inner is None or max(inner, outer) == 0 else (outer - inner) / max(inner, outer)


@pytest.mark.parametrize("n, seed", [(14, 1), (9, 2)])
def test_clusters_and_silhouettes(spark, n, seed):
    rng = np.random.default_rng(seed)
    corr = np.corrcoef(rng.normal(size=(n, 12)))
    corr[0, 1] = corr[1, 0] = np.nan
    names, pairs = frame(spark, corr)
    d = 1 - np.abs(np.nan_to_num(corr))
    np.fill_diagonal(d, 0)
    table = cl.distance_table(pairs)
    members = cl.medoid_clusters(table, [2, 3, 5, 20])
    want = plain(names, d, [2, 3, 5, 20])
    got = {(r.k, r.symbol): r.medoid for r in members.collect()}
    assert got == {(k, names[i]): names[m] for k, of in want.items() for i, m in of.items()} and {k for k, _ in got} == {2, 3, 5}
    values = cl.silhouettes(table, members)
    for r in values.collect():
        s = silhouette(np.round(d, 9), want[r.k], names.index(r.symbol))
        assert (r.silhouette is None) == (s is None) and (s is None or abs(r.silhouette - s) < 1e-9)
    means = {k: round(np.mean([silhouette(np.round(d, 9), of, i) for i in range(n)]), 9) for k, of in want.items()}
    chosen = [r.k for r in cl.scored(values).collect() if r.chosen]
    assert len(chosen) == 1 and means[chosen[0]] == max(means.values())


def test_known_clusters_are_found_and_limit_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 200))
    series = np.array([base[i % 3] * (1 if i % 2 else -1) + 0.4 * rng.normal(size=200) for i in range(12)])
    names, pairs = frame(spark, np.corrcoef(series))
    found = cl.chosen_clusters(cl.distance_table(pairs), [2, 3, 4, 5])
    rows = found.collect()
    assert {r.k for r in rows} == {3} and len(rows) == 12 and min(r.silhouette for r in rows) > 0.5
    groups = {}
    for r in rows:
        groups.setdefault(r.medoid, set()).add(int(r.symbol[1:]) % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    inside = cl.pairs_within(pairs, found, 0.3).collect()
    assert len(inside) == 18 and all(int(r.sym_x[1:]) % 3 == int(r.sym_y[1:]) % 3 for r in inside)


def test_no_symbols(spark):
    _, pairs = frame(spark, np.eye(0))
    table = cl.distance_table(pairs)
    assert cl.medoid_clusters(table, [2, 3]).count() == 0 and cl.chosen_clusters(table, [2]).count() == 0
