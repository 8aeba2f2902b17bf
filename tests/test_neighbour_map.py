"""Affinities of neighbours and the map made from them."""

from __future__ import annotations

import math

import numpy as np

from vigilark.operators import neighbour_map


def test_rows_have_the_wanted_perplexity():
    rng = np.random.default_rng(0)
    square, known = rng.uniform(0, 50, (6, 40)), np.ones((6, 40), bool)
    known[5, 4:] = False  # fewer than the perplexity
    p = neighbour_map.row_affinities(square, known, 8.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(p[5, :4], 0.25, atol=1e-6) and (p[~known] == 0).all()
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
    assert np.allclose(entropy[:5], math.log(8.0), atol=1e-6)
    for row, d in zip(p[:5], square[:5], strict=True):  # nearer ones weigh more, as a normal curve does
        i, j = np.argsort(d)[:2]
        assert row[i] > row[j] and math.isclose(math.log(row[i] / row[j]) / (d[j] - d[i]), math.log(row[i] / row[np.argsort(d)[3]]) / (np.sort(d)[3] - d[i]), rel_tol=1e-6)


def test_a_map_keeps_neighbours_and_its_divergence_falls(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.3, (14, 6)) + c for c in (np.zeros(6), np.full(6, 5.0), np.array([5.0, -5, 5, -5, 5, -5]))])
    terms = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "term bigint, v array<double>")
    found = list(neighbour_map.map_rounds(terms, 5.0, 12, 6, rate=10.0))
    assert [step for step, _, _ in found] == [6, 12] and found[1][2] < found[0][2]
    at = {r["term"]: (r["x"], r["y"]) for r in found[1][1].collect()}
    y = np.array([at[k] for k in range(42)])
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.diag(np.full(42, np.inf))
    kept = [(np.argsort(d[k])[:5] // 14 == k // 14).mean() for k in range(42)]
    assert np.mean(kept) > 0.9  # nearest neighbours on the map are of the same group
    edges = neighbour_map.joint(neighbour_map.affinities(terms, 5.0)).toPandas()
    assert math.isclose(edges["p"].sum(), 1.0, rel_tol=1e-9) and set(zip(edges["i"], edges["j"], strict=True)) == set(zip(edges["j"], edges["i"], strict=True))
