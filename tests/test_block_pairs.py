"""Block pairs: how often terms are sent, strips, and equal terms as one node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vigilark.operators import hdbscan, hierarchy, similarity
from vigilark.plans.groups import QUERIES


def table(spark, v):
    return spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "term bigint, v array<double>")


def test_terms_of_all_pairs_are_sent_to_few_blocks(spark, monkeypatch):
    """Before, a term was sent once for each BLOCK terms, so what was shuffled grew with the square of their number."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    sent = []
    dealt = similarity._block_pairs

    def counted(*args, **named):
        rows = dealt(*args, **named)
        sent.append(rows.count())
        return rows

    monkeypatch.setattr(similarity, "_block_pairs", counted)
    v = np.random.default_rng(0).normal(size=(150, 3))
    terms = table(spark, v)
    found = similarity.all_pairs(terms, "euclidean").toPandas()
    assert len(found) == 150 * 149 // 2 == len(found[["i", "j"]].drop_duplicates()) and (found["i"] < found["j"]).all()
    assert np.allclose(found["sim"], -np.linalg.norm(v[found["i"]] - v[found["j"]], axis=1), atol=1e-6)
    similarity.properties_of(terms, ["cosine", "euclidean", "manhattan"]).collect()
    assert sent == [150 * similarity.SPREAD] * 2  # and once for three metrics


def test_equal_vectors_are_one_node_of_the_properties(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 3))[np.r_[np.arange(12), np.zeros(5, int), np.full(8, 7), 3]]
    made = []
    matrix = similarity.pair_matrix
    nodes = similarity._block_pairs
    monkeypatch.setattr(similarity, "_block_pairs", lambda rows, wide=False: made.append(rows.count()) or nodes(rows, wide))
    got = {r["metric"]: r for r in similarity.properties_of(table(spark, v), ["cosine", "euclidean", "braycurtis"]).collect()}
    assert made == [12]  # before, all 26 terms were compared
    for metric, row in got.items():
        want = matrix(metric, v, v)[np.triu_indices(len(v), 1)]
        assert row["n"] == len(want) and np.allclose([row["min"], row["max"], row["mean"]], [want.min(), want.max(), want.mean()], atol=1e-6)


def test_equal_paths_are_one_node_of_the_properties(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rows = [(k, f"a{k % 4}", f"b{k % 2}", "c", "PRIMARY", 0) for k in range(20)] + [(k, f"a{k % 2}", "b0", "c", "SECONDARY", 1) for k in range(0, 20, 4)]
    levels = ["hlt", "hlgt", "soc"]
    paths = spark.createDataFrame(rows, "term bigint, hlt string, hlgt string, soc string, rank string, ord int")
    terms = hierarchy.term_paths(paths, levels).cache()
    assert terms.select("v").distinct().count() == 4
    metrics = ["meanminpath", "primaryminpath", "primarypath_additive"]
    got = {r["metric"]: r for r in similarity.properties_of(terms, metrics).collect()}
    for metric in metrics:
        want = similarity.all_pairs(terms, metric).filter("sim is not null").agg(*[f("sim") for f in (F.count, F.min, F.max, F.avg)]).first()
        assert np.allclose(list(want), [got[metric][c] for c in ("n", "min", "max", "mean")])


def test_the_spanning_tree_sends_terms_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(hdbscan, "BLOCK", 3)
    sent = []
    dealt = hdbscan._block_pairs

    def counted(rows, **named):
        sent.append(dealt(rows, **named).count())
        return dealt(rows, **named)

    monkeypatch.setattr(hdbscan, "_block_pairs", counted)
    v = np.random.default_rng(5).normal(size=(90, 3))
    got = hdbscan.reachability_tree(table(spark, v), 4).collect()
    assert len(got) == 89 and sent and max(sent) == 90 * similarity.SPREAD  # 30 blocks of 3 terms before
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, want = np.zeros(90, bool), reach[0].copy(), []
    inside[0] = True
    for _ in range(89):
        k = int(np.where(inside, np.inf, best).argmin())
        want.append(best[k])
        inside[k] = True
        best = np.minimum(best, reach[k])
    assert np.allclose(sorted(r["w"] for r in got), sorted(want), atol=1e-6)


def test_mean_gains_make_no_similarities_of_all_pairs(spark, sf, monkeypatch):
    def never(*args):
        raise AssertionError("the two means need no properties of all pairs")

    monkeypatch.setattr(similarity, "properties_of", never)
    monkeypatch.setattr(similarity, "pair_properties", never)
    rows = QUERIES["mean_gains"](spark, sf).collect()
    assert {(r["metric"], r["stat"]) for r in rows} == {(m, s) for m in ("cosine", "euclidean") for s in ("valid", "rand")}
