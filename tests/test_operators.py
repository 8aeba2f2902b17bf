"""Edge cases, golden values and properties of the toolkit's operators."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilark.functions import distributions, vectors
from vigilark.functions.optimisers import SLOTS, Optimiser
from vigilark.operators import clustering, frequencies, learning, multivariate, relational, sampling, signal, similarity, tests
from vigilark.sources import files, sinks
from vigilark.streaming import reports


@pytest.mark.parametrize(("df1", "df2", "f", "p"), [(1, 10, 4.9646, 0.05), (1, 20, 4.3512, 0.05), (2, 10, 4.1028, 0.05), (2, 2, 3, 0.25), (3, 7, 0, 1)])
def test_f_tail(df1, df2, f, p):
    assert math.isclose(distributions.f_tail(df1, df2, f), p, abs_tol=2e-5)


@settings(max_examples=100, deadline=None)
@given(st.floats(0.5, 40), st.floats(0.5, 40), st.floats(0.001, 0.999))
def test_beta_tails_add_up(a, b, x):
    assert math.isclose(distributions.beta_tail(a, b, x) + distributions.beta_tail(b, a, 1 - x), 1, abs_tol=1e-9)


def test_bh_keeps_four_of_five(spark):
    rows = spark.createDataFrame([("t", p) for p in (0.001, 0.01, 0.02, 0.03, 0.9)], "stat string, p double")
    adjusted = sorted(round(r["p_adjusted"], 4) for r in tests.adjust_pvalues(rows, ["stat"]).collect())
    assert adjusted == [0.005, 0.025, 0.0333, 0.0375, 0.9]
    assert tests.pass_rate(rows, ["stat"]).first()["rate"] == 0.8


def terms(spark, rows):
    return spark.createDataFrame(rows, "term int, v array<double>")


def test_degenerate_vectors(spark):
    t = terms(spark, [(0, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [-1.0, -2.0, -3.0])])
    pairs = t.alias("a").join(t.alias("b"), F.col("a.term") < F.col("b.term"))
    u, v = F.col("a.v"), F.col("b.v")
    got = {(r["i"], r["j"]): r for r in pairs.select(
        F.col("a.term").alias("i"), F.col("b.term").alias("j"), vectors.cosine(u, v).alias("cos"), vectors.canberra(u, v).alias("can"),
        vectors.braycurtis(u, v).alias("bray"), vectors.euclidean(u, v).alias("euc"), vectors.correlation(u, v).alias("cor"),
    ).collect()}
    assert got[0, 1]["cos"] is None and got[0, 1]["can"] == -3
    assert math.isclose(got[1, 2]["cos"], 1) and got[1, 2]["euc"] == 0
    assert math.isclose(got[1, 3]["cos"], -1) and math.isclose(got[1, 3]["cor"], -1)
    assert got[1, 3]["bray"] is None
    assert similarity.unit_vectors(t).filter("term = 0").first()["v"] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "canberra", "dot"])
def test_blocks_give_the_same_as_columns(spark, metric):
    rng = np.random.default_rng(2)
    t = terms(spark, [(k, [float(x) for x in rng.normal(size=6)]) for k in range(25)])
    block = {(r["i"], r["j"]): r["sim"] for r in similarity.all_pairs(t, metric).collect()}
    f = getattr(vectors, metric)
    pairs = t.alias("a").join(t.alias("b"), F.col("a.term") < F.col("b.term")).select(F.col("a.term"), F.col("b.term"), f(F.col("a.v"), F.col("b.v"))).collect()
    assert len(block) == len(pairs) == 300
    assert all(math.isclose(block[i, j], s, abs_tol=1e-9) for i, j, s in pairs)


def test_curves_of_one_class_and_ties(spark):
    rows = lambda xs: spark.createDataFrame(xs, "score double, label int")
    assert signal.auroc(rows([(0.1, 1), (0.2, 1)])).first()[0] is None
    assert signal.auroc(rows([(0.5, 1), (0.5, 0), (0.5, 0)])).first()[0] == 0.5
    assert signal.auroc(rows([(0.9, 1), (0.1, 0), (None, 1)])).first()[0] == 1.0
    assert math.isclose(signal.auprc(rows([(0.9, 1), (0.8, 0), (0.1, 1)])).first()[0], 0.5 + 0.5 * (0.5 + 2 / 3) / 2)


def test_performance_without_signals(spark):
    row = signal.signal_performance(spark.createDataFrame([(1.0, 0.5, 1)], "freq double, ror double, label int")).first()
    assert (row["tp"], row["fn"], row["precision"], row["specificity"], row["recall"]) == (0, 1, -1, -1, 0)


def test_partial_table_fills_with_zero(spark):
    main = spark.createDataFrame([("d", "r", 4.0, 2.0, 0.5)], "drug string, reaction string, freq double, ror double, ror_norm double")
    part = spark.createDataFrame([("d", "r", 1), ("d", "x", 0)], "drug string, reaction string, label int")
    rows = {r["reaction"]: r for r in relational.partial_table(part, main).collect()}
    assert (rows["r"]["freq"], rows["x"]["freq"], rows["x"]["found"]) == (4.0, 0.0, 0)


def test_unigram_sums_to_one_and_draws_follow_it(spark):
    freq = spark.createDataFrame([(k, float(k * k + 1)) for k in range(30)], "term int, freq double")
    unigram = frequencies.smoothed_unigram(freq)
    assert math.isclose(unigram.agg(F.sum("p")).first()[0], 1)
    draws = spark.range(20_000).withColumn("u", (F.col("id") + 0.5) / 20_000)
    counts = {r["x"]: r["count"] for r in sampling.draw(draws, sampling.intervals(unigram), "x").groupBy("x").count().collect()}
    assert sum(counts.values()) == 20_000
    for r in unigram.collect():
        assert abs(counts.get(r["term"], 0) - r["p"] * 20_000) <= 2


def test_negatives_are_never_known(spark):
    rng = np.random.default_rng(1)
    pos = spark.createDataFrame([(int(a), int(b)) for a, b in {(*x,) for x in rng.integers(0, 20, (120, 2)).tolist()}] + [(99, k) for k in range(20)], "drug int, reaction int")
    known = {tuple(r) for r in pos.collect()}
    for drawn in (sampling.negatives_by_key(pos, "drug", "reaction", pos), sampling.negatives_at_random(pos, pos)):
        got = {(r["drug"], r["reaction"]) for r in drawn.collect()}
        assert got and not got & known
    assert sampling.balanced(pos, drawn, 3).filter("label = 1").count() == 3 * len(known)


def test_batches_share_no_context(spark):
    counts = spark.createDataFrame([(t, c, 1 + (t * c) % 5) for t in range(60) for c in range(t % 7, 40, 7)], "target int, context int, n bigint")
    rows = sampling.contrastive_batches(counts, 8, 1).toPandas()
    assert not rows.duplicated(["batch", "context"]).any() and not rows.duplicated("target").any()


def test_training_lowers_the_loss(spark):
    rows = [(f"t{t}", f"c{c}", int(t % 3 == c % 3)) for t in range(12) for c in range(12)]
    samples = spark.createDataFrame(rows, "target string, context string, label int")
    before = learning.nsg_loss(samples, learning.initial_vectors(samples, 8)).first()["loss"]
    after = learning.nsg_loss(samples, learning.train_nsg(samples, 8, 4, rate=0.5, blocks=2)).first()["loss"]
    assert after < 0.6 * before


def test_frequent_terms_are_dealt_to_copies(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 == 0 else f"t{k % 50}", f"c{int(rng.integers(40))}", int(k % 2)) for k in range(6000)]
    samples = spark.createDataFrame(rows, "target string, context string, label int")
    named = learning.with_copies(samples, 4).toPandas()
    copies = named[named["target"].str.contains(learning.COPY)]["target"].value_counts()
    assert len(named) == 6000 and len(copies) == 2 and copies.sum() == 2000 and copies.min() > 900
    assert not named["context"].str.contains(learning.COPY).any()
    cells = learning.with_copies(samples, 4).select(learning._block("target", 4).alias("key")).groupBy("key").count().toPandas()["count"]
    assert len(cells) == 4 and cells.max() < 2 * cells.median()
    params = spark.createDataFrame(
        [("target", f"hot{learning.COPY}0", [1.0, 2.0], [4.0, 4.0], 3), ("target", f"hot{learning.COPY}1", [3.0, 6.0], [0.0, 2.0], 5), ("target", "t", [9.0, 9.0], [], 0)],
        "side string, term string, v array<double>, state array<double>, steps bigint",
    )
    got = {r["term"]: (r["v"], r["state"], r["steps"]) for r in learning.merge_copies(params).collect()}
    both = ([2.0, 4.0], [2.0, 3.0], 5)
    assert got == {f"hot{learning.COPY}0": both, f"hot{learning.COPY}1": both, "t": ([9.0, 9.0], [], 0)}


def test_training_with_a_frequent_target(spark):
    rows = [("t0", f"c{c}", int(c % 3 == 0)) for c in range(12) for _ in range(8)]
    rows += [(f"t{t}", f"c{c}", int(t % 3 == c % 3)) for t in range(1, 12) for c in range(12)]
    samples = spark.createDataFrame(rows, "target string, context string, label int")
    losses = []
    for _, vectors, loss in learning.nsg_rounds(samples, 6, 3, 0.5, 3, optimiser=Optimiser("adam", 0.05)):
        losses.append(loss)
        names = [(r["side"], r["term"]) for r in vectors.collect()]
        assert len(names) == len(set(names)) == 25 and not any(learning.COPY in t for _, t in names)
    assert losses[2] < losses[1] < losses[0]


def test_pair_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    a, c, shared = rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), rng.normal(size=10)
    y = np.array([1, 0, 1, 0, 0.0])
    for norm in (False, True):
        _, da, dc, ds = learning.pair_gradients(a, c, y, shared, norm)
        for x, g in ((a, da), (c, dc), (shared, ds)):
            for at in np.ndindex(x.shape):
                old, ends = x[at], []
                for eps in (1e-6, -1e-6):
                    x[at] = old + eps
                    ends.append(learning.pair_gradients(a, c, y, shared, norm)[0])
                x[at] = old
                assert math.isclose((ends[0] - ends[1]) / 2e-6, g[at], abs_tol=1e-5)


@pytest.mark.parametrize("kind", sorted(SLOTS))
def test_optimisers_go_downhill(kind):
    # adagrad's steps shrink: in n steps it goes about 2 * rate * sqrt(n), so it needs a larger rate
    opt = Optimiser(kind, 0.5 if kind == "adagrad" else 0.05, momentum=0.9)
    v = np.array([[3.0, -2.0], [0.5, 1.0]])
    state, steps, goal = opt.fresh(v.shape), np.zeros(2, int), np.array([[1.0, 1.0], [0.0, -1.0]])
    begin = ((v - goal) ** 2).sum()
    for _ in range(300):
        steps += 1
        v, state = opt.step(v, 2 * (v - goal), state, steps)
    assert ((v - goal) ** 2).sum() < 0.1 * begin


def test_optimisers_first_steps():
    v, g = np.array([[1.0]]), np.array([[4.0]])
    move = lambda **k: float(Optimiser(rate=0.1, **k).step(v, g, Optimiser(**k).fresh(v.shape), np.array([1]))[0][0, 0])
    assert math.isclose(move(kind="sgd"), 0.6)
    assert math.isclose(move(kind="sgd", momentum=0.9), 1 - 0.4 * 1.9)
    assert math.isclose(move(kind="rmsprop"), 1 - 0.1 / math.sqrt(0.1), abs_tol=1e-6)
    assert math.isclose(move(kind="adagrad"), 1 - 0.4 / math.sqrt(16.1))
    assert math.isclose(move(kind="adam"), 0.9, abs_tol=1e-5)
    assert move(kind="adagrad", l1=100.0) == 0


def test_training_with_an_adaptive_optimiser(spark):
    rows = [(a, c, int(a % 3 == c % 3)) for a in range(12) for c in range(12)] * 4
    samples = spark.createDataFrame(rows, "target int, context int, label int")
    loss = lambda p, norm: learning.nsg_loss(samples, p, norm).first()["loss"]
    before = loss(learning.initial_vectors(samples, 8), False)
    params = learning.train_nsg(samples, 8, 6, blocks=2, optimiser=Optimiser("adam", 0.05))
    assert params.filter("side = 'shared'").count() == 1 and params.count() == 25
    assert loss(params, False) < 0.6 * before
    params = learning.train_nsg(samples, 8, 6, blocks=2, optimiser=Optimiser("rmsprop", 0.05), norm=True)
    assert loss(params, True) < before
    counts = spark.createDataFrame([(a, a % 3, 5) for a in range(12)], "target int, context int, n long")
    vectors = learning.train_ntx(counts, 4, 2, 3, hidden=4, optimiser=Optimiser("amsgrad", 0.05))
    assert vectors.count() == 15


def contrastive_loss(vectors, batches, dim, hidden, temperature):
    """Mean loss of batches under vectors with biases and head."""
    own = {(r["side"], r["term"]): np.array(r["v"]) for r in vectors.collect()}
    shared, out = own["shared", ""], []
    for batch in batches:
        u, w = (np.array([own[side, x[k]] for x in batch]) + shared[k * dim : (k + 1) * dim] for k, side in enumerate(("target", "context")))
        out.append(learning.contrastive_gradients(u, w, shared[2 * dim :], hidden, temperature)[0])
    return float(np.mean(out))


def test_contrastive_training_takes_a_step_for_each_batch(spark):
    dim, hidden, size = 4, 3, 4
    rows = [(f"t{t}", f"c{c}", 1 + (t * c) % 4) for t in range(20) for c in range(15) if (t + c) % 3 == 0]
    counts = spark.createDataFrame(rows, "target string, context string, n bigint")
    # one block: the batches of an epoch one after the other, as written out here
    dealt = learning.contrastive_pairs(counts, size, 0, 1, seed=3).toPandas()
    assert set(dealt["key"]) == set(dealt["stratum"]) == {0}
    batches = list(learning.batches_of(dealt, size))
    assert len(batches) == 5 and all(len({c for _, c in b}) == len(b) <= size for b in batches)
    assert {t for b in batches for t, _ in b} <= {r[0] for r in rows}
    v = {(r["side"], r["term"]): np.array(r["v"]) for r in learning.initial_vectors(counts, dim, 3).collect()}
    flat = np.r_[np.zeros(2 * dim), learning.first_head(dim, hidden, 3)]
    for batch in batches:
        u, w = np.array([v["target", t] for t, _ in batch]), np.array([v["context", c] for _, c in batch])
        _, du, dw, dh = learning.contrastive_gradients(u + flat[:dim], w + flat[dim : 2 * dim], flat[2 * dim :], hidden, 0.5)
        for (t, c), a, b in zip(batch, du, dw, strict=True):
            v["target", t], v["context", c] = v["target", t] - 0.5 * a, v["context", c] - 0.5 * b
        flat = flat - 0.05 * np.r_[du.sum(0), dw.sum(0), dh]
    ((epoch, vectors, taken),) = learning.ntx_rounds(counts, dim, 1, size, 0.5, hidden, seed=3, blocks=1)
    got = {(r["side"], r["term"]): np.array(r["v"]) for r in vectors.collect()}
    assert (epoch, taken) == (1, len(batches)) and np.allclose(got.pop(("shared", "")), flat)
    assert got.keys() == v.keys() and all(np.allclose(got[k], v[k]) for k in v)


def test_cells_of_a_stratum_share_nothing_and_training_lowers_the_loss(spark):
    rows = [(f"t{t}", f"c{c}", 5 if t % 4 == c % 4 else 1) for t in range(40) for c in range(24) if t % 4 == c % 4 or (t + c) % 9 == 0]
    counts = spark.createDataFrame(rows, "target string, context string, n bigint")
    dealt = learning.contrastive_pairs(counts, 4, 2, 3).toPandas()
    assert dealt["target"].nunique() == 40  # every target takes part
    for _, stratum in dealt.groupby("stratum"):
        assert (stratum.groupby("target")["key"].nunique() == 1).all() and (stratum.groupby("context")["key"].nunique() == 1).all()
    assert len(set(dealt["stratum"])) == 3 and (dealt.groupby("target")["stratum"].nunique() == 1).all()
    batches = [b for _, cell in dealt.groupby(["key", "stratum"]) for b in learning.batches_of(cell, 4)]
    losses, steps = [], []
    for _, vectors, taken in learning.ntx_rounds(counts, 6, 3, 4, 0.3, 8, optimiser=Optimiser("adam", 0.1), blocks=3):
        losses.append(contrastive_loss(vectors, batches, 6, 8, 0.3))
        steps.append(taken)
    assert min(steps) >= 10 and losses[2] < losses[1] < losses[0], losses


def test_steps_of_a_cell_learn_its_pairs():
    rng = np.random.default_rng(0)
    dim, hidden, size = 6, 16, 4
    cell = pd.DataFrame({"target": [f"t{k}" for k in range(8)], "context": [f"c{k}" for k in range(8)], "turn": [str(k * 3 % 8) for k in range(8)], "rank": 1})
    params = pd.DataFrame({"side": ["target"] * 8 + ["context"] * 8, "term": [*cell["target"], *cell["context"]], "v": list(rng.normal(0, 0.2, (16, dim))), "state": [np.zeros(0)] * 16, "steps": 0})
    head = pd.DataFrame({"side": ["shared"], "term": [""], "v": [np.r_[np.zeros(2 * dim), learning.first_head(dim, hidden, 1)]], "state": [np.zeros(0)], "steps": [0]})
    opt, losses = Optimiser("adam", 0.02), []
    for _ in range(60):
        out = learning._contrast(cell, params, head, size, 0.3, hidden, opt, opt)
        params, head = out[out["side"] != "shared"].reset_index(drop=True), out[out["side"] == "shared"].reset_index(drop=True)
        own, flat = dict(zip(zip(params["side"], params["term"], strict=True), params["v"], strict=True)), head["v"].iloc[0]
        u, w = (np.array([own[side, x] for x in cell[side][:4]]) + flat[k * dim : (k + 1) * dim] for k, side in enumerate(("target", "context")))
        losses.append(learning.contrastive_gradients(u, w, flat[2 * dim :], hidden, 0.3)[0])
    assert int(head["steps"].iloc[0]) == 120 and (params["steps"] == 60).all()
    assert losses[-1] < 0.3 * losses[0]


def test_contrastive_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    u, w = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    flat = rng.normal(size=4 * 3 + 3 + 9 + 3)
    loss = lambda: learning.contrastive_gradients(u, w, flat, 3, 0.5)[0]
    _, du, dw, dh = learning.contrastive_gradients(u, w, flat, 3, 0.5)
    for x, g in ((u, du), (w, dw), (flat, dh)):
        for at in list(np.ndindex(x.shape))[:12]:
            old, eps = x[at], 1e-6
            x[at] = old + eps
            up = loss()
            x[at] = old - eps
            down = loss()
            x[at] = old
            assert math.isclose((up - down) / (2 * eps), g[at], abs_tol=1e-6)


def test_classifier_learns_a_line(spark):
    rng = np.random.default_rng(0)
    rows = [([float(a), float(b)], int(a + b > 0)) for a, b in rng.normal(size=(200, 2))]
    table = spark.createDataFrame(rows, "features array<double>, label int")
    model = learning.train_classifier(table, 2, (4,), 60)
    assert signal.accuracy(learning.classify(model, table)).first()[0] > 0.95


def test_density_clusters_and_noise(spark):
    rng = np.random.default_rng(0)
    pts = [rng.normal(size=2) * 0.05 + c for c in ((0, 0), (5, 5)) for _ in range(20)] + [np.array([20.0, -20.0])]
    got = {r["term"]: r["cluster"] for r in clustering.density_clusters(terms(spark, [(k, p.tolist()) for k, p in enumerate(pts)]), 4, 5, 1.0).collect()}
    assert {got[k] for k in range(20)} == {0} and {got[k] for k in range(20, 40)} == {20} and got[40] == -1


def test_geometric_median_and_permanova():
    assert np.allclose(multivariate.geometric_median(np.array([[0.0, 0], [2, 0], [1, 1], [1, -1]])), [1, 0], atol=1e-4)


def test_files_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "freq.csv").write_text("a|3\nb|x\na|5\n")
    freq = {r["term"]: r["freq"] for r in files.read_frequencies(spark, str(tmp_path / "freq.csv")).collect()}
    assert freq == {"a": 5.0, "b": None}
    (tmp_path / "vec.csv").write_text("a|1|2.5\nb|-1|0\nc\n")
    vecs = files.read_vectors(spark, str(tmp_path / "vec.csv"))
    assert {r["term"]: r["v"] for r in vecs.collect()} == {"a": [1.0, 2.5], "b": [-1.0, 0.0], "c": []}
    sinks.write_vectors(vecs.filter("size(v) > 0"), str(tmp_path / "out"))
    assert {r["term"]: r["v"] for r in files.read_vectors(spark, str(tmp_path / "out")).collect()} == {"a": [1.0, 2.5], "b": [-1.0, 0.0]}
    (tmp_path / "p1.csv").write_text("d|r|1\nd|s|0\n")
    (tmp_path / "p2.csv").write_text("d|r|0\n")
    ref = files.read_reference_pairs(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")])
    assert {(r["drug"], r["reaction"]): r["label"] for r in ref.collect()} == {("d", "r"): 0, ("d", "s"): 0}
    (tmp_path / "conf.json").write_text(json.dumps({"metrics": {"oCosine": True, "oDot": False}}))
    assert files.metric_names(files.read_config(str(tmp_path / "conf.json")), "metrics") == ["cosine"]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    src = spark.range(200).selectExpr("id % 5 as drug", "id % 7 as reaction", "timestamp_seconds(id * 3600) as at")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = reports.windowed_pair_counts(reports.report_stream(spark, str(tmp_path / "in"), "drug bigint, reaction bigint, at timestamp"), "at", late="30 days")
    run = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    got = spark.table("counted").agg(F.sum("n"), F.count("*")).first()
    assert got[0] == 200 and got[1] > 35


def test_density_clusters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)  # several blocks
    rng = np.random.default_rng(12)
    clump = lambda x, y, n: rng.normal(size=(n, 2)) * 0.05 + [x, y]
    pts = np.r_[clump(0, 0, 20), clump(0.8, 0, 20), clump(9, 9, 20), rng.uniform(2, 7, size=(25, 2)), [[0.4, 5.0]] * 6, [[20.0, 20.0]] * 3]
    pts = np.r_[pts, np.repeat(pts[:1], 9, axis=0), [[0.0, 0.5]] * 4, [[30.0, 0.0]] * 6, [[30.6, 0.0]] * 6]
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    for min_samples, min_size, radius in ((4, 5, 0.75), (5, 5, 0.9), (2, 3, 0.4)):
        core = np.sort(d, axis=1)[:, min_samples - 1]
        near = np.maximum(d, np.maximum(core[:, None], core[None])) <= radius
        label = np.arange(len(pts))
        for _ in range(len(pts)):
            label = np.minimum(label, np.where(near, label[None], len(pts)).min(1))
        want = {k: int(c) if (label == c).sum() >= min_size else -1 for k, c in enumerate(label)}
        got = {r["term"]: r["cluster"] for r in clustering.density_clusters(terms(spark, [(k, p.tolist()) for k, p in enumerate(pts)]), min_samples, min_size, radius).collect()}
        assert got == want
        assert want[0] == want[20] or radius < 0.7


def test_blocks_grow_with_the_samples(spark, monkeypatch):
    """However many samples there are, a task's share of a stratum is bounded, and vectors are still trained."""
    monkeypatch.setattr(learning, "CELL", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cells, kept = [], learning.settle

    def settle(df, *a, **k):
        out = kept(df, *a, **k)
        if "stratum" in out.columns:
            cells.extend(r["count"] for r in out.groupBy("key", "stratum").count().collect())
        return out

    monkeypatch.setattr(learning, "settle", settle)
    rows = [(f"t{k % 61}", f"c{k % 37}", k % 2) for k in range(2257)]
    samples = spark.createDataFrame(rows, "target string, context string, label int")
    try:
        (_, vectors, loss), = learning.nsg_rounds(samples, 4, 1, blocks=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(cells) == len(rows) and max(cells) < 400 and len(cells) > 16
    assert vectors.count() == 61 + 37 + 1
    assert loss == pytest.approx(learning.nsg_loss(samples, vectors).first()["loss"], rel=1e-9)


def test_samples_come_in_one_order():
    rows = pd.DataFrame({"target": ["b", "a", "b", "a", "c"] * 4, "context": ["x", "y", "y", "x"] * 5, "label": [0, 1] * 10})
    want = rows.sort_values(["target", "context", "label"]).sample(frac=1, random_state=3).reset_index(drop=True)
    for k in range(3):
        got = learning._in_turn(rows.sample(frac=1, random_state=k), 3)
        assert got.reset_index(drop=True).equals(want)
