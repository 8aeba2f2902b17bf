"""Tests and ordinations against published values, plain loops and their defining properties."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.functions import distributions
from vigilark.functions.distributions import normal_tail
from vigilark.operators import groups, hierarchy, multivariate, similarity, tests

# Body weights of a published worked example of tests of normality.
WEIGHTS = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)


def test_shapiro_of_a_published_example():
    w, p = tests.shapiro(WEIGHTS)
    assert math.isclose(w, 0.78881, abs_tol=2e-4) and math.isclose(p, 0.0067038, abs_tol=2e-4)
    assert tests.shapiro(np.array([1.0, 2.0])) is None and tests.shapiro(np.ones(8)) is None


def test_shapiro_of_three_values():
    w, p = tests.shapiro(np.array([1.0, 2.0, 3.0]))
    assert math.isclose(w, 1) and math.isclose(p, 1, abs_tol=1e-6)


def test_dagostino_of_a_published_example():
    assert math.isclose(-2 * math.log(tests.dagostino(WEIGHTS, least=8)), 13.034263, abs_tol=1e-4)
    assert tests.dagostino(WEIGHTS) is None


@pytest.mark.parametrize(("n", "d", "p"), [(1, 0.75, 0.5), (5, 0.56328, 0.05), (10, 0.40925, 0.05), (20, 0.29408, 0.05), (10, 0.48893, 0.01), (40, 0.21012, 0.05)])
def test_kolmogorov_critical_values(n, d, p):
    assert math.isclose(tests._kolmogorov_tail(n, d), p, abs_tol=2e-4)


def test_kolmogorov_distance_and_its_limit():
    # over 200 values the limit takes over: it is close to the exact value there
    exact, d = tests._kolmogorov_tail(200, 0.08), 0.08
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * d * d * 200) for k in range(1, 50))
    assert abs(exact - limit) < 0.02
    x = np.array([-1.0, 1.0])
    assert math.isclose(tests.kolmogorov(x), tests._kolmogorov_tail(2, 0.5 - distributions.normal_tail(1)), abs_tol=1e-9)


def test_normality_in_columns_equals_the_plain_functions(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=25), "b": rng.exponential(size=60), "c": np.array([1.0, 2.0]), "d": np.ones(30), "e": WEIGHTS, "f": rng.normal(size=3), "g": rng.normal(size=300)}
    rows = [(k, "m", "V", float(x)) for k, xs in groups.items() for x in xs] + [("a", "m", "V", None)]
    got = {r["drug"]: r for r in tests.normality(spark.createDataFrame(rows, "drug string, metric string, grp string, sim double")).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        flat = np.ptp(x) == 0
        w = None if flat else tests.shapiro(x)
        for name, want in (("normality", None if flat else tests.dagostino(x)), ("shapiro", w and w[1]), ("kolsir", None if flat else tests.kolmogorov(x))):
            assert (got[k][name] is None) == (want is None), (k, name)
            assert want is None or math.isclose(got[k][name], want, rel_tol=1e-6, abs_tol=1e-12), (k, name)


def values(spark, v, r, drug="d"):
    rows = [(drug, "m", g, float(x)) for g, xs in (("V", v), ("R", r)) for x in xs]
    return spark.createDataFrame(rows, "drug string, metric string, grp string, sim double")


def test_rank_test_exact_and_with_ties(spark):
    small = tests.mann_whitney(values(spark, [1, 2, 3], [4, 5, 6])).first()
    assert (small["stat"], round(small["p"], 6)) == (0.0, 0.1)
    # all 20 orders: U of 2 or less or 7 or more has 8 of them
    assert math.isclose(tests.mann_whitney(values(spark, [1, 2, 6], [3, 4, 5])).first()["p"], 14 / 20)
    tied = tests.mann_whitney(values(spark, [1, 2, 2, 3], [2, 4, 5, 6])).first()
    n1 = n2 = 4
    ties = 3**3 - 3
    sd = math.sqrt(n1 * n2 / 12 * (9 - ties / (8 * 7)))
    z = (abs(tied["stat"] - 8) - 0.5) / sd
    assert math.isclose(tied["p"], math.erfc(z / math.sqrt(2)), abs_tol=1e-9)
    flat = tests.mann_whitney(values(spark, [1, 1, 1], [2, 3, 4])).first()
    assert flat["stat"] is None and flat["p"] is None


def test_exact_ranks_match_all_orders():
    for m, n in ((2, 3), (3, 3), (4, 5), (1, 7)):
        count = {}
        for order in {tuple(sorted(o)) for o in permutations(range(m + n), m)}:
            u = sum(order) - m * (m - 1) // 2
            count[u] = count.get(u, 0) + 1
        for u in range(m * n + 1):
            upper = sum(c for k, c in count.items() if k >= max(u, m * n - u)) / sum(count.values())
            assert math.isclose(distributions.rank_sum_p(m, n, u), min(1, 2 * upper), abs_tol=1e-9)


def test_means_and_variances_by_plain_loops(spark):
    rng = np.random.default_rng(3)
    v, r = rng.normal(0, 1, 12), rng.normal(0.4, 2, 9)
    rows = values(spark, v, r)
    ss, n = [((x - x.mean()) ** 2).sum() for x in (v, r)], [len(v), len(r)]
    mean = np.r_[v, r].mean()
    between = sum(k * (x.mean() - mean) ** 2 for k, x in zip(n, (v, r), strict=True))
    part = [(1 - k / sum(n)) * s for k, s in zip(n, ss, strict=True)]
    got = tests.brown_forsythe_means(rows).first()
    assert math.isclose(got["stat"], between / sum(part))
    assert math.isclose(got["df2"], 1 / sum((p / sum(part)) ** 2 / (k - 1) for p, k in zip(part, n, strict=True)))
    part = [(1 - k / sum(n)) * s / (k - 1) for k, s in zip(n, ss, strict=True)]
    assert math.isclose(tests.brown_forsythe_means(rows, textbook=True).first()["stat"], between / sum(part))
    bart = tests.bartlett(rows).first()
    assert math.isclose(bart["p"], math.erfc(math.sqrt(bart["stat"] / 2)), abs_tol=1e-9)
    every = {r["stat"]: r["value"] for r in tests.all_tests(rows).collect()}
    assert len(every) == 2 * 8 + 6 and math.isclose(every["mean_brown_f"], got["stat"])
    assert all(0 <= x <= 1 for k, x in every.items() if k.endswith("_p") and x is not None)


def test_sums_of_blocks_give_the_same_tests(spark, monkeypatch):
    from vigilark.operators import groups

    monkeypatch.setattr(groups, "BLOCK", 4)
    v = cloud(2, 18)
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "term int, v array<double>")
    valid = spark.createDataFrame([("d", k) for k in range(9)], "drug string, reaction int")
    control = spark.createDataFrame([("d", k) for k in range(9, 18)], "drug string, reaction int")
    rows, sums = (f(valid, control, terms, ["euclidean", "cosine"]) for f in (groups.group_similarities, groups.group_moments))
    assert rows.count() == 2 * 2 * 36 and sums.agg({"n": "sum"}).first()[0] == 2 * 2 * 36
    for test in (tests.anova, tests.welch, tests.brown_forsythe_means, tests.variance_ratio, tests.bartlett):
        a, b = ({r["metric"]: r["stat"] for r in test(x).collect()} for x in (rows, sums))
        assert a.keys() == b.keys() and all(math.isclose(a[m], b[m], rel_tol=1e-9) for m in a), test


def test_distances_are_summed_in_blocks(spark, monkeypatch):
    """The same totals as from a table of all pairs, from a row a block pair; the largest similarity is that of both groups."""
    from vigilark.operators import groups

    monkeypatch.setattr(groups, "BLOCK", 4)
    v = cloud(2, 18)
    v[5] = 0  # no cosine
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(18, [0.0] * 5), (19, [0.0] * 5)], "term int, v array<double>")
    valid = spark.createDataFrame([("d", k) for k in range(9)] + [("e", 1), ("e", 2), ("f", 18), ("f", 19)], "drug string, reaction int")
    control = spark.createDataFrame([("d", k) for k in range(9, 18)] + [("e", 3), ("e", 4)], "drug string, reaction int")
    metrics = ["euclidean", "cosine"]
    table = similarity.to_distance(groups.group_similarities(valid, control, terms, metrics), ["drug"])
    want = {(r["drug"], r["metric"]): r["total"] for r in table.groupBy("drug", "metric").agg(F.sum("dist").alias("total")).collect()}
    moved = groups.group_distances(valid, control, terms, metrics)
    got = {(r["drug"], r["metric"]): r["total"] for r in moved.collect()}
    assert got.keys() == want.keys() and len(got) == 6 and got["f", "cosine"] is None and want["f", "cosine"] is None
    assert all(want[k] is None or math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    assert {(r["drug"], r["metric"]): r["n"] for r in moved.collect()}["d", "cosine"] == 28 + 36


def test_the_query_of_distances_makes_no_row_a_pair(spark, sf, monkeypatch):
    from vigilark.operators import groups
    from vigilark.plans.registry import QUERIES

    monkeypatch.setattr(groups, "group_similarities", None)
    assert QUERIES["to_distance"](spark, sf).count() > 0


def test_pairs_of_other_terms_go_before_pairs_are_made_distinct(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 9), ("b", 1), ("b", 8), ("c", None), (None, 1), (None, 2)], "drug string, reaction int")
    terms = spark.createDataFrame([(k, [0.0]) for k in (1, 2, 3)], "term int, v array<double>")
    found = groups.usable_groups(pairs, terms)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("a", 2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[k + 1] for k, line in enumerate(plan) if "LeftSemi" in line]
    assert below and not any("Aggregate" in line for line in below)


def test_masks_of_equal_sizes_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(multivariate, "masks_at", lambda places, *args, f=multivariate.masks_at: made.append(places) or f(places, *args))
    sizes = (3, 13, 20, 9, 50, 77)
    first, again = (multivariate._masks_of_block(*sizes) for _ in range(2))
    assert len(made) == 1 and np.array_equal(first, again) and first.shape == (51, 10)
    assert np.array_equal(first > 0, masks_of(np.arange(3, 13), 20, 9, 50, 77))
    for n_first, n in ((3, 6), (7, 19)):
        want = multivariate.orders(np.arange(n) < n_first, 800, 5, all_if_few=True)
        assert np.array_equal(multivariate._orders_of(n_first, n, 800, 5), want) and len(want) == (721 if n == 6 else 801)


def masks_of(places, n, n_first, permutations, seed):
    return np.array([[m[0] for m in row] for row in zip(*(multivariate.masks_at(np.array([p]), n, n_first, permutations, seed) for p in places), strict=True)])


def test_a_comparison_makes_its_similarities_and_tests_once(spark, sf, monkeypatch):
    """All tests of the comparison are those of the queries on their own; its rows are written down before they are read twice."""
    from vigilark.plans import groups as plans
    from vigilark.plans.fixtures import Tables

    passes = []
    monkeypatch.setattr(groups, "_in_drugs", lambda *a, f=groups._in_drugs: passes.append(a[-1].keys()) or f(*a))
    t = Tables(spark, sf)
    monkeypatch.setattr(plans, "both_groups", lambda t, f=plans.both_groups, kept={}: kept.setdefault("both", None) or kept.update(both=f(t)) or kept["both"])
    rows = plans.results(t)
    assert len(passes) == 1 and rows._settled_at
    found = {(r["drug"], r["metric"], r["stat"]): r["value"] for r in rows.collect()}
    assert len(found) == rows.count()
    for name, apart in (("mean_anova_f", tests.anova(plans.moments(t))), ("mean_mannwhitney_f", tests.mann_whitney(plans.ranks(t, digits=None))), ("var_brown_f", tests.anova(plans.deviations(t, "median")))):
        want = {(r["drug"], r["metric"], name): r["stat"] for r in apart.collect()}
        assert want and all(math.isclose(found[k], x, rel_tol=1e-9, abs_tol=1e-9) if x is not None else found[k] is None for k, x in want.items()), name
    want = {(r["drug"], "euclidean", "permanova_p"): r["permanova_p"] for r in multivariate.permanova(*plans.both_groups(t), t.terms(), "euclidean").collect()}
    assert want and all(found[k] == x for k, x in want.items())


def test_summary_counts_and_averages(spark):
    ps = [0.001, 0.01, 0.02, 0.03, 0.9, None, float("nan")]
    rows = [(str(k), "m", "permanova_p", p) for k, p in enumerate(ps)] + [("0", "m", "valid", 0.5), ("1", "m", "valid", 0.7), ("2", "m", "valid", float("nan")), ("0", "m", "other", 1.0)]
    props = spark.createDataFrame([("m", 0.0, 1.0, 0.4, 0.4)], "metric string, min double, max double, mean double, normed_mean double")
    got = {r["stat"]: r["value"] for r in tests.validity_summary(spark.createDataFrame(rows, "drug string, metric string, stat string, value double"), props).collect()}
    assert got.keys() == {"permanova_p", "valid", "min", "max", "mean", "normed_mean"}
    assert got["permanova_p"] == 0.8 and math.isclose(got["valid"], 0.6)


# -- ordination and permutation tests ----------------------------------------------------------
def cloud(seed: int, n: int = 14) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.r_[rng.normal(0, 1, (n // 2, 5)), rng.normal(0.8, 2, (n - n // 2, 5))]


def test_cailliez_constant_makes_distances_euclidean():
    d = np.abs(np.random.default_rng(1).normal(size=(7, 7)))
    d = np.triu(d, 1) + np.triu(d, 1).T  # no metric at all
    constant = multivariate.cailliez_constant(d, literal=False)
    gram = lambda c: np.linalg.eigvalsh(multivariate._gower(-0.5 * (d + c * (1 - np.eye(7))) ** 2)).min()
    assert gram(constant) > -1e-8 and gram(constant * 0.9) < -1e-6
    x = multivariate.principal_coordinates(d, constant)
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(apart, d + constant * (1 - np.eye(7)), atol=1e-6)
    # the literal one: symmetric eigenvalues of the lower triangle
    n = 7
    a1, a2 = multivariate._gower(-0.5 * d**2) * 2, multivariate._gower(-0.5 * d) * -4
    lower = np.tril(np.block([[np.zeros((n, n)), a1], [-np.eye(n), a2]]))
    assert math.isclose(multivariate.cailliez_constant(d), np.linalg.eigvalsh(lower + np.tril(lower, -1).T).max(), abs_tol=1e-9)


def plain_dispersion(d: np.ndarray, groups: list[list[int]]) -> float:
    n, k, total, sizes, means, sigma = sum(map(len, groups)), len(groups), 0.0, [], [], 0.0
    for g in groups:
        pairs = [d[a][b] for x, a in enumerate(g) for b in g[x + 1 :]]
        mean = sum(pairs) / len(pairs)
        spread = 0.0
        for a in g:
            own = [d[a][b] for b in g if b != a]
            spread += (sum(own) / len(own) - mean) ** 2
        spread *= 4 * (len(g) - 1) / (len(g) - 2) ** 2
        sigma += (len(g) - 1) * spread
        sizes.append(len(g))
        means.append(mean)
        total += len(g) * mean
    sigma /= n - k
    return sum(s * (m - total / n) ** 2 for s, m in zip(sizes, means, strict=True)) / ((k - 1) * sigma**2)


def test_dispersion_by_plain_loops():
    d = multivariate.distances("euclidean", cloud(4))
    first = np.arange(len(d)) < 6
    e = multivariate.centred_distances(d, first)
    masks = multivariate.orders(first, 25, seed=3)
    want = [plain_dispersion(e, [list(np.flatnonzero(m)), list(np.flatnonzero(~m))]) for m in masks]
    assert np.allclose(multivariate.dispersion_f(e, masks), want, rtol=1e-9)
    assert multivariate.share_beyond(np.array(want), strictly=True) == (1 + sum(x > want[0] * (1 + 1e-9) for x in want[1:])) / 26


def test_all_orders_are_tried_if_they_are_few():
    first = np.array([True] * 3 + [False] * 3)
    assert len(multivariate.orders(first, 999, 1, all_if_few=True)) == 721
    assert len(multivariate.orders(first, 700, 1, all_if_few=True)) == 701


def plain_permanova(d: np.ndarray, mask: np.ndarray) -> float:
    n, total, inside = len(d), 0.0, 0.0
    for i in range(n):
        for j in range(i + 1, n):
            total += d[i, j] ** 2 / n
            if mask[i] == mask[j]:
                inside += d[i, j] ** 2 / (mask.sum() if mask[i] else (~mask).sum())
    return (total - inside) / (inside / (n - 2))


@pytest.mark.parametrize(("n", "first"), [(6, 3), (14, 7), (1000, 300), (4096, 5)])
def test_masks_are_permutations(n, first):
    masks = multivariate.masks_at(np.arange(n), n, first, 400, seed=5)
    assert masks.shape == (401, n) and (masks.sum(1) == first).all() and masks[0].tolist() == [k < first for k in range(n)]
    some = np.array([n - 1, 0, n // 2])
    assert (multivariate.masks_at(some, n, first, 400, seed=5) == masks[:, some]).all()  # each place on its own
    assert len({m.tobytes() for m in masks}) > min(15, 300)
    share = masks[1:].mean(0)  # every place is in the first group as often as others
    assert np.abs(share - first / n).max() < 0.01 + 5 * (first / n * (1 - first / n) / 400) ** 0.5


def test_places_that_are_inside_are_not_permuted_again(monkeypatch):
    cells, spread = [], multivariate._spread
    monkeypatch.setattr(multivariate, "_spread", lambda x: cells.append(x.size) or spread(x))
    multivariate.masks_at(np.arange(300), 300, 150, 99, seed=1)
    assert sum(cells) < 4 * 5 * 300 * 99  # four rounds; 1024 places are walked through for 300
    assert multivariate.masks_at(np.arange(300), 300, 150, 1, seed=1).sum(1).tolist() == [150, 150]


@pytest.mark.parametrize(("metric", "block"), [("euclidean", 2048), ("euclidean", 4), ("cosine", 5)])
def test_permanova_by_plain_loops(spark, monkeypatch, metric, block):
    monkeypatch.setattr(multivariate, "BLOCK", block)
    v = cloud(9)
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "term int, v array<double>")
    valid = spark.createDataFrame([("d", k) for k in range(7)] + [("e", 0), ("e", 1)], "drug string, reaction int")
    control = spark.createDataFrame([("d", k) for k in range(7, 14)] + [("e", 2), ("e", 3)], "drug string, reaction int")
    got = {r["drug"]: r for r in multivariate.permanova(valid, control, terms, metric, 49, seed=2).collect()}
    assert got["e"]["permanova_f"] is None and got["e"]["permanova_p"] is None
    d = multivariate.distances(metric, v)
    masks = multivariate.masks_at(np.arange(14), 14, 7, 49, seed=2)
    want = np.array([plain_permanova(d, m) for m in masks])
    assert math.isclose(got["d"]["permanova_f"], want[0], rel_tol=1e-7)
    assert np.allclose(multivariate.permanova_f(d**2, masks), want)
    assert got["d"]["permanova_p"] == multivariate.share_beyond(want, strictly=False)


@pytest.mark.parametrize("seed", range(4))
def test_the_constant_is_that_of_the_whole_block_matrix(seed):
    d = multivariate.distances(("euclidean", "cosine")[seed % 2], cloud(seed))
    centred = lambda a: a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    n = len(d)
    block = np.block([[np.zeros((n, n)), centred(-(d**2))], [-np.eye(n), centred(2 * d)]])
    assert math.isclose(multivariate.cailliez_constant(d), np.linalg.eigvalsh(block).max(), rel_tol=1e-9)
    assert math.isclose(multivariate.cailliez_constant(d, literal=False), np.linalg.eigvals(block).real.max(), rel_tol=1e-9)


def test_permdisp_over_a_table(spark):
    v = cloud(5)
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "term int, v array<double>")
    valid = spark.createDataFrame([("d", k) for k in range(7)] + [("e", 0), ("e", 1)], "drug string, reaction int")
    control = spark.createDataFrame([("d", k) for k in range(7, 14)] + [("e", 2), ("e", 3)], "drug string, reaction int")
    got = {r["drug"]: r for r in multivariate.permdisp(valid, control, terms, "euclidean", 49).collect()}
    e = multivariate.centred_distances(multivariate.distances("euclidean", v), np.arange(14) < 7)
    assert math.isclose(got["d"]["permdisp_f"], plain_dispersion(e, [list(range(7)), list(range(7, 14))]), rel_tol=1e-9)
    assert 0 < got["d"]["permdisp_p"] <= 1 and got["e"]["permdisp_f"] is None


def test_projection_keeps_the_widest_directions(spark):
    from vigilark.operators import clustering

    v = cloud(6) * [5, 3, 1, 0.1, 0.1]
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "term int, v array<double>")
    got = {r["term"]: r["coords"] for r in clustering.projection(terms, 2).collect()}
    vectors = np.linalg.svd(v - v.mean(0), full_matrices=False)[2][:2]
    want = v @ vectors.T
    coords = np.array([got[k] for k in range(len(v))])
    assert np.allclose(np.abs(coords), np.abs(want), atol=1e-6)


# -- hierarchy scores in blocks ----------------------------------------------------------------
def test_path_blocks_give_the_same_as_columns(spark, monkeypatch):
    from vigilark.operators import frequencies, hierarchy

    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = np.random.default_rng(8)
    pick = lambda n: None if rng.random() < 0.2 else f"n{rng.integers(n)}"
    rows = [(t, o, "PRIMARY" if o == 0 or t % 4 == 0 else "SECONDARY", pick(9), pick(4), pick(2)) for t in range(17) for o in range(1 + t % 3)]
    levels = ["low", "mid", "top"]
    paths = spark.createDataFrame(rows, "term int, ord int, rank string, low string, mid string, top string")
    freq = spark.createDataFrame([(t, float(1 + t * t % 7)) for t in range(17)], "term int, freq double")
    content = frequencies.content_of_levels(freq, paths, levels)
    terms = hierarchy.term_paths(paths, levels, content)
    pairs = None
    for begin in (0, 9):
        stated = spark.createDataFrame([(t,) for t in range(begin, min(begin + 9, 17))], "term int")
        part = hierarchy.path_pairs(paths, stated, levels)
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.filter("q < t")
    shared = hierarchy.shared_content(pairs, content, levels)
    want = {
        "meanminpath": hierarchy.mean_score(pairs, hierarchy.first_match(levels)),
        "meanpath_additive": hierarchy.mean_score(pairs, hierarchy.sum_of_matches(levels)),
        "primaryminpath": hierarchy.primary_score(pairs, hierarchy.first_match(levels)),
        "primarypath": hierarchy.primary_score(pairs, hierarchy.first_match(levels), summed=True),
        "resnik": hierarchy.resnik(shared), "jiangconrath": hierarchy.jiang_conrath(shared), "lin": hierarchy.lin(shared),
    }
    for metric, rows in want.items():
        got = {(r["i"], r["j"]): r["sim"] for r in similarity.all_pairs(terms, metric).filter("sim is not null").collect()}
        expected = {(r["q"], r["t"]): r["sim"] for r in rows.filter("sim is not null").collect()}
        assert got.keys() == expected.keys(), metric
        assert all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got), metric
    with pytest.raises(ValueError, match="query terms"):
        hierarchy.path_pairs(paths, spark.range(200).withColumnRenamed("id", "term"), levels)


@pytest.mark.parametrize("digits", [6, 1])
def test_drugs_in_a_task_have_the_results_of_tables(spark, monkeypatch, digits):
    """Groups of at most BLOCK terms are reduced to a row where their similarities are made; larger ones take tables."""
    rng = np.random.default_rng(6)
    terms = spark.createDataFrame([(k, [0.0] * 3 if k == 3 else rng.normal(size=3).tolist()) for k in range(120)], "term int, v array<double>")
    groups_of = lambda sizes: spark.createDataFrame([(d, int(k)) for d, n in sizes for k in rng.choice(120, n, replace=False)], "drug string, reaction int")
    valid, control = groups_of([("a", 40), ("b", 8), ("c", 2), ("d", 25)]), groups_of([("a", 40), ("b", 7), ("c", 2)])
    rounded = lambda sims: {g: np.trunc(x * 10**digits + np.copysign(0.5, x)) / 10**digits + 0.0 for g, x in sims.items()}
    ways = {
        "ranks": (lambda s: tests.ranks_of(rounded(s)), lambda v: tests.rank_sums(v.withColumn("sim", F.round("sim", digits) + 0.0)), tests.RANKS, tests.mann_whitney),
        "means": (lambda s: tests.deviations_of(s, np.mean), tests.from_means, tests.PARTS, tests.anova),
        "medians": (lambda s: tests.deviations_of(s, np.median), tests.from_medians, tests.PARTS, tests.anova),
        "shapes": (tests.shapes_of, tests.shapes, tests.SHAPES, tests.normality),
    }
    for of_arrays, of_table, fields, last in ways.values():
        found = []
        for block in (2048, 10):
            monkeypatch.setattr(groups, "BLOCK", block)
            made = groups.over_drugs(valid, control, terms, ["cosine", "euclidean"], of_arrays, of_table, fields)
            if block == 2048:
                assert made.count() <= 16  # no row per pair
            found.append({tuple(r[:2]) + ((r["grp"],) if "grp" in r else ()): [r[c] for c in sorted(r.asDict()) if c not in ("drug", "metric", "grp")] for r in last(made).collect()})
        assert found[0].keys() == found[1].keys() and len(found[0]) >= 8
        for k, row in found[0].items():
            for x, y in zip(row, found[1][k], strict=True):
                assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)), (k, row, found[1][k])


def test_the_furthest_distance_is_found_by_stretches():
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=5000), np.round(rng.normal(size=3001), 1), rng.exponential(size=777), np.array([1.0, 2.0]), np.r_[np.zeros(400), 1.0]):
        x, n = np.sort(x), len(x)
        cdf = np.array([1 - normal_tail(z) for z in (x - x.mean()) / x.std()])
        want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
        assert tests.furthest(x, x.mean(), x.std()) == want


def test_blocks_in_pieces_are_those_made_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    path = lambda k: {"names": [str(rng.integers(3)), None, str(rng.integers(2))], "ic": [1.0, None, float(k)], "own": 2.5, "primary": k == 0}
    x, y = (hierarchy.Paths.load([[path(k) for k in range(n)] for n in sizes]) for sizes in ([2] * 9, [1, 3, 0, 2, 2]))
    a, b = rng.normal(size=(23, 5)), rng.normal(size=(7, 5))
    metrics = ("manhattan", "chebyshev", "minkowski", "braycurtis", "canberra")
    whole = [hierarchy.path_matrix(m, *p) for m in hierarchy.PATH_METRICS for p in ((x, y), (y, x), (x, x))] + [similarity.pair_matrix(m, a, b) for m in metrics]
    monkeypatch.setattr(hierarchy, "CELLS", 20)
    monkeypatch.setattr(similarity, "CELLS", 20)
    pieces = [hierarchy.path_matrix(m, *p) for m in hierarchy.PATH_METRICS for p in ((x, y), (y, x), (x, x))] + [similarity.pair_matrix(m, a, b) for m in metrics]
    assert all(np.array_equal(p, w, equal_nan=True) for p, w in zip(pieces, whole, strict=True))
    rows, largest = hierarchy._path_rows, []
    monkeypatch.setattr(hierarchy, "_path_rows", lambda m, p, q, *codes: largest.append(len(p.names) * len(q.names)) or rows(m, p, q, *codes))
    many = hierarchy.Paths.load([[path(0)] * 2 for _ in range(50)])
    hierarchy.path_matrix("lin", many, x)
    assert len(largest) == 50 and max(largest) == 36  # never more than one term's beyond CELLS
