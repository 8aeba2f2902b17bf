"""Orders over ranges: dense indexes, sums before a row, medians and rank tests of large groups."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.operators import ranks, sampling, tests


@pytest.fixture
def adaptive(spark):
    """Adaptive execution as it is out of the box but for small targets, so that partitions are merged and split."""
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_no_row_is_lost_from_a_dense_index(adaptive):
    n = 60_000
    rows = adaptive.range(n, numPartitions=7).select(
        (F.col("id") * 7919 % n).alias("ord"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2((-F.col("id")).cast("string"), 512).alias("b")
    )
    found = ranks.dense_index(rows)
    assert found.columns == ["ord", "a", "b", "index"]
    got = found.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index"), F.count(F.when(F.col("ord") == F.col("index"), 1))).first()
    assert tuple(got) == (n, n, 0, n - 1, n)
    assert ranks.ranged(rows, "ord").select("_range").distinct().count() > 3


def test_an_index_of_equal_and_null_values(adaptive):
    rows = adaptive.createDataFrame([(None if k % 10 == 0 else k // 400, k % 50) for k in range(2000)], "ord int, x int")
    got = ranks.dense_index(rows).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(2000))
    orders = [-1 if r["ord"] is None else r["ord"] for r in got]
    assert orders == sorted(orders) and Counter((r["ord"], r["x"]) for r in got) == Counter(tuple(r) for r in rows.collect())
    assert ranks.dense_index(rows.limit(0)).count() == 0


def test_batches_are_full_whatever_the_partitions(adaptive):
    counts = adaptive.range(40_000, numPartitions=5).select(F.sha2(F.col("id").cast("string"), 512).alias("target"), F.col("id").cast("string").alias("context"), F.lit(1).alias("n"))
    sizes = sampling.contrastive_batches(counts, 16, 1).groupBy("batch").count()
    got = sizes.agg(F.count("*"), F.min("count"), F.max("count"), F.sum("count")).first()
    assert tuple(got) == (2500, 16, 16, 40_000)


def test_sums_before_equal_a_plain_version(adaptive):
    rng = random.Random(5)
    rows = [(g, o, rng.randrange(100) if rng.random() < 0.9 else None) for g in ("hot", "b", None, "d") for o in rng.sample(range(100_000), 6000 if g == "hot" else 40)]
    table = adaptive.createDataFrame(rows, "g string, o int, n int").repartition(6)
    want, upto = {}, defaultdict(int)
    for g, o, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[g, o] = upto[g]
        upto[g] += n or 0
    got = ranks.sums_before(table, ["g"], "o", ["n"])
    assert got.columns == ["g", "o", "n", "before_n"]
    assert {(r["g"], r["o"]): r["before_n"] for r in got.collect()} == want
    assert ranks.ranged(table, "g", "o").filter("g = 'hot'").select("_range").distinct().count() > 3  # a large group has several tasks


def test_medians_are_exact(adaptive):
    rng = np.random.default_rng(2)
    own = {"hot": np.round(rng.normal(size=20_001), 3), "even": rng.normal(size=10), "one": np.array([4.0]), "flat": np.zeros(1000)}
    rows = [(g, float(x)) for g, v in own.items() for x in v] + [("none", None)]
    got = {r["g"]: r["median"] for r in ranks.medians(adaptive.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got.keys() == own.keys() and all(math.isclose(got[g], float(np.median(v)), abs_tol=1e-12) for g, v in own.items())


def ranked(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_tests_of_a_group_in_many_ranges(adaptive):
    rng = np.random.default_rng(8)
    v, r = np.round(rng.normal(0.2, 1, 3000), 2), np.round(rng.normal(0, 1.5, 2500), 2)
    rows = [("hot", "m", "V", float(x)) for x in v] + [("hot", "m", "R", float(x)) for x in r] + [("small", "m", g, float(k)) for g in "VR" for k in range(5)]
    values = adaptive.createDataFrame(rows, "drug string, metric string, grp string, sim double").repartition(5)
    u = tests.mann_whitney(values).filter("drug = 'hot'").first()
    all_ranks = ranked(np.r_[v, r])
    want = all_ranks[:3000].sum() - 3000 * 3001 / 2
    ties = np.array(list(Counter(np.r_[v, r].tolist()).values()), float)
    sd = math.sqrt(3000 * 2500 / 12 * (5501 - (ties**3 - ties).sum() / (5500 * 5499)))
    assert u["stat"] == want and math.isclose(u["z"], (abs(want - 3000 * 2500 / 2) - 0.5) / sd, rel_tol=1e-9)
    brown = tests.brown_forsythe_variances(values).filter("drug = 'hot'").first()
    dev = [np.abs(x - np.median(x)) for x in (v, r)]
    mean = np.concatenate(dev).mean()
    between = sum(len(d) * (d.mean() - mean) ** 2 for d in dev)
    inside = sum(((d - d.mean()) ** 2).sum() for d in dev)
    assert math.isclose(brown["stat"], between / inside * 5498, rel_tol=1e-9) and brown["df2"] == 5498
    got = {(x["drug"], x["grp"]): x for x in tests.normality(values).collect()}
    for g, x in (("V", v), ("R", r)):
        own = got["hot", g]
        assert math.isclose(own["shapiro"], tests.shapiro(x)[1], rel_tol=1e-6)
        assert math.isclose(own["kolsir"], tests.kolmogorov(x), rel_tol=1e-6)
        assert math.isclose(own["normality"], tests.dagostino(x), rel_tol=1e-6)
    assert got["small", "V"]["normality"] is None and got["small", "V"]["shapiro"] is not None


def test_scores_of_ties_add_up():
    before, ties, n = np.array([0, 1, 4, 9]), np.array([1, 3, 5, 1]), np.full(4, 10)
    total, square = tests.score_sums(before, ties, n)
    one = tests.normal_score(np.arange(1, 11), 10)
    for k in range(4):
        own = one[before[k] : before[k] + ties[k]]
        assert math.isclose(total[k], own.sum(), abs_tol=1e-12) and math.isclose(square[k], (own**2).sum())
