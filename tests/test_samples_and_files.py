"""Exactness of draws at their edges, and every reader and writer."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.operators import groups, learning, ranks, relational, sampling, similarity
from vigilark.sources import files, sinks, tables


def test_control_groups_are_full_and_disjoint(spark):
    pool = spark.range(40).select(F.col("id").alias("term"), F.col("id").alias("index"))
    rows = [("tight", k) for k in range(20)] + [("wide", k) for k in range(3)] + [("too much", k) for k in range(21)]
    valid = groups.usable_groups(spark.createDataFrame(rows, "drug string, reaction bigint"), pool.select("term"))
    for spare in (3, 0):  # without spare draws most come from the second pass
        got = defaultdict(set)
        drawn = groups.control_groups(valid, pool, spare=spare).collect()
        for r in drawn:
            got[r["drug"]].add(r["reaction"])
        assert got.keys() == {"tight", "wide"} and len(drawn) == 23
        assert len(got["wide"]) == 3 and not got["wide"] & {0, 1, 2}
        assert got["tight"] == set(range(20, 40))


def test_every_positive_gets_a_negative(spark):
    # drug 0 knows all reactions but one rare one, drug 1 all of them
    rows = [(0, r) for r in range(30)] + [(1, r) for r in range(31)] + [(2, 5), (2, 30)] + [(k, 3) for k in range(3, 60)]
    pos = spark.createDataFrame(rows, "drug int, reaction int")
    known = {tuple(r) for r in rows}
    got = sampling.negatives_by_key(pos, "drug", "reaction", pos, attempts=2).collect()
    count = defaultdict(int)
    for r in got:
        assert (r["drug"], r["reaction"]) not in known
        count[r["drug"]] += 1
    assert count[0] == 30 and count[1] == 0 and count[2] == 2 and all(count[k] == 1 for k in range(3, 60))
    assert {r["reaction"] for r in got if r["drug"] == 0} == {30}
    full = sampling.negatives_at_random(pos, pos, attempts=1).collect()
    assert len(full) == len(rows) and not {(r["drug"], r["reaction"]) for r in full} & known
    with pytest.raises(ValueError, match="known"):
        every = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "drug int, reaction int")
        sampling.negatives_at_random(every, every)
    assert sampling.negatives_by_key(pos.limit(0), "drug", "reaction", pos).count() == 0


def test_negatives_when_nearly_all_pairs_are_known(spark):
    free = [(d, (d * 37) % 250) for d in range(0, 40, 4)]
    rows = [(d, r) for d in range(40) for r in range(250) if (d, r) not in free]
    known = spark.createDataFrame(rows, "drug int, reaction int")
    few = known.filter("reaction < 3")
    got = sampling.negatives_at_random(few, known, True, 1, 3, known).collect()
    assert len(got) == few.count() and {(r["drug"], r["reaction"]) for r in got} <= set(free)
    assert len({(r["drug"], r["reaction"]) for r in got}) == len(free)  # all that is free is drawn
    mine = known.filter("drug % 8 = 0 and reaction < 20")
    got = sampling.negatives_by_key(mine, "drug", "reaction", known, True, 1, 3, known).collect()
    assert len(got) == mine.count() and {(r["drug"], r["reaction"]) for r in got} == {f for f in free if f[0] % 8 == 0}


def test_draws_go_on_beyond_what_is_taken(spark):
    taken = spark.createDataFrame([("a", k, 1) for k in (0, 1, 4, 7)] + [("b", 2, 1)], "g string, at bigint, size bigint")
    draws = spark.createDataFrame([(g, k, f"{g}{k}") for g in "abc" for k in range(5)], "g string, u bigint, name string")
    got = {r["name"]: r["u"] for r in ranks.beyond_taken(draws, ["g"], "u", taken).collect()}
    want = {"a": [2, 3, 5, 6, 8], "b": [0, 1, 3, 4, 5], "c": [0, 1, 2, 3, 4]}
    assert got == {f"{g}{k}": x for g, xs in want.items() for k, x in enumerate(xs)}


def test_a_control_group_for_nearly_half_of_the_pool(spark):
    pool = spark.range(5000).select((F.col("id") * 3).alias("term"), F.col("id").alias("index"))
    valid = pool.filter("index % 50 < 22").select(F.lit("hot").alias("drug"), F.col("term").alias("reaction"))
    valid = groups.usable_groups(valid.unionByName(spark.createDataFrame([("hot", -1), ("small", 0), ("small", 3)], "drug string, reaction bigint")), pool.select("term"))
    got = groups.control_groups(valid, pool, spare=0).collect()
    own = {r["reaction"] for r in got if r["drug"] == "hot"}
    assert len(own) == len([r for r in got if r["drug"] == "hot"]) == 2200
    assert not own & {r["reaction"] for r in valid.filter("drug = 'hot'").collect()}
    assert len([r for r in got if r["drug"] == "small"]) == 2


def test_draws_of_few_drugs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(groups, "RUN", 64)
    monkeypatch.setattr(groups, "DRAWS", 500)
    rows = spark.createDataFrame([("a", 3000), ("b", 63), ("c", 65), ("d", 1), ("e", 0)], "drug string, n int").coalesce(1)
    made = groups.numbered(rows, "attempt", F.col("n") + 0).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["drug"], r["attempt"]) for r in made) == [(d, k) for d, n in (("a", 3000), ("b", 63), ("c", 65), ("d", 1)) for k in range(1, n + 1)]
    assert len({r["task"] for r in made}) > 3 and max(Counter(r["task"] for r in made).values()) < 2000
    assert groups.numbered(rows.limit(0), "attempt", F.col("n")).count() == 0


def test_batches_have_their_size_and_lose_no_context(spark):
    rows = [(t, c, 1 + (t * c) % 5) for t in range(50) for c in range(t % 7, 40, 7)] + [(100 + t, 0, 1) for t in range(6)]
    counts = spark.createDataFrame(rows, "target int, context int, n bigint")
    got = sampling.contrastive_batches(counts, 8, 1).collect()
    by_batch = defaultdict(dict)
    for r in got:
        by_batch[r["batch"]][r["target"]] = r["context"]
    assert set(by_batch) == set(range(7)) and max(map(len, by_batch.values())) <= 8
    own = defaultdict(set)
    for t, c, _ in rows:
        own[t].add(c)
    chosen = {t for b in by_batch.values() for t in b}
    for b in by_batch.values():
        assert len(set(b.values())) == len(b) and all(c in own[t] for t, c in b.items())
    assert len([t for t in own if t not in chosen]) <= 6  # only those whose one context is taken
    assert all(own[t] == {0} for t in own if t not in chosen)


def test_neighbours_of_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    terms = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40)] + [(99, [0.0, 1.0])], "term int, v array<double>")
    emitted = []
    real = similarity.pa.concat_tables
    monkeypatch.setattr(similarity.pa, "concat_tables", lambda parts: emitted.append(1) or real(parts))
    got = defaultdict(list)
    for r in similarity.all_top_neighbours(terms, "cosine", 3).orderBy("term", "rank").collect():
        got[r["term"]].append(r["neighbour"])
    assert got[0] == [1, 2, 3] and got[5] == [0, 1, 2] and got[99] == [0, 1, 2]


def test_neighbours_in_wide_blocks(spark, monkeypatch):
    """Blocks grow with the table, so that a term is sent to few of them; what is best does not change, ties and NaN included."""
    monkeypatch.setattr(similarity, "WIDE", 40)
    monkeypatch.setattr(similarity, "SPREAD", 2)
    v = np.random.default_rng(5).integers(-2, 3, (85, 3)).astype(float)
    v[7] = np.nan
    terms = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "term int, v array<double>")
    monkeypatch.setattr(similarity, "BLOCK", 10)
    assert similarity._block_pairs(terms, wide=True).count() == 85 * 3 and similarity._block_pairs(terms).count() == 85 * 9
    got = {(r["term"], r["rank"]): r["neighbour"] for r in similarity.all_top_neighbours(terms, "manhattan", 6).collect()}
    d = np.abs(v[:, None] - v[None]).sum(2)
    want = {(k, r + 1): j for k in range(85) for r, j in enumerate([j for j in np.lexsort((np.arange(85), d[k])) if j != k and d[k, j] == d[k, j]][:6])}
    assert got == want
    own = similarity._best_of("manhattan", v, v, 6, True)
    for strip in (10, 100):
        monkeypatch.setattr(similarity, "BLOCK", strip)
        assert all((x == y).all() for x, y in zip(own, similarity._best_of("manhattan", v, v, 6, True), strict=True))


def test_shuffle_is_a_repeatable_permutation(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    a, b, c = ([r["k"] for r in sampling.shuffle(d, ["k"], seed).collect()] for d, seed in ((rows, 1), (rows.repartition(7), 1), (rows, 2)))
    assert a == b != c and sorted(a) == sorted(c) == list(range(200)) != a


def test_draws_within_a_key(spark):
    weights = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, 2.0)], "k string, term int, p double")
    draws = spark.range(400).selectExpr("id", "(id + 0.5) / 400 as u", "'a' as k").unionByName(spark.range(10).selectExpr("id", "(id + 0.5) / 10 as u", "'b' as k"))
    got = {(r["k"], r["x"]): r["count"] for r in sampling.draw(draws, sampling.intervals_within(weights, "k"), "x", within=["k"]).groupBy("k", "x").count().collect()}
    assert got == {("a", 1): 300, ("a", 2): 100, ("b", 1): 10}


# -- models ------------------------------------------------------------------------------------
def test_rounds_of_training_go_on_and_emit(spark):
    rows = [(f"t{t}", f"c{c}", int(t % 3 == c % 3)) for t in range(9) for c in range(9)]
    samples = spark.createDataFrame(rows, "target string, context string, label int")
    asked = []

    def drawn(epoch):
        asked.append(epoch)
        return samples.unionByName(spark.createDataFrame([(f"new{epoch}", "c0", 1)], samples.schema))

    out = list(learning.nsg_rounds(drawn, 6, 5, rate=0.5, blocks=2, epochs_per_out=2))
    assert [e for e, _, _ in out] == [1, 2, 4, 5] and asked == [1, 2, 4]
    assert out[-1][2] < out[0][2]
    assert {r["term"] for r in out[-1][1].filter("side = 'target'").collect()} >= {"new1", "new2", "new4", "t0"}


def test_models_and_scalers_are_kept(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [([float(a) * 50 + 3, float(b)], int(a + b > 0)) for a, b in rng.normal(size=(200, 2))]
    table = spark.createDataFrame(rows, "features array<double>, label int")
    scaler = relational.scaler(table, "features")
    model = learning.train_classifier(relational.scale(table, "features", scaler), 2, (4,), 40)
    learning.save_classifier(model, str(tmp_path / "model"))
    tables.save_table(scaler, str(tmp_path / "scaler"))
    again = relational.scale(table, "features", tables.load_table(spark, str(tmp_path / "scaler")))
    x = np.array([r["features"] for r in again.collect()])
    assert np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 1)
    plain = [r["score"] for r in learning.classify(model, again).orderBy("features").collect()]
    stored = [r["score"] for r in learning.classify(learning.load_classifier(str(tmp_path / "model")), again.drop("label")).orderBy("features").collect()]
    assert np.allclose(plain, stored)
    seen = [n for n, _ in learning.classifier_rounds(again, 2, (4,), 25, every=10)]
    assert seen == [10, 20, 25]


def test_reactions_by_index(spark):
    rng = np.random.default_rng(1)
    rows = [("d", f"r{k % 6}", [float(x)], int((x > 0) == (k % 2 == 0))) for k, x in enumerate(rng.normal(size=600))]
    table = spark.createDataFrame(rows, "drug string, reaction string, features array<double>, label int")
    model = learning.train_indexed_classifier(table, rounds=200)
    got = learning.classify_indexed(model, table).collect()
    right = np.mean([(r["score"] > 0.5) == bool(y[3]) for r, y in zip(got, rows, strict=True)])
    assert right > 0.9  # the sign of the feature counts the other way for every second reaction
    assert learning.classify_indexed(model, table.limit(1).withColumn("reaction", F.lit("unseen"))).count() == 1


def test_gradients_of_the_machine():
    rng = np.random.default_rng(2)
    p, x, y, at, shared = rng.normal(size=(4, 4)), rng.normal(size=(9, 2)), rng.integers(0, 2, 9).astype(float), rng.integers(0, 4, 9), rng.normal(size=1 + 2 + 6)

    def loss(p, shared):
        factors = np.c_[np.zeros(9), x]  # the pair sum, one pair of features after the other
        z = shared[0] + p[at, 0] + x @ shared[1:3]
        v = shared[3:].reshape(2, 3)
        for k in range(9):
            z[k] += x[k, 0] * (p[at[k], 1:] @ v[0]) + x[k, 1] * (p[at[k], 1:] @ v[1]) + factors[k, 1] * factors[k, 2] * (v[0] @ v[1])
        return np.log1p(np.exp(np.where(y > 0, -z, z))).sum()

    for k, got in enumerate(learning.machine_gradients(p, at, x, y, shared, 3)):
        want = np.zeros_like(got)
        for cell in np.ndindex(got.shape):
            ends = [[p.copy(), shared.copy()] for _ in range(2)]
            for end, step in zip(ends, (1e-6, -1e-6), strict=True):
                end[k][cell] += step
            want[cell] = (loss(*ends[0]) - loss(*ends[1])) / 2e-6
        assert np.allclose(got, want, atol=1e-6)


def test_many_reactions_are_rows(spark, monkeypatch):
    """Beyond MOST_DENSE reactions no weight of a reaction is in the driver; blocks do not change what is learned."""
    monkeypatch.setattr(learning, "MOST_DENSE", 3)
    rng = np.random.default_rng(1)
    rows = [(k, f"r{k % 6}", [float(x)], int((x > 0) == (k % 2 == 0))) for k, x in enumerate(rng.normal(size=300))]
    table = spark.createDataFrame(rows, "drug bigint, reaction string, features array<double>, label int")
    got = {}
    for cell in (1 << 19, 70):
        monkeypatch.setattr(learning, "CELL", cell)
        monkeypatch.setattr(learning, "RATE", 0.5)
        model = learning.train_indexed_classifier(table, rounds=12)
        assert isinstance(model, learning.IndexedModel) and len(model.shared) == 1 + 1 + 8
        got[cell] = {r["drug"]: r["score"] for r in learning.classify_indexed(model, table.union(table.limit(1).selectExpr("-1", "'unseen'", "features", "label"))).collect()}
    few, many = got.values()
    assert len(few) == 301 and all(many[k] == pytest.approx(few[k], abs=1e-9) for k in few)
    assert np.mean([(few[k] > 0.5) == bool(r[3]) for k, r in enumerate(rows)]) > 0.9


def test_settle_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    df = tables.settle(spark.range(5), columnar=True)
    assert df.count() == 5
    tables.release(df, spark.range(1))
    with pytest.raises(Exception, match="(?i)does not exist|not found|FILE_NOT_EXIST|no such"):
        spark.read.parquet(df._settled_at).count()

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())


# -- files -------------------------------------------------------------------------------------
def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pairs_names_and_valid_pairs(spark, tmp_path):
    assert [tuple(r) for r in files.read_pairs(spark, write(tmp_path / "p.csv", "a|x\na|x\nb|y\n")).orderBy("target").collect()] == [("a", "x"), ("a", "x"), ("b", "y")]
    names = files.read_names(spark, write(tmp_path / "n.csv", "code|name\nab|First\nAB|Second\n"), header=True)
    assert [tuple(r) for r in names.collect()] == [("AB", "Second")]
    v1, v2 = write(tmp_path / "v1.csv", "d|r|t\na|x|1\na|x|1\na|y|0\n"), write(tmp_path / "v2.csv", "d|r|t\na|x|0\nb|z|1\n")
    pairs = files.read_valid_pairs(spark, [v1, v2])
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert {r["drug"]: r["reactions"] for r in files.group_pairs(pairs).collect()} == {"a": ["x", "y"], "b": ["z"]}


def test_hierarchies(spark, tmp_path):
    line = "0|1|{pt}|h1|{hlt}|g1|{hlgt}|s1|{soc}|x|{rank}"
    rows = ["h" * 3 + "|b" * 10] + [line.format(pt=p, hlt=h, hlgt="G", soc="S", rank=k) for p, h, k in (("a", "H", "PRIMARY"), ("a", "H", "PRIMARY"), ("a", "I", "SECONDARY"))]
    path = write(tmp_path / "h.csv", "\n".join(rows) + "\n")
    got = files.read_paths(spark, path, files.THREE_LEVELS, distinct=True)
    assert sorted((r["pt"], r["hlt"], r["rank"]) for r in got.collect()) == [("a", "H", "PRIMARY"), ("a", "I", "SECONDARY")]
    assert files.read_paths(spark, path, files.THREE_LEVELS, primary_only=True).count() == 2
    five = write(tmp_path / "s.csv", "x\na|0|s5|0|-|0|s3|0|-|0|s1\na|0|s5|0|-|0|s3|0|-|0|s1\n")
    smq = files.read_paths(spark, five, files.FIVE_LEVELS).collect()
    assert len(smq) == 2 and (smq[0]["smq5"], smq[0]["smq4"], smq[0]["smq1"]) == ("s5", None, "s1")
    codes = files.name_code_map(spark.createDataFrame([("a", "H", "7"), ("a", None, "8")], "pt string, hlt string, code string"), {"hlt": "code"})
    assert codes.first()["codes"] == {"H": "7", "7": "H", "8": None}


def test_main_table_and_matrix(spark, tmp_path):
    main = files.read_main_table(spark, write(tmp_path / "m.csv", "a_x|a|x|1|5|2.5\nb_y|b|y|-1|none|\n")).orderBy("drug").collect()
    assert (main[0]["label"], main[0]["freq"], main[0]["ror"]) == (1, 5.0, 2.5)
    assert (main[1]["label"], main[1]["freq"], main[1]["ror"]) == (-1, None, None)
    matrix = write(tmp_path / "x.csv", "names|a|b|c\na|-inf|0.5|-inf\nb|0.5|-inf|0.25\nc|-inf|0.25|-inf\n")
    got = {(r["i"], r["j"]): r["sim"] for r in files.read_matrix(spark, matrix).collect()}
    assert got == {("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "c"): 0.25, ("c", "b"): 0.25}


def test_lines_keep_their_order_over_part_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(4):
        write(folder / f"part-{k}.csv", "".join(f"t|{k}.{n}\n" for n in range(3)) + f"u{k}|{k}\n")
    got = {r["term"]: r["freq"] for r in files.read_frequencies(spark, str(folder)).collect()}
    assert got["t"] == 3.2 and got["u1"] == 1
    header = tmp_path / "head"
    header.mkdir()
    for k in range(3):
        write(header / f"part-{k}.csv", f"name|v\na{k}|1|2\n")
    assert {r["term"] for r in files.read_vectors(spark, str(header), header=True).collect()} == {"a0", "a1", "a2"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "k string, x double")
    out = str(tmp_path / "rows")
    sinks.write_rows(rows, out)
    sinks.write_rows(rows.limit(1), out, append=True)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["a|1.5", "a|1.5", "b|2.0"]
    sims = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "i string, j string, sim double")
    assert [tuple(r) for r in sinks.square_matrix(sims, ["a", "b"]).collect()] == [("a", None, 0.5), ("b", 0.5, None)]
    ranked = spark.createDataFrame([("x", "m", 0.9, 1), ("y", "m", 0.8, 2), ("z", "n", 0.7, 1)], "term string, metric string, sim double, rank int")
    wide = sinks.ranking_table(ranked, ["m", "n"]).collect()
    assert [tuple(r) for r in wide] == [(1, "x", 0.9, "z", 0.7), (2, "y", 0.8, None, None)]
    results = spark.createDataFrame([("d", "m", "F", 1.0), ("d", "n", "F", 2.0), ("d", "m", "U", 3.0)], "drug string, metric string, stat string, value double")
    assert {(r["drug"], r["stat"]): (r["m"], r["n"]) for r in sinks.stat_table(results, ["m", "n"]).collect()} == {("d", "F"): (1.0, 2.0), ("d", "U"): (3.0, None)}
    assert sinks.stat_table(results, ["m", "n"], "U").count() == 1
    turned = sinks.transpose(spark.createDataFrame([("r1", 1, 2), ("r2", 3, 4)], "name string, a int, b int"), "name")
    assert {r["name"]: (r["r1"], r["r2"]) for r in turned.collect()} == {"a": ("1", "3"), "b": ("2", "4")}
    assert sinks.output_dir("/x/", "Run").startswith("/x/2") and sinks.output_dir("/x", "Run").endswith("_run")
    vectors = spark.createDataFrame([("target", "t", [1.0]), ("context", "c", [2.0]), ("shared", "", [0.0])], "side string, term string, v array<double>")
    sinks.write_epoch(vectors, str(tmp_path / "epochs"), 5)
    assert spark.read.text(str(tmp_path / "epochs/5_context_dict.csv")).first()[0] == "c|2.0"
    assert json.loads(open(sinks.write_config({"a": 1}, str(tmp_path / "run"))).read()) == {"a": 1}


def test_incomplete_rows_are_dropped_and_counted(spark):
    rows = spark.createDataFrame([("a", "x", 1, 2.0), ("a", "y", 0, None), (None, "y", 1, 1.0)], "drug string, reaction string, label int, freq double")
    got = {r["stage"]: r for r in relational.counts_before_and_after(rows).collect()}
    assert (got["all"]["n_rows"], got["complete"]["n_rows"], got["all"]["n_positive"], got["complete"]["n_drugs"]) == (3, 1, 2, 1)
    assert math.isclose(relational.scaler(spark.createDataFrame([([2.0],), ([2.0],)], "v array<double>"), "v").first()["spread"], 1)


def lines_of(path) -> list[str]:
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


def test_matrices_are_written_without_a_column_per_name(spark, tmp_path):
    names = [f"n{k:03d}" for k in range(30)]
    cells = [(a, b, round((i * 31 + j * 17) % 100 / 100, 2)) for i, a in enumerate(names) for j, b in enumerate(names) if (i + j) % 7]
    table = spark.createDataFrame(cells, "i string, j string, sim double").repartition(5)
    sinks.write_matrix(table, f"{tmp_path}/m")
    known = {(a, b): str(x) for a, b, x in cells}
    want = ["|" + "|".join(names)] + [a + "|" + "|".join(known.get((a, b), "") for b in names) for a in names]
    assert lines_of(tmp_path / "m") == want
    wide = spark.createDataFrame([(k, k * 2, None if k % 2 else f"x{k}") for k in range(4)], "id int, b int, a string")
    sinks.write_transposed(wide, "id", f"{tmp_path}/t", ",")
    assert lines_of(tmp_path / "t") == [",0,1,2,3", "a,x0,,x2,", "b,0,2,4,6"]
    sinks.write_matrix(table.limit(0), f"{tmp_path}/none")
    assert lines_of(tmp_path / "none") == []


def test_a_matrix_of_many_names(spark, tmp_path):
    n = 3000
    cells = spark.range(n, numPartitions=4).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(500))).alias("j"), F.lit(1).alias("sim"))
    cells = cells.unionByName(spark.range(n).select(F.lit(0).alias("i"), F.col("id").alias("j"), F.lit(2).alias("sim")))
    sinks.write_matrix(cells, f"{tmp_path}/m")
    lines = lines_of(tmp_path / "m")
    assert len(lines) == n + 1 and all(x.count("|") == n for x in lines)
    assert lines[1].startswith("0|2|2|2") and sum(x != "" for x in lines[2].split("|")[1:]) == n // 500
