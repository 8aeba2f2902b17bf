"""The classifiers on held-out rows, the mix, and the pipeline's stages."""

from __future__ import annotations

import itertools
import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilark.llm import mixing, quality, toxicity
from vigilark.llm._labelled import remainder
from vigilark.llm.queries import QUERIES

from .test_copies import plain_fingerprint, roots
from .test_texts import library, plain_base

BIG = "/root/testdata/sf0.1"


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(np.argsort(scores, kind="stable"))
    up = labels == 1
    return float((order[up].sum() - up.sum() * (up.sum() - 1) / 2) / (up.sum() * (~up).sum()))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.9)])
def test_held_out_rows_are_told_apart(spark, name, label, least):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = QUERIES[name](spark, BIG).join(labels, "doc_id").filter("held_out and label is not null").toPandas()
    assert len(rows) > 100
    assert area(rows["score"].to_numpy(), rows["label"].to_numpy()) >= least
    assert rows["score"].between(0, 1).all()
    assert ((rows["score"] >= (0.3 if label == "toxic" else 0.5)).astype(int) == rows["predicted"]).all()


@pytest.mark.parametrize(("train", "score", "label"), [
    (toxicity.train_toxicity, toxicity.score_toxicity, "toxic"), (quality.train_quality, quality.score_quality, "quality"),
])
def test_classifiers_take_odd_tables(spark, sf, train, score, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = train(docs, labels, remainder("doc_id", 4) != 2)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (4, "word " * 200_000, "d"), (4, "!!", "e")], "doc_id bigint, text string, score string")
    rows = score(odd, machine).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(odd.limit(0), machine).count() == 0
    empty = train(docs, labels.limit(0), remainder("doc_id", 4) != 2)
    assert score(docs, empty).count() == docs.count()


def test_words_that_polynomials_confuse_are_different():
    from .test_copies import thue_morse

    a, b = thue_morse(2048)
    once, key, place = toxicity.distinct(toxicity.words_of([f"{a} {b} {a} ab ba"]))
    assert len(once.sizes) == 4 and len(set(key.tolist())) == 4 and place.tolist() == [0, 1, 0, 2, 3]


def test_the_most_telling_words_are_kept_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WORDS", 12)
    rng = random.Random(2)
    clean = ["".join(rng.choices("aeiourstln", k=6)) for _ in range(300)]
    rows = [(". ".join(" ".join(rng.choices(clean, k=6)) for _ in range(3)), 0) for _ in range(120)]
    rows += [(" ".join([*rng.choices(clean, k=5), "zzgrimbly" if k % 10 else "qqvoxel"]), 1) for k in range(120)]
    machine = toxicity.fit_machine(rows)
    scores = machine.score(["some zzgrimbly words", "nothing of the kind", ""])
    assert scores[0] > 0.5 > scores[1] >= scores[2] - 0.2


# -- the kernel and the machine, written out ---------------------------------------------------
def plain_kernel(a: str, b: str) -> float:
    """Sum over equal letter triples of both words of DECAY to the letters that they span in each."""

    def features(w: str) -> dict:
        out: dict = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.MAX_SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


WORDS = ["idiot", "idxiot", "abcabc", "aaaaaa", "moron", "morning", "letter", "banana", "xyz"]


def test_maps_and_norms_equal_the_explicit_kernel():
    w = toxicity.words_of(WORDS)
    maps = toxicity.feature_maps(w)
    want = np.array([[plain_kernel(a, b) / math.sqrt(plain_kernel(a, a) * plain_kernel(b, b)) for b in WORDS] for a in WORDS])
    assert np.allclose(maps @ maps.T, want, atol=1e-5) and np.allclose(np.diag(want), 1)
    assert np.allclose(toxicity.kernel_rows(w, maps), want, atol=1e-5)
    # one weight per triple gives the same decisions as the expansion over landmarks
    alpha = np.random.default_rng(0).normal(size=len(WORDS))
    assert np.allclose(toxicity.decisions(w, alpha @ maps), want @ alpha, atol=1e-4)


def test_each_different_word_is_scored_once(monkeypatch):
    texts = ["Banana banana i d i o t b-a-n-a-n-a", "", "moron moron xyz", "x" * 5000 + " " + "x" * 5000]
    w = toxicity.words_of(texts)
    once, key, place = toxicity.distinct(w)
    assert len(once.sizes) == len(key) == 5 and len(place) == len(w.sizes)
    weights = np.random.default_rng(1).normal(size=toxicity.LETTERS**3)
    want = toxicity.decisions(w, weights)
    assert np.allclose(toxicity.decisions(once, weights)[place], want)
    machine = toxicity.Machine(weights, 0.0, np.zeros(6))
    for most in (500_000, 0):  # the second time from what is known, or all anew
        monkeypatch.setattr(toxicity, "MOST_KNOWN", most)
        assert all(np.allclose(machine.word_values(toxicity.words_of(part)), toxicity.decisions(toxicity.words_of(part), weights)) for part in (texts[:1], texts, texts))
    assert len(machine.known[0]) == 5 and not len(pickle.loads(pickle.dumps(machine)).known[0])


def insult_machine():
    rng = random.Random(5)
    common = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    insults = ["zwackelkopf", "quarzbirne", "knallfrosch"]
    rows = []
    for k in range(240):
        sentences = [" ".join(rng.choice(common) for _ in range(9)) for _ in range(4)]
        toxic = k % 2
        if toxic:
            words = sentences[k % 4].split()
            words.insert(rng.randrange(9), insults[k // 2 % 3])
            sentences[k % 4] = " ".join(words)
        rows.append((". ".join(sentences) + ".", toxic))
    return toxicity.fit_machine(rows), common, insults


def test_gapped_and_inserted_insults_are_found():
    machine, common, insults = insult_machine()
    rng = random.Random(9)
    line = lambda w: " ".join([*rng.sample(common, 6), w, *rng.sample(common, 6)])
    clean = machine.score([line(rng.choice(common)) for _ in range(200)])
    assert (clean < 0.3).mean() >= 0.97
    changed = []
    for w in insults:
        changed += [w, w.upper(), " ".join(w), "-".join(w), w[:4] + "x" + w[4:], w[:3] + "*" + w[3:], w[:5] + w[6:], w + "s"]
    scores = machine.score([line(w) for w in changed])
    assert (scores >= 0.3).mean() >= 0.9, list(zip(changed, scores.round(2), strict=True))


def test_the_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    width = (1 << quality.BUCKET_BITS) + len(quality.STATISTICS)
    m = quality.Factorisation(0.3, rng.normal(size=width), rng.normal(size=(width, quality.RANK)), rng.normal(size=len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    texts = ["one two two three, four!", "", "A b", "same same same"]
    rows = quality.featurise(texts)
    got, _, x = m.parts(rows)
    for k in range(len(texts)):
        full = np.zeros(width)
        own = rows.row == k
        full[rows.bucket[own]] = rows.value[own]
        full[1 << quality.BUCKET_BITS :] = x[k]
        at = np.flatnonzero(full)
        pairs = sum(m.factor[i] @ m.factor[j] * full[i] * full[j] for n, i in enumerate(at) for j in at[n + 1 :])
        assert math.isclose(got[k], 0.3 + full @ m.weight + pairs, rel_tol=1e-8, abs_tol=1e-8)


def test_texts_without_words_are_not_of_high_quality(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.train_quality(docs, labels, remainder("doc_id", 3) != 1)
    odd = machine.score(["", " ", "\n", "!!!!", "$$$ ### &&& |||", "... --- ...", "?", "*** " * 500])
    good = [r["text"] for r in docs.join(labels.filter("quality = 1"), "doc_id").limit(200).collect()]
    assert odd.max() < 0.5 and odd.max() <= np.quantile(machine.score(good), 0.05)


def plain_mix(rows: list[tuple], repeats: float) -> dict[str, float]:
    """Tokens that each source should give when none is repeated more than `repeats` times as often as another."""
    total: dict[str, int] = {}
    for _, text, source in rows:
        total[source or ""] = total.get(source or "", 0) + len((text or "").split())
    total = {s: n for s, n in total.items() if n}
    low, high = 0.0, 1.0
    ratio = lambda t: max(n ** (t - 1) for n in total.values()) / min(n ** (t - 1) for n in total.values())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio(mid) <= repeats else (mid, high)
    weight = {s: n**high for s, n in total.items()}
    return {s: w / sum(weight.values()) for s, w in weight.items()}


def test_blocks_of_the_mix_against_a_plain_one(spark):
    docs = mix_docs(spark)
    rows = [tuple(r) for r in docs.collect()]
    want = plain_mix(rows, 2.0)
    out = mixing.mix(docs, mixing.Target(max_repeats=2.0)).select("row.*", "weight", "block", "place", F.coalesce("source", F.lit("")).alias("s")).toPandas()
    got = out.dropna(subset=["weight"]).groupby("s")["weight"].first()
    assert got.index.tolist() == sorted(want) and np.allclose(got, [want[s] for s in got.index], rtol=1e-6)
    # every block but a source's last one holds each of its documents once: a permutation
    own = {s: {i for i, text, source in rows if (source or "") == s} for s in want}
    for (s, _), part in out[out["s"].isin(want)].groupby(["s", "block"]):
        assert part["doc_id"].is_unique and set(part["doc_id"]) <= own[s]
    for s in want:
        blocks = out[out["s"] == s].groupby("block")["doc_id"].apply(set)
        assert all(b == own[s] for b in blocks.sort_index().iloc[:-1])


def mix_docs(spark):
    rows = [(k, "w " * (5 + k % 7), "hot") for k in range(600)]
    rows += [(1000 + k, "w " * (3 + k % 5), "mid") for k in range(60)] + [(2000 + k, "w w", "rare") for k in range(9)]
    rows += [(3000, None, "blank"), (3001, "one", None), (3002, "one two", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix_meets_its_repetition_limit(spark):
    docs = mix_docs(spark)
    rows = mixing.mix(docs, mixing.Target(max_repeats=2.0)).select("row.*", "weight", "block", F.col("source").alias("s")).toPandas()
    shares = docs.withColumn("tokens", mixing.token_count(F.col("text")))
    total = {r["s"]: r["n"] for r in shares.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("tokens").alias("n")).collect()}
    weight = rows.dropna(subset=["weight"]).groupby("s")["weight"].first()
    assert math.isclose(weight.sum(), 1)
    per_token = [weight[s] / total[s] for s in weight.index]
    assert math.isclose(max(per_token) / min(per_token), 2.0, rel_tol=1e-6)
    assert set(rows["doc_id"]) == {r["doc_id"] for r in docs.collect()}  # nothing is left out
    counts = rows[rows["s"] == "hot"].groupby("doc_id").size()
    assert (counts == 1).all()
    drawn = rows.assign(n=rows["text"].fillna("").str.split().map(len)).groupby("s")["n"].sum()
    for s in weight.index:
        budget = weight[s] / weight["hot"] * total["hot"]
        assert budget - 12 <= drawn[s] <= budget + 1


def test_mix_entropy_and_budget(spark):
    docs = mix_docs(spark)
    even = mixing.mix(docs, mixing.Target(entropy_share=1.0), budget_tokens=400).select("row.*", "weight", F.col("source").alias("s")).toPandas()
    weight = even.dropna(subset=["weight"]).groupby("s")["weight"].first()
    assert np.allclose(weight, 1 / len(weight), atol=1e-6)
    n = even["text"].fillna("").str.split().map(len).groupby(even["s"]).sum()
    assert all(88 <= n[s] <= 100 for s in weight.index)
    half = mixing.source_shares(docs.select("source", mixing.token_count(F.col("text")).alias("tokens")))
    w = [r["weight"] for r in mixing.mix_weights(half, mixing.Target(entropy_share=0.7)).collect()]
    assert math.isclose(-sum(x * math.log(x) for x in w) / math.log(len(w)), 0.7, abs_tol=1e-6)
    assert mixing.mix(docs.limit(0), mixing.Target(max_repeats=2.0)).count() == 0


def test_mix_is_a_permutation_that_repeats(spark):
    docs = mix_docs(spark)
    a, b = (mixing.mix(d, mixing.Target(max_repeats=1.5)).select("row.doc_id", "block", "place").collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert len({(r["block"], r["place"]) for r in a}) == len(a)


def test_pipeline_stages_against_plain_ones(spark, sf):
    """Every stage over what its predecessor kept, beside the same in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    machine = toxicity.train_toxicity(docs, labels, remainder("doc_id", 4) != 2)
    kept: dict[str, dict] = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
        rows, given = docs.collect(), {r["doc_id"]: r["text"] or "" for r in before.collect()}
        kept[name] = {r["doc_id"]: r["text"] or "" for r in rows}
        if name == "toxicity":
            assert kept[name].keys() == {i for i, t in given.items() if machine.score([t])[0] < 0.3}
            assert len(toxic & kept[name].keys()) <= 0.2 * len(toxic)
            clean = given.keys() - toxic
            assert len(clean & kept[name].keys()) >= 0.95 * len(clean)
        elif name == "simhash_near_dedup":
            fps = {i: plain_fingerprint(t) for i, t in given.items()}
            links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
            assert kept[name].keys() == {i for i, r in roots(list(fps), links).items() if i == r}
        elif name == "personal_data":
            assert kept[name].keys() == given.keys() and all(r["n_chars"] == len(r["text"] or "") for r in rows)
            for i, t in given.items():
                base, out = plain_base(t), kept[name][i]
                assert base or "[ID]" in out or out == t
                assert not any(x for x in plain_base(out)), i
                for kind in {k for k, _, _ in base}:
                    assert f"[{kind.upper()}]" in out or len(base) > 1
        else:
            assert kept[name] == given and len(rows) >= len(given)  # nothing is lost, small sources recur
            weight = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], corpus_pipeline.MAX_REPEATS)
            drawn = {s: sum(len((r["text"] or "").split()) for r in rows if (r["source"] or "") == s) for s in weight}
            total = {s: sum(len(t.split()) for i, t in given.items()) for s in weight}
            ratio = {s: drawn[s] / weight[s] for s in weight if total[s]}
            assert max(ratio.values()) <= 1.5 * min(ratio.values())
    tok = library()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = tok.encode(kept["mixing"][r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)


def test_stages_take_null_ids_and_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    rows = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows, sf)
        assert out.filter("doc_id is null").count() == 1, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
