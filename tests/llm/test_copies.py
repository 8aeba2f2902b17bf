"""Near-duplicate and substring operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilark.llm import _words, embedding_dedup, simhash, simhash_dedup, substring_dedup

WORDS = [f"w{k}" for k in range(400)]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {n: n for n in nodes}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text: str | None) -> int:
    words = [w.lower() for w in (text or "").split()]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    base = [text_of(rng, 600) for _ in range(6)]
    texts = [None, "", " \n ", "One two", "one TWO", "x"] + base
    for b in base:
        for _ in range(4):
            words = b.split()
            for _ in range(rng.choice([1, 2, 8])):
                words[rng.randrange(600)] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rows = [(i * 3 + 1, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, base[0], "no id"), rows[7]], "doc_id bigint, text string, fp string")
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(links) > 6
    want = roots(list(fps), links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fp"] % (1 << 64), r["component_id"]) == (fps[r["doc_id"]], want[r["doc_id"]])


def near_fps(seed: int, n: int = 120) -> list[int]:
    rng = random.Random(seed)
    fps = {0}
    for _ in range(n):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def brute_pairs(fps: list[int]) -> set[tuple[int, int]]:
    return {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_grid_join_finds_every_pair_once(spark, depth):
    fps = near_fps(2, n=120 if depth < 6 else 40)
    rows = simhash_dedup.links_between(spark.createDataFrame([(f, f) for f in fps], "node bigint, fp bigint"), depth).collect()
    assert len(rows) == len(set(rows)) and {(min(r), max(r)) for r in rows} == brute_pairs(fps)


def test_popcount_map_bounds_the_distance(spark):
    fps = near_fps(5, n=20)
    rows = spark.createDataFrame([(f,) for f in fps], "fp bigint").select("fp", simhash_dedup.popcount_map(F.col("fp")).alias("m")).collect()
    counts = {r["fp"]: [(r["m"] % (1 << 64)) >> 2 * k & 3 for k in range(32)] for r in rows}
    for f, c in counts.items():
        assert c == [((f % (1 << 64)) >> 2 * k & 3).bit_count() for k in range(32)]
    for a in fps[:40]:
        for b in fps[:40]:
            assert sum(abs(x - y) for x, y in zip(counts[a], counts[b], strict=True)) <= ((a ^ b) % (1 << 64)).bit_count()
    assert [simhash_dedup.grid_depth(n) for n in (1000, 10**6, 10**10)] == [1, 2, 6]


def test_block_tables_find_every_pair_once(spark):
    fps = near_fps(3)
    rows = simhash.neighbours(spark.createDataFrame([(f,) for f in [*fps, None]], "fp bigint")).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == brute_pairs(fps)


def weighted_fingerprint(text: str) -> int:
    terms = [(xxhash.xxh64_intdigest(w, seed=42), len(w)) for w in text.split()]
    total = sum(w for _, w in terms)
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in terms if h >> b & 1) > total)


def test_edited_texts_and_fingerprints(spark):
    rng = random.Random(4)
    rows = [(7, "héllo wörld again"), (3, None), (12, ""), (9, "ab"), (20, text_of(rng, 3000)), (15, text_of(rng, 40)), (1, "same"), (2, "same")]
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fp"] % (1 << 64) == weighted_fingerprint(t)
        assert r["edited_fp"] % (1 << 64) == weighted_fingerprint(edited)
        assert r["next_fp"] % (1 << 64) == weighted_fingerprint(following)
    assert simhash.edited_fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("most", [2, 200_000])
def test_edited_texts_of_rows_with_one_id_or_none(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    rng = random.Random(6)
    rows = [(None, f"none {text_of(rng, 4)}") for _ in range(9)] + [(50, f"hot {text_of(rng, 5)}") for _ in range(14)] + [(k * 7, text_of(rng, 6)) for k in range(12)]
    rows += [(50, "same twice"), (50, "same twice"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, mark string")
    marks = {r["t"]: r["m"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    order = sorted(((i is not None, i or 0, marks[t or ""], t or "") for i, t in rows), reverse=True)
    want = []
    for k, (_, _, _, t) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    got = [r["edited_sha256"] for r in simhash.edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def removed_by_brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, ws in words.items():
        for k in range(len(ws) - 49):
            key = tuple(ws[k : k + 50])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        passages = [text_of(rng, rng.choice([49, 50, 51, 60, 200])) for _ in range(5)] + [" ".join(["again"] * 120), "a b " * 60]
        rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "one word")]
        for i in range(3, 45):
            parts = [text_of(rng, rng.randrange(0, 70)) for _ in range(3)]
            for p in rng.sample(passages, rng.randrange(0, 4)):
                ws = p.split()
                cut = rng.randrange(0, 8)
                parts.insert(rng.randrange(len(parts) + 1), "\t".join(ws[cut:] if rng.random() < 0.5 else ws))
            rows.append((rng.randrange(10**6) * 50 + i, " \n".join(parts)))
        rows.append((10**9, rows[5][1]))
        docs = spark.createDataFrame(rows + [rows[6]], "doc_id bigint, text string").repartition(3)
        got = substring_dedup.remove_duplicate_spans(docs).withColumn(
            "sha", F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("whole"))
        )
        want = removed_by_brute_force(rows)
        seen = got.select("doc_id", "n_words", "n_removed", "sha").collect()
        assert len(seen) == len(rows) + 1
        assert sum(w[1] for w in want.values()) > 500
        for r in seen:
            assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert substring_dedup.remove_duplicate_spans(docs.limit(0)).count() == 0


def test_factors_are_the_longest_matches():
    """Matches found by anchors and extended against the reference equal the longest common runs."""
    rng = random.Random(7)
    ref = [rng.randrange(10**9) for _ in range(400)]
    own = [rng.randrange(10**9) for _ in range(30)] + ref[40:160] + [1, 2, 3] + ref[200:275] + [rng.randrange(10**9) for _ in range(20)]
    flat = np.array(own, np.int64)
    for begin, end, at in ((70, 96, 80), (153 + 20, 153 + 46, 220)):
        source = np.array(ref, np.int64)
        a, b = substring_dedup.extended(flat, begin, end, source[max(0, at - 50) : at], source[at + end - begin : at + end - begin + 50])
        want_a, want_b = begin, end
        while want_a > 0 and at - (begin - want_a) > 0 and begin - want_a < 50 and own[want_a - 1] == ref[at - (begin - want_a) - 1]:
            want_a -= 1
        while want_b < len(own) and want_b - end < 50 and own[want_b] == ref[at + want_b - begin]:
            want_b += 1
        assert (a, b) == (want_a, want_b)
    assert substring_dedup.extended(flat, 0, 30, flat[:0], flat[:0]) == (0, 30)
    occ = [(0, p, 1, 9, p + 10) for p in (77, 30, 50)] + [(1, 80, 1, 9, 90), (1, 90, 2, 9, 100)]
    found = substring_dedup.chains(*np.array(occ).T).tolist()
    assert found == [[0, 30, 76, 1, 9, 40, 86], [0, 77, 103, 1, 9, 87, 113], [1, 80, 106, 1, 9, 90, 116], [1, 90, 116, 2, 9, 100, 126]]
    assert substring_dedup.chains(*np.zeros((5, 0), int)).shape == (0, 7)
    starts = substring_dedup.boundary_windows(np.array([30, 100]), np.array([[20, 90], [95, 120]]), 200)
    assert starts.tolist() == [*range(6, 20), *range(76, 101)]


def thue_morse(length: int) -> tuple[str, str]:
    """The word of this length and its complement: equal under polynomials modulo 2**64 from 1024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(length)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_differ_anywhere_have_other_hashes():
    texts = [tail + x for n in (1, 8, 23, 24, 31, 32, 33) for tail in ("x" * n,) for x in ("aXb", "bXa", "aXbc", "bXac")]
    texts += ["a" * k for k in range(1, 70)] + [w + x for n in (16, 32, 1024, 4096) for w in ("", "x" * 24) for x in thue_morse(n)]
    for own in _words.hashes(_words.split(texts)):
        assert len(set(own.tolist())) == len(set(texts)) == len(texts)
    both = _words.hashes(_words.split([" ".join(texts)]))
    for own, alone in zip(both, _words.hashes(_words.split(texts)), strict=True):
        assert own.tolist() == alone.tolist()  # whatever stands around a word


def test_substrings_with_words_that_polynomials_confuse(spark):
    x, y = ("x" * 24 + w for w in thue_morse(1024))
    same = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join([*same[:20], x, *same[20:]])), (2, " ".join([*same[:20], y, *same[20:]])), (3, " ".join([*same[:20], y, *same[20:]]))]
    out = substring_dedup.remove_duplicate_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 0, 3: 50}


def test_substrings_with_hot_passages_and_clashing_columns(spark):
    rng = random.Random(11)
    hot = text_of(rng, 70)
    rows = [(k, f"{text_of(rng, 20)} {hot} {text_of(rng, 20)}" if k % 3 else text_of(rng, 80), "m", k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, place int")
    out = substring_dedup.remove_duplicate_spans(docs).withColumn("sha", F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("whole")))
    want = removed_by_brute_force([(i, t) for i, t, *_ in rows])
    for r in out.collect():
        assert (r["n_words"], r["n_removed"], r["sha"]) == want[r["doc_id"]]


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(60, size=200)] + rng.normal(size=(200, 16)) * 0.12
    vs = [list(map(float, v)) for v in np.r_[base, near, base[:5] * 2.5, base[:5]]]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows = [(i * 2 + 5, v) for i, v in enumerate(vs)] + [(10_000 + k, v) for k, v in enumerate(odd)] + [(None, vs[0])]
    got = embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == len(rows)
    unit = np.array(vs) / np.linalg.norm(vs, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    ids = [r[0] for r in rows[: len(vs)]]
    links = [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)]
    assert len(links) > 100
    want = roots(ids, links)
    by_id = {r["vec_id"]: r for r in got}
    found = sum(by_id[x]["n_links"] for x in ids)
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    assert sum(by_id[x]["component_id"] == want[x] for x in ids) >= 0.97 * len(ids)
    for k in range(len(odd)):
        assert (by_id[10_000 + k]["n_links"], by_id[10_000 + k]["component_id"]) == (0, 10_000 + k)


def test_vectors_of_rare_lengths_link_among_themselves(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0, "n") for k in range(50)]
    rows += [(100, [1.0, 2.0], 0, "n"), (101, [2.0, 4.0], 0, "n"), (102, [1.0, 2.0, 0.0], 0, "n"), (103, [1.0, 2.0, 0.001], 0, "n"), (104, [2.0, -1.0], 0, "n"), (104, [2.0, -1.0], 0, "n")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n bigint, component string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_duplicates(table).collect()}
    assert got[100] == (1, 100, True) and got[101] == (1, 100, False)
    assert got[102] == (1, 102, True) and got[103] == (1, 102, False)
    assert got[104] == (1, 104, True) and got[0] == (0, 0, True)
    assert embedding_dedup.embedding_duplicates(table.limit(0)).count() == 0
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")).count() == 1


def test_embedding_recall_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    v = np.array(rows["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = int((v @ v.T >= 0.95).sum()) - len(v)
    got = embedding_dedup.embedding_duplicates(table).agg(F.sum("n_links").alias("n")).first()["n"]
    assert 0.9 * want <= got <= want


def hot_group(n: int) -> np.ndarray:
    """Unit vectors, a third of them different ones of one group of pairwise cosine about 0.96."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[: n // 3] = 0.96**0.5 * v[-1] + 0.04**0.5 * v[: n // 3]
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_index_meets_the_pairs_of_a_hot_group():
    for total in (20_000, 80_000):
        v = hot_group(total)
        rng = np.random.default_rng(2)
        index = embedding_dedup.fit_index(v[rng.permutation(total)[: embedding_dedup.SAMPLE]], total)
        a, b = v[rng.integers(total // 3, size=(2, 2000))]
        met = [(index.visit(x, index.cells) == index.home(y)[:, None]).any(1) for x, y in ((a, b), (b, a))]
        assert (met[0] | met[1]).mean() >= 0.99
        assert index.recall >= embedding_dedup.TARGET
        # the other vectors' cells stay small
        held = np.bincount(index.home(v))
        assert np.median(held[index.home(v[total // 3 :])]) < 200


def test_links_of_a_hot_group_of_different_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ASKS", 2000)  # several tiles
    v = hot_group(20_000)
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "node bigint, v array<double>")
    got = embedding_dedup.links(nodes)
    want = int((v @ v.T >= 0.95).sum()) - len(v)
    assert want > 20_000_000
    assert 0.99 * want <= 2 * got.count() <= want
