"""Discovery of personal data: the graph against a plain version, hidden seeds, odd and long texts."""

from __future__ import annotations

import math
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigilark.llm import pii

BIG = "/root/testdata/sf0.1"
PLACES = ["kitchen", "garden", "office", "harbour", "station"]


def town(spark):
    """Emails and phones in telling contexts, unseen forms in the same ones, numbers in others."""
    rows = []
    for k in range(30):
        rows.append((k, f"In the {PLACES[k % 5]} we heard it. Please write to user{k}@mail.example.org today, item {k}"))
        rows.append((100 + k, f"The {PLACES[k % 5]} was closed, ring me at +1 ({200 + k}) 555-01{k:02d} after lunch, row {k}"))
    rows += [(200 + k, f"Old note. Please write to user{k}@intranet today, item {k * 7}") for k in range(4)]
    rows += [(300 + k, f"Shut now, ring me at 555-77{k} after lunch, row {k}") for k in range(4)]
    rows += [(400 + k, f"we saw {k} apples in the garden, then item {k} and row {k}") for k in range(40)]
    return spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string")


def plain_graph(links: set[tuple[str, str]], kinds: dict[str, str]) -> dict[tuple[str, str], float]:
    """The same graph by dictionaries."""
    trust = {(v, k): 1.0 for v, k in kinds.items()}
    degree = defaultdict(int)
    for p, _ in links:
        degree[p] += 1
    found = {}
    for _ in range(pii.ROUNDS):
        by_value = defaultdict(list)
        for (v, k), t in trust.items():
            by_value[v].append((k, t))
        sums = defaultdict(list)
        for p, v in links:
            for k, t in by_value[v]:
                sums[p, k].append(t)
        found = {
            (p, k): sum(ts) / (degree[p] + 0.5)
            for (p, k), ts in sums.items()
            if degree[p] >= pii.MIN_SEEDS and sum(t >= pii.MIN_CONFIDENCE for t in ts) >= pii.MIN_SEEDS
        }
        doubt = defaultdict(float)
        for p, v in links:
            for k in (*pii.KINDS, pii.SECRET):
                if found.get((p, k), 0) >= pii.PASSING:
                    doubt[v, k] += math.log(1 - min(found[p, k], 0.999))
        trust = {(v, k): 1.0 for v, k in kinds.items()}
        for key, d in doubt.items():
            trust[key] = max(trust.get(key, 0), 1 - math.exp(d))
    return {key: c for key, c in found.items() if c >= pii.MIN_CONFIDENCE}


def test_the_graph_equals_a_plain_one(spark):
    seen = pii.seen_tokens(pii.scan(town(spark), "doc_id", "text"))
    rows = seen.collect()
    links = {(p, r["value"]) for r in rows for p in r["patterns"]}
    kinds = {r["value"]: r["kind"] for r in rows if r["kind"]}
    want = plain_graph(links, kinds)
    got = {(r["pattern"], r["like"]): r["confidence"] for r in pii.trusted_patterns(seen).collect()}
    assert got.keys() == want.keys() and len(got) >= 4
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)


def test_seeds_are_whole_and_unseen_forms_are_found(spark):
    seen = {r["value"]: r for r in pii.seen_tokens(pii.scan(town(spark), "doc_id", "text")).collect()}
    assert seen["+1 (205) 555-0105"]["kind"] == "phone" and "ring me at _" not in seen["+1 (205) 555-0105"]["patterns"]
    assert "me at _" in seen["+1 (205) 555-0105"]["patterns"]
    assert not any(re.fullmatch(r"[#^_$|= ]+", p) for r in seen.values() for p in r["patterns"])
    found = defaultdict(list)
    for r in pii.find_personal_data(town(spark)).collect():
        found[r["doc_id"]] += [(s["value"], s["like"]) for s in r["spans"] if s["kind"] == pii.FOUND]
    assert all(found[200 + k] == [(f"user{k}@intranet", "email")] for k in range(4))
    assert all(found[300 + k] == [(f"555-77{k}", "phone")] for k in range(4))
    assert not any(found[k] for k in found if k < 200 or k >= 400)
    spans = [s for r in pii.find_personal_data(town(spark)).collect() for s in r["spans"]]
    assert all(s["weak"] == bool(s["kind"] == pii.FOUND and re.fullmatch("[0-9a-fA-F]{32,}", s["value"])) for s in spans)


@pytest.mark.parametrize("least", [0.9])
def test_hidden_seeds_are_found_again(spark, least):
    """A third of the seeds become unknown: the contexts of the others bring them up again, and nothing else."""
    seen = pii.seen_tokens(pii.scan(town(spark), "doc_id", "text"))
    hidden = F.pmod(F.xxhash64("value"), F.lit(3)) == 0
    good = pii.trusted_patterns(seen.withColumn("kind", F.when(~hidden, F.col("kind"))))
    unknown = seen.filter("kind is null or pmod(xxhash64(value), 3) = 0").select("value", "kind", F.explode("patterns").alias("pattern"))
    brought = {(r["value"], r["kind"]) for r in unknown.join(good, "pattern").select("value", "kind").distinct().collect()}
    held = {(r["value"], r["kind"]) for r in seen.filter(hidden & F.col("kind").isNotNull()).select("value", "kind").collect()}
    assert len(held) >= 10
    assert len(held & brought) >= least * len(held)
    wrong = {v for v, k in brought if k is None and not v.endswith("@intranet") and not v.startswith("555-77")}
    assert not wrong


def test_discovery_over_the_big_table(spark):
    """Spans are found, none overlaps a checked one, and they are what the contexts of the data hide: keys."""
    rows = pii.find_personal_data(spark.read.parquet(f"{BIG}/documents.parquet")).filter(F.size("spans") > F.size("base")).collect()
    fresh = [s for r in rows for s in r["spans"] if s["kind"] == pii.FOUND]
    assert len(fresh) >= 150
    keys = [s for s in fresh if re.fullmatch("[0-9a-fA-F]{40}", s["value"])]
    assert len(keys) >= 0.95 * len(fresh) and all(s["weak"] for s in keys)
    for r in rows:
        new = [s for s in r["spans"] if s["kind"] == pii.FOUND]
        assert all(s["end"] <= b["start"] or b["end"] <= s["start"] for s in new for b in r["base"])


def test_overlapping_spans_and_private_characters(spark):
    odd = "see +49.123.45.67.89 and 1.2.3.4 1111 1111 1111 111 \U0010f041 a@b.co"
    docs = spark.createDataFrame([(1, odd), (2, "\U0010f041 none"), (3, "x 10.0.0.1 y"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[2] == "\U0010f041 none" and got[4] is None and got[5] == "" and got[3] == "x [IP] y"
    assert "�" in got[1] and got[1].endswith("[EMAIL]") and not re.search("[0-9]{4}", got[1])
    base = {r["doc_id"]: r["base"] for r in pii.find_personal_data(docs).collect()}
    for s in base[1]:
        assert odd[s["start"] : s["end"]] == s["value"]


def test_long_texts_take_linear_time(spark):
    """200 000 identifier-like tokens in one text, and as many addresses: seconds, not hours."""
    many = " ".join(f"n{k} of {k}" for k in range(100_000)) + " " + " ".join(f"a{k}@b.co" for k in range(20_000))
    docs = spark.createDataFrame([(1, many)], "doc_id bigint, text string")
    began = time.monotonic()
    text = pii.redact(docs).first()["text"]
    assert time.monotonic() - began < 120
    assert text.count("[EMAIL]") == 20_000 and text.startswith("n0 of 0 n1 of 1 ")


def test_clashing_columns_and_empty_tables(spark):
    docs = town(spark)
    named = docs.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(["id", "mark", "base", "spans", "fresh", "value", "kind"])])
    assert sorted(map(str, pii.find_personal_data(named).collect())) == sorted(map(str, pii.find_personal_data(docs).collect()))
    out = pii.redact(named)
    assert out.columns == named.columns and out.count() == named.count()
    assert pii.redact(named.limit(0)).count() == pii.find_personal_data(docs.limit(0)).count() == 0


def test_parts_of_a_joined_pattern_are_never_broadcast(spark, tmp_path):
    edges = spark.createDataFrame([(f"p{k % 3}", f"v{k}") for k in range(30)], "pattern string, value string")
    edges.write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")  # so small that Spark would broadcast its sixteen copies
    trust = edges.select("value", F.lit(1.0).alias("trust"))
    joined = pii._salted(edges, trust, "value", "pattern")
    assert sorted((r["pattern"], r["value"], r["trust"]) for r in joined.collect()) == sorted((f"p{k % 3}", f"v{k}", 1.0) for k in range(30))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
