"""Vector codes, language identification and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilark.llm import language_id, token_alignment, vector_codes
from vigilark.llm._labelled import remainder
from vigilark.llm.oracles import ORACLES
from vigilark.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- vector codes ------------------------------------------------------------------------------
def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int = 256) -> tuple[dict, list]:
    """Codes and errors by id (ids are different), and the codebooks, one part of one vector at a time."""
    whole = {i: [math.floor(scale * x) for x in v] for i, v in rows}
    dims = len(next(iter(whole.values()))) // parts
    cut = {i: [v[p * dims : (p + 1) * dims] for p in range(parts)] for i, v in whole.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for i in cut:
                own[nearest(cut[i][p], books[p])].append(cut[i][p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else books[p][e] for e in range(len(books[p]))]
    codes = {i: [nearest(cut[i][p], books[p]) for p in range(parts)] for i in cut}
    return {i: (codes[i], sum(far(cut[i][p], books[p][codes[i][p]]) for p in range(parts))) for i in cut}, books


def test_codes_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k) * 7 - 50, [float(x) for x in rng.integers(-8, 8, 12) / 16], None if k % 5 == 0 else int(k) % 3) for k in rng.permutation(90)]
    odd = [(900, None, 1), (901, [0.5, None] + [0.0] * 10, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, None), (904, [1.0, 2.0], 1), (905, [], 7)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").withColumns({"x": F.lit(1), "codes": F.lit("c"), "error": F.lit("e"), "n": F.lit(2)})
    found, books = vector_codes.compress_vectors(table.repartition(5), parts=4, entries=10, rounds=2)
    got = {r["vec_id"]: r for r in found.collect()}
    want, plain = plain_codes([(i, v) for i, v, _ in rows], 4, 10, 2)
    assert books.entries.tolist() == plain
    assert {i: (r["codes"], r["error"]) for i, r in got.items() if r["codes"] is not None} == want
    label = {i: k for i, _, k in rows}
    for i in want:
        assert got[i]["label_error"] == sum(e for j, (_, e) in want.items() if label[j] == label[i])
    assert set(got) == set(want) | {904, 905} and got[904]["codes"] is None and got[905]["error"] is None


def test_codes_of_repeated_few_and_no_vectors(spark):
    kind = "vec_id bigint, embedding array<double>, label string"
    rows, books = vector_codes.compress_vectors(spark.createDataFrame([(1, [0.1] * 16, "a")] * 3 + [(None, [1e30] * 16, None)], kind))
    got = rows.orderBy("vec_id").collect()
    assert len(got) == 4 and books.entries.shape == (16, 4, 1)
    assert [r["codes"] for r in got[1:]] == [[0] * 16] * 3 and got[0]["codes"] == [3] * 16  # ties go to the lower entry
    assert {r["error"] for r in got} == {0}
    for none in ([], [(1, None, "a")], [(1, [1.0], "a")]):
        rows, books = vector_codes.compress_vectors(spark.createDataFrame(none, kind))
        assert books is None and rows.count() == (none != [] and none[0][1] is not None)
    assert vector_codes.codebook_digest(None) == hashlib.sha256(b"").hexdigest()


def test_blocks_and_partitions_do_not_show(spark, monkeypatch):
    table = spark.read.parquet(f"{BIG}/embeddings.parquet")
    one, a = vector_codes.compress_vectors(table.coalesce(1))
    monkeypatch.setattr(vector_codes, "BLOCK_CELLS", 1000)
    many, b = vector_codes.compress_vectors(table.repartition(7))
    assert (a.entries == b.entries).all() and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_the_query_of_codes_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(ORACLES["op11_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    got = QUERIES["op11_vector_codes"](spark, sf).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and len(got) == len(want)


# -- languages ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def languages(spark):
    return language_id.train_languages(spark.read.parquet(f"{BIG}/documents.parquet"), remainder("doc_id", 5) != 0)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op12_language_id"](spark, BIG).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 1000 and (rows["lang"] == rows["lang_pred"]).mean() >= 0.99
    assert rows["score"].between(0, 1).all()


def test_mixed_documents_show_their_languages(spark, languages):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").filter("n_chars > 3000 and crc32(cast(doc_id as string)) % 5 = 0")
    text = {r["lang"]: r["text"][:2000] for r in docs.orderBy("doc_id").collect()}
    for a, b in [("de", "fr"), ("en", "es"), ("es", "fr")]:
        share = dict(zip(languages.names, languages.shares([text[a] + "\n" + text[b][:1000]])[0], strict=True))
        assert abs(share[a] - 2 / 3) < 0.1 and abs(share[b] - 1 / 3) < 0.1, (a, b, share)
    for a in text:
        share = dict(zip(languages.names, languages.shares([text[a]])[0], strict=True))
        assert share[a] > 0.95


def test_a_mixture_equals_plain_maximisation():
    rng = np.random.default_rng(1)
    like, often = rng.normal(-20, 3, (40, 3)), rng.integers(1, 5, 40).astype(float)
    share, value = language_id.mixture(like, often, np.array([40]), np.array([[True, False, True]]))
    grid = np.linspace(1e-6, 1 - 1e-6, 20_001)
    total = (often[:, None] * np.log(np.exp(like[:, :1]) * grid + np.exp(like[:, 2:]) * (1 - grid))).sum(0)
    assert abs(grid[total.argmax()] - share[0, 0]) < 0.02 and share[0, 1] == 0
    assert value[0] <= total.max() + 1e-6 and value[0] > total.max() - 0.05


def test_ngrams_are_counted_once_each():
    at, of = language_id.ngrams(["ab", "é"])
    assert np.bincount(of).tolist() == [3 + 2 + 1, 3 + 2 + 1]  # two letters, and two bytes, with both marks
    counts = np.zeros(language_id.PLACES, np.int64)
    language_id.add_counts(counts, Counter({"ab": 3, "é": 2}))
    assert counts.sum() == 6 * 5 and counts[at[of == 0]].min() >= 3


def test_languages_of_odd_tables(spark, languages):
    odd = [(1, None, "a"), (2, "", "b"), (None, "12 34 !?", "c"), (4, "the house and the " * 100_000, "d"), (4, "x" * 300_000, "e"), (5, "漢字", "f")]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang_pred string").withColumn("score", F.lit("s"))
    rows = language_id.identify_languages(docs, languages).collect()
    assert len(rows) == 6
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in rows), key=str)
    assert [g for g in got if g[0] in (0, 1, 2)] == [(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)]
    assert all(g[1] in languages.names and 0 < g[2] <= 1 for g in got if g[0] in (4, 5)) and (4, "en", 1.0) in got
    assert language_id.identify_languages(docs.limit(0), languages).count() == 0
    nothing = language_id.train_languages(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}
    one = language_id.train_languages(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, one).collect()} == {"und", "xx"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y"), (3, "e f", "z")], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.train_languages(docs, F.lit(True))


# -- token alignment ---------------------------------------------------------------------------
@lru_cache
def libraries() -> tuple[Tokenizer, sentencepiece.SentencePieceProcessor]:
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    """Groups of a whole text, each library called once for it."""
    if not text:
        return []
    lib_a, lib_b = libraries()
    pair = token_alignment.tokenizers(*PATHS)
    a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return []
    out, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            left.append(a[i])
            at_a, i = at_a + len(pair.bytes_a[a[i]]), i + 1
        else:
            right.append(b[j])
            at_b, j = at_b + len(pair.bytes_b[b[j]]), j + 1
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    return out


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    found = [plain_groups(t) for t in texts]
    links = [[(x, y) for left, right in groups for x in left for y in right] for groups in found]
    held = Counter(p for own in links for p in set(own))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    as_text = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), as_text(g))
        for g, own in zip(found, links, strict=True)
    ]


ODD = [
    None, "", " ", "\n", "  two  spaces\n\n\tand tabs ", "a;\r\nb }\r\n", "<|endoftext|> <s> </s> <unk>", "has ▁ sign", "▁", "é漢字🙂\x00\x01   　x y z",
    "    a  b", "don't STOP 1234567 89", "x" * 5000, "same text", "same text", "\x1c a\x1f b", "Ünï cödé ½ ﬁ",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_alignment_equals_whole_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 20_000)  # many blocks and buckets
    monkeypatch.setattr(token_alignment, "COMPOSED", 1000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150)
    odd = spark.createDataFrame([(None if k % 3 else -k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    both = docs.unionByName(odd).cache()
    names = {"n_a": F.lit("a"), "groups": F.lit(1), "id": F.lit(2), "block": F.lit(3)}
    got = token_alignment.align_tokenizers(both.withColumns(names).repartition(6), *PATHS).collect()
    rows = both.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == want


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_alignment.align_tokenizers(docs, *PATHS).count() == 0
    docs = spark.createDataFrame([("a", None), ("b", "▁")], "doc_id string, text string")
    rows = token_alignment.align_tokenizers(docs, *PATHS, digest=True).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, 0, 0, 0, 0, 0, ""), ("b", 0, 0, 0, 0, 0, 0, "")]


def test_the_query_of_alignments_gives_digests(spark, sf):
    rows = QUERIES["op13_token_alignment"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, plain_alignment(list(texts.values())), strict=True))
    for r in rows:
        own = want[r["doc_id"]]
        assert tuple(r[c] for c in COLUMNS[:-1]) == own[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(own[-1].encode()).hexdigest() if own[-1] else "")
    assert len(rows) == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab;'}1. \t\n\r\x0b\x0c\x1c 　▁é漢🙂<s>")), max_size=30), max_size=4))
def test_segments_stand_for_any_text(texts):
    """Cuts never change what either library makes of the whole text."""
    pair = token_alignment.tokenizers(*PATHS)
    for text in texts:
        parts = pair.split(text)
        assert "".join(parts) == (" " + text if text else "")
        found = pair.align(parts)
        if not all(found.column("valid").to_pylist()):
            assert plain_groups(text) == []
            continue
        lib_a, lib_b = libraries()
        flat = lambda c: [i for x in found.column(c).to_pylist() for i in x]
        assert flat("a") == (lib_a.encode(" " + text, add_special_tokens=False).ids if text else [])
        assert flat("b") == lib_b.encode(text)


def test_white_space_that_a_vocabulary_reaches_across_is_left_out():
    pair = token_alignment.tokenizers(*PATHS)
    assert pair.cuts == [" ", "\t", "\n", "\x0b", "\x0c"]  # ";\r" is a piece of the second vocabulary
