"""The numbered queries: thin layers over the operators, with their contracts' digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from rows whose remainder modulo 4 is not 2."""
    from vigilark.llm._labelled import remainder
    from vigilark.llm.toxicity import score_toxicity, train_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train_toxicity(docs, labels, remainder("doc_id", 4) != 2)
    return verdicts(score_toxicity(docs, machine), was_held_out(4, 2), 0.3)


def was_held_out(modulus: int, value: int) -> Column:
    """Whether the id's remainder is `value`; false without an id, though such rows teach nothing."""
    from vigilark.llm._labelled import remainder

    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


def verdicts(scores: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents in which no source recurs more than twice as often as another."""
    from vigilark.llm.mixing import Target, mix

    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Target(max_repeats=2.0))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "source", "weight", "block", "place")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how many other documents are near.

    `n_near` counts the other documents whose fingerprints differ in at most 3 bits.
    """
    from vigilark.llm._tables import settle
    from vigilark.llm.simhash import edited_fingerprints, likeness, neighbours

    rows = settle(edited_fingerprints(table(spark, sf_dir, "documents")))
    counts = settle(rows.groupBy("fp").agg(F.count("*").alias("n")))
    pairs = neighbours(counts.select("fp"))
    ends = pairs.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("other")).unionByName(
        pairs.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("other"))
    )
    weighed = counts.select(F.col("fp").alias("other"), F.col("n").alias("n_other"))
    near = ends.join(weighed, "other").groupBy("fp").agg(F.sum("n_other").alias("n_linked"))
    known = settle(counts.join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_near")))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(known, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("fp").alias("fingerprint"),
        text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document.

    `score` is 1 where a whole template matches, 0.5 where only a phrase does, else 0.
    """
    from vigilark.llm.licenses import scan_licenses

    rows = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["kind"] == "phrase")
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["first"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.when(F.exists("hits", lambda h: h["kind"] == "template"), 1.0)
        .when(F.size("hits") > 0, 0.5)
        .otherwise(0.0)
        .alias("score"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings by cosine."""
    from vigilark.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that smaller documents hold too."""
    from vigilark.llm.substring_dedup import remove_duplicate_spans

    rows = remove_duplicate_spans(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("whole"))
    return rows.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document and the text that its ids decode to."""
    import public_tokenizers

    from vigilark.llm.bpe import bpe_encode

    rows = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from rows whose remainder modulo 3 is not 1."""
    from vigilark.llm._labelled import remainder
    from vigilark.llm.quality import score_quality, train_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train_quality(docs, labels, remainder("doc_id", 3) != 1)
    return verdicts(score_quality(docs, machine), was_held_out(3, 1), 0.5)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 64-bit fingerprints of word shingles."""
    from vigilark.llm.simhash_dedup import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed patterns and discovered identifiers."""
    from vigilark.llm.pii import KINDS, describe, find_personal_data

    rows = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(describe(F.col("base")), 256).alias("base_sha256"),
        describe(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: (s["kind"] == "id") & ~s["weak"])).cast("long").alias("n_unseen"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings and the digest of their codebooks."""
    from vigilark.llm.vector_codes import codebook_digest, compress_vectors

    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows whose remainder modulo 5 is not 0."""
    from vigilark.llm._labelled import remainder
    from vigilark.llm.language_id import identify_languages, train_languages

    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, train_languages(docs, remainder("doc_id", 5) != 0))
    mix = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["name"], F.format_number(x["share"], 3))), ",")
    return found.select("doc_id", was_held_out(5, 0).alias("held_out"), "lang_pred", "score", mix.alias("languages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens in a byte-level and a piece vocabulary."""
    import public_tokenizers

    from vigilark.llm.token_alignment import align_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_pii": op10_pii,
    "op11_vector_codes": op11_vector_codes,
    "op12_language_id": op12_language_id,
    "op13_token_alignment": op13_token_alignment,
}
