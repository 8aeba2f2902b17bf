"""Bounded samples of labelled documents, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    usable: Column,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most `per_class` (text, label) of each class, the same ones whatever the partitioning, and the
    number of usable labels of each class.

    The rows with the smallest hash of their id are taken, so the sample does not depend on
    order. Only `usable` labels of 0 or 1 count. The bounded list of ids is broadcast.
    """
    rows = labels.filter(usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    parts = [
        rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)
    ]
    picked = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "id").select("id", "text", "label").collect()
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().filter("label in (0, 1)").collect()}
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["id"], r["text"], r["label"]))], totals
