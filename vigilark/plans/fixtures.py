"""Logical tables of the toolkit, made from the star schema; the same in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS3, LEVELS5 = ["hlt", "hlgt", "soc"], ["smq5", "smq4", "smq3", "smq2", "smq1"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def terms(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("term"), F.col("embedding").cast("array<double>").alias("v"))

    def pool(self) -> DataFrame:
        """Terms with their place; ids run from 0 without gaps."""
        return self.raw("embeddings").select(F.col("vec_id").alias("term"), F.col("vec_id").alias("index"))

    def pairs(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("context"))

    def reports(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("reaction"))

    def freq(self) -> DataFrame:
        return self.pairs().groupBy(F.col("target").alias("term")).agg(F.count("*").cast("double").alias("freq"))

    def paths3(self) -> DataFrame:
        part = self.raw("part")
        cols = [F.col("p_brand").alias("hlt"), F.col("p_type").alias("hlgt"), F.floor(F.col("p_size") / 10).cast("string").alias("soc")]
        first = part.select(F.col("p_partkey").alias("term"), *cols, F.lit("PRIMARY").alias("rank"), F.lit(0).alias("ord"))
        n = part.agg(F.count("*").alias("n"))  # one row
        moved = part.select("p_partkey").join(F.broadcast(n)).select(
            F.col("p_partkey").alias("term"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("k")
        )
        second = moved.join(part.select(F.col("p_partkey").alias("k"), *cols), "k").select("term", *LEVELS3, F.lit("SECONDARY").alias("rank"), F.lit(1).alias("ord"))
        return first.unionByName(second)

    def paths5(self) -> DataFrame:
        t = F.col("vec_id")
        level = lambda k, m: F.when(t % k == 0, (t % m).cast("string"))
        return self.raw("embeddings").select(
            t.alias("term"), level(2, 40).alias("smq5"), level(3, 20).alias("smq4"), level(5, 10).alias("smq3"),
            level(7, 5).alias("smq2"), F.when(t % 2 == 1, (t % 3).cast("string")).alias("smq1"),
        )

    def valid(self) -> DataFrame:
        return self.reports().distinct()

    def labelled(self) -> DataFrame:
        """Pairs with a label: 1 if any of their reports was returned, else -1."""
        line = self.raw("lineitem")
        flag = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(-1))
        return line.groupBy(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("reaction")).agg(flag.alias("label"))

    def reference(self) -> DataFrame:
        """Two files with contradicting labels as rows with `ord`: odd and even orders."""
        line = self.raw("lineitem").withColumn("ord", (F.col("l_orderkey") % 2).cast("int"))
        flag = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
        return line.groupBy(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("reaction"), "ord").agg(flag.alias("label"))

    def scores(self) -> DataFrame:
        line = self.raw("lineitem")
        return line.select(F.col("l_discount").cast("double").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))

    def chemical(self) -> DataFrame:
        """Drug features; every 17th drug has none."""
        s = self.raw("supplier")
        v = F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double"))
        return s.select(F.col("s_suppkey").alias("term"), F.when(F.col("s_suppkey") % 17 == 0, F.array().cast("array<double>")).otherwise(v).alias("v"))

    def biological(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        hot = F.array(*[(F.col("n_regionkey") == k).cast("double") for k in range(5)])
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("term"), hot.alias("v"))


SQL = {
    "terms": "SELECT vec_id AS term, embedding::DOUBLE[] AS v FROM embeddings",
    "pool": "SELECT vec_id AS term, vec_id AS idx FROM embeddings",
    "pairs": "SELECT l_partkey AS target, l_suppkey AS context FROM lineitem",
    "reports": "SELECT l_suppkey AS drug, l_partkey AS reaction FROM lineitem",
    "freq": "SELECT l_partkey AS term, count(*)::DOUBLE AS freq FROM lineitem GROUP BY 1",
    "paths3": """SELECT p_partkey AS term, p_brand AS hlt, p_type AS hlgt, (p_size // 10)::VARCHAR AS soc, 'PRIMARY' AS rnk
        FROM part
        UNION ALL SELECT a.p_partkey, b.p_brand, b.p_type, (b.p_size // 10)::VARCHAR, 'SECONDARY'
        FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part)""",
    "paths5": """SELECT vec_id AS term, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 40)::VARCHAR END AS smq5,
        CASE WHEN vec_id % 3 = 0 THEN (vec_id % 20)::VARCHAR END AS smq4,
        CASE WHEN vec_id % 5 = 0 THEN (vec_id % 10)::VARCHAR END AS smq3,
        CASE WHEN vec_id % 7 = 0 THEN (vec_id % 5)::VARCHAR END AS smq2,
        CASE WHEN vec_id % 2 = 1 THEN (vec_id % 3)::VARCHAR END AS smq1 FROM embeddings""",
    "valid": "SELECT DISTINCT l_suppkey AS drug, l_partkey AS reaction FROM lineitem",
    "labelled": """SELECT l_suppkey AS drug, l_partkey AS reaction,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS label FROM lineitem GROUP BY 1, 2""",
    "reference": """SELECT l_suppkey AS drug, l_partkey AS reaction, (l_orderkey % 2)::INT AS ord,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY 1, 2, 3""",
    "scores": "SELECT l_discount::DOUBLE AS score, (l_returnflag = 'R')::INT AS label FROM lineitem",
    "chemical": """SELECT s_suppkey AS term, CASE WHEN s_suppkey % 17 = 0 THEN []::DOUBLE[]
        ELSE [s_acctbal::DOUBLE, s_nationkey::DOUBLE] END AS v FROM supplier""",
    "biological": """SELECT s_suppkey AS term, [(n_regionkey = 0)::DOUBLE, (n_regionkey = 1)::DOUBLE, (n_regionkey = 2)::DOUBLE,
        (n_regionkey = 3)::DOUBLE, (n_regionkey = 4)::DOUBLE] AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}


def with_tables(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A query over the named logical tables and some more common table expressions."""
    parts = {n: SQL[n] for n in names} | (extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" + body
