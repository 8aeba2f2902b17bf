"""Queries on vectors, hierarchies and frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.functions.vectors import METRICS
from vigilark.operators import frequencies, hierarchy, ranks, similarity
from vigilark.plans.fixtures import LEVELS3, LEVELS5, Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The query term of single-term searches.
QUERY = 0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(c: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


# -- single-term similarities ------------------------------------------------------------------
_ZIP = "list_zip(q.v, t.v)"
SIM_SQL = {
    "cosine": "list_cosine_similarity(q.v, t.v)",
    "euclidean": "-list_distance(q.v, t.v)",
    "dot": "list_inner_product(q.v, t.v)",
    "manhattan": f"-list_sum(list_transform({_ZIP}, lambda p: abs(p[1] - p[2])))",
    "braycurtis": f"-list_sum(list_transform({_ZIP}, lambda p: abs(p[1] - p[2]))) / list_sum(list_transform({_ZIP}, lambda p: abs(p[1] + p[2])))",
    "canberra": f"-list_sum(list_transform({_ZIP}, lambda p: CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0e0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END))",
    "chebyshev": f"-list_max(list_transform({_ZIP}, lambda p: abs(p[1] - p[2])))",
    "correlation": "list_cosine_similarity(list_transform(q.v, lambda x: x - list_avg(q.v)), list_transform(t.v, lambda x: x - list_avg(t.v)))",
    "minkowski": f"-pow(list_sum(list_transform({_ZIP}, lambda p: pow(abs(p[1] - p[2]), 1.3e0))), 1 / 1.3e0)",
    "sqeuclidean": f"-list_sum(list_transform({_ZIP}, lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}
_VARIANCE = {
    "cells": "SELECT term, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM terms",
    "spread": "SELECT list(sqrt(s) ORDER BY dim) AS scale FROM (SELECT dim, var_pop(x) AS s FROM cells GROUP BY dim)",
    "scaled": "SELECT term, list_transform(list_zip(v, scale), lambda p: p[1] / p[2]) AS v FROM terms, spread",
}


def _one_to_all(metric: str):
    def run(t: Tables) -> DataFrame:
        return similarity.similarities_to(t.terms(), QUERY, [metric]).select("term", rounded("sim"))

    return run


for _m in METRICS:
    query(
        f"v_{_m}",
        with_tables(["terms"], f"SELECT t.term, round({SIM_SQL[_m]}, 6) + 0e0 AS sim FROM terms q, terms t WHERE q.term = {QUERY} AND t.term <> {QUERY}"),
    )(_one_to_all(_m))
query(
    "v_seuclidean",
    with_tables(["terms"], f"SELECT t.term, round(-list_distance(q.v, t.v), 6) + 0e0 AS sim FROM scaled q, scaled t WHERE q.term = {QUERY} AND t.term <> {QUERY}", _VARIANCE),
)(_one_to_all("seuclidean"))
# the inverse covariance by Gauss and Jordan: row k is scaled, then taken from all others, the identity alongside
_INVERSE = {
    "cells": "SELECT term, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM terms",
    "spread": "SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS s FROM cells a JOIN cells b USING (term) GROUP BY 1, 2",
    "wide": """SELECT list(line ORDER BY i) AS m FROM (SELECT i, list_concat(list(s ORDER BY j), list_transform(range(1, count(*) + 1),
        lambda x: CASE WHEN x = i THEN 1e0 ELSE 0e0 END)) AS line FROM spread GROUP BY i)""",
    "steps": """SELECT 0 AS k, m FROM wide UNION ALL SELECT k + 1, list_transform(range(1, len(m) + 1), lambda i:
        CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
        ELSE list_transform(list_zip(m[i], m[k + 1]), lambda p: p[1] - p[2] / m[k + 1][k + 1] * m[i][k + 1]) END) FROM steps WHERE k < len(m)""",
    "inverse": "SELECT list_transform(m, lambda line: line[len(m) + 1:]) AS w FROM steps WHERE k = len(m)",
    "apart": f"""SELECT t.term, list_transform(list_zip(q.v, t.v), lambda p: p[1] - p[2]) AS d
        FROM terms q, terms t WHERE q.term = {QUERY} AND t.term <> {QUERY}""",
}
query(
    "v_mahalanobis",
    with_tables(
        ["terms"], "SELECT term, round(-sqrt(list_inner_product(d, list_transform(w, lambda line: list_inner_product(line, d)))), 6) + 0e0 AS sim FROM apart, inverse", _INVERSE
    ).replace("WITH", "WITH RECURSIVE", 1),
)(_one_to_all("mahalanobis"))

_TOP = ["cosine", "euclidean", "dot", "manhattan", "canberra"]


@query(
    "topk_neighbors",
    with_tables(
        ["terms"],
        "SELECT term, metric, round(sim, 6) + 0e0 AS sim, rank FROM (SELECT *, (row_number() OVER (PARTITION BY metric ORDER BY sim DESC NULLS LAST, term))::INT AS rank FROM ("
        + " UNION ALL ".join(f"SELECT t.term, '{m}' AS metric, {SIM_SQL[m]} AS sim FROM terms q, terms t WHERE q.term = {QUERY} AND t.term <> {QUERY}" for m in _TOP)
        + ")) WHERE rank <= 25",
    ),
)
def _topk(t: Tables) -> DataFrame:
    return similarity.top_neighbours(similarity.similarities_to(t.terms(), QUERY, _TOP)).select("term", "metric", rounded("sim"), "rank")


@query(
    "all_topk_cosine",
    with_tables(
        ["terms"],
        """SELECT term, rank, neighbour, round(sim, 6) AS sim FROM (SELECT a.term, b.term AS neighbour,
        list_cosine_similarity(a.v, b.v) AS sim, (row_number() OVER (PARTITION BY a.term ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.term))::INT AS rank
        FROM terms a, terms b WHERE a.term <> b.term) WHERE rank <= 25""",
    ),
)
def _all_topk(t: Tables) -> DataFrame:
    return similarity.all_top_neighbours(t.terms(), "cosine").select("term", "rank", "neighbour", rounded("sim"))


_ALL = {"cosine": "list_cosine_similarity(q.v, t.v)", "euclidean": "-list_distance(q.v, t.v)", "manhattan": SIM_SQL["manhattan"], "braycurtis": SIM_SQL["braycurtis"]}


@query(
    "all_pairs_euclidean",
    with_tables(["terms"], "SELECT q.term AS i, t.term AS j, round(-list_distance(q.v, t.v), 6) + 0e0 AS sim FROM terms q, terms t WHERE q.term < t.term"),
)
def _all_pairs(t: Tables) -> DataFrame:
    return similarity.all_pairs(t.terms(), "euclidean").select("i", "j", rounded("sim"))


@query(
    "pair_matrix_props",
    with_tables(
        ["terms"],
        """SELECT metric, n, round(low, 6) AS min, round(high, 6) AS max, round(mean, 6) AS mean, round((mean - low) / (high - low), 6) AS normed_mean FROM (
        SELECT metric, count(*)::BIGINT AS n, min(sim) AS low, max(sim) AS high, avg(sim) AS mean FROM ("""
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, {e} AS sim FROM terms q, terms t WHERE q.term < t.term" for m, e in _ALL.items())
        + ") GROUP BY metric)",
    ),
)
def _props(t: Tables) -> DataFrame:
    return properties(t, list(_ALL)).select("metric", "n", *[rounded(c) for c in ("min", "max", "mean", "normed_mean")])


def properties(t: Tables, metrics: list[str]) -> DataFrame:
    return similarity.properties_of(t.terms(), metrics)


@query(
    "normalized_terms",
    with_tables(
        ["terms"],
        """SELECT term, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square, round(u[1], 6) + 0e0 AS first FROM (
        SELECT term, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS u FROM (
        SELECT term, list_transform(v, lambda x: x * (1 + term % 5)) AS w FROM terms))""",
    ),
)
def _normalized(t: Tables) -> DataFrame:
    longer = t.terms().withColumn("v", F.transform("v", lambda x: x * (1 + F.col("term") % 5)))
    u = similarity.unit_vectors(longer)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return u.select("term", F.round(square, 6).alias("square"), (F.round(F.col("v")[0], 6) + 0.0).alias("first"))


@query("dense_index", with_tables(["freq"], "SELECT term, freq, row_number() OVER (ORDER BY term) - 1 AS idx FROM freq"))
def _index(t: Tables) -> DataFrame:
    return ranks.dense_index(t.freq(), "term").select("term", "freq", F.col("index").alias("idx"))


# -- frequencies -------------------------------------------------------------------------------
@query("pair_counts", with_tables(["pairs"], "SELECT target, context, count(*)::BIGINT AS n FROM pairs GROUP BY 1, 2"))
def _pair_counts(t: Tables) -> DataFrame:
    return frequencies.pair_counts(t.pairs())


@query(
    "entity_counts",
    with_tables(["reports"], "SELECT 'drug' AS side, drug AS term, count(*)::DOUBLE AS freq FROM reports GROUP BY 2 UNION ALL SELECT 'reaction', reaction, count(*)::DOUBLE FROM reports GROUP BY 2"),
)
def _entities(t: Tables) -> DataFrame:
    sides = [frequencies.entity_counts(t.reports(), c).select(F.lit(c).alias("side"), "term", "freq") for c in ("drug", "reaction")]
    return sides[0].unionByName(sides[1])


@query("unigram_dist", with_tables(["freq"], "SELECT term, round(pow(freq, 0.75e0) / sum(pow(freq, 0.75e0)) OVER (), 12) AS p FROM freq"))
def _unigram(t: Tables) -> DataFrame:
    return frequencies.smoothed_unigram(t.freq()).select("term", F.round("p", 12).alias("p"))


@query(
    "subsample_prob",
    with_tables(["freq"], "SELECT term, round((sqrt(freq / t) + 1) / (freq / t), 9) AS p_keep FROM freq, (SELECT count(*) * 1e-5 AS t FROM lineitem)"),
)
def _subsample(t: Tables) -> DataFrame:
    return frequencies.keep_probability(t.freq(), t.pairs()).select("term", F.round("p_keep", 9).alias("p_keep"))


@query("ic_terms", with_tables(["freq"], "SELECT term, round(-ln(freq / sum(freq) OVER ()) / ln(2e0), 6) AS ic FROM freq"))
def _ic(t: Tables) -> DataFrame:
    return frequencies.content_of_terms(t.freq()).select("term", rounded("ic"))


def _content_ctes(paths: str, levels: list[str]) -> dict[str, str]:
    above = " UNION ALL ".join(f"SELECT term, '{c}' AS level, {c} AS name FROM {paths}" for c in levels)
    return {
        "named": f"SELECT DISTINCT term, level, name FROM ({above}) WHERE name IS NOT NULL",
        "own": f"SELECT * FROM freq WHERE term IN (SELECT term FROM {paths})",
        "sums": "SELECT 'pt' AS level, term::VARCHAR AS name, freq FROM own UNION ALL SELECT level, name, sum(freq) FROM named JOIN own USING (term) GROUP BY 1, 2",
        "content": "SELECT level, name, -ln(freq / sum(freq) OVER ()) / ln(2e0) AS ic FROM sums",
    }


_C3, _C5 = _content_ctes("paths3", LEVELS3), _content_ctes("paths5", LEVELS5)


@query("ic_levels", with_tables(["freq", "paths3"], "SELECT level, name, round(ic, 6) AS ic FROM content", _C3))
def _ic3(t: Tables) -> DataFrame:
    return frequencies.content_of_levels(t.freq(), t.paths3(), LEVELS3).select("level", "name", rounded("ic"))


@query("ic_sparse_levels", with_tables(["freq", "paths5"], "SELECT level, name, round(ic, 6) AS ic FROM content", _C5))
def _ic5(t: Tables) -> DataFrame:
    return frequencies.content_of_levels(t.freq(), t.paths5(), LEVELS5).select("level", "name", rounded("ic"))


# -- hierarchies -------------------------------------------------------------------------------
#: The query term of hierarchy searches; it has frequency, vector and paths in both hierarchies.
H_QUERY = 30


def _first_sql(levels: list[str]) -> str:
    whens = " ".join(f"WHEN q.{c} = t.{c} THEN 1 / {2 * (k + 1)}e0" for k, c in enumerate(levels))
    return f"CASE {whens} ELSE 1 / {2 * (len(levels) + 1)}e0 END"


def _sum_sql(levels: list[str]) -> str:
    parts = " + ".join(f"CASE WHEN q.{c} = t.{c} THEN 1 / {2 * (k + 1)}e0 ELSE 0e0 END" for k, c in enumerate(levels))
    return f"CASE WHEN {parts} > 0 THEN {parts} ELSE 1 / {2 * (len(levels) + 1)}e0 END"


def _h_sql(table: str, score: str, agg: str = "avg", where: str = "") -> str:
    return with_tables([table], f"SELECT t.term AS t, round({agg}({score}), 6) AS sim FROM {table} q, {table} t WHERE q.term = {H_QUERY} AND t.term <> {H_QUERY}{where} GROUP BY 1")


def _pairs(t: Tables, levels: list[str]) -> DataFrame:
    paths = t.paths3() if levels is LEVELS3 else t.paths5()
    return hierarchy.path_pairs(paths, t.spark.createDataFrame([(H_QUERY,)], "term bigint"), levels)


_PRIMARY = " AND q.rnk = 'PRIMARY' AND t.rnk = 'PRIMARY'"
for _name, _levels, _agg, _score, _sql in (
    ("meanminpath", LEVELS3, hierarchy.mean_score, hierarchy.first_match, _h_sql("paths3", _first_sql(LEVELS3))),
    ("meanpath_additive", LEVELS3, hierarchy.mean_score, hierarchy.sum_of_matches, _h_sql("paths3", _sum_sql(LEVELS3))),
    ("primaryminpath", LEVELS3, hierarchy.primary_score, hierarchy.first_match, _h_sql("paths3", _first_sql(LEVELS3), "max", _PRIMARY)),
    ("smqmeanminpath", LEVELS5, hierarchy.mean_score, hierarchy.first_match, _h_sql("paths5", _first_sql(LEVELS5))),
):
    query(f"h_{_name}", _sql)(lambda t, lv=_levels, a=_agg, s=_score: a(_pairs(t, lv), s(lv)).select("t", rounded("sim")))
query("h_meanpath_first", ORACLES["h_meanminpath"])(lambda t: hierarchy.mean_score(_pairs(t, LEVELS3), hierarchy.first_match(LEVELS3)).select("t", rounded("sim")))
query("h_primarypath_additive", _h_sql("paths3", _sum_sql(LEVELS3), "sum", _PRIMARY))(
    lambda t: hierarchy.primary_score(_pairs(t, LEVELS3), hierarchy.sum_of_matches(LEVELS3), summed=True).select("t", rounded("sim"))
)
query("h_primarypath_first", _h_sql("paths3", _first_sql(LEVELS3), "sum", _PRIMARY))(
    lambda t: hierarchy.primary_score(_pairs(t, LEVELS3), hierarchy.first_match(LEVELS3), summed=True).select("t", rounded("sim"))
)


def _shared_sql(table: str, levels: list[str], ctes: dict[str, str], score: str) -> str:
    low = "coalesce(" + ", ".join(f"CASE WHEN q.{c} = t.{c} THEN (SELECT ic FROM content c WHERE c.level = '{c}' AND c.name = q.{c}) END" for c in levels) + ", 0e0)"
    body = f"""SELECT t, round(avg({score}), 6) AS sim FROM (SELECT t.term AS t, {low} AS s,
        (SELECT ic FROM content c WHERE c.level = 'pt' AND c.name = q.term::VARCHAR) AS a,
        (SELECT ic FROM content c WHERE c.level = 'pt' AND c.name = t.term::VARCHAR) AS b
        FROM {table} q, {table} t WHERE q.term = {H_QUERY} AND t.term <> {H_QUERY}) GROUP BY t"""
    return with_tables(["freq", table], body, ctes)


for _name, _f, _sql in (
    ("resnik", hierarchy.resnik, "s"),
    ("jiangconrath", hierarchy.jiang_conrath, "CASE WHEN a + b - 2 * s <> 0 THEN 1 / (a + b - 2 * s) END"),
    ("lin", hierarchy.lin, "CASE WHEN a + b <> 0 THEN 2 * s / (a + b) END"),
):
    for _suffix, _table, _levels, _ctes in (("meddra", "paths3", LEVELS3, _C3), ("smq", "paths5", LEVELS5, _C5)):

        def _run(t: Tables, f=_f, lv=_levels, table=_table) -> DataFrame:
            content = frequencies.content_of_levels(t.freq(), getattr(t, table)(), lv)
            return f(hierarchy.shared_content(_pairs(t, lv), content, lv)).select("t", rounded("sim"))

        query(f"h_{_name}{_suffix}", _shared_sql(_table, _levels, _ctes, _sql))(_run)


# -- hierarchies, all pairs of embedded terms --------------------------------------------------
def path_terms(t: Tables, levels: list[str]) -> DataFrame:
    """Paths of the embedded terms with the content of their names."""
    paths = t.paths3() if levels is LEVELS3 else t.paths5()
    content = frequencies.content_of_levels(t.freq(), paths, levels)
    return hierarchy.term_paths(paths.join(t.terms().select("term"), "term", "left_semi"), levels, content)


PATH_QUERIES = {
    **{m: (LEVELS3, m) for m in ("meanminpath", "meanpath_additive", "primaryminpath", "primarypath", "primarypath_additive")},
    "smqmeanminpath": (LEVELS5, "smqmeanminpath"),
    **{f"{m}{suffix}": (levels, m) for m in ("resnik", "jiangconrath", "lin") for suffix, levels in (("meddra", LEVELS3), ("smq", LEVELS5))},
}


def _content_sql(levels: list[str], tag: str) -> dict[str, str]:
    """Paths of the embedded terms with contents, and the content ctes under names of their own."""
    table = "paths3" if levels is LEVELS3 else "paths5"
    own = {f"{k}_{tag}": q for k, q in _content_ctes(table, levels).items()}
    own = {k: q.replace("FROM named", f"FROM named_{tag}").replace("FROM own", f"FROM own_{tag}").replace("JOIN own", f"JOIN own_{tag}").replace("FROM sums", f"FROM sums_{tag}") for k, q in own.items()}
    joins = " ".join(f"LEFT JOIN content_{tag} c_{c} ON c_{c}.level = '{c}' AND c_{c}.name = p.{c}" for c in levels)
    contents = ", ".join(f"c_{c}.ic AS ic_{c}" for c in levels)
    rank = "p.rnk" if levels is LEVELS3 else "'PRIMARY'"
    own[f"path_{tag}"] = f"""SELECT p.term, {rank} AS rnk, {", ".join("p." + c for c in levels)}, {contents}, c_pt.ic AS own FROM {table} p
        {joins} LEFT JOIN content_{tag} c_pt ON c_pt.level = 'pt' AND c_pt.name = p.term::VARCHAR WHERE p.term IN (SELECT term FROM terms)"""
    return own


def _score_sql(levels: list[str], metric: str) -> tuple[str, str, str]:
    kind, fold = hierarchy.PATH_METRICS[metric]
    shared = "coalesce(" + ", ".join(f"CASE WHEN q.{c} = t.{c} THEN q.ic_{c} END" for c in levels) + ", 0e0)"
    score = {
        "first": _first_sql(levels), "additive": _sum_sql(levels), "resnik": shared,
        "jiang": f"CASE WHEN q.own + t.own - 2 * {shared} <> 0 THEN 1 / (q.own + t.own - 2 * {shared}) END",
        "lin": f"CASE WHEN q.own + t.own <> 0 THEN 2 * {shared} / (q.own + t.own) END",
    }[kind]
    return score, {"mean": "avg", "last": "max", "sum": "sum"}[fold], "" if fold == "mean" else _PRIMARY


def _all_paths_sql(metrics: list[str]) -> str:
    parts = []
    for m in metrics:
        levels, kind = PATH_QUERIES[m]
        score, agg, where = _score_sql(levels, kind)
        table = "path_a" if levels is LEVELS3 else "path_b"
        parts.append(f"SELECT '{m}' AS metric, q.term AS i, t.term AS j, {agg}({score}) AS sim FROM {table} q JOIN {table} t ON q.term < t.term{where} GROUP BY 2, 3")
    return " UNION ALL ".join(parts)


_PATHS = {**_content_sql(LEVELS3, "a"), **_content_sql(LEVELS5, "b")}


@query("h_all_pairs", with_tables(["terms", "freq", "paths3"], "SELECT i, j, round(sim, 6) AS sim FROM every", _content_sql(LEVELS3, "a") | {"every": _all_paths_sql(["linmeddra"])}))
def _h_all(t: Tables) -> DataFrame:
    rows = similarity.all_pairs(path_terms(t, LEVELS3), "lin").filter("sim is not null")
    return rows.select("i", "j", rounded("sim"))


@query(
    "h_pair_props",
    with_tables(
        ["terms", "freq", "paths3", "paths5"],
        """SELECT metric, n, round(low, 6) AS min, round(high, 6) AS max, round(mean, 6) AS mean, round((mean - low) / (high - low), 6) AS normed_mean FROM (
        SELECT metric, count(sim)::BIGINT AS n, min(sim) AS low, max(sim) AS high, avg(sim) AS mean FROM every GROUP BY metric)""",
        _PATHS | {"every": _all_paths_sql(list(PATH_QUERIES))},
    ),
)
def _h_props(t: Tables) -> DataFrame:
    """Properties of all pairs for every hierarchy and content metric."""
    out = None
    for levels in (LEVELS3, LEVELS5):
        names = {m: name for name, (own, m) in PATH_QUERIES.items() if own is levels}
        one = similarity.properties_of(path_terms(t, levels), list(names))
        one = one.withColumn("metric", F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("metric")))
        out = one if out is None else out.unionByName(one)
    return out.select("metric", "n", *[rounded(c) for c in ("min", "max", "mean", "normed_mean")])


def _joined(c: str) -> str:
    return f"coalesce(list_aggregate(list_transform(list_sort(list(DISTINCT {c}::VARCHAR) FILTER (WHERE {c} IS NOT NULL)), lambda x: ' | ' || x), 'string_agg', ''), '') AS {c}"


@query("hier_tier_names", with_tables(["paths3"], "SELECT term, " + ", ".join(map(_joined, LEVELS3)) + " FROM paths3 GROUP BY term"))
def _tiers(t: Tables) -> DataFrame:
    return hierarchy.tier_names(t.paths3(), LEVELS3)


@query("pairs_by_reaction", with_tables(["valid"], "SELECT reaction, " + _joined("drug").replace("AS drug", "AS drugs") + " FROM valid GROUP BY 1"))
def _by_reaction(t: Tables) -> DataFrame:
    return hierarchy.drugs_of_reactions(t.valid())


@query(
    "tiers_by_reaction",
    with_tables(["valid", "paths3"], "SELECT reaction, " + ", ".join(map(_joined, LEVELS3)) + " FROM valid JOIN paths3 ON drug = term GROUP BY 1"),
)
def _tiers_by_reaction(t: Tables) -> DataFrame:
    return hierarchy.tiers_of_reactions(t.valid(), t.paths3(), LEVELS3)
