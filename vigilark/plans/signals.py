"""Queries on labelled pairs: lookups, signals, evaluation and negative samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import frequencies, relational, sampling, signal
from vigilark.plans.fixtures import Tables, with_tables
from vigilark.plans.groups import uniform_sql
from vigilark.plans.similarity import rounded
from vigilark.sources.files import last_wins
from vigilark.sources.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, ATTEMPTS, NEGATIVES, TEST_FRACTION = 1, 12, 3, 0.2


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- lookups, recodings and features -----------------------------------------------------------
LAST = "SELECT drug, reaction, arg_max(label, ord) AS label FROM reference GROUP BY 1, 2"
MAIN = """SELECT a.drug, a.reaction, a::DOUBLE AS freq, CASE WHEN nd > a AND nr > a AND n - nd - nr + a > 0 THEN
    exp(ln(a * (n - nd - nr + a) / ((nd - a) * (nr - a))) - 1.96e0 * sqrt(1e0 / a + 1e0 / (nd - a) + 1e0 / (nr - a) + 1e0 / (n - nd - nr + a)))
    ELSE -1e0 END AS ror
    FROM (SELECT drug, reaction, count(*)::DOUBLE AS a FROM reports GROUP BY 1, 2) a
    JOIN (SELECT drug, count(*)::DOUBLE AS nd FROM reports GROUP BY 1) USING (drug)
    JOIN (SELECT reaction, count(*)::DOUBLE AS nr FROM reports GROUP BY 1) USING (reaction), (SELECT count(*)::DOUBLE AS n FROM reports)"""
NORMED = """SELECT *, CASE WHEN freq < 3 THEN 0e0 ELSE coalesce((ror - min(ror) OVER ()) / nullif(max(ror) OVER () - min(ror) OVER (), 0), 0e0) END AS ror_norm FROM main"""
RECODED = "SELECT drug, reaction, CASE WHEN label = -1 THEN 0 ELSE label END AS label FROM labelled"
PARTIAL = """SELECT l.drug, l.reaction, l.label, coalesce(freq, 0e0) AS freq, coalesce(ror, 0e0) AS ror, coalesce(ror_norm, 0e0) AS ror_norm,
    CASE WHEN freq IS NULL THEN 0 ELSE 1 END AS found
    FROM (SELECT drug, reaction, label FROM last UNION ALL SELECT drug, reaction + 1000000, label FROM last WHERE reaction % 3 = 0) l
    LEFT JOIN normed USING (drug, reaction)"""
SIGNAL_CTES = {"main": MAIN, "normed": NORMED, "last": LAST, "partial": PARTIAL}


def last_label(t: Tables) -> DataFrame:
    return last_wins(t.reference(), ["drug", "reaction"], "ord").drop("ord")


def main_table(t: Tables) -> DataFrame:
    return relational.scale_signal(signal.reporting_odds(t.reports()))


def partial_rows(t: Tables) -> DataFrame:
    """The reference set, and for a third of its pairs one that the main table does not know."""
    last = last_label(t)
    unknown = last.filter("reaction % 3 = 0").withColumn("reaction", F.col("reaction") + 1000000)
    return relational.partial_table(last.unionByName(unknown), main_table(t))


@query("ref_last_label", with_tables(["reference"], LAST))
def _last(t: Tables) -> DataFrame:
    return last_label(t)


@query(
    "frequency_lookup",
    with_tables(["pairs", "freq"], "SELECT target, context, freq FROM (SELECT DISTINCT target + 100 AS target, context FROM pairs) LEFT JOIN freq ON term = target"),
)
def _lookup(t: Tables) -> DataFrame:
    pairs = t.pairs().select((F.col("target") + 100).alias("target"), "context").distinct()
    return relational.lookup(pairs, t.freq(), "target")


@query("label_recode", with_tables(["labelled"], RECODED))
def _recode(t: Tables) -> DataFrame:
    return t.labelled().withColumn("label", relational.recode_label(F.col("label")))


@query(
    "feature_semi",
    with_tables(
        ["reports", "chemical", "biological", "terms"],
        """SELECT drug, reaction FROM valid WHERE drug IN (SELECT term FROM chemical WHERE len(v) > 0)
        AND drug IN (SELECT term FROM biological) AND reaction IN (SELECT term FROM terms)""",
        {"valid": "SELECT DISTINCT drug, reaction FROM reports"},
    ),
)
def _semi(t: Tables) -> DataFrame:
    chemical, biological = relational.non_empty(t.chemical(), t.biological())
    return relational.with_features(t.valid(), [chemical, biological], [t.terms()])


FEATURES_SQL = """SELECT drug, reaction, round(list_sum(list_concat(e.v, c.v, b.v)), 6) + 0e0 AS total, len(list_concat(e.v, c.v, b.v))::BIGINT AS width
    FROM (SELECT DISTINCT drug, reaction FROM reports) JOIN terms e ON e.term = reaction
    JOIN (SELECT * FROM chemical WHERE len(v) > 0) c ON c.term = drug JOIN biological b ON b.term = drug"""


@query("feature_concat", with_tables(["reports", "chemical", "biological", "terms"], FEATURES_SQL))
def _features(t: Tables) -> DataFrame:
    (chemical,) = relational.non_empty(t.chemical())
    rows = relational.gather(t.valid(), reaction_embedding=t.terms(), drug_chemical=chemical, drug_biological=t.biological())
    rows = relational.concatenated(rows, ["reaction_embedding", "drug_chemical", "drug_biological"])
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.select("drug", "reaction", (F.round(total, 6) + F.lit(0.0)).alias("total"), F.size("features").cast("bigint").alias("width"))


@query(
    "ref_anti",
    with_tables(
        ["labelled", "reference"],
        "SELECT drug, reaction, label FROM recoded r WHERE NOT (label = 1 AND (drug, reaction) IN (SELECT drug, reaction FROM last WHERE label = 1))",
        {"recoded": RECODED, "last": LAST.replace("GROUP BY", "WHERE reaction % 2 = 0 GROUP BY")},
    ),
)
def _anti(t: Tables) -> DataFrame:
    rows = t.labelled().withColumn("label", relational.recode_label(F.col("label")))
    return relational.without_positives(rows.select("drug", "reaction", "label"), last_label(t).filter("reaction % 2 = 0 and label = 1"))


@query(
    "frequent_terms",
    with_tables(["terms", "freq"], "SELECT term FROM terms WHERE term IN (SELECT term FROM freq WHERE freq >= 30)"),
)
def _frequent(t: Tables) -> DataFrame:
    return relational.frequent(t.terms(), t.freq(), 30).select("term")


@query("listed_terms", with_tables(["terms"], "SELECT term FROM terms WHERE upper(term::VARCHAR) IN (SELECT upper((s_suppkey * 3)::VARCHAR) FROM supplier)"))
def _listed(t: Tables) -> DataFrame:
    names = t.raw("supplier").select((F.col("s_suppkey") * 3).cast("string").alias("name"))
    return relational.in_list(t.terms(), names).select("term")


@query(
    "table_counts",
    with_tables(
        ["labelled"],
        """SELECT count(*) AS n_rows, count(DISTINCT drug) AS n_drugs, count(DISTINCT reaction) AS n_reactions,
        count(DISTINCT (drug, reaction)) AS n_pairs, count(*) FILTER (WHERE label = 1) AS n_positive FROM labelled""",
    ),
)
def _counts(t: Tables) -> DataFrame:
    return relational.table_counts(t.labelled())


_SPARSE = "SELECT drug, reaction, CASE WHEN drug % 7 <> 0 THEN label END AS label, CASE WHEN reaction % 5 <> 0 THEN freq END AS freq FROM labelled LEFT JOIN freq ON term = reaction"
_COUNTED = "count(*) AS n_rows, count(DISTINCT drug) AS n_drugs, count(DISTINCT reaction) AS n_reactions, count(DISTINCT (drug, reaction)) AS n_pairs, count(*) FILTER (WHERE label = 1) AS n_positive"


@query(
    "complete_counts",
    with_tables(
        ["labelled", "freq"],
        f"SELECT 'all' AS stage, {_COUNTED} FROM sparse UNION ALL SELECT 'complete', {_COUNTED} FROM sparse WHERE label IS NOT NULL AND freq IS NOT NULL",
        {"sparse": _SPARSE},
    ),
)
def _complete(t: Tables) -> DataFrame:
    rows = relational.lookup(t.labelled(), t.freq(), "reaction")
    rows = rows.withColumn("label", F.when(F.col("drug") % 7 != 0, F.col("label"))).withColumn("freq", F.when(F.col("reaction") % 5 != 0, F.col("freq")))
    return relational.counts_before_and_after(rows)


@query(
    "scaler_table",
    with_tables(
        ["terms"],
        """SELECT (d - 1)::INT AS dim, round(avg(e), 6) + 0e0 AS mean, round(stddev_pop(e), 6) AS spread FROM
        (SELECT unnest(v) AS e, generate_subscripts(v, 1) AS d FROM terms WHERE term % 5 <> 0) GROUP BY d""",
    ),
)
def _scaler(t: Tables) -> DataFrame:
    return relational.scaler(t.terms().filter("term % 5 <> 0"), "v").select("dim", rounded("mean"), F.round("spread", 6).alias("spread"))


@query(
    "scaler_params",
    with_tables(
        ["terms"],
        """SELECT x.term, round(list_sum(list_transform(list_zip(x.v, p.m, p.s), lambda q: abs((q[1] - q[2]) / CASE WHEN q[3] = 0 THEN 1e0 ELSE q[3] END))), 6) AS size
        FROM terms x, (SELECT list(m ORDER BY d) AS m, list(s ORDER BY d) AS s FROM
        (SELECT d, avg(e) AS m, stddev_pop(e) AS s FROM (SELECT unnest(v) AS e, generate_subscripts(v, 1) AS d FROM terms WHERE term % 5 <> 0) GROUP BY d)) p""",
    ),
)
def _scaled(t: Tables) -> DataFrame:
    rows = relational.standardise(t.terms().filter("term % 5 <> 0"), t.terms(), "v")
    size = F.aggregate(F.transform("v", F.abs), F.lit(0.0), lambda a, x: a + x)
    return rows.select("term", F.round(size, 6).alias("size"))


# -- signals and evaluation ----------------------------------------------------------------------
@query("reporting_odds", with_tables(["reports"], "SELECT drug, reaction, freq, round(ror, 6) AS ror FROM main", {"main": MAIN}))
def _odds(t: Tables) -> DataFrame:
    return signal.reporting_odds(t.reports()).select("drug", "reaction", "freq", F.round("ror", 6).alias("ror"))


@query(
    "ror_normalised",
    with_tables(["reports"], "SELECT drug, reaction, round(ror_norm, 6) + 0e0 AS ror_norm FROM normed", {"main": MAIN, "normed": NORMED}),
)
def _normed(t: Tables) -> DataFrame:
    return main_table(t).select("drug", "reaction", rounded("ror_norm"))


@query(
    "ror_partial",
    with_tables(["reports", "reference"], "SELECT drug, reaction, label, freq, round(ror_norm, 6) + 0e0 AS ror_norm, found FROM partial", SIGNAL_CTES),
)
def _partial(t: Tables) -> DataFrame:
    return partial_rows(t).select("drug", "reaction", "label", "freq", rounded("ror_norm"), "found")


HIT = "(freq >= 3 AND ror >= 1)"
CONFUSION = f"""SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), -1), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), -1), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), -1), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), -1), 6) AS specificity FROM
    (SELECT count(*) FILTER (WHERE {HIT} AND label = 1) AS tp, count(*) FILTER (WHERE {HIT} AND label = 0) AS fp,
    count(*) FILTER (WHERE NOT {HIT} AND label = 1) AS fn, count(*) FILTER (WHERE NOT {HIT} AND label = 0) AS tn FROM partial)"""


@query("ror_confusion", with_tables(["reports", "reference"], CONFUSION, SIGNAL_CTES))
def _confusion(t: Tables) -> DataFrame:
    rows = signal.signal_performance(partial_rows(t))
    return rows.select("tp", "fp", "fn", "tn", *[rounded(c) for c in ("accuracy", "precision", "recall", "specificity")])


@query("ror_coverage", with_tables(["reports", "reference"], "SELECT round(avg(found), 6) AS coverage FROM partial", SIGNAL_CTES))
def _coverage(t: Tables) -> DataFrame:
    return signal.coverage(partial_rows(t)).select(rounded("coverage"))


CURVE = """SELECT score, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM
    (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM scores GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""
AUROC = "SELECT round(sum(n * (cp - p / 2)) / any_value(pp * nn), 6) AS auroc FROM curve"
AUPRC = """SELECT round(sum((cp - p) * 0 + (cp / pp - lag_r) * (cp / (cp + cn) + lag_p) / 2), 6) AS auprc FROM
    (SELECT *, lag(cp / pp, 1, 0e0) OVER (ORDER BY score DESC) AS lag_r, lag(cp / (cp + cn), 1, 1e0) OVER (ORDER BY score DESC) AS lag_p FROM curve)"""
ROR_SCORES = {"main": MAIN, "normed": NORMED, "last": LAST, "partial": PARTIAL, "scores": "SELECT ror_norm AS score, label FROM partial"}


@query("ror_auroc", with_tables(["reports", "reference"], AUROC, ROR_SCORES | {"curve": CURVE}))
def _ror_auroc(t: Tables) -> DataFrame:
    return signal.auroc(partial_rows(t).select(F.col("ror_norm").alias("score"), "label")).select(rounded("auroc"))


@query("ror_auprc", with_tables(["reports", "reference"], AUPRC, ROR_SCORES | {"curve": CURVE}))
def _ror_auprc(t: Tables) -> DataFrame:
    return signal.auprc(partial_rows(t).select(F.col("ror_norm").alias("score"), "label")).select(rounded("auprc"))


@query("score_auroc", with_tables(["scores"], AUROC, {"curve": CURVE}))
def _auroc(t: Tables) -> DataFrame:
    return signal.auroc(t.scores()).select(rounded("auroc"))


@query("score_auprc", with_tables(["scores"], AUPRC, {"curve": CURVE}))
def _auprc(t: Tables) -> DataFrame:
    return signal.auprc(t.scores()).select(rounded("auprc"))


@query("score_accuracy", with_tables(["scores"], "SELECT round(avg(((score * 10 > 0.5e0)::INT = label)::INT), 6) AS accuracy FROM scores"))
def _accuracy(t: Tables) -> DataFrame:
    return signal.accuracy(t.scores().withColumn("score", F.col("score") * 10)).select(rounded("accuracy"))


# -- samples -------------------------------------------------------------------------------------
IS_TEST = uniform_sql("drug", "reaction", "'split'", f"'{SEED}'") + f" < {TEST_FRACTION}e0"


def positives(t: Tables) -> DataFrame:
    rows = t.labelled().filter("label = 1").select("drug", "reaction")
    return sampling.split(rows, TEST_FRACTION, ["drug", "reaction"], SEED)


@query("train_test_split", with_tables(["labelled"], f"SELECT drug, reaction, {IS_TEST} AS is_test FROM labelled WHERE label = 1"))
def _split(t: Tables) -> DataFrame:
    return positives(t)


def corpus(t: Tables) -> DataFrame:
    line = t.raw("lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("context")
    )


CORPUS = "SELECT concat_ws('-', l_orderkey, l_linenumber) AS row, l_partkey AS target, l_suppkey AS context FROM lineitem"


@query(
    "corpus_thinned",
    with_tables(
        ["freq"],
        f"SELECT row, target, context FROM corpus JOIN keep ON term = target WHERE {uniform_sql('row', repr('keep'), repr(str(SEED)))} < p_keep",
        {"corpus": CORPUS, "keep": "SELECT term, (sqrt(freq / th) + 1) * th / freq AS p_keep FROM freq, (SELECT count(*) * 1e-5 AS th FROM lineitem)"},
    ),
)
def _thin(t: Tables) -> DataFrame:
    return sampling.thin(corpus(t), frequencies.keep_probability(t.freq(), t.pairs()), SEED).select("row", "target", "context")


def contexts(t: Tables) -> DataFrame:
    return frequencies.smoothed_unigram(t.pairs().groupBy(F.col("context").alias("term")).agg(F.count("*").cast("double").alias("freq")))


def spans_sql(freq: str) -> str:
    """Terms laid end to end by slice and term, of a table `term`, `freq`."""
    return f"""SELECT term, sum(p) OVER w - p AS lo, sum(p) OVER w AS hi FROM (SELECT term, pow(freq, 0.75e0) / sum(pow(freq, 0.75e0)) OVER () AS p,
        substr(md5(term::VARCHAR), 1, 3) AS slice FROM {freq}) WINDOW w AS (ORDER BY slice, term ROWS UNBOUNDED PRECEDING)"""


@query(
    "corpus_with_negatives",
    with_tables(
        [],
        f"""SELECT row, target, context, 1 AS label FROM own UNION ALL
        SELECT t.row, t.target, s.term, 0 FROM (SELECT *, CASE WHEN v >= lo THEN v + hi - lo ELSE v END AS u FROM tries) t ASOF JOIN spans s ON t.u >= s.lo""",
        {
            "corpus": CORPUS,
            "freq": "SELECT context AS term, count(*)::DOUBLE AS freq FROM corpus GROUP BY 1",
            "spans": spans_sql("freq"),
            "own": "SELECT corpus.*, lo, hi FROM corpus JOIN spans ON term = context",
            "tries": f"SELECT own.*, {uniform_sql('row', 'attempt', repr(str(SEED)))} * (1 - (hi - lo)) AS v FROM own, (SELECT unnest(range(1, {NEGATIVES + 1})) AS attempt)",
        },
    ),
)
def _negatives(t: Tables) -> DataFrame:
    return sampling.corpus_with_negatives(corpus(t), contexts(t), NEGATIVES, SEED)


BATCH, EPOCH = 64, 1
# the targets of a batch in turn take the first of their contexts, in the order of weighted keys, that none before took
_BATCHES = {
    "counts": "SELECT target, context, count(*) AS n FROM pairs GROUP BY 1, 2",
    "dealt": f"""SELECT target, (row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', '{EPOCH}', target))) - 1) // {BATCH} AS batch
        FROM (SELECT DISTINCT target FROM counts)""",
    "keyed": f"SELECT batch, target, context, ln(greatest({uniform_sql('target', 'context', repr(str(EPOCH)), repr(str(SEED)))}, 1e-12)) / pow(n, 0.75e0) AS w FROM counts JOIN dealt USING (target)",
    "choices": "SELECT batch, target, list(context ORDER BY w DESC, context) AS cs, row_number() OVER (PARTITION BY batch ORDER BY target) AS k FROM keyed GROUP BY 1, 2",
    "walk": """SELECT batch, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS target, NULL::BIGINT AS context FROM (SELECT DISTINCT batch FROM dealt)
        UNION ALL SELECT batch, k, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, target, c FROM
        (SELECT l.batch, l.k, w.taken, l.target, list_filter(l.cs, lambda x: NOT list_contains(w.taken, x))[1] AS c
        FROM walk w JOIN choices l ON l.batch = w.batch AND l.k = w.k + 1)""",
}


@query("contrastive_batches", with_tables(["pairs"], "SELECT batch, target, context FROM walk WHERE context IS NOT NULL", _BATCHES).replace("WITH", "WITH RECURSIVE", 1))
def _batches(t: Tables) -> DataFrame:
    counts = frequencies.pair_counts(t.pairs())
    return sampling.contrastive_batches(counts, BATCH, EPOCH, seed=SEED)


def _sampled(t: Tables, kind: str, test: bool = False) -> DataFrame:
    """Positives and negatives of the training split, whose negatives are no training positives, or
    of the test split, whose negatives are no positives at all and are drawn as all positives are."""
    every = positives(t)
    rows = settle(every.filter("is_test" if test else "not is_test").select("drug", "reaction"))
    known, source = (every, every) if test else (rows, rows)
    if kind == "random":
        drawn = sampling.negatives_at_random(rows, known, True, ATTEMPTS, SEED, source)
    else:
        other = "reaction" if kind == "drug" else "drug"
        drawn = sampling.negatives_by_key(rows, kind, other, known, True, ATTEMPTS, SEED, source)
    return sampling.balanced(rows, drawn)


_PARTS = {
    "split": f"SELECT drug, reaction, {IS_TEST} AS is_test FROM labelled WHERE label = 1",
    "train": "SELECT drug, reaction FROM split WHERE NOT is_test",
    "test": "SELECT drug, reaction FROM split WHERE is_test",
}
_MOST = ATTEMPTS * (1 + sampling.MORE_ATTEMPTS)


def _draw_sql(rows: str, spans: str, side: str, first: int, last: int) -> str:
    u = uniform_sql("drug", "reaction", "attempt", f"'{side}'", f"'{SEED}'")
    return f"""SELECT p.drug, p.reaction, attempt, s.term FROM (SELECT drug, reaction, attempt, {u} AS u FROM {rows}, (SELECT unnest(range({first}, {last + 1})) AS attempt)) p
        ASOF JOIN {spans} s ON p.u >= s.lo"""


def negatives_sql(key: str, test: bool) -> tuple[dict[str, str], str]:
    """Common tables and the rows of a sample. After the second lot of attempts none is left at the sizes compared."""
    own, known = ("test", "split") if test else ("train", "train")
    other = {"drug": "reaction", "reaction": "drug"}.get(key)
    ctes = dict(_PARTS)
    for side in [other] if other else ["drug", "reaction"]:
        ctes[f"freq_{side}"] = f"SELECT {side} AS term, count(*)::DOUBLE AS freq FROM {known} GROUP BY 1"
        ctes[f"spans_{side}"] = spans_sql(f"freq_{side}")

    def drawn(rows: str, first: int, last: int) -> str:
        if other:
            pair = {key: f"q.{key}", other: "q.term"}
            inner = _draw_sql(rows, f"spans_{other}", key, first, last)
            return f"SELECT q.drug AS pd, q.reaction AS pr, attempt, {pair['drug']} AS drug, {pair['reaction']} AS reaction FROM ({inner}) q"
        a, b = (_draw_sql(rows, f"spans_{s}", s, first, last) for s in ("drug", "reaction"))
        return f"""SELECT a.drug AS pd, a.reaction AS pr, a.attempt, a.term AS drug, b.term AS reaction FROM ({a}) a
            JOIN ({b}) b ON a.drug = b.drug AND a.reaction = b.reaction AND a.attempt = b.attempt"""

    best = f"SELECT pd, pr, arg_min(drug, attempt) AS drug, arg_min(reaction, attempt) AS reaction FROM %s ANTI JOIN {known} USING (drug, reaction) GROUP BY 1, 2"
    ctes["tries"] = drawn(own, 1, ATTEMPTS)
    ctes["found"] = best % "tries"
    ctes["left_over"] = f"SELECT drug, reaction FROM {own} WHERE (drug, reaction) NOT IN (SELECT pd, pr FROM found)"
    ctes["again"] = drawn("left_over", ATTEMPTS + 1, _MOST)
    ctes["more"] = best % "again"
    return ctes, f"SELECT drug, reaction, 1 AS label FROM {own} UNION ALL SELECT drug, reaction, 0 FROM found UNION ALL SELECT drug, reaction, 0 FROM more"


for _kind, _name in (("drug", "neg_by_drug"), ("reaction", "neg_by_reaction"), ("random", "neg_full_random")):
    for _test in (False, True):
        _ctes, _body = negatives_sql(_kind, _test)
        query(_name + ("_test" if _test else ""), with_tables(["labelled"], _body, _ctes))(lambda t, k=_kind, x=_test: _sampled(t, k, x))

_CTES, _ = negatives_sql("drug", False)


@query(
    "false_negative_rate",
    with_tables(
        ["labelled"],
        """SELECT round((SELECT count(*) FROM (SELECT DISTINCT drug, reaction FROM (SELECT drug, reaction FROM found UNION ALL SELECT drug, reaction FROM more))
        SEMI JOIN test USING (drug, reaction))::DOUBLE / (SELECT count(*) FROM test), 9) AS rate""",
        _CTES,
    ),
)
def _rate(t: Tables) -> DataFrame:
    test = positives(t).filter("is_test").withColumn("label", F.lit(1))
    return sampling.false_negative_rate(_sampled(t, "drug").filter("label = 0"), test).select(F.round("rate", 9).alias("rate"))
