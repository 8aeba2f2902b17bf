"""Queries that train, score, project and cluster."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import clustering, frequencies, hdbscan, learning, neighbour_map, relational, sampling, signal
from vigilark.plans.fixtures import Tables, with_tables
from vigilark.plans.signals import SEED, TEST_FRACTION, _sampled, contexts, corpus, last_label
from vigilark.sources.tables import load_table, save_table, settle, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM, BLOCKS, NEAR, RADIUS = 16, 4, 5, 1.2
#: The whole training of the negative-sampling model, as the reference's template has it.
NSG_DIM, NSG_EPOCHS, NSG_NEGATIVES = 200, 30, 7


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def samples(t: Tables) -> DataFrame:
    return sampling.corpus_with_negatives(corpus(t), contexts(t), NSG_NEGATIVES, SEED)


@query("nsg_vectors")
def _nsg(t: Tables) -> DataFrame:
    """The terms' own vectors, without the row that all share."""
    return learning.train_nsg(samples(t), NSG_DIM, NSG_EPOCHS, blocks=BLOCKS, seed=SEED).filter("side <> 'shared'")


@query("ntx_vectors")
def _ntx(t: Tables) -> DataFrame:
    return learning.train_ntx(frequencies.pair_counts(t.pairs()), DIM, 2, 64, hidden=16, seed=SEED, blocks=BLOCKS)


def pair_features(t: Tables, rows: DataFrame) -> DataFrame:
    (chemical,) = relational.non_empty(t.chemical())
    found = relational.gather(rows, reaction_embedding=t.terms(), drug_chemical=chemical, drug_biological=t.biological())
    return relational.concatenated(found, ["reaction_embedding", "drug_chemical", "drug_biological"]).select("drug", "reaction", "label", "features")


WIDTH = 64 + 2 + 5


def regime(t: Tables, negatives: bool, reference: bool) -> tuple[DataFrame, DataFrame]:
    """Training and test pairs (`drug`, `reaction`, `label`).

    With `negatives` the negatives are drawn, else they are the labelled ones. The test set is the
    reference set, whose positives training then does without, or the test split.
    """
    if negatives:
        train, test = _sampled(t, "drug"), None if reference else _sampled(t, "drug", test=True)
    else:
        rows = t.labelled().withColumn("label", relational.recode_label(F.col("label"))).select("drug", "reaction", "label")
        split = sampling.split(rows, TEST_FRACTION, ["drug", "reaction"], SEED)
        train, test = (split.filter(c).drop("is_test") for c in ("not is_test", "is_test"))
    if reference:
        test = last_label(t)
        train = relational.without_positives(train, test.filter("label = 1").select("drug", "reaction"))
    return train, test


def trained(t: Tables, negatives: bool, reference: bool):
    """Model, scaler parameters and test pairs of one regime."""
    train, test = (pair_features(t, relational.complete_rows(rows)) for rows in regime(t, negatives, reference))
    train = settle(train, columnar=True)
    scaler = settle(relational.scaler(train, "features"))
    model = learning.train_classifier(relational.scale(train, "features", scaler), WIDTH, rounds=20, seed=SEED)
    return model, scaler, test


def _regime_scores(negatives: bool, reference: bool):
    def run(t: Tables) -> DataFrame:
        model, scaler, test = trained(t, negatives, reference)
        return learning.classify(model, relational.scale(test, "features", scaler)).select("drug", "reaction", "label", "score")

    return run


for _name, _negatives, _reference in (
    ("classifier_scores", True, True), ("classifier_sampled_split", True, False), ("classifier_plain_reference", False, True), ("classifier_plain_split", False, False),
):
    query(_name)(_regime_scores(_negatives, _reference))


@query("classifier_stored")
def _stored(t: Tables) -> DataFrame:
    """A model and a scaler written to the shared folder, read again, and applied to pairs without labels."""
    model, scaler, test = trained(t, True, True)
    folder = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    learning.save_classifier(model, f"{folder}/model")
    save_table(scaler, f"{folder}/scaler")
    rows = relational.scale(test.drop("label"), "features", load_table(t.spark, f"{folder}/scaler"))
    return learning.classify(learning.load_classifier(f"{folder}/model"), rows).select("drug", "reaction", "score")


@query("classifier_indexed")
def _indexed(t: Tables) -> DataFrame:
    """Reactions by index instead of vectors, scored on the test split."""
    (chemical,) = relational.non_empty(t.chemical())

    def ready(rows: DataFrame) -> DataFrame:
        found = relational.gather(rows, drug_chemical=chemical, drug_biological=t.biological())
        return relational.concatenated(found, ["drug_chemical", "drug_biological"]).select("drug", "reaction", "label", "features")

    train, test = (settle(ready(rows), columnar=True) for rows in regime(t, True, False))
    scaler = settle(relational.scaler(train, "features"))
    model = learning.train_indexed_classifier(relational.scale(train, "features", scaler), rounds=20, seed=SEED)
    return learning.classify_indexed(model, relational.scale(test, "features", scaler))


@query("classifier_progress")
def _progress(t: Tables) -> DataFrame:
    """`rounds`, `auroc`, `auprc`, `accuracy` on the test split while training goes on."""
    train, test = (pair_features(t, rows) for rows in regime(t, True, False))
    train = settle(train, columnar=True)
    scaler = settle(relational.scaler(train, "features"))
    train, test = (settle(relational.scale(rows, "features", scaler), columnar=True) for rows in (train, test))
    out = None
    for done, model in learning.classifier_rounds(train, WIDTH, rounds=20, every=10, seed=SEED):
        scored = settle(learning.classify(model, test).select("score", "label"))
        one = signal.auroc(scored).crossJoin(signal.auprc(scored)).crossJoin(signal.accuracy(scored))  # one row each
        one = one.select(F.lit(done).alias("rounds"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("nsg_losses")
def _losses(t: Tables) -> DataFrame:
    """`epoch`, `loss`: a corpus drawn anew for each epoch and the loss on it after the epoch."""

    def drawn(epoch: int) -> DataFrame:
        kept = sampling.thin(corpus(t), frequencies.keep_probability(t.freq(), t.pairs()), SEED + epoch)
        return sampling.corpus_with_negatives(kept, contexts(t), 3, SEED + epoch)

    rows = [(epoch, loss) for epoch, _, loss in learning.nsg_rounds(drawn, DIM, 2, blocks=2, seed=SEED)]
    return t.spark.createDataFrame(rows, "epoch int, loss double")


_NEAR = f"""SELECT term, neighbour, d, k FROM (SELECT a.term AS term, b.term AS neighbour, list_distance(a.v, b.v) AS d,
    row_number() OVER (PARTITION BY a.term ORDER BY list_distance(a.v, b.v), b.term) AS k
    FROM terms a JOIN terms b ON a.term <> b.term) WHERE k < {NEAR}"""
_CORE = f"SELECT term, d AS core FROM near WHERE k = {NEAR - 1}"


@query("core_distance", with_tables(["terms"], "SELECT term, round(core, 6) AS core FROM core", {"near": _NEAR, "core": _CORE}))
def _core(t: Tables) -> DataFrame:
    return clustering.core_distances(t.terms(), NEAR).select("term", F.round("core", 6).alias("core"))


@query(
    "mutual_reachability",
    with_tables(
        ["terms"],
        """SELECT i, j, round(greatest(d, a.core, b.core), 6) AS dist FROM ends JOIN core a ON a.term = i JOIN core b ON b.term = j""",
        {"near": _NEAR, "core": _CORE, "ends": "SELECT least(term, neighbour) AS i, greatest(term, neighbour) AS j, min(d) AS d FROM near GROUP BY 1, 2"},
    ).replace("near AS (", "near AS MATERIALIZED (").replace("core AS (", "core AS MATERIALIZED ("),
)
def _reach(t: Tables) -> DataFrame:
    return clustering.reachability_edges(t.terms(), NEAR).select("i", "j", F.round("dist", 6).alias("dist"))


_NODES = f"SELECT term, core FROM core WHERE core <= {RADIUS}"
_LINKS = f"""SELECT a.term AS a, b.term AS b FROM nodes a JOIN nodes b ON a.term <> b.term JOIN terms x ON x.term = a.term JOIN terms y ON y.term = b.term
    WHERE list_distance(x.v, y.v) <= {RADIUS}"""
_REACH = "SELECT term, term AS low FROM nodes UNION SELECT links.b, low FROM reach JOIN links ON links.a = reach.term WHERE low < links.b"


@query(
    "density_clusters",
    with_tables(
        ["terms"],
        """SELECT term, CASE WHEN count(*) OVER (PARTITION BY coalesce(low, term)) >= 5 THEN coalesce(low, term) ELSE -1 END AS cluster
        FROM terms LEFT JOIN lows USING (term)""",
        {"near": _NEAR, "core": _CORE, "nodes": _NODES, "links": _LINKS, "reach": _REACH, "lows": "SELECT term, min(low) AS low FROM reach GROUP BY 1"},
    ).replace("WITH", "WITH RECURSIVE", 1).replace("near AS (", "near AS MATERIALIZED (").replace("links AS (", "links AS MATERIALIZED ("),
)
def _clusters(t: Tables) -> DataFrame:
    return clustering.density_clusters(t.terms(), NEAR, 5, RADIUS)


#: Prim's steps: of the nodes outside the tree the nearest joins it, and the others' distances to the tree follow.
_PRIM = """SELECT 0 AS step, term, false AS inside, CASE WHEN term = (SELECT min(term) FROM points) THEN 0e0 ELSE 'infinity'::DOUBLE END AS best FROM points
    UNION ALL SELECT step + 1, s.term, s.inside OR s.term = pick,
        CASE WHEN s.inside OR s.term = pick THEN best ELSE least(best, greatest(list_distance(a.v, b.v), a.core, b.core)) END
    FROM (SELECT *, first_value(term) OVER (ORDER BY inside, best, term) AS pick, bool_or(NOT inside) OVER () AS more FROM prim) s
    JOIN points a ON a.term = s.term JOIN points b ON b.term = pick WHERE more"""
_POINTS = "SELECT term, n.v, core FROM (SELECT min(term) AS term, v FROM terms GROUP BY v) n JOIN core USING (term)"


@query(
    "reachability_tree",
    with_tables(
        ["terms"],
        "SELECT round(best, 6) + 0e0 AS w, count(*) AS n FROM prim WHERE step = (SELECT max(step) FROM prim) AND term <> (SELECT min(term) FROM points) GROUP BY 1",
        {"near": _NEAR, "core": _CORE, "points": _POINTS, "prim": _PRIM},
    ).replace("WITH", "WITH RECURSIVE", 1).replace("near AS (", "near AS MATERIALIZED (").replace("points AS (", "points AS MATERIALIZED ("),
)
def _tree(t: Tables) -> DataFrame:
    """Edge weights of the least spanning tree of mutual reachability, with their numbers."""
    tree = hdbscan.reachability_tree(t.terms(), NEAR)
    return tree.groupBy((F.round("w", 6) + 0.0).alias("w")).agg(F.count("*").alias("n"))


@query("stable_clusters")
def _stable(t: Tables) -> DataFrame:
    """Clusters of at least ten terms, chosen by stability."""
    return hdbscan.stable_clusters(t.terms(), 10, NEAR)


PERPLEXITY, MAP_ROUNDS = 30, 3000


@query(
    "tsne_affinities",
    with_tables(["terms"], f"SELECT term, least(3 * {PERPLEXITY}, (SELECT count(*) - 1 FROM terms)) AS n, 1e0 AS total, round(ln({PERPLEXITY}), 6) AS entropy FROM terms"),
)
def _affinities(t: Tables) -> DataFrame:
    """Number of neighbours, sum of weights and entropy of every term's row."""
    rows = neighbour_map.affinities(t.terms(), PERPLEXITY)
    p = F.col("p")
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("p"), 9).alias("total"), F.round(-F.sum(F.when(p > 0, p * F.log("p")).otherwise(0.0)), 6).alias("entropy"))


@query("tsne_coords")
def _coords(t: Tables) -> DataFrame:
    """Places on the map after all its rounds."""
    *_, (_, places, _) = neighbour_map.map_rounds(t.terms(), PERPLEXITY, MAP_ROUNDS, MAP_ROUNDS)
    return places


@query("pca_projection")
def _pca(t: Tables) -> DataFrame:
    return clustering.projection(t.terms(), 2)
