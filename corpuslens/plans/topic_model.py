"""End-to-end topic model: corpus -> topics -> features -> LSA -> clusters
-> themes -> map.  Each stage is a library operator; results are DataFrames
(written where they are reused)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import features as G
from corpuslens.operators import gmm as GM
from corpuslens.operators import kmeans as KM
from corpuslens.operators import map2d as M2
from corpuslens.operators import svd as SV
from corpuslens.operators import themes as TH
from corpuslens.plans.corpus_flow import CorpusFlow
from corpuslens.session import stage


@dataclass
class ModelParams:
    weighting: str = "tfidf"          # count | tf | tfidf
    norm: str | None = "l2"
    lsa_components: int | None = 135  # None: cluster on the weights directly
    k_means: int | None = None        # None: int(sqrt(N))
    gmm_components: int | None = None
    gmm_covariance: str | None = "diag"   # None: no mixture
    n_words: int = 10
    map_sample: float | None = None
    seed: int = 0


@dataclass
class ModelResult:
    topics: DataFrame
    features: DataFrame
    vectors: DataFrame
    km_labels: DataFrame
    km_themes: DataFrame
    km_map: DataFrame
    gm_labels: DataFrame | None
    gm_themes: DataFrame | None
    gm_map: DataFrame | None
    coords: DataFrame
    labelled: DataFrame               # documents with both labels appended


def _themes_and_map(centres: DataFrame, labels: DataFrame, flow: CorpusFlow, loadings, coords: DataFrame, n_words: int):
    """Themes by centre, and the wide table with document counts and the
    medians of the map."""
    themes = TH.themes_from_centres(centres, flow.topics, loadings, n_words)
    sizes = KM.cluster_sizes(labels, flow.docs, "label", "corpus")
    return themes, TH.cluster_map(labels, coords, TH.themes_wide(themes, n_words, sizes))


def run(flow: CorpusFlow, params: ModelParams | None = None) -> ModelResult:
    """The model over a flow (``CorpusFlow.of_tables`` or ``of_corpus``)."""
    p = params or ModelParams()
    spark = flow.spark
    n, _ = flow.stats
    if p.weighting == "count":
        feats = flow.counts.select("doc_id", "topic_id", F.col("tf").alias("value"))
    elif p.weighting == "tf":
        feats = G.tf_features(flow.counts, p.norm)
    elif p.weighting == "tfidf":
        feats = G.tfidf_features(flow.counts, n, p.norm)
    else:
        raise ValueError("weighting must be count, tf or tfidf")
    feats = stage(feats)
    n_topics = flow.topics.count()

    loadings = None
    if p.lsa_components:
        lsa, model = SV.lsa(feats, n_topics, p.lsa_components, flow.docs)
        vectors, loadings = stage(lsa), model.loadings
    else:
        # the weights themselves, as sparse vectors over the topics
        rows = SV.document_rows(feats, all_docs=flow.docs)
        vectors = stage(rows.select("doc_id", sparse_vector(n_topics)("topics", "values").alias("features")))
    k = p.k_means or max(2, int(math.sqrt(n)))
    km_labels, _ = KM.kmeans_fit(vectors, k, seed=p.seed)
    km_labels = stage(km_labels)
    # themes from the label means in the clustering space (renumbered labels)
    arr = vectors.select("doc_id", vector_to_array("features").alias("features"))
    centres = (KM.group_means(arr.join(km_labels, "doc_id"), "label", "features")
               .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("_c"))
               .select("label", F.col("_c.mean").alias("centre")))
    coords = stage(M2.coordinates_2d(vectors, p.map_sample, p.seed))
    km_themes, km_map = _themes_and_map(centres, km_labels, flow, loadings, coords, p.n_words)
    labelled = (flow.docs.select("doc_id", "corpus", F.array_join("stems", " ").alias("corpus_stemmed"))
                .join(km_labels.withColumnRenamed("label", "km_label"), "doc_id", "left"))

    gm_labels = gm_themes = gm_map = None
    if p.gmm_covariance:
        gp = GM.gmm_fit(arr, p.gmm_components or k, p.gmm_covariance, seed=p.seed)
        gm_labels = stage(GM.gmm_predict(arr, gp))
        gcent = spark.createDataFrame(
            [(i, [float(v) for v in gp.means[i]]) for i in range(gp.k)], "label int, centre array<double>")
        gm_themes, gm_map = _themes_and_map(gcent, gm_labels, flow, loadings, coords, p.n_words)
        labelled = labelled.join(gm_labels.select("doc_id", F.col("label").alias("gm_label")), "doc_id", "left")

    return ModelResult(flow.topics, feats, vectors, km_labels, km_themes, km_map, gm_labels, gm_themes, gm_map, coords, labelled)


def sparse_vector(size: int):
    @F.udf(VectorUDT())
    def of(topics, values):
        return Vectors.sparse(size, list(topics), list(values))
    return of
