"""Steps that hold, write or work out no more than they need."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from corpuslens import session
from corpuslens.operators import gmm as GM
from corpuslens.operators import sweeps as SW
from corpuslens.plans.corpus_flow import CorpusFlow


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_stage_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(session.DROP_SHUFFLES)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert {r["k"]: r["n"] for r in session.stage(df).collect()} == {k: 143 - (k == 6) for k in range(7)}
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(session.DROP_SHUFFLES) == setting


def test_the_flow_writes_only_terms_that_the_frequency_filter_keeps(spark):
    docs = spark.createDataFrame([(i, "s", "wolf bear " * 4 + f"only{i}") for i in range(3)], "doc_id long, source string, text string")
    flow = CorpusFlow.of_corpus(docs, ["source", "text"])
    kept = {r["stem"] for r in flow.freq_flagged.where("kept").collect()}
    assert {r["stem"] for r in flow.freq_kept.collect()} == kept
    assert not [x for x in flow.freq_flagged.inputFiles() if x in flow.freq_kept.inputFiles()]
    assert flow.freq_flagged.count() == flow.vocab.count()


def test_scores_work_out_no_sums_of_a_round(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, features array<double>")
    mixtures = SW.mixtures_from_centres(points, {k: x[:k] for k in (2, 5)})
    monkeypatch.setattr(SW, "_em_batch", None)
    for k, (aic, bic) in SW.scores(points, mixtures).items():
        ll, q = GM._lse(GM.log_prob(x, mixtures[k])).sum(), mixtures[k].n_parameters()
        assert math.isclose(aic, 2 * q - 2 * ll, rel_tol=1e-9) and math.isclose(bic, q * math.log(60) - 2 * ll, rel_tol=1e-9)
