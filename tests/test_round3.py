"""Steps that were changed so that they grow no faster than their input."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.plans import queries as Q
from corpuslens.sources import corpus as C


def test_a_folder_of_kv_files_belongs_to_a_task(spark, tmp_path):
    path = str(tmp_path / "kv")
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit("Title: T").alias("value"))
    C.write_one_file_each(rows, path, "k", "value")
    folders = [x for x in os.listdir(path) if x.startswith("task=")]
    assert 1 < len(folders) <= 4 * spark.sparkContext.defaultParallelism
    assert C.read_kv_records(spark, path).count() == 500


def test_one_file_a_key_in_folders_of_tasks(spark, tmp_path):
    rows = [("a", "Title: A"), ("b", "Title: B"), ("b", "DOI: 10.1/b"), (None, "Title: N")]
    path = str(tmp_path / "kv")
    C.write_one_file_each(spark.createDataFrame(rows, "k string, value string"), path, "k", "value")
    names = [x for _, _, files in os.walk(path) for x in files if x.startswith("part-")]
    assert len(names) == 3
    got = {(r["title"], r["doi"]) for r in C.read_kv_records(spark, path).collect()}
    assert got == {("A", None), ("B", "10.1/b"), ("N", None)}


def test_first_place_of_a_word_for_any_id(spark):
    from corpuslens.operators import vocab as V
    rows = [(None, ["n", "a"]), (-(1 << 63), ["a", "low", "low"]), ((1 << 63) - 1, ["high", "low"]), (-1, ["b", "m"]), (-1, ["m"]), (0, ["z", "m"])]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {r["phrase"]: (r["first_doc"], r["first_pos"]) for r in V.word_vocabulary(docs).collect()}
        want = {"n": (None, 0), "a": (None, 1), "low": (-(1 << 63), 1), "high": ((1 << 63) - 1, 0), "b": (-1, 0), "m": (-1, 0), "z": (0, 0)}
        if kind == "string":  # no id first, then by text
            want = {k: (None if d is None else str(d), p) for k, (d, p) in want.items()}
            want["low"] = min((str(-(1 << 63)), 1), (str((1 << 63) - 1), 1))
        assert got == want


def test_word_vocabulary_is_kept_by_hash(spark):
    from corpuslens.operators import vocab as V
    docs = spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>")
    plan = V.word_vocabulary(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_strips_do_not_follow_the_number_of_points():
    from corpuslens.operators import silhouette as SH
    assert SH._n_strips(100, 3, 512) == 1
    assert SH._n_strips(60_000, 10, 512) == SH._n_strips(600_000, 10, 512) == SH.STRIPS
    assert SH._n_strips(6_000_000, 10, 512) == -(-6_000_000 // SH.STRIP)
    assert SH._n_strips(600_000, 2000, 512) == -(-600_000 // (SH.CELLS // 2000))


def test_strips_of_several_blocks_give_the_definition():
    import pandas as pd
    from corpuslens.operators import silhouette as SH
    rng = np.random.default_rng(3)
    x, label, strip = rng.normal(size=(70, 4)), rng.integers(0, 3, 70), np.arange(70) % 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = pd.DataFrame({"row": np.arange(70), "label": label, "vec": list(x), "strip": strip})
    parts = []
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        held = rows[rows["strip"].isin([lo, hi])].assign(lo=lo, hi=hi)
        parts.append(SH._tile_of(8)(held))
    got = pd.concat(parts).groupby(["row", "own", "other"])[["total", "n"]].sum().reset_index()
    for r in got.itertuples():
        assert r.own == label[r.row] and r.n == (label == r.other).sum()
        assert r.total == pytest.approx(d[r.row, label == r.other].sum(), abs=1e-5)


def test_sweep_passes_hold_a_bounded_number_of_models(spark, monkeypatch):
    from corpuslens.operators import sweeps as SW
    assert SW._passes([5, 10, 15, 100, 2], 10) == [[5, 10, 15, 100, 2]]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, features array<double>")
    centres = {k: x[:k] for k in (2, 3, 4, 7)}
    whole = SW.inertias(points, centres), SW.silhouettes(points, centres)
    monkeypatch.setattr(SW, "PASS_NUMBERS", 30)
    monkeypatch.setattr(SW, "BATCH_CELLS", 20)
    assert SW._passes([2, 3, 4, 7], 5) == [[2, 3], [4], [7]]
    for a, b in zip(whole, (SW.inertias(points, centres), SW.silhouettes(points, centres)), strict=True):
        assert a == pytest.approx(b)

def test_records_land_packed(spark, tmp_path):
    from corpuslens.sources import xml as SX
    path = str(tmp_path / "xml")
    names = F.struct(F.array(F.struct(F.lit("A, B").alias("display_name"), F.lit("A").alias("wos_standard"))).alias("name"))
    rec = spark.range(40).select(F.concat(F.lit("WOS:"), "id").alias("UID"), F.struct(F.struct(names.alias("names")).alias("summary")).alias("static_data"))
    SX.write_records(rec, path)
    assert {x.rsplit(".", 1)[1] for x in os.listdir(path) if x.startswith("part-")} == {"gz"}
    assert SX.project_records(SX.read_records(spark, path)).where("authors = array('A, B')").count() == 40
