import json

import numpy as np
import pytest

from shelfgraph import cli
from shelfgraph.operators import analysis
from shelfgraph.plans import catalog_tables
from shelfgraph.plans.pipeline import Config, read_config


def test_steps_from_raw_tables_to_communities(spark, tmp_path):
    rows = [(i, f"quiet harbour tale of ship{i % 5} and ship{i % 5} on sea{i % 3}", "eng", f"s{i % 4}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in catalog_tables.raw(spark, str(tmp_path)).items():
        df.write.parquet(f"{tmp_path}/raw/{name}.parquet")
    at = lambda n: f"{tmp_path}/{n}"
    (tmp_path / "c.json").write_text(json.dumps({"threshold": 0.2, "resolutions": [0.5, 1.0], "tfidf_weight": 0.1}))
    run = lambda *x: cli.main([*x, "--config", at("c.json")], spark)
    run("extract", "--source", at("raw"), "--out", at("final"), "--works", "60")
    run("normalize", "--source", at("final"), "--out", at("clean"), "--accept")
    run("embed", "--source", at("clean"), "--out", at("vectors"))
    run("similarity", "--source", at("vectors"), "--out", at("graph"))
    run("communities", "--source", at("graph"), "--out", at("groups"), "--smallest", "2")
    run("merge", "--source", at("final"), "--increment", at("clean"), "--out", at("both"))
    read = lambda p: spark.read.parquet(at(p))
    works = read("final/work_final.parquet").count()
    assert 0 < works <= 60 and read("clean/work_final.parquet").count() == works == read("both/work_final.parquet").count()
    assert read("vectors/embeddings.parquet").count() == works
    column = sorted(r["column"] for r in read("vectors/vocabulary.parquet").collect())
    assert column == list(range(len(column)))
    groups = read("groups/communities.parquet").collect()
    assert groups and all(r.cluster_size >= 2 for r in groups) and len({r.resolution for r in groups}) == 1
    with pytest.raises(SystemExit):
        cli.main(["extract", "--source", "x"], spark)


def test_config_files(tmp_path):
    (tmp_path / "a.toml").write_text("seed = 7\nresolutions = [1.0]\n")
    assert read_config(str(tmp_path / "a.toml")) == Config(seed=7, resolutions=(1.0,)) and read_config(None) == Config()


def test_runtime_estimates(spark):
    runs = spark.createDataFrame([(200, 1000, 100.0, [("a", 40.0), ("b", 60.0)]), (400, None, 180.0, [("a", 80.0)])], "sample_size long, node_count long, total_seconds double, steps array<struct<title:string,seconds:double>>")
    assert analysis.runtime_estimate(runs, 600).first().seconds == pytest.approx(260.0)
    assert analysis.runtime_estimate(runs, 600, 5000).first().seconds == pytest.approx(500.0)
    assert {(r.title, r.seconds, r.runs) for r in analysis.step_durations(runs).collect()} == {("a", 60.0, 2), ("b", 60.0, 1)}


def test_fit_and_elbow(spark):
    x = np.linspace(0.2, 1.0, 14)
    assert analysis.exponential_fit(x, 0.5 * np.exp(-6 * x) + 0.02) == pytest.approx((0.5, 6.0, 0.02), abs=1e-4)
    sweep = spark.createDataFrame([(float(v), float(0.5 * np.exp(-6 * v) + 0.02), float(10 * v)) for v in x], "cover double, purity double, weight double")
    at, _, w = analysis.elbow(sweep, "cover", "purity", "weight")
    assert 0.25 < at < 0.6 and w == pytest.approx(10 * at)
