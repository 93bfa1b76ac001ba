import json

from shelfgraph.sources import tables as src
from shelfgraph.streaming.upserts import upsert_stream


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, tags array<string>")
    src.write_tables({"t": df}, str(tmp_path))
    assert src.read_table(spark, str(tmp_path), "t", required=("id",)).count() == 2
    src.write_csv(df, f"{tmp_path}/c.csv")
    assert sorted(r.tags for r in src.read_table(spark, str(tmp_path), "c", lists=("tags",)).collect()) == [[], ["a", "b"]]
    assert src.read_table(spark, str(tmp_path), "absent", schema="id long").columns == ["id"]


def test_json_lines_and_runs(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert src.read_json_lines(spark, str(tmp_path / "w.json"), "id string").where("id IS NOT NULL").count() == 2
    (tmp_path / "run_1.json").write_text(json.dumps({"sample_size": 200, "total_seconds": 9.5, "steps": []}))
    (tmp_path / "run_2.json").write_text(json.dumps({"nodes": {"Work": {"created": 2}, "Book": {"created": 3}}}))
    assert src.read_runs(spark, str(tmp_path / "run_*.json")).count() == 1
    assert {r.nodes for r in src.created_nodes(spark, str(tmp_path / "run_2.json")).collect()} == {5}


def test_upsert_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, a string, b string").schema
    go = lambda: upsert_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", "id", schema, f"{tmp_path}/ck").awaitTermination()
    spark.createDataFrame([(1, "x", None)], schema).write.parquet(f"{tmp_path}/in")
    go()
    spark.createDataFrame([(1, None, "y"), (2, "z", None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    go()  # nothing new
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/v1").collect())
    assert got == [(1, "x", "y"), (2, "z", None)]
