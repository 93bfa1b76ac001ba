import collections
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfgraph.operators import analysis, community, graph, similarity
from shelfgraph.plans import catalog


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source long, target long, score double")


TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def test_metrics(spark):
    nodes = spark.range(5)
    got = graph.metrics(nodes, edges(spark, (0, 1), (1, 2))).first()
    assert (got.components, got.giant_ratio, got.average_degree, got.density, got.isolated) == (3, 0.6, 0.8, 0.2, 2)


def test_neighbours_and_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.436]), (2, [0.8, -0.6])], "id long, vector array<double>")
    for block in (1, 2, 100):
        ranked = similarity.neighbours(v, 1, 0.5, block_rows=block)
        assert sorted((r.source, r.target) for r in similarity.edges(ranked).collect()) == [(0, 1), (0, 2)]
        assert sorted((r.source, r.target) for r in similarity.edges(ranked, "lower").collect()) == [(0, 1)]
    assert similarity.neighbours(v, 10, -1.0).count() == 6


def test_string_ids(spark):
    v = spark.createDataFrame([("w0", [1.0, 0.0]), ("w1", [0.9, 0.436]), ("w2", [0.8, -0.6])], "id string, vector array<double>")
    for block in (1, 100):
        e = similarity.edges(similarity.neighbours(v, 1, 0.5, block_rows=block))
        assert sorted((r.source, r.target) for r in e.collect()) == [("w0", "w1"), ("w0", "w2")]
    assert {r.id for r in community.communities(e, (1.0,)).collect()} == {"w0", "w1", "w2"}
    assert {r.id: r.betweenness for r in graph.betweenness(v.select("id"), e).collect()} == {"w0": 1.0, "w1": 0.0, "w2": 0.0}


def plain_neighbours(rows, k, threshold, weight):
    """(src, dst) to score of each id's k best, by plain loops."""
    found = {}
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    for a, v, ts in rows:
        scored = []
        for b, u, us in rows:
            if a != b:
                norm = np.sqrt(sum(x * x for x in ts.values())) * np.sqrt(sum(x * x for x in us.values())) or 1.0
                scored.append(((1 - weight) * (unit(v) @ unit(u)) + weight * sum(x * us[t] for t, x in ts.items() if t in us) / norm, b))
        scored = sorted((-round(s, 12), b) for s, b in scored if s >= threshold)
        found |= {(a, b): -s for s, b in (scored[:k] if k else scored)}
    return found


@pytest.mark.parametrize("k,threshold,weight", [(5, 0.1, 0.0), (0, 0.3, 0.0), (5, 0.1, 0.1), (3, -1.0, 0.6), (3, 0.0, 1.0)])
def test_neighbours_by_plain_loops(spark, monkeypatch, k, threshold, weight):
    """Tiles, blocks, equal vectors (ties by id), zero vectors, rows without terms and vectors that aren't numbers."""
    monkeypatch.setattr(similarity, "TILE", 16)
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(90, 6))
    v[40:50], v[77] = v[3], 0.0
    terms = [{f"t{t}": float(rnd.random()) for t in rnd.choice(12, int(rnd.integers(0, 5)), replace=False)} for _ in v]
    rows = [(i, v[i], terms[i]) for i in range(len(v))]
    data = [(i, x.tolist(), list(t), list(t.values())) for i, x, t in rows] + [(900, [float("nan")] * 6, [], []), (None, v[0].tolist(), [], []), (901, None, [], [])]
    df = spark.createDataFrame(data, "id long, vector array<double>, terms array<string>, weights array<double>")
    want = plain_neighbours(rows, k, threshold, weight)
    for block in (20, None):
        got = {(r.src, r.dst): r.score for r in similarity.neighbours(df, k, threshold, weight, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_neighbours_copy_vectors_to_few_blocks(spark):
    """Each vector goes to as many tasks as there are blocks: eight for small tables, where blocks of 2,048 rows made 15 for 30,000 and five times more for five times the rows."""
    v = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.xxhash64("id", i) % 1000 + 0.5).cast("float")).alias("vector"))
    ranked = similarity.neighbours(v, 3, 0.0)
    assert ranked.count() == 9000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapCoGroupsInPandas" not in plan


def test_equal_vectors_hold_a_bounded_number_of_pairs():
    """All pairs of equal vectors are among the best of 32 bits; they were held until a tile's end, 1.1 GB here."""
    n = 8192
    v = np.tile(np.random.default_rng(2).normal(size=8), (n, 1))
    packs = pa.table({"ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(range(n))), "width": pa.array([8], pa.int32()), "v": [v.tobytes()]})
    block = similarity._Block(packs, "f8")
    tracemalloc.start()
    found = similarity._nearest(block, block, True, 3, 0.5, 0.0)
    r, c, score = next(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (r[:9].tolist(), c[:9].tolist()) == ([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 0, 2, 3, 0, 1, 3])
    assert len(r) == 3 * similarity.TILE and np.allclose(score, 1.0) and peak < 300e6


def test_modularity_and_leiden(spark):
    e = edges(spark, *TRIANGLES)
    found = community.communities(e, (1.0,))
    label = {r.id: r.cluster_id for r in found.collect()}
    assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5]
    q = graph.modularity(e, found.select("id", "cluster_id")).first().modularity
    assert q == pytest.approx(0.357143, abs=1e-6)
    best = community.best_partition(community.evaluate(e, found, (1.0,)), 6).first()
    assert (best.communities, best.resolution) == (2, 1.0)


def test_clustering_and_betweenness(spark):
    e, nodes = edges(spark, *TRIANGLES), spark.range(6)
    got = {r.id: r.clustering for r in graph.clustering(nodes, e).collect()}
    assert got[0] == 1.0 and got[2] == pytest.approx(1 / 3)
    between = {r.id: r.betweenness for r in graph.betweenness(nodes, e).collect()}
    # pairs whose shortest path passes node 2: {0, 1} x {3, 4, 5}
    assert between[2] == pytest.approx(6 / 10) and between[0] == 0


def test_shares_are_those_of_single_steps():
    """Levels at once give what the queue of single steps gives, with repeated edges, loops and two components."""
    rnd = np.random.default_rng(2)
    pairs = np.r_[rnd.integers(0, 30, (60, 2)), rnd.integers(30, 40, (12, 2)), [[0, 1], [0, 1], [5, 5]], [[i, i + 1] for i in range(39) if i != 29]]
    adjacency = collections.defaultdict(list)
    for s, t in pairs.tolist():
        adjacency[s].append((t, 1.0))
        adjacency[t].append((s, 1.0))
    want = np.zeros(40)
    for source in (0, 7, 35):
        for v, x in graph._brandes(adjacency, source, False).items():
            want[v] += x
    assert np.allclose(graph._shares(pairs[:, 0], pairs[:, 1], np.array([0, 7, 35]), 40), want)


def test_queries_find_neighbours_once(spark, monkeypatch):
    """Operators that read edges more than once get them written."""
    calls = []
    monkeypatch.setattr(catalog, "written", lambda df, name: calls.append(name) or df)
    for name in ("graph_metrics", "edge_overlap", "avg_clustering", "numeric_assortativity", "attr_assortativity", "modularity_of_labels"):
        monkeypatch.setattr(catalog, "_edges", lambda *a: edges(spark, *TRIANGLES))
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert calls == ["edges"] * 6


def test_assortativity(spark):
    e = edges(spark, *TRIANGLES)
    values = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, value long")
    pairs = [(a // 3, b // 3) for a, b in itertools.chain(TRIANGLES, [(b, a) for a, b in TRIANGLES])]
    mean = sum(x for x, _ in pairs) / len(pairs)
    want = sum((x - mean) * (y - mean) for x, y in pairs) / sum((x - mean) ** 2 for x, _ in pairs)
    assert graph.numeric_assortativity(e, values).first()[0] == pytest.approx(want)
    assert graph.attribute_assortativity(e, values).first()[0] == pytest.approx(want)


def test_purities(spark):
    m = spark.createDataFrame([(0, i, (["a", "b"] if i < 3 else [])) for i in range(4)], "cluster_id int, id int, terms array<string>")
    assert analysis.top_signal(m, 4).first().share == 0.75 and analysis.term_purity(m).first().purity == 0.5
    p = spark.createDataFrame([(0.9,), (0.5,), (None,)], "p double")
    assert analysis.share_at_least(p, "p", 0.8).first().share == pytest.approx(1 / 3)
    fit = analysis.linear_fit(spark.createDataFrame([(200, 1397), (200, 1413), (5000, 38666)], "x long, y long"), "x", "y").first()
    assert fit.slope == pytest.approx(7.762708, abs=1e-6) and fit.intercept == 0
    bins = analysis.histogram(spark.range(21).withColumn("v", F.col("id").cast("double")), "v", 20)
    assert {r.bin: r.n for r in bins.collect()}[19] == 2
