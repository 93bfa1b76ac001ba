import random

from shelfgraph.operators.components import connected_components


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def run(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["component"] for r in connected_components(df).collect()}


def test_random_and_path_and_hub(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    assert run(spark, edges) == brute(edges)
    path = [(i, i + 1) for i in range(60)]
    assert set(run(spark, path).values()) == {0}
    hub = [(500, i) for i in range(50)] + [(7, 900)]
    assert set(run(spark, hub).values()) == {0}


def test_empty_and_null_ends(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1), (3, 3)]) == {3: 3}


def test_edges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert seen.value == 2
