"""Graph metrics over edges (source, target, score)."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.operators.components import connected_components
from shelfgraph.operators.similarity import ids_column
from shelfgraph.session import written


def canonical_edges(edges: DataFrame) -> DataFrame:
    """[FLT9, GRF3] one row for each undirected pair with its largest score; self-loops and NaN scores go."""
    ok = edges.where("source <> target AND score IS NOT NULL AND NOT isnan(score)")
    return ok.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("score").alias("score"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id"), "score")


def degrees(edges: DataFrame) -> DataFrame:
    """[GRF5, TOP8, TOP9] (id, degree, weighted_degree)."""
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("score").alias("weighted_degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[GRF1] (id, component): least id of the component; nodes without edges are their own."""
    found = connected_components(edges, "source", "target").withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[GRF2] one row: nodes, edges, works_with_edges, isolated, average_degree, density, components, largest_component, giant_ratio."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    d = degrees(edges).agg(F.count("*").alias("works_with_edges"))
    c = components(nodes, edges).groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest_component"))
    one = n.join(e, F.lit(True)).join(d, F.lit(True)).join(c, F.lit(True))  # one row each
    return one.select(
        "*", (F.col("nodes") - F.col("works_with_edges")).alias("isolated"), (2.0 * F.col("edges") / F.col("nodes")).alias("average_degree"),
        F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"),
        (F.col("largest_component") / F.col("nodes")).alias("giant_ratio"),
    )


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[GRF9] (id, degree, triangles, clustering): 2T / (d (d - 1)), 0 below two neighbours. Edges point from lower to higher degree, which bounds the wedges at hubs."""
    d = degrees(edges).select("id", "degree")
    e = edges.select("source", "target").join(d.withColumnsRenamed({"id": "source", "degree": "ds"}), "source").join(d.withColumnsRenamed({"id": "target", "degree": "dt"}), "target")
    up = F.struct("ds", "source") < F.struct("dt", "target")
    o = e.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("u"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("v"))
    a, b, c = o.alias("a"), o.alias("b"), o.alias("c")
    tri = a.join(b, F.col("a.u") == F.col("b.u")).where("a.v <> b.v").join(c, (F.col("a.v") == F.col("c.u")) & (F.col("b.v") == F.col("c.v")))
    t = tri.select(F.explode(F.array("a.u", "a.v", "b.v")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = nodes.select("id").join(d, "id", "left").join(t, "id", "left").na.fill(0, ["degree", "triangles"])
    return out.withColumn("clustering", F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def numeric_assortativity(edges: DataFrame, values: DataFrame) -> DataFrame:
    """[GRF7] one row: correlation of values (id, value) over both directions of the edges whose ends have one."""
    a, b = values.select(F.col("id").alias("source"), F.col("value").alias("x")), values.select(F.col("id").alias("target"), F.col("value").alias("y"))
    one = edges.join(a, "source").join(b, "target").where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).agg(F.corr("x", "y").alias("assortativity"))


def attribute_assortativity(edges: DataFrame, values: DataFrame) -> DataFrame:
    """[GRF8] one row: (sum e_ii - sum a_i^2) / (1 - sum a_i^2) of the mixing matrix of values (id, value)."""
    a, b = values.select(F.col("id").alias("source"), F.col("value").alias("x")), values.select(F.col("id").alias("target"), F.col("value").alias("y"))
    e = edges.join(a, "source").join(b, "target").where("x IS NOT NULL AND y IS NOT NULL")
    same = e.agg(F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("e"))
    ends = e.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    square = ends.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("s"))
    return same.join(square, F.lit(True)).select(((F.col("e") - F.col("s")) / (1 - F.col("s"))).alias("assortativity"))


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0, weighted: bool = False) -> DataFrame:
    """[GRF4] one row: sum over clusters of L / m - resolution (K / 2m)^2 for assignment (id, cluster_id)."""
    e = edges.select("source", "target", (F.col("score") if weighted else F.lit(1.0)).alias("w"))
    a, b = assignment.select(F.col("id").alias("source"), F.col("cluster_id").alias("x")), assignment.select(F.col("id").alias("target"), F.col("cluster_id").alias("y"))
    e = e.join(a, "source").join(b, "target")
    m = e.agg(F.sum("w").alias("m"))
    inside = e.where("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("l"))
    k = e.select(F.explode(F.array("x", "y")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return m.join(inside, F.lit(True)).join(k, F.lit(True)).select((F.col("l") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _brandes(adjacency: dict, source, weighted: bool) -> dict:
    """One source's part of betweenness; distance is 1, or 1 / score."""
    dist, paths, before, done, out = {source: 0.0}, defaultdict(float), defaultdict(list), [], {}
    paths[source] = 1.0
    heap, settled = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in settled:
            continue
        settled.add(v)
        done.append(v)
        for w, s in adjacency[v]:
            step = d + (1 / s if weighted and s > 0 else 1.0)
            if w not in dist or step < dist[w] - 1e-12:
                dist[w], paths[w], before[w] = step, paths[v], [v]
                heapq.heappush(heap, (step, w))
            elif abs(step - dist[w]) <= 1e-12 and w not in settled:
                paths[w] += paths[v]
                before[w].append(v)
    share = defaultdict(float)
    for w in reversed(done):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + share[w])
        if w != source:
            out[w] = share[w]
    return out


def _shares(s: np.ndarray, t: np.ndarray, sources: np.ndarray, n: int) -> np.ndarray:
    """Sum of the sources' parts of unweighted betweenness of nodes 0 to n - 1, level by level over edges (s, t)."""
    tail, head = np.r_[s, t].astype(np.int32), np.r_[t, s].astype(np.int32)
    order = np.argsort(tail, kind="stable")
    head, degree = head[order], np.bincount(tail, minlength=n)
    start, total = np.cumsum(degree) - degree, np.zeros(n)
    for source in sources:
        seen, paths, level, steps = np.zeros(n, bool), np.zeros(n), np.array([source]), []
        seen[source], paths[source] = True, 1.0
        while len(level):
            size = degree[level]
            ends = np.cumsum(size)
            to = head[np.arange(ends[-1]) + np.repeat(start[level] - (ends - size), size)]
            new = ~seen[to]
            at, to = np.repeat(level, size)[new].astype(np.int32), to[new]
            seen[to] = True
            paths += np.bincount(to, paths[at], minlength=n)
            steps.append((at, to))
            level = np.unique(to)
        share = np.zeros(n)
        for at, to in reversed(steps):
            share += np.bincount(at, paths[at] / paths[to] * (1 + share[to]), minlength=n)
        share[source] = 0.0
        total += share
    return total


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 500, seed: int = 42, weighted: bool = False, parts: int = 16) -> DataFrame:
    """[GRF6] (id, betweenness), normalised, from at most `pivots` sources (least seeded hash first; a documented sample), scaled to all.

    Each task holds the edges of one component and takes its part of the component's pivots.
    """
    n = nodes.count()
    chosen = nodes.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots)
    k = min(n, pivots)
    labels = connected_components(edges, "source", "target").withColumnRenamed("node", "id")
    own = edges.join(labels.withColumnRenamed("id", "source"), "source").select("component", "source", "target", "score")
    # renamed, so that both sides may come from one lineage
    picked = written(chosen.join(labels, "id").select(F.col("component").alias("c"), F.col("id").alias("pivot"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p")), "pivots")
    # at most `pivots` rows; edges go only to parts that have pivots
    own = own.join(F.broadcast(picked.select(F.col("c").alias("component"), F.col("p").alias("part")).distinct()), "component")
    scale = (n / max(k, 1)) / max((n - 1) * (n - 2), 1)

    def part(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not weighted:
            places, names = pd.factorize(pd.concat([e["source"], e["target"]], ignore_index=True))
            x = _shares(places[: len(e)], places[len(e) :], pd.Index(names).get_indexer(p["pivot"]), len(names))
            return pd.DataFrame({"id": ids_column(names), "x": x})
        adjacency = defaultdict(list)
        for s, t, w in zip(e["source"], e["target"], e["score"], strict=True):
            adjacency[s].append((t, w))
            adjacency[t].append((s, w))
        total: dict = defaultdict(float)
        for source in p["pivot"]:
            for v, x in _brandes(adjacency, source, weighted).items():
                total[v] += x
        return pd.DataFrame({"id": ids_column(total), "x": list(total.values())})

    sums = own.groupBy("component", "part").cogroup(picked.groupBy("c", "p")).applyInPandas(part, f"id {nodes.schema['id'].dataType.simpleString()}, x double").groupBy("id").agg(F.sum("x").alias("x"))
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))
