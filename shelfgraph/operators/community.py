"""[GRF4] Leiden communities (Traag, Waltman, van Eck, 2019) under the Reichardt-Bornholdt configuration model.

With a positive resolution no community spans two components (merging them has a loss and no gain), so each
component and resolution is a task of its own, given the whole graph's weight. A seeded order of nodes makes
runs agree. Clusters are numbered by size, then by least id.
"""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.constants import RESOLUTIONS
from shelfgraph.operators.components import connected_components
from shelfgraph.operators.graph import modularity
from shelfgraph.operators.similarity import ids_column


def _move(adj: list[dict], degree: list[float], label: list[int], two_m: float, gamma: float, rnd: random.Random, within: list[int] | None = None) -> bool:
    """Moves nodes to the neighbouring community of most gain until none gains; within: communities they may not leave."""
    total: dict[int, float] = {}
    for v, c in enumerate(label):
        total[c] = total.get(c, 0.0) + degree[v]
    order = list(range(len(adj)))
    rnd.shuffle(order)
    queue, waiting, moved = deque(order), set(order), False
    while queue:
        v = queue.pop()
        waiting.discard(v)
        old, links = label[v], {}
        for u, w in adj[v].items():
            if u != v and (within is None or within[u] == within[v]):
                links[label[u]] = links.get(label[u], 0.0) + w
        total[old] -= degree[v]
        best, gain = old, links.get(old, 0.0) - gamma * degree[v] * total[old] / two_m
        for c in sorted(links):
            g = links[c] - gamma * degree[v] * total[c] / two_m
            if g > gain + 1e-12:
                best, gain = c, g
        total[best] = total.get(best, 0.0) + degree[v]
        if best != old:
            label[v], moved = best, True
            for u in adj[v]:
                if label[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.appendleft(u)
    return moved


def leiden(edges: list[tuple], two_m: float, gamma: float, seed: int = 42, levels: int = 20) -> dict:
    """Node to community of one graph's weighted edges."""
    names = sorted({x for s, t, _ in edges for x in (s, t)})
    at = {v: i for i, v in enumerate(names)}
    adj: list[dict] = [{} for _ in names]
    for s, t, w in edges:
        a, b = at[s], at[t]
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    degree = [sum(x.values()) for x in adj]
    node = list(range(len(names)))  # each name's node at this level
    label = list(range(len(adj)))
    rnd = random.Random(seed)
    for _ in range(levels):
        moved = _move(adj, degree, label, two_m, gamma, rnd)
        fine = list(range(len(adj)))
        _move(adj, degree, fine, two_m, gamma, rnd, within=label)
        ids = {c: i for i, c in enumerate(sorted(set(fine)))}
        if not moved or len(ids) == len(adj):
            break
        coarse: list[dict] = [{} for _ in ids]
        weight = [0.0] * len(ids)
        outer = [0] * len(ids)
        for v, x in enumerate(adj):
            i = ids[fine[v]]
            weight[i] += degree[v]
            outer[i] = label[v]
            for u, w in x.items():
                j = ids[fine[u]]
                if i != j:
                    coarse[i][j] = coarse[i].get(j, 0.0) + w
        node = [ids[fine[v]] for v in node]
        first: dict[int, int] = {}
        label = [first.setdefault(c, i) for i, c in enumerate(outer)]
        adj, degree = coarse, weight
    return {v: label[node[i]] for i, v in enumerate(names)}


def communities(edges: DataFrame, resolutions: tuple = RESOLUTIONS, seed: int = 42) -> DataFrame:
    """[GRF4, JN33, AGG30] (resolution, id, cluster_id, cluster_label, cluster_size) for each resolution; nodes are the ends of edges."""
    labels = connected_components(edges, "source", "target").withColumnRenamed("node", "source")
    two_m = 2 * (edges.agg(F.sum("score")).first()[0] or 0.0)
    own = edges.join(labels, "source").withColumn("resolution", F.explode(F.array(*map(F.lit, resolutions))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "target"])
        found = leiden(list(zip(rows["source"], rows["target"], rows["score"], strict=True)), two_m, key[1], seed)
        return pd.DataFrame({"component": ids_column([key[0]] * len(found)), "resolution": key[1], "id": ids_column(found), "c": list(found.values())})

    ident = edges.schema["source"].dataType.simpleString()
    raw = own.groupBy("component", "resolution").applyInPandas(run, f"component {ident}, resolution double, id {ident}, c long")
    sizes = raw.groupBy("resolution", "component", "c").agg(F.count("*").alias("cluster_size"), F.min("id").alias("least"))
    number = F.row_number().over(Window.partitionBy("resolution").orderBy(F.desc("cluster_size"), "least")) - 1
    numbered = sizes.withColumn("cluster_id", number)
    return raw.join(numbered, ["resolution", "component", "c"]).select("resolution", "id", "cluster_id", F.concat(F.lit("cluster_"), "cluster_id").alias("cluster_label"), "cluster_size")


def evaluate(edges: DataFrame, assigned: DataFrame, resolutions: tuple = RESOLUTIONS, smallest: int = 3) -> DataFrame:
    """[GRF4] (resolution, communities, modularity) of each resolution with two communities or more, one of them at least `smallest`."""
    out = None
    for r in resolutions:
        own = assigned.where(F.col("resolution") == r)
        q = modularity(edges, own.select("id", "cluster_id"))
        c = own.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.max("n").alias("largest"))
        row = c.join(q, F.lit(True)).where(f"communities >= 2 AND largest >= {smallest}").select(F.lit(r).alias("resolution"), "communities", "modularity")
        out = row if out is None else out.unionByName(row)
    return out


def best_partition(evaluated: DataFrame, nodes: int) -> DataFrame:
    """[TOP7] the row of most modularity, then of a count nearest to nodes / 20, then of the least resolution."""
    return evaluated.orderBy(F.desc("modularity"), F.abs(F.col("communities") - nodes / 20), "resolution").limit(1)
