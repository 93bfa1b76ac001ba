"""Cluster and score statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str, quantiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """[AGG28, AGG29, AGG31] one row: n, mean, std (sample), min, quantiles (linear), max."""
    name = lambda q: f"p{round(100 * q)}"
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        *[F.percentile(column, F.lit(q)).alias(name(q)) for q in quantiles], F.max(column).alias("max"),
    )


def top_signal(members: DataFrame, smallest: int = 5) -> DataFrame:
    """[AGG32, AGG34] from (cluster_id, id, terms): (cluster_id, size, term, n, share of members) of the most frequent term; ties by text."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= smallest)
    counts = members.select("cluster_id", F.explode("terms").alias("term")).groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term"))).where("r = 1")
    return size.join(top, "cluster_id").select("cluster_id", "size", "term", "n", (F.col("n") / F.col("size")).alias("share"))


def term_purity(members: DataFrame) -> DataFrame:
    """[AGG33] (cluster_id, purity): the most frequent term's share of all terms."""
    counts = members.select("cluster_id", F.explode("terms").alias("term")).groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg((F.max("n") / F.sum("n")).alias("purity"))


def value_purity(members: DataFrame, value: str) -> DataFrame:
    """[AGG38, AGG39, AGG42] (cluster_id, dominant, purity, distinct_values), nulls left out; ties by value."""
    counts = members.where(F.col(value).isNotNull()).groupBy("cluster_id", value).agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.max(F.struct("n", F.lit(0))).alias("_"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"), (F.max("n") / F.sum("n")).alias("purity"), F.count("*").alias("distinct_values")).drop("_")


def share_at_least(df: DataFrame, column: str, line: float) -> DataFrame:
    """[AGG36, AGG43] one row: share of rows at or over the line; null counts as below."""
    return df.agg(F.avg(F.when(F.coalesce(F.col(column), F.lit(0.0)) >= line, 1.0).otherwise(0.0)).alias("share"))


def value_shares(df: DataFrame, value: str, nulls: bool = False) -> DataFrame:
    """[AGG41] (value, n, share), share rounded to 3 places."""
    own = df if nulls else df.where(F.col(value).isNotNull())
    counts = own.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("total"))
    return counts.join(total, F.lit(True)).select("value", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))


def quality_summary(stats: DataFrame, line: float) -> DataFrame:
    """[AGG35] one row of stats (cluster_id, size, share): clusters and members at or over the line, and the members' share."""
    ok = F.col("share") >= line
    return stats.agg(F.sum(ok.cast("long")).alias("clusters"), F.sum(F.when(ok, F.col("size")).otherwise(0)).alias("works"), (F.sum(F.when(ok, F.col("size")).otherwise(0)) / F.sum("size")).alias("works_share"))


def top_terms(members: DataFrame, limit: int = 6) -> DataFrame:
    """[AGG45-AGG48] (cluster_id, terms): 'term (n)' of the most frequent terms, joined by a comma."""
    counts = members.select("cluster_id", F.explode("terms").alias("term")).groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term"))).where(F.col("r") <= limit)
    item = F.transform(F.array_sort(F.collect_list(F.struct("r", "term", "n"))), lambda x: F.format_string("%s (%d)", x["term"], x["n"]))
    return top.groupBy("cluster_id").agg(F.array_join(item, ", ").alias("terms"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """[AGG50] (bin, n): equal bins between least and greatest value, the last closed; empty bins are left out."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(bounds), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def edge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """[AGG49, SET4] one row: pairs only in a, only in b, in both, in all."""
    pair = lambda x, side: x.select(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t"), F.lit(side).alias("side")).distinct()
    sides = pair(a, 1).unionByName(pair(b, 2)).groupBy("s", "t").agg(F.sum("side").alias("side"))
    count = lambda v: F.count(F.when(F.col("side") == v, 1))
    return sides.agg(count(1).alias("only_a"), count(2).alias("only_b"), count(3).alias("both"), F.count("*").alias("total"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """[AGG53-AGG55] one row: slope and intercept of least squares, each cut at 0 in this order, and the error's root mean square; one point gives a ratio."""
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    fit = own.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.when(F.col("n") == 1, F.col("my") / F.col("mx")).otherwise(F.greatest(F.lit(0.0), F.coalesce("b", F.lit(0.0))))
    fit = fit.withColumn("slope", slope).withColumn("intercept", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("my") - F.col("slope") * F.col("mx"))))
    error = own.join(F.broadcast(fit), F.lit(True)).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 2))).alias("rmse"))
    return error


def runtime_estimate(runs: DataFrame, sample: float, nodes: float | None = None) -> DataFrame:
    """[AGG55] one row (seconds, slope, intercept, rmse, runs, basis) from runs (sample_size, node_count, total_seconds): by nodes where wanted and known, else by sample size."""
    known = runs.where("node_count > 0")
    by_nodes = bool(nodes) and not known.isEmpty()
    own, x, target = (known, "node_count", nodes) if by_nodes else (runs, "sample_size", sample)
    fit = linear_fit(own, x, "total_seconds").join(own.agg(F.count("*").alias("runs")), F.lit(True))
    return fit.select(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.lit(float(target))).alias("seconds"), "slope", "intercept", "rmse", "runs", F.lit(x).alias("basis"))


def step_durations(runs: DataFrame) -> DataFrame:
    """[AGG52] (title, seconds, runs): mean duration of each step of runs (steps: title, seconds)."""
    each = runs.select(F.explode("steps").alias("s")).select(F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.seconds", F.lit(0.0)).alias("x"))
    return each.groupBy("title").agg(F.avg("x").alias("seconds"), F.count("*").alias("runs"))


def exported(members: DataFrame, smallest: int) -> DataFrame:
    """[FLT10] members of clusters with at least `smallest` of them."""
    return members.where(F.col("cluster_size") >= smallest)


def timeline(members: DataFrame, year: str, cluster: str = "cluster_id") -> DataFrame:
    """[GRF10, FLT11] (cluster_id, year, n): a cluster's works by year, 1800 to 2025."""
    return members.where(F.col(year).between(1800, 2025)).groupBy(F.col(cluster).alias("cluster_id"), F.col(year).alias("year")).agg(F.count("*").alias("n"))


def exponential_fit(x: list[float], y: list[float]) -> tuple[float, float, float]:
    """[SIM5] a, b, c of least squares for y = a exp(-b x) + c. For each b the rest is linear, so only b is searched."""
    xs, ys = np.asarray(x, float), np.asarray(y, float)

    def solved(b: float) -> tuple[float, np.ndarray]:
        m = np.stack([np.exp(np.clip(-b * (xs - xs.min()), -50, 50)), np.ones(len(xs))], axis=1)
        p = np.linalg.lstsq(m, ys, rcond=None)[0]
        return float(((m @ p - ys) ** 2).sum()), p

    grid = np.concatenate([-np.geomspace(1e-3, 30, 200)[::-1], np.geomspace(1e-3, 1e3, 200)]) / max(1e-12, float(np.ptp(xs)))
    at = int(np.argmin([solved(b)[0] for b in grid]))
    lo, hi = sorted((grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]))
    for _ in range(100):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, q) if solved(p)[0] < solved(q)[0] else (p, hi)
    b = (lo + hi) / 2
    a, c = solved(b)[1]
    return float(a * np.exp(b * xs.min())), float(b), float(c)


def elbow(sweep: DataFrame, x: str, y: str, w: str, steps: int = 400, margin: int = 30) -> tuple[float, float, float]:
    """[SIM5] (x, y, w) where the two straight lines that best follow the fitted curve of a sweep meet; w is read off the sweep. A sweep has a row a run."""
    rows = sorted((float(r[x]), float(r[y]), float(r[w])) for r in sweep.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").collect())
    xs, ys, ws = (np.array(c) for c in zip(*rows, strict=True))
    a, b, c = exponential_fit(xs, ys)
    grid = np.linspace(xs[0], xs[-1], steps)
    curve = a * np.exp(-b * grid) + c

    def lines(k: int) -> tuple:
        left, right = np.polyfit(grid[:k], curve[:k], 1), np.polyfit(grid[k:], curve[k:], 1)
        return float(((curve[:k] - np.polyval(left, grid[:k])) ** 2).sum() + ((curve[k:] - np.polyval(right, grid[k:])) ** 2).sum()), left, right

    _, left, right = min((lines(k) for k in range(margin, steps - margin)), key=lambda v: v[0])
    at = (right[1] - left[1]) / (left[0] - right[0])
    return float(at), float(left[0] * at + left[1]), float(np.interp(at, xs, ws))


def cluster_profile(members: DataFrame, title: str, limit: int = 5) -> DataFrame:
    """[AGG46, SRT3] (cluster_id, size, titles): distinct titles, the first `limit` in order, a line each; largest cluster first."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    once = members.where(F.col(title).isNotNull()).select("cluster_id", F.col(title).alias("t")).distinct()
    top = once.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("t"))).where(F.col("r") <= limit)
    titles = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), "\n").alias("titles"))
    return size.join(titles, "cluster_id", "left").orderBy(F.desc("size"), "cluster_id")


def inspect_cluster(members: DataFrame, cluster_id, title: str, limit: int = 25) -> DataFrame:
    """[SRT2, SRT4, FLT12, GRF10] the cluster's rows by title, the first `limit`; an empty cluster is an error."""
    own = members.where(F.col("cluster_id") == cluster_id)
    if not own.limit(1).count():
        raise ValueError(f"no members in cluster {cluster_id}")
    return own.orderBy(title).limit(limit)


def coverage(encoded: DataFrame, works: DataFrame, edges: DataFrame) -> DataFrame:
    """[AGG37] one row: share of works with a vector, and of vectors with an edge."""
    w, e = works.agg(F.count("*").alias("w")), encoded.agg(F.count("*").alias("e"))
    g = edges.select(F.explode(F.array("source", "target")).alias("id")).agg(F.countDistinct("id").alias("g"))
    return w.join(e, F.lit(True)).join(g, F.lit(True)).select((F.col("e") / F.col("w")).alias("embedding_coverage"), (F.col("g") / F.col("e")).alias("graph_coverage"))


def success(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """[AGG36] (metric, value, threshold, met) of one row of metrics; a missing value isn't met."""
    pairs = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for k, t in thresholds.items()]
    return metrics.select(F.explode(F.array(*pairs)).alias("m")).select("m.*", F.coalesce(F.col("m.value") >= F.col("m.threshold"), F.lit(False)).alias("met"))
