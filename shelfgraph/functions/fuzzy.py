"""[SCL-S11] Edit-based similarity as Arrow-batched functions, for callers that need it instead of the native ratio.

The ratio of two texts is 200 * LCS / (len a + len b): insertions and deletions alone. The longest common
subsequence is counted with one bit a character (Hyyro, 2004), so a pair costs as many word operations as the
shorter text has characters.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def sorted_ratio(a: str, b: str) -> float:
    """Ratio of the texts' words in order, lower-cased."""
    order = lambda x: " ".join(sorted(x.lower().split()))
    return ratio(order(a), order(b))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and each text's common and own words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    ours, theirs = (f"{both} {' '.join(sorted(p - q))}".strip() for p, q in ((x, y), (y, x)))
    return 100.0 if both and (x <= y or y <= x) else max(ratio(ours, theirs), *(ratio(both, t) for t in (ours, theirs) if both), 0.0)


def _mapped(f):
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")

    return each


def token_sort_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_mapped(sorted_ratio), "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_mapped(set_ratio), "double")(a, b)


def edit_pairs(names: DataFrame, name: str, threshold: float, limit: int | None = None, block_rows: int = 512) -> DataFrame:
    """[JN28, ER4] (source, candidate, sort_ratio, set_ratio) of distinct trimmed names, source < candidate, either ratio at or over threshold.

    Every pair is scored: names are dealt to blocks by hash and each pair of blocks is one bounded task, so the
    work is quadratic in the distinct names and nothing grows with them but the number of tasks. limit: best of
    each name by sort_ratio, ties by name.
    """
    own = names.select(F.trim(name).alias("n")).where("n <> ''").distinct()
    blocks = max(1, math.ceil(own.count() / block_rows))
    dealt = own.withColumn("blk", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int"))
    left = dealt.select(F.col("blk").alias("i"), F.explode(F.sequence("blk", F.lit(blocks - 1))).alias("j"), "n")
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("ri"), F.col("blk").alias("rj"), F.col("n").alias("m"))

    def score(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x in a["n"] if len(a) else ():
            for y in b["m"] if len(b) else ():
                # a pair within one block is met from both sides
                if x == y or (key[0] == key[1] and x > y):
                    continue
                p, q = min(x, y), max(x, y)
                one, two = sorted_ratio(p, q), set_ratio(p, q)
                if max(one, two) >= threshold:
                    rows.append((p, q, one, two))
        return pd.DataFrame(rows, columns=["source", "candidate", "sort_ratio", "set_ratio"])

    scored = left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInPandas(score, "source string, candidate string, sort_ratio double, set_ratio double")
    if limit is None:
        return scored
    both = scored.withColumn("of", F.explode(F.array("source", "candidate"))).withColumn("other", F.when(F.col("of") == F.col("source"), F.col("candidate")).otherwise(F.col("source")))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("sort_ratio"), "other"))).where(F.col("r") <= limit)
    return best.select("source", "candidate", "sort_ratio", "set_ratio").distinct()
