r"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A text becomes statistics (lengths, shares of symbols, capitals, digits, repeated words and lines, word-length
moments, ...), standardised by the training rows' mean and deviation. cos(Wx + b) with Gaussian W approximates
a Gaussian kernel. Each partition of training rows sums its part of the normal equations, once for each of
FOLDS folds; the sums, of a fixed size, are added by key and solved on the driver. Out-of-fold scores are
counted in CELLS cells by label and pooled (pool adjacent violators) into a calibrated probability.

Statistics are computed where the text is, in one pass over whole texts; only statistics of labelled rows are
kept for training (all of them, no sample). Labels, ids, language and source are no inputs.

Defined results: null and blank texts have statistics of zero and get a score; without labels of both classes
every score is the share of ones, or 0.5 without labels; repeated rows each get their row; rows without an id are
scored, never learnt from; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.shared import map_batches
from shelfgraph.session import written

FEATURES = 192
FOLDS = 4
CELLS = 512
RIDGE = 1.0
STATISTICS = (
    "log_words", "mean_length", "deviation_length", "longest", "symbols", "marks", "capitals", "digits", "letters", "non_ascii",
    "distinct", "after_same", "top_word", "repeated_pairs", "lines", "repeated_lines", "line_words", "ends", "capital_words", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.float64, n)
    codes = np.frombuffer(raw, np.uint8)
    seen = np.bincount(codes, minlength=256)
    total = float(lengths.sum())
    of = lambda chars: float(seen[np.frombuffer(chars, np.uint8)].sum())
    capitals, small = float(seen[65:91].sum()), float(seen[97:123].sum())
    digits, high = float(seen[48:58].sum()), float(seen[128:].sum())
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    same = float((code[1:] == code[:-1]).sum()) if n > 1 else 0.0
    pairs = code[1:] * len(ids) + code[:-1]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), total / n, float(lengths.std()), float(np.log1p(lengths.max())),
        of(b"#*$%&|<>@=+~^\\_{}[]") / n, of(b".,;:!?-'\"()") / n, capitals / max(1.0, capitals + small), digits / total, (capitals + small + high) / total, high / total,
        len(ids) / n, same / n, float(np.bincount(code).max()) / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)),
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        float(sum(map(bytes.isupper, words))) / n, float((lengths <= 2).mean()),
    ]


def with_statistics():
    """For map_batches: (doc_id, text) to (doc_id, statistics)."""

    def each(batch):
        return [batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))]

    return each


class Kernel:
    """x to random Fourier features of a Gaussian kernel over standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = 4.0, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _sums(kernel):
    """For map_batches: (fold, y, statistics) to one row a fold and partition: Z'Z and Z'y, packed."""

    def run(batches):
        k, held = kernel.value, {}
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
            z = k(_matrix(batch.column(2)))
            for f in range(FOLDS):
                zf, yf = z[fold == f], y[fold == f]
                if len(zf):
                    part = np.concatenate([zf.T @ zf, (zf.T @ yf)[:, None]], axis=1)
                    held[f] = held.get(f, 0) + part
        for f, part in held.items():
            for r in range(len(part)):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([r], pa.int32()), pa.array([part[r].tolist()], pa.list_(pa.float64()))], names=["fold", "r", "part"])

    return run


def _cells(kernel, weights):
    def make():
        k, w = kernel.value, weights.value

        def each(batch):
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            s = (k(_matrix(batch.column(2))) * w[fold]).sum(axis=1)
            cell = np.clip(((s + 0.5) / 2 * CELLS).astype(np.int64), 0, CELLS - 1)
            return [cell, y.astype(np.int64)]

        return each

    return make


def pooled(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic means of cells in rising order; a cell without rows gets the line between its neighbours."""
    blocks: list = []
    full = np.flatnonzero(total > 0)
    for i in full:
        blocks.append([float(ones[i]), float(total[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    value = np.concatenate([np.full(b[2], b[0] / b[1]) for b in blocks])
    return np.interp(np.arange(len(total)), full, value)


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, levels: np.ndarray):
        self.kernel, self.weights, self.levels = kernel, weights, levels

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None or not len(x):
            return np.full(len(x), self.levels[0])
        s = np.clip((self.kernel(x) @ self.weights + 0.5) / 2 * CELLS - 0.5, 0, CELLS - 1)
        # the raw score breaks ties inside a pooled block, by less than a thousandth
        return np.clip(np.interp(s, np.arange(CELLS), self.levels) * 0.999 + 0.001 * s / CELLS, 0, 1)


def fit(rows: DataFrame, features: int = FEATURES) -> Model:
    """Model from (doc_id, y, stats): labelled training rows. Nothing but sums of fixed size reaches the driver."""
    spark = rows.sparkSession
    k = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)]).first()
    n, ones = moments["n"] or 0, moments["ones"] or 0
    if not 0 < ones < n:
        return Model(None, None, np.full(CELLS, ones / n if n else 0.5))
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(k)]), np.array([moments[f"s{i}"] or 1.0 for i in range(k)]), features)
    shared = spark.sparkContext.broadcast(kernel)
    folded = rows.select(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("y").cast("int").alias("y"), "stats")
    sums = folded.mapInArrow(_sums(shared), "fold int, r int, part array<double>")
    size = features + 1
    added = sums.groupBy("fold", "r").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(size + 1)]).alias("part"))
    total = np.zeros((FOLDS, size, size + 1))
    for row in added.collect():  # FOLDS * size rows
        total[row["fold"], row["r"]] = row["part"]
    every = total.sum(axis=0)
    solve = lambda m: np.linalg.solve(m[:, :size] + RIDGE * np.eye(size), m[:, size])
    apart = np.stack([solve(every - total[f]) for f in range(FOLDS)])
    counts = map_batches(folded, _cells(shared, spark.sparkContext.broadcast(apart)), "cell long, y long").groupBy("cell").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    good, all_ = np.zeros(CELLS), np.zeros(CELLS)
    for row in counts.collect():  # at most CELLS rows
        good[row["cell"]], all_[row["cell"]] = row["ones"], row["n"]
    return Model(kernel, solve(every), pooled(good, all_))


def _score_statistics(model):
    def make():
        own = model.value

        def each(batch):
            return [batch.column(0), pa.array(own.scores(_matrix(batch.column(1))), pa.float64())]

        return each

    return make


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for each row; labels are the rows that may be learnt from. Statistics are written to the shared folder once, with the labels' rows or not."""
    stats = map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), with_statistics, "doc_id long, stats array<double>")
    stats = written(stats, "quality-statistics")
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    model = fit(stats.join(own, "doc_id").select("doc_id", "y", "stats"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(stats, _score_statistics(shared), "doc_id long, score double")
