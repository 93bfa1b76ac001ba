"""Cosine neighbours in blocks, and edges from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.session import batches_of, written

BLOCK_ROWS = 65_536  # of a block at most; a pair of blocks is a task
SIDE = 8  # blocks, so that small tables are dealt to SIDE * SIDE tasks; fewer where a block would have under LEAST rows
LEAST = 256
TILE = 1024  # rows of one product
FIRST = 256  # of its columns that give the first bars


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n == 0, 1.0, n)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block as packs. Vectors with parts that aren't numbers have no score and go."""
    for batch in batches:
        blks = batch["blk"].to_numpy()
        starts = np.flatnonzero(np.r_[True, blks[1:] != blks[:-1]]) if len(blks) else []
        for at, end in zip(starts, [*starts[1:], len(blks)], strict=True):
            rows = batch.slice(at, end - at)
            widths = np.unique(rows["vector"].value_lengths().to_numpy())
            if len(widths) > 1:
                raise ValueError(f"vectors of {widths.tolist()} parts")
            v = rows["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(widths[0]))
            with np.errstate(all="ignore"):
                good = np.isfinite(_unit(v)).all(axis=1)
            if not good.any():
                continue
            rows, v = rows.filter(pa.array(good)), v[good]
            cols = {"blk": pa.array([int(blks[at])], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows["id"]), "width": pa.array([v.shape[1]], pa.int32()), "v": [v.tobytes()]}
            if "terms" in rows.schema.names:
                names, at_name = np.unique(rows["terms"].flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                lens, weights = rows["terms"].value_lengths().to_numpy(), rows["weights"].flatten().to_numpy(zero_copy_only=False)
                cols |= {"lens": [lens.astype(np.int32).tobytes()], "names": [names.astype(np.int64).tobytes()], "terms": [at_name.astype(np.int32).tobytes()], "weights": [weights.astype(np.float64).tobytes()]}
            yield pa.RecordBatch.from_pydict(cols)


class _Block:
    """A block's ids in order, with unit vectors in 64 and 32 bits and, where there are terms, their sparse rows of unit length."""

    def __init__(self, packs: pa.Table, kind: str):
        ids = pa.concat_arrays([c.flatten() for c in packs["ids"].chunks])
        self.width = packs["width"][0].as_py()
        if set(packs["width"].to_pylist()) != {self.width}:
            raise ValueError(f"vectors of {sorted(set(packs['width'].to_pylist()))} parts")
        read = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in packs[c]]
        order = pc.sort_indices(ids)
        o = order.to_numpy()
        self.ids, self.v = ids.take(order), _unit(np.concatenate(read("v", kind)).reshape(-1, self.width)[o])
        self.v32 = self.v.astype(np.float32)
        if "lens" in packs.schema.names:
            lens, weights, names, terms = np.concatenate(read("lens", np.int32)), np.concatenate(read("weights", np.float64)), read("names", np.int64), read("terms", np.int32)
            self.names = np.unique(np.concatenate(names))
            terms = np.concatenate([np.searchsorted(self.names, x)[t] for x, t in zip(names, terms, strict=True)])
            row = np.repeat(np.arange(len(lens)), lens)
            norm = np.sqrt(np.bincount(row, weights * weights, minlength=len(lens)))
            weights = weights / np.where(norm == 0, 1.0, norm)[row]
            places = _ranges((np.cumsum(lens, dtype=np.int64) - lens)[o], lens[o])
            self.lens, self.terms, self.weights = lens[o], terms[places], weights[places]
            self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lens, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _sparse(a: _Block, b: _Block, r: np.ndarray, c: np.ndarray, to_b: np.ndarray) -> np.ndarray:
    """Products of the sparse rows of pairs (r, c); r is in order. A row of a is spread over b's terms once, for all its pairs; to_b: the places of a's terms there."""
    out, spread = np.zeros(len(r)), np.zeros(len(b.names) + 1)
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(r)], strict=True):
        own = slice(a.starts[r[lo]], a.starts[r[lo]] + a.lens[r[lo]])
        spread[to_b[a.terms[own]]] = a.weights[own]
        spread[-1] = 0.0  # terms that b doesn't hold
        places, lens = _ranges(b.starts[c[lo:hi]], b.lens[c[lo:hi]]), b.lens[c[lo:hi]]
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), lens), spread[b.terms[places]] * b.weights[places], minlength=hi - lo)
        spread[to_b[a.terms[own]]] = 0.0
    return out


def _kth(r: np.ndarray, s: np.ndarray, k: int, rows: int) -> np.ndarray:
    """The k-th largest of s for each row; -inf below k values. r is in order."""
    count = np.bincount(r, minlength=rows)
    first, width, bar = np.cumsum(count) - count, int(count.max(initial=0)), np.full(rows, -np.inf)
    if width < k:
        return bar
    if rows * width <= 8 * len(r):
        wide = np.full((rows, width), -np.inf, s.dtype)
        wide[r, np.arange(len(r)) - first[r]] = s
        return np.partition(wide, width - k, axis=1)[:, width - k].astype(np.float64)
    # a few rows have most of the values
    full = count >= k
    bar[full] = s[np.lexsort((-s, r))][first[full] + k - 1]
    return bar


def _at_least(m: np.ndarray, bar: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of m's finite values at or over their row's bar, in order. flags: of m's shape or wider, its width a multiple of 8; most groups of 8 have none."""
    np.greater_equal(m, bar.astype(np.float32)[:, None], out=flags[:, : m.shape[1]])
    flags[:, m.shape[1] :] = False
    some = np.flatnonzero(flags.view(np.uint64).astype(bool))
    g, x = np.nonzero(flags.reshape(-1, 8)[some])
    y, x = np.divmod(some[g] * 8 + x, flags.shape[1])
    v = m[y, x]
    good = np.isfinite(v)
    return (y, x, v) if good.all() else (y[good], x[good], v[good])


def _nearest(a: _Block, b: _Block, same: bool, k: int, threshold: float, w: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, score) of each row's k best at or over threshold, ties by id; k = 0: of all.

    Products in 32 bits leave out what can't be among the k best, by a bound on their error (and on what
    terms may add, at most w); what is left is scored in 64 bits. Where much is left, as of equal vectors, it
    is scored as it comes and only the k best of a row stay, so a tile's rows hold a bounded number of pairs.
    """
    if a.width != b.width:
        raise ValueError(f"vectors of {a.width} and {b.width} parts")
    slack = (a.width + 4) * 2.0**-22
    gap = w / (1 - w) + slack if w < 1 else np.inf
    # a dense product below this can't give the score: (1 - w) * dense + w * [0, 1] is under it
    dense = lambda score: (score - w) / (1 - w) - slack if w < 1 else np.full_like(score, -np.inf)
    codes = b.ids.dictionary_encode().indices.to_numpy() if same else None  # ids are in order, and so are their codes
    if w > 0:
        to_b = np.searchsorted(b.names, a.names)
        to_b[(to_b == len(b.names)) | (b.names[np.minimum(to_b, len(b.names) - 1)] != a.names if len(b.names) else True)] = len(b.names)

    def scored(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores in 64 bits; r is in order."""
        score = np.concatenate([np.einsum("ij,ij->i", a.v[r[p : p + 65536]], b.v[c[p : p + 65536]]) for p in range(0, len(r), 65536)] or [np.zeros(0)])
        return (1 - w) * score + w * _sparse(a, b, r, c, to_b) if w > 0 else score

    for i in range(0, len(a.ids), TILE):
        left = a.v32[i : i + TILE]
        rows = len(left)
        bar, most = dense(np.full(rows, float(threshold))), 16 * max(k, 1) * TILE
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        best = none  # what was scored: row, row of b, score
        pile, size, kept = [], 0, 0  # what wasn't

        def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pile in the order of rows, then of rows of b, without what the bar leaves out."""
            r, c, s = (np.concatenate([x[n] for x in pile]) if pile else none[n] for n in range(3))
            order = np.argsort(r.astype(np.uint16) if rows <= 65_536 else r, kind="stable")
            r, c, s = r[order], c[order], s[order]
            if k and w < 1:
                np.maximum(bar, _kth(r, s, k, rows) - gap, out=bar)
                stays = s >= bar[r]
                r, c, s = r[stays], c[stays], s[stays]
            return r, c, s

        def merged(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """best and pairs (r, c): the k best of each row."""
            score = scored(i + r, c)
            good = score >= threshold
            r, c, score = (np.r_[x, y[good]] for x, y in zip(best, (r, c, score), strict=True))
            order = np.lexsort((c, -score, r))
            r, c, score = r[order], c[order], score[order]
            stays = np.arange(len(r)) - np.searchsorted(r, r) < k if k else slice(None)
            return r[stays], c[stays], score[stays]

        for n, j in enumerate(range(0, len(b.ids), TILE)):
            m = left @ b.v32[j : j + TILE].T
            if same:
                lo, hi = (np.searchsorted(codes[j : j + TILE], codes[i : i + rows], side) for side in ("left", "right"))
                for extra in range(int((hi - lo).max(initial=0))):
                    hit = np.flatnonzero(lo + extra < hi)
                    m[hit, lo[hit] + extra] = -np.inf
            if n == 0 and w < 1 and 0 < k < (few := min(m.shape[1], FIRST)):
                np.maximum(bar, np.partition(m[:, :few], few - k, axis=1)[:, few - k] - gap, out=bar)
            y, x, v = _at_least(m, bar, np.empty((rows, -(-m.shape[1] // 8) * 8), bool))
            pile.append((y, x + j, v))
            size += len(y)
            if k and (size - kept > 4 * k * rows or n & (n + 1) == 0):
                pile = [gathered()]
                size = kept = len(pile[0][0])
                if size > most:
                    best = merged(*pile[0][:2])
                    np.maximum(bar, dense(_kth(best[0], best[2], k, rows)), out=bar)
                    pile, size, kept = [], 0, 0
        r, c, score = merged(*gathered()[:2])
        yield i + r, c, score


def ids_column(values) -> pd.Series:
    """Ids as numbers, or as plain objects: Spark doesn't take pandas' Arrow-backed text."""
    out = pd.Series(list(values), dtype=object)
    return out if not len(out) or isinstance(out.iat[0], str) else out.infer_objects()


def with_terms(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Every vector (id, vector) with its terms and weights (id, terms, weights); empty arrays where it has none, which score 0 there."""
    joined = vectors.join(weights, "id", "left")
    return joined.withColumns({"terms": F.coalesce("terms", F.array().cast("array<string>")), "weights": F.coalesce("weights", F.array().cast("array<double>"))})


def neighbours(vectors: DataFrame, k: int, threshold: float = -1.0, weight: float = 0.0, block_rows: int | None = None) -> DataFrame:
    """[SIM1, JN29, TOP4, SCL-N5-N8] (src, dst, score, rank): each id's k most similar others at or over threshold, ties by id.

    vectors: (id, vector), for weight > 0 also terms and weights, none below 0. Rows are dealt to blocks by hash and
    packed; each pair of blocks is a task that multiplies in tiles and keeps k rows for each id. So nothing grows with
    the table but the number of tasks, and a vector is copied as often as there are blocks. k = 0 keeps all at or over
    threshold.
    """
    spark = vectors.sparkSession
    w = max(0.0, min(1.0, weight))
    # terms are larger than vectors; where they weigh much, vectors leave out little
    block_rows = block_rows or (BLOCK_ROWS if w == 0 else BLOCK_ROWS // 4 if w <= 0.25 else 2048)
    own = vectors.where("id IS NOT NULL AND vector IS NOT NULL")
    n = own.count()
    blocks = max(1, math.ceil(n / block_rows), min(SIDE, n // LEAST))
    short = vectors.schema["vector"].dataType.elementType.simpleString() == "float"
    dealt = own.select("id", F.col("vector").cast("array<float>" if short else "array<double>").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), *(["terms", "weights"] if w > 0 else []))
    ident = vectors.schema["id"].dataType.simpleString()
    schema = f"blk int, ids array<{ident}>, width int, v binary"
    if w > 0:
        # 64 bits of a term stand for it
        dealt = dealt.withColumns({"terms": F.transform("terms", lambda t: F.xxhash64(t)), "weights": F.col("weights").cast("array<double>")})
        schema += ", lens binary, names binary, terms binary, weights binary"
    with batches_of(spark, 4096):
        packs = written(dealt.repartition(min(blocks, 1024), "blk").sortWithinPartitions("blk").mapInArrow(_packed, schema), "packs")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # as many tasks as pairs of blocks and more, however few bytes they read; pairs of large blocks seldom share one
    tasks = min((2 if blocks <= SIDE else 8) * blocks * blocks, 4096)
    left = packs.withColumnRenamed("blk", "i").withColumn("j", others).repartition(tasks, "i", "j")
    right = packs.withColumnRenamed("blk", "rj").withColumn("ri", others).repartition(tasks, "ri", "rj")

    def products(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        kind = (x if len(x) else y).schema.field("ids").type.value_type
        out = [pa.table({"src": pa.array([], kind), "dst": pa.array([], kind), "score": pa.array([], pa.float64())})]
        if len(x) and len(y):
            a = _Block(x, "f4" if short else "f8")
            same = key[0].as_py() == key[1].as_py()  # an id's rows are dealt to one block
            b = a if same else _Block(y, "f4" if short else "f8")
            out += [pa.table({"src": a.ids.take(pa.array(r)), "dst": b.ids.take(pa.array(c)), "score": score}) for r, c, score in _nearest(a, b, same, k, threshold, w)]
        return pa.concat_tables(out).combine_chunks()

    found = left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInArrow(products, f"src {ident}, dst {ident}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def edges(ranked: DataFrame, symmetrize: str = "or") -> DataFrame:
    """[SIM1-SIM4, SET4] (source, target, score), source < target. 'or': either end ranks the other; 'lower': the smaller id ranks the larger."""
    if symmetrize == "lower":
        return ranked.where("src < dst").select(F.col("src").alias("source"), F.col("dst").alias("target"), "score")
    return ranked.groupBy(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).agg(F.max("score").alias("score"))


def sweep(ranked: DataFrame, thresholds: list[float], ks: list[int]) -> DataFrame:
    """[SIM2] (threshold, top_k, source, target, score) of each cell of the grid, from neighbours ranked once; the grid is a few literal rows."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("top_k")) for t in thresholds for k in ks]))
    cells = ranked.where("src < dst").withColumn("g", grid).where("score >= g.threshold AND rank <= g.top_k")
    return cells.select("g.threshold", "g.top_k", F.col("src").alias("source"), F.col("dst").alias("target"), "score")
