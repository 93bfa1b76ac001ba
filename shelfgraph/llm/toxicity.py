r"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 code points of the lower-cased word with
edge marks, hashed to 2**18 rows, FNV-1a over code points); a window of twelve words is the mean of its
words; a softmax over two classes reads the window. Vectors and softmax are trained together by Adagrad, so
misspellings never seen share the vectors of the n-grams they keep. Labels are of documents, so training is
multiple-instance: windows first bear their document's label, then those of toxic documents that the model
finds clean are dropped and training goes on. A document's score is its most toxic window's, through a
logistic calibration on the training documents.

Since the softmax is linear, a word's share is one number; tasks get the trained table as two numbers a row
folded into one and keep a bounded memo of words. Training uses at most `most` labelled rows of each class,
least hash of id first (a documented bound); scoring reads whole texts of all rows.

Defined results: null and blank texts are scored like a window without words (the prior); rows without a
label only get a score; without labels of both classes every score is the share of toxic labels, or 0; rows without an id
are scored, never learnt from; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.shared import map_batches

ROWS = 1 << 18
DIM = 8
WINDOW = 12
GRAMS = (3, 4, 5)
MOST = 1500
MEMO_WORDS = 400_000


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of words, one after the other, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # code points to the end of the word
    found, owner = [], []
    for n in GRAMS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, 14695981039346656037 + n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * np.uint64(1099511628211)
        ok = left[:m] >= n
        found.append(((h[ok] ^ (h[ok] >> np.uint64(29))) % np.uint64(ROWS)).astype(np.int64))
        owner.append(word[:m][ok])
    rows, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return rows[order], np.bincount(own, minlength=len(words))


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; one that repeats the word before it is left out, so that a run of one word doesn't fill a window."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, ["", *words]) if w != before]  # noqa: B905


def window_starts(n_words: int) -> np.ndarray:
    """Windows of WINDOW words, half overlapping; the last may be shorter."""
    return np.arange(0, max(1, n_words - WINDOW // 2), WINDOW // 2)


class Model:
    """weight: each n-gram row's share of the logit; bias; slope and level of the documents' calibration."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, level: float):
        self.weight, self.bias, self.slope, self.level = weight.astype(np.float32), bias, slope, level
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.weight, self.bias, self.slope, self.level

    def __setstate__(self, state):
        self.__init__(*state)

    def word_shares(self, words: list[str]) -> np.ndarray:
        rows, counts = gram_rows(words)
        sums = np.bincount(np.repeat(np.arange(len(words)), counts), weights=self.weight[rows], minlength=len(words))
        return sums / np.maximum(counts, 1)

    def window_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.array([self.bias])
        share = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words)))])
        a = window_starts(len(words))
        b = np.minimum(a + WINDOW, len(words))
        return self.bias + (share[b] - share[a]) / (b - a)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The most toxic window's logit of each text."""
        docs = [words_of(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        new = list(set().union(*docs) - self.memo.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.memo.update(zip(part, self.word_shares(part).tolist(), strict=True))
        return np.array([self.window_logits(d).max() for d in docs])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.level, -40, 40)))


class _Trainer:
    """Table and softmax by Adagrad over windows; a word's vector is the mean of its n-grams' vectors."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows, counts = gram_rows(vocabulary)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.table = (rng.random((ROWS, DIM), dtype=np.float32) - 0.5) / DIM
        self.square = np.full((ROWS, 1), 1e-6, np.float32)
        self.out = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.out_square = np.full((DIM, 2), 1e-6, np.float32)

    def shares(self) -> np.ndarray:
        return self.table @ (self.out[:, 1] - self.out[:, 0])

    def epoch(self, windows: np.ndarray, label: np.ndarray, order: np.ndarray, rate: float, batch: int = 512) -> None:
        """windows: vocabulary indexes, -1 beyond a window's end."""
        for at in range(0, len(order), batch):
            w = windows[order[at : at + batch]]
            y = label[order[at : at + batch]]
            inside = w >= 0
            size = inside.sum(axis=1)
            used, slot = np.unique(w[inside], return_inverse=True)
            n = self.start[used + 1] - self.start[used]
            grams = np.repeat(self.start[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows = self.rows[grams]
            word = np.add.reduceat(self.table[rows], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
            window = np.repeat(np.arange(len(w)), size)
            share = (1.0 / size)[window].astype(np.float32)
            mean = np.zeros((len(w), DIM), np.float32)
            np.add.at(mean, window, word[slot] * share[:, None])
            z = mean @ self.out + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(w)), y] -= 1
            g_mean = p @ self.out.T
            g_out = mean.T @ p / len(w)
            g_word = np.zeros((len(used), DIM), np.float32)
            np.add.at(g_word, slot, g_mean[window] * share[:, None])
            g_rows = np.repeat(g_word / n[:, None], n, axis=0)
            distinct, at_row = np.unique(rows, return_inverse=True)
            g = np.zeros((len(distinct), DIM), np.float32)
            np.add.at(g, at_row, g_rows)
            self.square[distinct] += (g**2).mean(axis=1, keepdims=True)
            self.table[distinct] -= rate * g / np.sqrt(self.square[distinct])
            self.out_square += g_out**2
            self.out -= rate * g_out / np.sqrt(self.out_square)
            self.bias -= 0.1 * rate * p.mean(axis=0)


def fit(texts: list[str], labels: list[int], rounds: int = 4, rate: float = 0.1, seed: int = 7, clean_windows: int = 16_000, share: float | None = None) -> Model:
    """Model from labelled texts. A round trains on toxic documents' windows and on clean_windows clean ones, half of them those scored worst so far. share: of toxic documents among all labelled ones, if texts are a balanced choice."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = (float(y.mean()) if len(y) else 0.0) if share is None else share
        return Model(np.zeros(ROWS), 0.0, 0.0, float(np.log(max(share, 1e-18) / max(1 - share, 1e-18))))
    docs = [words_of(t) for t in texts]
    vocabulary = sorted(set().union(*docs))
    index = {w: i for i, w in enumerate(vocabulary)}
    rows, owner = [], []
    for d, words in enumerate(docs):
        ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        n = -(-len(ids) // WINDOW)
        rows.append(np.pad(ids, (0, n * WINDOW - len(ids)), constant_values=-1).reshape(n, WINDOW))
        owner.append(np.full(n, d))
    windows, owner = np.concatenate(rows), np.concatenate(owner)
    label, inside = y[owner], windows >= 0
    trainer, rng = _Trainer(vocabulary, seed), np.random.default_rng(seed)
    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    logit = np.zeros(len(windows))
    for k in range(rounds):
        hard = clean[np.argsort(-logit[clean], kind="stable")[: clean_windows // 2]] if k else clean[:0]
        live = np.concatenate([toxic, rng.permutation(clean)[: clean_windows - len(hard)], hard])
        trainer.epoch(windows, label, rng.permutation(live), rate)
        each = trainer.shares()
        word = np.add.reduceat(each[trainer.rows], trainer.start[:-1]) / np.diff(trainer.start)
        logit = np.where(inside, word[windows], 0).sum(axis=1) / inside.sum(axis=1) + trainer.bias[1] - trainer.bias[0]
        # a toxic document keeps its worst window and those worse than nearly all clean windows
        worst = np.full(len(docs), -np.inf)
        np.maximum.at(worst, owner, logit)
        line = np.quantile(logit[clean], 0.999)
        toxic = np.flatnonzero((label == 1) & ((logit >= worst[owner]) | (logit > line)))
    model = Model(trainer.shares(), float(trainer.bias[1] - trainer.bias[0]), 1.0, 0.0)
    model.slope, model.level = _calibrate(model.logits(texts), y)
    if share is not None and 0 < share < 1:
        model.level += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    model.memo = {}
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, with targets drawn in (Platt)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, scale = float(np.median(x)), float(x.std()) or 1.0
    z = np.stack([(x - mid) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - t) + 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return float(w[0] / scale), float(w[1] - w[0] * mid / scale)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> tuple[list, float]:
    """((text, label) of at most `most` labelled rows of each class, least hash of the id first), and the share of 1 among all labels."""
    own = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    share = own.agg(F.avg("y")).first()[0] or 0.0
    picked = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * most rows
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(F.broadcast(picked), "id").select("id", "t", "y")
    return [(r["t"] or "", r["y"]) for r in sorted(found.collect(), key=lambda r: (r["id"], r["y"], r["t"] or ""))], float(share)


def _score(model):
    def make():
        own = model.value

        def each(batch):
            return [batch.column(0), pa.array(np.clip(own.scores(batch.column(1).to_pylist()), 0, 1), pa.float64())]

        return each

    return make


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS numbers
    return map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), _score(shared), "doc_id long, score double")
