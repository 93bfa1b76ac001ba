r"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once; its top bits choose a bin, the bin keeps its least hash. An empty bin
borrows from the first non-empty bin of its own random order of bins (Shrivastava, 2017), the same for every
text. A fingerprint stores the low BITS of each bin; the share of equal bins, m, overstates likeness by the
chance matches of BITS bits, so likeness is (m - 2**-BITS) / (1 - 2**-BITS), cut to 0 .. 1 (Li, Koenig, 2010).

Defined results: null and blank texts have the empty fingerprint, of likeness 1 to itself and 0 to others;
fewer than five words make one shingle; equal texts have equal fingerprints; texts are hashed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.shared import map_batches

BINS = 512
BITS = 4
SHINGLE = 5
RUN_BYTES = 64 << 20

_orders: dict[int, np.ndarray] = {}


def bin_orders(bins: int) -> np.ndarray:
    """For each bin a random order of all bins, the same everywhere."""
    if bins not in _orders:
        rng = np.random.default_rng(20170)
        _orders[bins] = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
    return _orders[bins]


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (Stafford's mix 13)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return _mix(h)


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low bits of each bin's least shingle hash, mixed with the bin; no bins for a text without words."""
    h = shingle_hashes(text or "")
    if not len(h):
        return np.zeros(0, np.uint8)
    h.sort()
    at = (h >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    full = np.zeros(bins, bool)
    value = np.zeros(bins, np.uint64)
    full[at[first]] = True
    value[at[first]] = h[first]
    empty = np.flatnonzero(~full)
    orders, k, step = bin_orders(bins), 0, 8
    while len(empty):
        tried = orders[empty, k : k + step]
        hit = full[tried]
        found = hit.any(axis=1)
        value[empty[found]] = value[tried[found, hit[found].argmax(axis=1)]]
        empty, k, step = empty[~found], k + step, step * 2
    # the bin is mixed in, so that bins that borrow one hash still match another text's by chance one by one
    low = _mix(value ^ (np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(2**bits - 1)
    return low.astype(np.uint8)


def packed(value: np.ndarray, bits: int = BITS) -> str:
    """Lowercase hex of the bins' low bits."""
    return np.packbits(np.unpackbits(value[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes().hex() if len(value) else ""


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of two texts' shingle sets from their fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-bits
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def edited_text(text: str, following: str) -> str:
    """text with its last half (floor) of code points replaced by as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (run, borrowed, doc_id, text, tie) whose partitions hold whole runs of ids, each with the head of the next run behind it.

    Runs cut the id range at quantiles; the head of a run (its largest id) is copied to the run above, the
    last run's successor being the first. One shuffle moves each text once; the driver sees a row a run.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("__at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a run holds some RUN_BYTES of text, however large the table
    runs = max(4 * dealt, (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RUN_BYTES)
    cuts = own.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / runs for i in range(1, runs)], 0.25 / runs)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        own = Bucketizer(splits=splits, inputCol="__at", outputCol="run").transform(own)
    else:
        own = own.withColumn("run", F.lit(0.0))
    heads = own.select("run", "doc_id").groupBy("run").agg(F.max("doc_id").alias("head")).orderBy("run").collect()
    to = {r["run"]: heads[(i + 1) % len(heads)]["run"] for i, r in enumerate(heads)}
    small = spark.createDataFrame([(r["run"], r["head"], to[r["run"]]) for r in heads], "run double, head long, to double")
    placed = own.join(F.broadcast(small), "run").withColumn("x", F.expr("explode(CASE WHEN doc_id <=> head THEN array(named_struct('r', run, 'b', 0), named_struct('r', to, 'b', 1)) ELSE array(named_struct('r', run, 'b', 0)) END)"))
    rows = placed.select(F.col("x.r").alias("run"), F.col("x.b").alias("borrowed"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    spread = rows.repartition("run") if runs == 4 * dealt else rows.repartition(runs, "run")
    return spread.sortWithinPartitions("run", "borrowed", F.col("doc_id").desc_nulls_last(), "tie")


FORMAT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_next():
    """For map_batches on with_next: a row of FORMAT for each own row."""
    held: list = []  # an own row that waits for the text after it: run, doc_id, text, fingerprint

    def each(batch):
        out: list = []
        for run, borrowed, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if borrowed and not held:
                continue
            f = fingerprint(text)
            if held:
                _, last_id, last_text, last_f = held
                edited = edited_text(last_text, text)
                e = fingerprint(edited)
                out.append((last_id, len(last_text), hashlib.sha256(edited.encode()).hexdigest(), packed(last_f), packed(e), likeness(last_f, e), likeness(last_f, f)))
            held[:] = [] if borrowed else [run, i, text, f]
        return list(zip(*out, strict=True)) if out else [[]] * 7

    return each


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its edited text, their likeness and that to the next row in descending id order."""
    return map_batches(with_next(docs, doc_id, text), compare_next, FORMAT)


def _only():
    def each(batch):
        return [batch.column(0), [packed(fingerprint(t)) for t in batch.column(1).to_pylist()]]

    return each


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint for each row."""
    return map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), _only, "doc_id long, fingerprint string")
