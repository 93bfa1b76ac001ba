r"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's word shingles. Covering masks
(Pagh, 2016): each of the 64 bit places gets a vector m(i) <> 0 of radius + 1 bits; the mask of table v keeps
the places with <m(i), v> = 1. Up to `radius` differing places span at most `radius` dimensions, so some
v <> 0 is orthogonal to them all and its mask hides exactly those places: every pair within the radius shares
a bucket of one of the 2 ** (radius + 1) - 1 tables, with no false negatives.

Equal fingerprints become one node first. Buckets are then sorted by range partitions, so a bucket of any
size is spread over tasks, and sorted neighbours within the radius are linked; the components of those links
leave few labels in a bucket. An exact pass then joins bucket mates of different labels with the distance in
the join condition, so links between all labels are found while pairs inside a group are never made. Nothing
but counts reaches the driver.

Defined results: null and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle of them all; repeated rows share a component; null ids take part in linking but
never name a component unless it has no other id; an empty table gives none; further columns are untouched.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.shared import fresh, map_batches
from shelfgraph.operators.components import connected_components
from shelfgraph.session import written

SHINGLE = 3
RADIUS = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def make():
        def each(batch):
            return [batch.column(0), batch.column(1), pa.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], pa.int64())]

        return each

    return make


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp for each row."""
    own = docs.select(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.col(text))
    return map_batches(own, _fingerprints(shingle), "doc_id long, text_hash long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 11) -> list[int]:
    """Signed masks; vectors are dealt evenly over the bit places in an order fixed by seed."""
    dims = radius + 1
    vectors = [1 + i % (2**dims - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    masks = []
    for v in range(1, 2**dims):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _neighbours(radius: int):
    def make():
        last: list = []

        def each(batch):
            t, b, f = (batch.column(i).to_numpy() for i in range(3))
            if last:
                t, b, f = (np.concatenate([[x], y]) for x, y in zip(last, (t, b, f), strict=True))
            last[:] = [t[-1], b[-1], f[-1]] if len(t) else last
            near = (t[1:] == t[:-1]) & (b[1:] == b[:-1]) & (np.bitwise_count(f[1:].view(np.uint64) ^ f[:-1].view(np.uint64)) <= radius)
            return [f[:-1][near], f[1:][near]]

        return each

    return make


def fingerprint_components(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, label): label names the component of fp among nodes' distinct fp, by links of at most radius differing bits."""
    masks = covering_masks(radius)
    tables = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks)])).alias("x")).select("x.t", "x.bucket", "fp")
    ordered = tables.repartitionByRange("t", "bucket", "fp").sortWithinPartitions("t", "bucket", "fp")
    chain = map_batches(ordered, _neighbours(radius), "src long, dst long").distinct()
    first = written(connected_components(chain), "simhash-chains")
    label = F.coalesce("component", "fp").alias("label")
    labelled = nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", label)
    labelled = written(labelled, "simhash-labels")
    spread = labelled.select("fp", "label", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks)])).alias("x")).select("x.t", "x.bucket", "fp", "label")
    mixed = spread.groupBy("t", "bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("t", "bucket")
    open_ = written(spread.join(mixed, ["t", "bucket"]), "simhash-open")
    x, y = open_.alias("x"), open_.alias("y")
    links = x.join(y, F.expr(f"x.t = y.t AND x.bucket = y.bucket AND x.label < y.label AND bit_count(x.fp ^ y.fp) <= {int(radius)}"))
    second = connected_components(links.select(F.col("x.label").alias("src"), F.col("y.label").alias("dst")).distinct())
    return labelled.join(second.withColumnRenamed("node", "label"), "label", "left").select("fp", F.coalesce("component", "label").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, component_id and first (the component's first row as a struct of doc_id and text_hash) for each row."""
    rows = written(fingerprints(docs, doc_id, text, shingle), "simhash-fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    nodes = written(nodes, "simhash-nodes")
    labels = written(fingerprint_components(nodes.select("fp"), radius), "simhash-components")
    of_label = nodes.join(labels, "fp").groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    found = labels.join(of_label, "label").select("fp", "component_id", "first")
    return rows.join(found, "fp").select("doc_id", "text_hash", "fp", "component_id", "first")


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each component (least id, then least text hash), with docs' columns."""
    p = fresh(docs, "__sh_")
    firsts = near_duplicates(docs, doc_id, text).select("first").distinct().select(F.col("first.doc_id").alias(f"{p}id"), F.col("first.text_hash").alias(f"{p}hash"))
    keyed = docs.withColumn(f"{p}key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = keyed.join(firsts, keyed[doc_id].cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}hash")), "left_semi")
    one = Window.partitionBy(doc_id, f"{p}key").orderBy(doc_id)
    return kept.withColumn(f"{p}row", F.row_number().over(one)).where(f"{p}row = 1").select(*docs.columns)
