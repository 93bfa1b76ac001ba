"""Sentence embeddings by an encoder that the caller names."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64


def hashed_words(texts: list[str], size: int = 256) -> np.ndarray:
    """A stand-in encoder without a model: signed counts of hashed words, of unit length."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for r, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[r, h % size] += 1 if h >> 31 else -1
    n = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(n == 0, 1, n)


def embed(docs: DataFrame, encoder: str = "shelfgraph.operators.embedding:hashed_words", doc_id: str = "id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """[TXT4] (id, vector of floats) of texts that aren't blank, `batch` at a time. encoder: "module:function" from a list of texts to a matrix; each task loads it once."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("trim(text) <> ''")
    module, name = encoder.split(":")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = getattr(importlib.import_module(module), name)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["id", "vector"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, vector array<float>")
