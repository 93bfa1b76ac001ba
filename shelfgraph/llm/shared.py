"""What the Arrow operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, prefix: str) -> str:
    """prefix, with underscores before it until no column of df starts so."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str, most: int = 32 << 20) -> DataFrame:
    """df through make()(batch), which returns columns of schema. make runs once for each task;
    batches come in slices of about `most` bytes.

    make must be a function of a module, so that tasks import it instead of receiving a copy.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in sliced(batch, most):
                cols = each(part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        del each
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives free memory back to the system: a Python worker outlives its task and idles beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sliced(batch: pa.RecordBatch, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes, one row at least, so that long texts don't multiply memory."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)
