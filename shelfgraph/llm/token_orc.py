r"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id and sorted in each partition, so each file holds a run of ids and file
and stripe statistics prune by id; a Bloom filter answers point look-ups inside the run. `before` is the
number of tokens that its task wrote before a document, so a document's global start is its file's base (from a
sum over one small row a file, sent to all tasks up to MOST_FILES) plus `before`. Stripes are read in parallel by Spark's ORC reader.

Ids come from the tokenizers library: a text is cut at special tokens and at spaces that begin a word (where
a byte-level file always splits), and the library's BPE model encodes each distinct piece of a batch; a memo of two
generations of bounded size keeps pieces already encoded by the worker. Texts with characters on whose class Unicode
versions disagree are encoded by the library whole.

Defined results: a null text is encoded as an empty one and holds the end id alone; null document ids sort
first; rows with equal ids stay in one file, ordered by a hash of their text; long texts are encoded whole;
an empty table gives no files' rows and an empty result; further columns of docs aren't stored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgraph.llm.bpe import KNOWN, byte_alphabet
from shelfgraph.llm.shared import map_batches
from shelfgraph.session import batches_of, shared_path, written

END_ID = 0
FORMAT = "doc_id long, n_tokens long, before long, ids array<int>"
#: How byte-level files split text.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO_PIECES, MEMO_UNITS = 300_000, 300_000
BATCH_ROWS = 5000  # rows sent to a worker at once
MOST_FILES = 1_000_000  # rows of 16 bytes sent to all tasks
#: Stands for a unit that must be split together with what surrounds it.
LOOSE = b"loose"


class _Memo(dict):
    """Values by key, made where they lack. Two generations: once `most` keys are held, those not asked for again go."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class ByteEncoder:
    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, memo_units: int = MEMO_UNITS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = {s: np.array([self.library.token_to_id(s)], "<u4").tobytes() for s in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.space = self.alphabet[32]
        self.words, self.units = _Memo(self._pretoken, memo_pieces), _Memo(self._unit, memo_units)

    def _pretoken(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            plain = word.replace(" ", self.space)
        else:
            plain = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """What follows a space up to the next; LOOSE if the space before it doesn't begin a word."""
        if unit.isalpha():
            return self._pretoken(" " + unit)
        if not unit or unit[0].isspace():
            return LOOSE
        return self._text(" " + unit)

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, BYTE_LEVEL.findall(text)))

    def _whole(self, text: str) -> bytes:
        """A text with special tokens, rare characters or runs of white space."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part and KNOWN.search(part):
                out.append(np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
            elif part:
                out.append(self._text(part))
        return b"".join(out)

    def _odd(self, text: str) -> bool:
        return (not text.isascii() and KNOWN.search(text) is not None) or any(s in text for s in self.special)

    def encode_lists(self, texts: pa.StringArray, end_id: int | None = None) -> pa.ListArray:
        """Ids of each text, with end_id behind them. Texts are split at spaces and each distinct unit is encoded once."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        whole = texts.to_pylist()
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy()
        at = at - at[0]
        coded = split.flatten().dictionary_encode()
        del split
        code, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del coded
        begins = np.zeros(len(code), bool)
        begins[at[:-1]] = True  # a text's first piece follows no space
        rest = np.zeros(len(known), bool)
        rest[code[~begins]] = True
        units = [self.units[u] if r else b"" for u, r in zip(known, rest.tolist(), strict=True)]
        loose = np.fromiter((u is LOOSE for u in units), bool, len(units))
        slow = np.fromiter(map(self._odd, whole), bool, len(whole))
        if loose.any():
            slow[np.searchsorted(at, np.flatnonzero(loose[code] & ~begins), side="right") - 1] = True
        heads = [self._whole(t) if s else self._text(t[: len(known[c])]) for t, s, c in zip(whole, slow.tolist(), code[at[:-1]].tolist(), strict=True)]
        # each text: its head (all of it, if slow), its other units, its end
        values = [*(b"" if u is LOOSE else u for u in units), *heads, *([np.array([end_id], "<u4").tobytes()] if end_id is not None else [])]
        del whole, known, units, heads
        # places fit 32 bits, as the offsets of the result do
        size = np.fromiter(map(len, values), np.int32, len(values)) >> 2
        begin = np.cumsum(size, dtype=np.int32) - size
        chosen, count = code.copy(), np.diff(at)
        chosen[at[:-1]] = np.arange(len(loose), len(loose) + len(slow))
        if slow.any():
            chosen, count = chosen[begins | ~np.repeat(slow, count)], np.where(slow, 1, count)
        if end_id is not None:
            chosen, count = np.insert(chosen, np.cumsum(count), len(values) - 1), count + 1
        n = size[chosen]
        upto = np.cumsum(n, dtype=np.int32)
        place = np.repeat(begin[chosen] - (upto - n), n)
        place += np.arange(len(place), dtype=np.int32)
        flat = np.frombuffer(b"".join(values), "<i4")[place]
        offsets = np.concatenate([[0], upto[np.cumsum(count) - 1]]).astype(np.int32)
        self.words.age()
        self.units.age()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.array(x.as_py(), "<u4").tobytes() for x in self.encode_lists(pa.array(texts, pa.string()))]


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _encode(path: str, end_id: int):
    def make():
        own, before = encoder(path), 0

        def each(batch):
            nonlocal before
            ids = own.encode_lists(batch.column(1), end_id)
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            return [batch.column(0), pa.array(sizes), pa.array(starts), ids]

        return each

    return make


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes docs into ORC files at path, ascending by id; returns path."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = map_batches(ordered, _encode(tokenizer, end_id), FORMAT, 10 << 20)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        (
            rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
            .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path)
        )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids. A filter on doc_id prunes files, stripes and row groups."""
    rows = spark.read.schema(FORMAT).orc(path).withColumn("__file", F.xxhash64("_metadata.file_path"))
    files = rows.groupBy("__file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.min("before").alias("low"))
    # a row a file, over which the one window runs; a task may have written several files
    before = Window.orderBy("first", "low").rowsBetween(Window.unboundedPreceding, -1)
    base = written(files.select("__file", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("__base")), "tokens-files")
    base = F.broadcast(base) if base.count() <= MOST_FILES else base
    return rows.join(base, "__file").select("doc_id", (F.col("__base") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums():
    """For map_batches: (doc_id, start, n_tokens, ids) to the same with the ids' crc32."""

    def each(batch):
        ids = batch.column(3)
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        offsets = ids.offsets.to_numpy()
        return [*(batch.column(i) for i in range(3)), [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]]

    return each


def token_digests(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes docs' tokens, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    at = write_tokens(docs, tokenizer, path or shared_path(spark, "tokens-orc"))
    return map_batches(read_tokens(spark, at), checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
