r"""Line dedup by an exact set-similarity join (prefix, positional and length filters, verified Jaccard).

A line is the set of its words (ASCII lower case). Lines with equal sets are one set that stands where it
first occurs (by doc_id, nulls last, then text hash and line number). Words are ordered by rarity; two sets
with Jaccard >= 4/5 share one of the first n - ceil(4n/5) + 1 words, so only those are entries. A line goes
if its set occurred before, or if an earlier set is similar (its removal doesn't matter: earlier is enough).

Rarity comes from counts of word hashes in 2**SKETCH_BITS cells over the lines (a line that a task has met is
counted once), summed in blocks and broadcast as one byte a cell (16 MB, whatever the corpus). Cells only order
words and drop those that occur once, which nothing can match; a full sketch costs speed, not results.

Entries are dealt by word and sorted by word and set size, once. One pass over the sorted entries (equal sets side by side) compares each
with those of its word inside the size window, LONG of them, and emits the pairs that also pass the positional
filter and a parity filter (64 or 128 parities of a set's words differ in at most as many bits as the sets in words). An
entry emits at most FEW pairs and the one with its earliest partner, so a group of near copies costs a few rows a
member. Sets with more partners, or with a window beyond LONG, are remembered; those among them that no emitted
pair settles are joined with all entries of their words, so that no pair is lost (only entries that pass a Bloom
filter of these words are dealt again, with 512 parities of their sets). Words of pairs are fetched in
a pass over the documents that hold them, found through Bloom filters sized by their number, and Jaccard is
counted on 64-bit hashes (of a word's bytes, eight at a time, each step mixed; words over a kilobyte by BLAKE2b).

Defined results: lines without words are kept; null texts stay null; a text all of whose lines go becomes
empty; of repeated rows (same id and text) one keeps its lines; long texts are treated whole; an empty table
gives none; columns besides text and n_chars are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.shared import fresh, map_batches, release, sliced
from shelfgraph.session import batches_of, dropped, tidy, written

NUM, DEN = 4, 5  # Jaccard >= NUM / DEN
SKETCH_BITS = 24
MOST_BLOOM_BITS = 28
BLOCK = 1 << 16
SEEN_SETS = 150_000
SLICE = 2 << 20  # bytes of text at once
FEW = 4
LONG = 1024
WIDE = 32  # words from which on a set's name is its parities
ROWS = 1 << 18  # entries compared at once
MOST_SENT = 200_000  # rows of 16 bytes
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(int(c in b"\t\n\v\f\r ") for c in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOW = (1 << 24) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (Stafford's mix 13)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of raw (ASCII lower case, ASCII white space; raw begins and ends with a line feed) and where it starts."""
    blank = np.frombuffer(raw.translate(_BLANK), np.uint8)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    low = raw.translate(_LOWER) + bytes(8)
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # eight bytes from each place on
    h = eight[start] & _MASK[np.minimum(size, 8)]
    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rest, at = np.flatnonzero((size > 8) & (size <= 1024)), 8
    while len(rest):
        left = size[rest] - at
        h[rest] = _mix((h[rest] ^ (eight[start[rest] + at] & _MASK[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(size > 1024).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return h, start


class _Lines:
    """Words of the lines of some texts: hashes h, and of each line with words its first word, number of words, text and line number."""

    def __init__(self, texts: pa.Array):
        held = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        raw = b"\n".join([b"", *held, b""])
        self.h, start = _hashes(raw)
        feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        first = np.searchsorted(start, feeds)
        words = np.diff(first)
        at = np.flatnonzero(words)
        self.first, self.words = first[:-1][at], words[at]
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)])[:-1]
        line = np.searchsorted(feeds, begin)  # each text's first line
        self.text = np.searchsorted(line, at, side="right") - 1
        self.number = (at - line[self.text]).astype(np.int32)

    def names(self) -> np.ndarray:
        """Order-free hash of each line's words, repeats included: cheaper than the set's."""
        return np.add.reduceat(_mix(self.h), self.first) if len(self.first) else np.zeros(0, np.uint64)


class _Sets:
    """Word sets of the lines of some texts, in line order: hashes h, start and size of each set, its text and line number."""

    def __init__(self, texts: pa.Array, codes: np.ndarray | None = None, bits: int = 0):
        lines = _Lines(texts)
        h, rank = lines.h, np.repeat(np.arange(len(lines.first)), lines.words)
        self.text, self.number = lines.text, lines.number
        code = codes[(h >> np.uint64(64 - bits)).astype(np.int64)] if codes is not None else np.zeros(len(h), np.uint8)
        # by line, rarity, hash
        key = (rank.astype(np.uint64) << np.uint64(40)) | (code.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(key)
        k, sorted_h = key[order], h[order]
        if len(lines.first) >= 1 << 24 or ((k[1:] == k[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():  # the key is too short for these
            order = np.lexsort((h, code, rank))
        h, rank, code = h[order], rank[order], code[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (rank[1:] != rank[:-1])
        self.h, self.code, rank = h[keep], code[keep], rank[keep]
        self.start = np.flatnonzero(np.diff(rank, prepend=-1))
        self.n = np.diff(np.append(self.start, len(self.h)))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that name each set. Sets of WIDE words or more: 128 parities of their words, each word counting
        in one; they differ in at most as many bits as the sets in words. Others: a sum of hashes, and the 128 parities
        folded to 64."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bit = np.uint64(1) << (self.h >> np.uint64(7) & np.uint64(63))
        high = (self.h >> np.uint64(13) & np.uint64(1)).astype(bool)
        zero = np.uint64(0)
        a, b = (np.bitwise_xor.reduceat(x, self.start) for x in (np.where(high, zero, bit), np.where(high, bit, zero)))
        wide = self.n >= WIDE
        return np.where(wide, b, np.add.reduceat(_mix(self.h), self.start)).view(np.int64), np.where(wide, a, a ^ b).view(np.int64)


    def signs(self) -> list[np.ndarray]:
        """512 parities of each set's words in eight numbers: nearly the difference itself, for pairs that names alone can't tell."""
        if not len(self.start):
            return [np.zeros(0, np.int64)] * len(SIGNS)
        bit, part = np.uint64(1) << (self.h >> np.uint64(7) & np.uint64(63)), self.h >> np.uint64(13) & np.uint64(7)
        return [np.bitwise_xor.reduceat(np.where(part == np.uint64(k), bit, np.uint64(0)), self.start).view(np.int64) for k in range(len(SIGNS))]


def _count_cells(bits: int):
    def run(batches):
        total, seen = np.zeros(1 << bits, np.uint32), set()
        for batch in batches:
            for part in sliced(batch, SLICE):
                lines = _Lines(part.column(0))
                new = np.fromiter((x not in seen and not seen.add(x) for x in lines.names().tolist()), bool, len(lines.first))
                if len(seen) > SEEN_SETS:
                    seen.clear()
                cell = (lines.h[np.repeat(new, lines.words)] >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(total, cell, np.uint32(1))
        for block in range(max(1, (1 << bits) // BLOCK)):
            part = total[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                cells = np.concatenate([at.astype("<u2").view(np.uint8), part[at].astype("<u4").view(np.uint8)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells], pa.binary())], names=["block", "cells"])
        del total, seen
        release()

    return run


def _add_cells(key, rows):
    total = np.zeros(BLOCK, np.uint64)
    for cells in rows["cells"]:
        k = len(cells) // 6
        total[np.frombuffer(cells[: 2 * k], "<u2")] += np.frombuffer(cells[2 * k :], "<u4")
    # exact below 128, then eight steps for each doubling
    code = np.where(total < 128, total, np.minimum(255, 128 + 8 * np.log2(np.maximum(total, 128) / 128)))
    return pd.DataFrame({"block": [key[0]], "codes": [code.astype(np.uint8).tobytes()]})


def token_sketch(docs: DataFrame, text: str = "text", bits: int = SKETCH_BITS) -> np.ndarray:
    """One byte a cell: how often words of the cell occur (exact below 128, then by logarithm)."""
    cells = docs.select(text).mapInArrow(_count_cells(bits), "block int, cells binary")
    codes = np.zeros(1 << bits, np.uint8)
    with tidy(docs.sparkSession):
        blocks = cells.groupBy("block").applyInPandas(_add_cells, "block int, codes binary").collect()  # 2**bits bytes in all
    for row in blocks:
        part = np.frombuffer(row["codes"], np.uint8)[: len(codes)]
        codes[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return codes


SIGNS = [f"s{k}" for k in range(8)]
LINES = f"doc_id long, h long, line int, g1 long, g2 long, n int, {', '.join(f'{s} long' for s in SIGNS)}, prefix array<long>"
BATCH_ROWS = 2500  # rows sent to a worker at once
LAST = (1 << 63) - 1  # where null ids stand


def _index(sketch, bits: int):
    def make():
        codes, seen = sketch.value, {}

        def each(batch):
            s = _Sets(batch.column(2), codes, bits)
            if not len(s.start):
                return [[]] * (7 + len(SIGNS))
            g1, g2 = s.ids()
            at = pa.array(s.text)
            doc = batch.column(0).take(at)
            new = np.zeros(len(g1), bool)
            # a set already met by this task in an earlier document has no prefix of its own
            for i, (x, y, d) in enumerate(zip(g1.tolist(), g2.tolist(), doc.fill_null(LAST).to_pylist(), strict=True)):
                if d < seen.get((x, y), LAST + 1):
                    seen[x, y], new[i] = d, True
            if len(seen) > SEEN_SETS:
                seen.clear()
            place = np.arange(len(s.h)) - np.repeat(s.start, s.n)
            inside = (place < np.repeat(s.n - -(-NUM * s.n // DEN) + 1, s.n)) & (s.code > 1) & np.repeat(new, s.n)
            counts = np.add.reduceat(inside, s.start, dtype=np.int64)
            # the top 40 bits name the word to the join, which verification makes exact; the rest is the place
            items = ((s.h[inside] >> np.uint64(24) << np.uint64(24)) | np.minimum(place[inside], _LOW).astype(np.uint64)).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~new, False)), pa.array(items))
            return [doc, batch.column(1).take(at), pa.array(s.number), pa.array(g1), pa.array(g2), pa.array(s.n.astype(np.int32)), *s.signs(), prefix]

        return each

    return make


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def differing(n, m, a1, a2, b1, b2) -> np.ndarray:
    """In how many parities sets of sizes n, m and names (a1, a2), (b1, b2) differ, at least."""
    folded = _bits(np.where(n >= WIDE, a1 ^ a2, a2) ^ np.where(m >= WIDE, b1 ^ b2, b2))
    return np.where((n >= WIDE) & (m >= WIDE), _bits(a1 ^ b1) + _bits(a2 ^ b2), folded)


def passes(n, m, p, q, differ):
    """Length, positional and parity filters of two entries of sizes n, m at places p, q whose parities differ in so many bits."""
    need = NUM * (n + m)
    ok = (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ((NUM + DEN) * np.minimum(n - p, m - q) >= need) & ((NUM + DEN) * (n + m - differ) >= 2 * need)
    return ok | ((n == _LOW) & (m == _LOW))  # sizes beyond what an entry holds


PAIRS = "a1 long, a2 long, b1 long, b2 long"


class _Window:
    """Compares sorted entries (k: word and size, g1, g2, place, ord) with those of their word inside the size window, block by block.

    pairs() gives rows of PAIRS; where b is null, a has partners that were not emitted.
    """

    def __init__(self):
        self.held = [np.zeros(0, np.int64)] * 5
        self.count, self.best = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        self.cut = None  # the word whose window went beyond LONG

    def pairs(self, new: list[np.ndarray], last: bool) -> list[pa.Array]:
        old = len(self.held[0])
        k, g1, g2, p, ord_ = (np.concatenate([a, b]) for a, b in zip(self.held, new, strict=True))
        # equal sets of one word stand side by side: one entry, in the least document
        rows = np.arange(len(k))
        same = np.zeros(len(k), bool)
        same[1:] = (k[1:] == k[:-1]) & (g1[1:] == g1[:-1]) & (g2[1:] == g2[:-1])
        same[:old] = False
        again = k[old] >> 24 if same[old : old + 1].any() else None  # a held entry may stand in an earlier document than known
        if same.any():
            start = np.flatnonzero(~same)
            least = np.minimum.reduceat(ord_, start)
            k, g1, g2, p, ord_ = k[start], g1[start], g2[start], p[start], least
            rows = np.arange(len(k))
        t, n = k >> 24, k & _LOW
        first = np.maximum.accumulate(np.where(np.diff(t, prepend=t[:1] - 1) != 0, rows, 0)) if len(t) else rows
        place = rows - first
        count = np.zeros(len(k), np.int64)
        best = np.zeros((len(k), 3), np.int64)
        best[:, 2] = LAST
        count[:old], best[:old] = self.count, self.best
        cut = np.zeros(len(k), bool)
        for word in (self.cut, again):
            if word is not None:
                cut |= t == word
        out: list[tuple] = []
        i, d = rows[old:], 1
        while len(i) and d <= LONG:
            i = i[(place[i] >= d)]
            j = i - d
            inside = DEN * n[j] >= NUM * n[i]
            i, j = i[inside], j[inside]
            ok = passes(n[i], n[j], p[i], p[j], differing(n[i], n[j], g1[i], g2[i], g1[j], g2[j])) & ((g1[i] != g1[j]) | (g2[i] != g2[j]))
            x, y = i[ok], j[ok]
            late, tie = ord_[x] > ord_[y], ord_[x] == ord_[y]
            emit = np.zeros(len(x), bool)
            for a, b, mine in ((x, y, late | tie), (y, x, ~late)):
                a, b, = a[mine], b[mine]
                emit[mine] |= count[a] < FEW
                count[a] += 1
                sooner = ord_[b] < best[a, 2]
                best[a[sooner]] = np.stack([g1[b], g2[b], ord_[b]], axis=1)[sooner]
            out.append((g1[x[emit]], g2[x[emit]], g1[y[emit]], g2[y[emit]]))
            d += 1
        if len(i := i[place[i] >= d]):
            i = i[DEN * n[i - d] >= NUM * n[i]]
            cut |= np.isin(t, np.unique(t[i]))
        # entries of the last word that later ones may still meet stay
        stay = np.zeros(len(k), bool)
        if not last and len(k):
            stay = (t == t[-1]) & (DEN * n >= NUM * n[-1])
            more = np.flatnonzero(stay)
            if len(more) > LONG:
                stay[more[:-LONG]] = False
                cut |= t == t[-1]
        self.cut = t[-1] if len(t) and cut[-1] else None
        count[cut] = np.maximum(count[cut], FEW + 1)
        done = ~stay & (count > FEW)
        met = done & (best[:, 2] < LAST)
        out.append((g1[met], g2[met], best[met, 0], best[met, 1]))
        self.held = [c[stay] for c in (k, g1, g2, p, ord_)]
        self.count, self.best = count[stay], best[stay]
        a1, a2, b1, b2 = (np.concatenate(c) for c in zip(*out, strict=True))
        none = np.zeros(done.sum(), np.int64)
        mask = np.concatenate([np.zeros(len(b1), bool), np.ones(len(none), bool)])
        return [pa.array(np.concatenate([a1, g1[done]])), pa.array(np.concatenate([a2, g2[done]])), pa.array(np.concatenate([b1, none]), mask=mask), pa.array(np.concatenate([b2, none]), mask=mask)]


def _side_by_side(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Entries sorted by k, those of one k by g1 and g2 too."""
    k = cols[0]
    again = np.flatnonzero(k[1:] == k[:-1])
    tied = np.zeros(len(k), bool)
    tied[again] = tied[again + 1] = True
    at = np.flatnonzero(tied)
    order = at[np.lexsort((cols[2][at], cols[1][at], k[at]))]
    for c in cols:
        c[at] = c[order]
    return cols


def _compare(batches):
    window, held = _Window(), []

    def block(last):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64) for _ in range(5)]
        held.clear()
        if not last and (at := int(np.searchsorted(cols[0], cols[0][-1]))):  # a block ends where k changes, if it does
            held.append([c[at:] for c in cols])
            cols = [c[:at] for c in cols]
        return pa.RecordBatch.from_arrays(window.pairs(_side_by_side(cols), last), names=["a1", "a2", "b1", "b2"])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in range(5)])
        if sum(len(h[0]) for h in held) >= ROWS:
            yield block(False)
    yield block(True)
    del window
    release()


def _bloom_places(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    x, y = _mix(a.view(np.uint64)), _mix(b.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    return [((x + np.uint64(k) * y) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2, 3)]


def _places(bits: int):
    def make():
        def each(batch):
            return [np.concatenate(_bloom_places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))]

        return each

    return make


def _pack(key, rows):
    held = np.zeros(1024, np.int64)
    held[rows["w"].to_numpy() & 1023] = rows["m"]
    return pd.DataFrame({"block": [key[0]], "bits": [held.tobytes()]})


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of two-column keys: 2**bits bits, packed, collected in blocks of 8 KB."""
    words = map_batches(keys, _places(bits), "b long").groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("m"))
    held = np.zeros((1 << bits) // 64, np.int64)
    with tidy(keys.sparkSession):
        blocks = words.groupBy(F.shiftright("w", 10).alias("block")).applyInPandas(_pack, "block long, bits binary").collect()  # 2**bits / 8 bytes at most
    for row in blocks:
        held[row["block"] * 1024 : row["block"] * 1024 + 1024] = np.frombuffer(row["bits"], np.int64)
    return held.view(np.uint8)


def _in_bloom(held: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.all([held[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in _bloom_places(a, b, bits)], axis=0).astype(bool)


def _fetch(docs, sets, bits: int):
    def make():
        in_docs, in_sets, seen = docs.value, sets.value, set()

        def each(batch):
            key = batch.column(0).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(_in_bloom(in_docs, key, key, bits))))
            s = _Sets(batch.column(1))
            g1, g2 = s.ids()
            first = np.zeros(len(g1), bool)
            for i in np.flatnonzero(_in_bloom(in_sets, g1, g2, bits)).tolist():
                x = (int(g1[i]), int(g2[i]))
                if x not in seen:
                    seen.add(x)
                    first[i] = True
            if len(seen) > SEEN_SETS:
                seen.clear()
            offsets = np.concatenate([[0], np.cumsum(s.n[first])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.h[np.repeat(first, s.n)].view(np.int64)))
            return [pa.array(g1[first]), pa.array(g2[first]), tokens]

        return each

    return make


def _later(pairs: DataFrame, own: DataFrame, firsts: DataFrame) -> DataFrame:
    """(g1, g2) of the sets that are similar to the other, earlier set of a pair."""
    spark = own.sparkSession
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("g1"), F.col("a2").alias("g2")), F.struct(F.col("b1").alias("g1"), F.col("b2").alias("g2")))).alias("e")).select("e.g1", "e.g2").distinct()
    ends = written(ends.join(firsts, ["g1", "g2"]), "line-ends")
    bits = min(MOST_BLOOM_BITS, max(16, (8 * ends.count()).bit_length()))
    docs, sets = (spark.sparkContext.broadcast(_bloom(k, bits)) for k in (ends.select(F.col("first.h").alias("x"), F.col("first.h").alias("y")), ends.select("g1", "g2")))
    tokens = map_batches(own.select("h", "text"), _fetch(docs, sets, bits), "g1 long, g2 long, tokens array<long>", SLICE).groupBy("g1", "g2").agg(F.first("tokens").alias("tokens"))
    tokens = written(ends.join(tokens, ["g1", "g2"]).select("g1", "g2", "first", "tokens"), "line-tokens")
    side = lambda s: tokens.select(F.col("g1").alias(f"{s}1"), F.col("g2").alias(f"{s}2"), F.col("first").alias(f"{s}f"), F.col("tokens").alias(f"{s}t"))
    both = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).withColumn("i", F.size(F.array_intersect("at", "bt")))
    later = F.when(F.col("af") > F.col("bf"), F.struct(F.col("a1").alias("g1"), F.col("a2").alias("g2"))).otherwise(F.struct(F.col("b1").alias("g1"), F.col("b2").alias("g2")))
    out = written(both.where(f"{DEN} * i >= {NUM} * (size(at) + size(bt) - i)").select(later.alias("e")).select("e.g1", "e.g2").distinct(), "line-later")
    dropped(ends, tokens)
    docs.unpersist()
    sets.unpersist()
    return out


def _entries(lines: DataFrame, more: list[str] = ()) -> DataFrame:
    """(k, g1, g2, p, ord, *more): a row for each word of a prefix; k holds the word's 40 bits and the set's size."""
    size = F.least(F.col("n"), F.lit(_LOW)).cast("long")
    each = lines.select("g1", "g2", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), size.alias("n"), *more, F.explode("prefix").alias("x"))
    return each.select(F.expr("(x & ~16777215L) | n").alias("k"), "g1", "g2", F.expr("x & 16777215L").alias("p"), "ord", *more)


def _word(k: str):
    return F.shiftright(k, 24)


def _under(words, bits: int):
    """For map_batches: LINES with only those items of a prefix whose word may be among words."""

    def make():
        held = words.value

        def each(batch):
            prefix = batch.column(batch.num_columns - 1)
            items = prefix.flatten().to_numpy()
            word = items >> 24
            stay = _in_bloom(held, word, word, bits)
            size = np.diff(prefix.offsets.to_numpy())
            count = np.bincount(np.repeat(np.arange(len(size)), size)[stay], minlength=len(size))
            some = np.flatnonzero(count)
            offsets = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
            return [*(batch.column(c).take(pa.array(some)) for c in range(batch.num_columns - 1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[stay]))]

        return each

    return make


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, h, line): lines with words that stay; h is the hash of the text."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _kept_lines(docs, doc_id, text, sketch_bits)


def _kept_lines(docs: DataFrame, doc_id: str, text: str, sketch_bits: int) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(token_sketch(own, "text", sketch_bits))
    lines = written(map_batches(own, _index(sketch, sketch_bits), LINES, SLICE), "line-sets", **{"parquet.enable.dictionary": "false"})  # hashes hardly repeat
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "line")).alias("first")
    firsts = written(lines.groupBy("g1", "g2").agg(first), "line-firsts")
    sketch.unpersist()

    dealt = _entries(lines).repartition(_word("k")).sortWithinPartitions("k")  # one number: a radix sort
    found = written(dealt.mapInArrow(_compare, PAIRS), "line-pairs")
    gone = _later(written(found.where("b1 IS NOT NULL").distinct(), "line-pairs"), own, firsts)
    # sets with more partners than were emitted, if no emitted one settled them, meet all of their words' entries
    open_ = written(found.where("b1 IS NULL").select(F.col("a1").alias("g1"), F.col("a2").alias("g2")).distinct().join(gone, ["g1", "g2"], "left_anti"), "line-open")
    n_open = open_.count()
    if n_open:
        # a set's entries of several tasks become one, in its least document
        once = lambda df: df.groupBy("k", "g1", "g2", "p", *SIGNS).agg(F.min("ord").alias("ord"))
        few = (lambda df: F.broadcast(df)) if n_open <= MOST_SENT else (lambda df: df)
        x = written(once(_entries(lines.join(few(open_), ["g1", "g2"], "left_semi"), SIGNS)), "line-open")
        words = x.select(_word("k").alias("t")).distinct()
        bits = min(MOST_BLOOM_BITS, max(16, (8 * words.count()).bit_length()))
        known = spark.sparkContext.broadcast(_bloom(words.select("t", F.col("t").alias("u")), bits))
        # of all entries only those under these words are dealt
        y = once(_entries(map_batches(lines.where("prefix IS NOT NULL"), _under(known, bits), LINES, SLICE), SIGNS))
        n, m = "(x.k & 16777215L)", "(y.k & 16777215L)"
        need = f"{NUM} * ({n} + {m})"
        differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in SIGNS)
        ok = f"{DEN} * {n} >= {NUM} * {m} AND {DEN} * {m} >= {NUM} * {n} AND {NUM + DEN} * least({n} - x.p, {m} - y.p) >= {need} AND {NUM + DEN} * ({n} + {m} - ({differ})) >= 2 * {need}"
        ok = f"shiftright(x.k, 24) = shiftright(y.k, 24) AND x.ord >= y.ord AND NOT (x.g1 = y.g1 AND x.g2 = y.g2) AND (({n} = 16777215L AND {m} = 16777215L) OR ({ok}))"
        rest = x.alias("x").join(y.alias("y"), F.expr(ok)).select(F.col("x.g1").alias("a1"), F.col("x.g2").alias("a2"), F.col("y.g1").alias("b1"), F.col("y.g2").alias("b2")).distinct()
        gone = gone.unionByName(_later(written(rest, "line-pairs"), own, firsts)).distinct()
        known.unpersist()
    dropped(lines, found)
    return firsts.join(gone, ["g1", "g2"], "left_anti").select("first.doc_id", "first.h", "first.line")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later matches of lines removed from text, and n_chars, where it exists, set anew."""
    p = fresh(docs, "__ld_")
    # keys without nulls, so that join and window share one dealing of the texts
    keys = [f"{p}id", f"{p}none", f"{p}key"]

    def keyed(df: DataFrame, ident: str, key) -> DataFrame:
        return df.withColumns({keys[0]: F.coalesce(F.col(ident).cast("long"), F.lit(0)), keys[1]: F.col(ident).cast("long").isNull(), keys[2]: key})

    stay = keyed(kept_lines(docs, doc_id, text), "doc_id", F.col("h")).groupBy(*keys).agg(F.collect_list("line").alias(f"{p}stay"))
    # split before the join, so that each line is reached by its number
    each = keyed(docs, doc_id, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(text, F.split(text, "\n"))
    joined = each.join(stay, keys, "left").withColumn(f"{p}row", F.row_number().over(Window.partitionBy(*keys).orderBy(keys[2])))
    first = f"CASE WHEN {p}row = 1 AND {p}stay IS NOT NULL THEN {p}stay ELSE CAST(array() AS ARRAY<INT>) END"
    blank = f"filter(sequence(0, size(`{text}`) - 1), i -> NOT get(`{text}`, i) RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    kept = f"transform(array_sort(concat({first}, {blank})), i -> get(`{text}`, i))"
    out = joined.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(F.expr(kept), "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
