r"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

A word is a row of symbols; the leaves of a segment tree hold the merge ranks of adjacent symbol pairs, each
inner node the lesser of its children. The root yields the lowest rank; descending to the left child on ties
finds its leftmost place. A merge joins two symbols in a linked list and rewrites three leaves (the merged
pair goes, its neighbours get new ranks), each a point update along log2(n) nodes, until the root says that
no pair can be merged. Words of like length run side by side in numpy arrays (one tree a row), so each step
costs a few array operations for thousands of words; very long words get trees as tall as they need.

Ids equal those of the tokenizers library for the same file: special tokens are cut out of the raw text, the
rest is normalised and split as the file's normalizer and pre_tokenizer say. Characters on whose class
Unicode versions disagree go through the library's own normalizer and pre_tokenizer for the split; the merges
are always made here. A memo of bounded size keeps the ids of words already seen by the task; it is freed when the
task ends. Decoding starts from ids alone: names are taken from the file's table by id and joined.

Defined results: a null text is encoded as an empty one; an empty text has no ids and decodes to an empty
text; texts of any length are encoded whole; repeated rows each get their row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

NO_RANK = np.int64(1 << 40)
#: Characters outside these ranges may be classed differently by Unicode versions.
KNOWN = re.compile("[^\\u0000-\\u052f\\u1e00-\\u1fff\\u2000-\\u2064\\u20a0-\\u20bf\\u3000-\\u312e\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
MEMO_WORDS = 300_000


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class MergeTable:
    """Vocabulary and merges of a tokenizer file; pairs are looked up by binary search in numpy."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(self.strings) + 1
        self.names = pa.array([self.strings.get(i) for i in range(self.size)], pa.string())
        self.known = np.array([i in self.strings for i in range(self.size)])
        keys, into = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(self.vocab[a] * self.size + self.vocab[b])
            into.append(self.vocab[a + b])
        keys_, into_ = np.array(keys, np.int64), np.array(into, np.int64)
        order = np.argsort(keys_, kind="stable")
        self.keys, self.ranks, self.into = keys_[order], order.astype(np.int64), into_[order]
        alphabet = byte_alphabet()
        self.byte_id = np.array([self.vocab[alphabet[b]] for b in range(256)], np.int64)
        self.last_id = np.array([self.vocab[alphabet[b] + self.suffix] for b in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; NO_RANK where there is no merge or a symbol is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.into[at], -1)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> np.ndarray:
    """Ids of words, one a row: symbols (words x width, -1 beyond a word's length) merged to the end; -1 where a symbol has gone."""
    n, width = symbols.shape
    leaves = 1 << max(1, int(width - 1).bit_length())
    sym = np.full((n, leaves + 1), -1, np.int64)
    sym[:, :width] = symbols
    place = np.arange(leaves)
    nxt = np.tile(place + 1, (n, 1))
    nxt[place[None, :] + 1 >= lengths[:, None]] = leaves  # the last symbol's successor is a place without a symbol
    prv = np.tile(np.concatenate([[leaves], place[:-1]]), (n, 1))
    rank, into = table.find(sym[:, :leaves], np.concatenate([sym[:, 1:leaves], np.full((n, 1), -1)], axis=1))
    tree = np.full((n, 2 * leaves), NO_RANK, np.int64)
    tree[:, leaves:] = rank
    target = np.full((n, leaves + 1), -1, np.int64)
    target[:, :leaves] = into
    for level in range(leaves.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    live = np.flatnonzero(tree[:, 1] < NO_RANK)

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + leaves
        tree[rows, node] = value
        while node[0] > 1:  # all leaves are equally deep
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    while len(live):
        least = tree[live, 1]
        node = np.ones(len(live), np.int64)
        for _ in range(leaves.bit_length() - 1):
            node = 2 * node
            node += tree[live, node] != least  # left on ties
        at = node - leaves
        gone = nxt[live, at]
        after = nxt[live, gone]
        sym[live, at] = target[live, at]
        sym[live, gone] = -1
        nxt[live, at] = after
        has_after = after < leaves
        prv[live[has_after], after[has_after]] = at[has_after]
        update(live, gone, np.full(len(live), NO_RANK))
        r, t = table.find(sym[live, at], sym[live, after])
        target[live, at] = t
        update(live, at, r)
        before = prv[live, at]
        has = before < leaves
        if has.any():
            rows, b = live[has], before[has]
            r, t = table.find(sym[rows, b], sym[rows, at[has]])
            target[rows, b] = t
            update(rows, b, r)
        live = live[tree[live, 1] < NO_RANK]
    return sym[:, :leaves]


def encode_words(words: list[bytes], table: MergeTable, block: int = 1 << 18) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each word (UTF-8 bytes, not empty).

    Words of like length run together; block bounds the symbols held at once.
    """
    ids_of: list = [b""] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    start = 0
    while start < len(order):
        width = int(sorted_[start])
        limit = 1 << max(1, (width - 1).bit_length())
        stop = int(np.searchsorted(sorted_, limit, side="right"))
        stop = min(stop, start + max(1, block // limit))
        rows, ls = order[start:stop], sorted_[start:stop]
        top = int(ls[-1])
        flat = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)
        symbols = np.full((len(rows), top), -1, np.int64)
        symbols[np.arange(top)[None, :] < ls[:, None]] = table.byte_id[flat]
        symbols[np.arange(len(rows)), ls - 1] = table.last_id[flat[np.cumsum(ls) - 1]]
        ids = merge_words(symbols, ls, table)
        keep = ids >= 0
        raw = ids[keep].astype("<u4").tobytes()
        at = 0
        for i, end in zip(rows.tolist(), (4 * np.cumsum(keep.sum(axis=1))).tolist(), strict=True):
            ids_of[i] = raw[at:end]
            at = end
        start = stop
    return ids_of


#: How word_bpe files split text after normalisation; white space is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Codec:
    """Encodes whole texts to ids and decodes ids to text, for a tokenizer file with word ends."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.path, self.table, self.memo_words = path, merge_table(path), memo_words
        self.ids: dict = {}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.table.special), key=len, reverse=True)) + ")") if self.table.special else None

    @lru_cache(maxsize=1)  # noqa: B019
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain_words(self, text: str) -> list[str]:
        """Units of a text of known characters: what stands between white space, to be split by WORDS."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if regex.search("[\x1c-\x1f]", text):
            return [x for x in regex.split(r"\s+", text) if x]
        return text.split()

    def _other_words(self, text: str) -> list[bytes]:
        lib = self._library()
        back = {c: b for b, c in byte_alphabet().items()}
        norm = lib.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w) for w, _ in lib.pre_tokenizer.pre_tokenize_str(norm)]

    def _pieces(self, text: str) -> list:
        """In order: (id,) of a special token, a unit of white-space split text, or the bytes of a word."""
        out: list = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append((self.table.special[part],))
            elif part:
                out += self._other_words(part) if KNOWN.search(part) else self._plain_words(part)
        return out

    def _learn(self, units: list) -> None:
        """Memoises units: strings that WORDS splits further, or bytes of one word."""
        split = [(u,) if isinstance(u, bytes) else [w.encode() for w in WORDS.findall(u)] for u in units]
        words = list({w for ws in split for w in ws})
        raw = dict(zip(words, encode_words(words, self.table), strict=True))
        for u, ws in zip(units, split, strict=True):
            self.ids[u] = raw[ws[0]] if len(ws) == 1 else b"".join([raw[w] for w in ws])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(t or "") for t in texts]
        if len(self.ids) > self.memo_words:
            self.ids = {}
        for i in self.table.special.values():
            self.ids[(i,)] = np.array([i], "<u4").tobytes()
        new = list(set().union(*pieces) - self.ids.keys())
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])
        ids = self.ids.__getitem__
        return [b"".join(map(ids, ps)) for ps in pieces]

    def decode_batch(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of lists of ids: names joined by a space, as a file without a decoder says; unknown ids are skipped."""
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        flat, offsets = flat.astype(np.int64), offsets - offsets[0]
        known = (flat >= 0) & (flat < self.table.size)
        known[known] = self.table.known[flat[known]]
        if not known.all():
            offsets = np.concatenate([[0], np.cumsum(known)])[offsets].astype(np.int32)
            flat = flat[known]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.table.names.take(pa.array(flat))), " ")

    def decode(self, ids) -> str:
        """The text of one list of ids."""
        return self.decode_batch(pa.array([list(ids)], pa.list_(pa.int64())))[0].as_py()


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """Lists of ids from their little-endian unsigned 32-bit integers."""
    ends = np.cumsum([len(a) // 4 for a in raw], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _sha256(parts) -> list[str]:
    return [hashlib.sha256(b).hexdigest() for b in parts]


@lru_cache(maxsize=1)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def digests(path: str):
    """For map_batches: (id, text) to (id, n_tokens, ids_sha256, decoded_sha256); the text is decoded from the ids."""

    def make():
        own = Codec(path)

        def each(batch):
            raw = own.encode_batch(batch.column(1).to_pylist())
            decoded = own.decode_batch(id_lists(raw))
            return [batch.column(0), [len(a) // 4 for a in raw], _sha256(raw), _sha256(decoded.cast(pa.binary()).to_pylist())]

        return each

    return make


def encoded_rows(path: str, memo_words: int = MEMO_WORDS):
    """For map_batches: (..., text) to the columns before the text, ids and the text decoded from them."""

    def make():
        own = Codec(path, memo_words)

        def each(batch):
            k = batch.num_columns - 1
            ids = id_lists(own.encode_batch(batch.column(k).to_pylist()))
            return [*(batch.column(i) for i in range(k)), ids, own.decode_batch(ids)]

        return each

    return make
