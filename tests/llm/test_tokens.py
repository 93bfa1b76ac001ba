import zlib

import numpy as np
import pytest

from shelfgraph.llm import bpe, token_orc
from shelfgraph.llm.queries import tokenizer_path
from shelfgraph.llm.shared import map_batches

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer_path(name))


def test_segment_tree_takes_leftmost_lowest_rank():
    table = bpe.MergeTable(tokenizer_path(WORD))
    raw = bpe.encode_words([b"aaaaaaa", b"x", b"thethethe"], table)
    lib = library(WORD)
    for w, r in zip(["aaaaaaa", "x", "thethethe"], raw, strict=True):
        assert np.frombuffer(r, "<u4").tolist() == lib.encode(w, add_special_tokens=False).ids


def test_ids_and_text_equal_the_library(docs, rows):
    got = map_batches(docs.select("doc_id", "text"), bpe.encoded_rows(tokenizer_path(WORD)), "doc_id long, ids array<int>, decoded string").collect()
    lib = library(WORD)
    want = sorted((str(r[0]), e := lib.encode(r[1] or "", add_special_tokens=False).ids, lib.decode(e, skip_special_tokens=False)) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want


def test_memo_overflow_changes_nothing(rows):
    small, large = bpe.Codec(tokenizer_path(WORD), memo_words=3), bpe.Codec(tokenizer_path(WORD))
    texts = [r[1] for r in rows]
    assert [small.encode_batch([t])[0] for t in texts] == large.encode_batch(texts)


def test_orc_round_trip(docs, rows):
    got = token_orc.token_digests(docs, tokenizer_path(BYTE)).collect()
    lib, at, want = library(BYTE), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((str(r[0]), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_starts_hold_when_a_task_writes_several_files(spark, docs):
    want = sorted(map(str, token_orc.token_digests(docs, tokenizer_path(BYTE)).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        assert sorted(map(str, token_orc.token_digests(docs, tokenizer_path(BYTE)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_orc_prunes_by_id(spark, docs):
    from shelfgraph.session import shared_path

    path = token_orc.write_tokens(docs, tokenizer_path(BYTE), shared_path(spark, "t"))
    found = token_orc.read_tokens(spark, path).where("doc_id = 103")
    assert "EqualTo(doc_id,103)" in found._jdf.queryExecution().toString()
    assert found.count() == 1


def test_odd_white_space_equals_the_library():
    import random

    rnd, lib, own = random.Random(2), library(BYTE), token_orc.ByteEncoder(tokenizer_path(BYTE))
    texts = ["".join(rnd.choice(["a", "é", " ", " ", "\n", "\t", "'s", "1", "!", "\xa0", "<|endoftext|>", "ก"]) for _ in range(20)) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(empty):
    assert token_orc.token_digests(empty, tokenizer_path(BYTE)).count() == 0


def test_lists_with_ends_whatever_the_batch():
    import pyarrow as pa

    lib, own = library(BYTE), token_orc.ByteEncoder(tokenizer_path(BYTE), memo_pieces=3)
    texts = ["", None, "a b  c", " lead", "trail ", "x\ty\n z", "plain words here", "<|endoftext|> mid<|endoftext|>", "ก ข", "\n", "one", "words here plain", "it's 12 o'clock!"]
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert own.encode_lists(pa.array(texts), 0).to_pylist() == want
    assert [x for t in texts for x in own.encode_lists(pa.array([t], pa.string()), 0).to_pylist()] == want
    assert own.encode_lists(pa.array([], pa.string()), 0).to_pylist() == []


def test_decoding_starts_from_ids():
    import pyarrow as pa

    codec, lib = bpe.Codec(tokenizer_path(WORD)), library(WORD)
    ids = [[], [5, 9, 5], [40000], [1, 2, 3]]
    assert codec.decode_batch(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [lib.decode(i, skip_special_tokens=False) for i in ids]
    assert codec.decode_batch(pa.array([[5, 10**7, -3, 9]], pa.list_(pa.int64()))).to_pylist() == [lib.decode([5, 9], skip_special_tokens=False)]
    assert codec.decode_batch(pa.array([[1], [5, 9], [7]], pa.list_(pa.int32()))[1:2]).to_pylist() == [lib.decode([5, 9], skip_special_tokens=False)]
    assert codec.decode([5, 9]) == lib.decode([5, 9], skip_special_tokens=False)


def test_the_queries_equal_the_library(spark, tmp_path, docs, rows):
    import hashlib

    from shelfgraph.llm import queries

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    lib = library(WORD)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
    got = queries.op2_bpe_codec(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op2_bpe_codec(spark, f"{tmp_path}/none").count() == queries.op3_token_orc(spark, f"{tmp_path}/none").count() == 0


def test_tokens_are_written_from_small_batches(spark):
    from shelfgraph.session import batches_of, written

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, token_orc.BATCH_ROWS):
        sizes = written(spark.range(0, 2 * token_orc.BATCH_ROWS + 1, 1, 1).mapInArrow(counted, "n long"), "rows")
    assert sorted(r.n for r in sizes.collect()) == [1, token_orc.BATCH_ROWS, token_orc.BATCH_ROWS]
    assert spark.conf.get(name) == before
