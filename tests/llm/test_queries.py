"""Every query opN_ on a folder with nulls, empty, blank and repeated rows, clashing columns and empty tables; models against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from shelfgraph.llm import minhash, quality_classifier, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    at = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{at}/documents.parquet")
    ids = [(r.doc_id, int(k % 3 == 0), int(k % 4 == 0), "clash") for k, r in enumerate(docs.select("doc_id").collect())] + [(99999, 1, 1, None), (None, None, None, None)]
    spark.createDataFrame(ids, "doc_id long, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory, empty):
    at = tmp_path_factory.mktemp("none")
    empty.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


COLUMNS = {
    "op2_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op3_token_orc": ["doc_id", "start", "n_tokens", "ids_crc32"], "op4_simhash_groups": ["doc_id", "fingerprint", "component_id"],
    "op5_mix_sources": ["doc_id", "size", "source_size", "target", "taken"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"], "op8_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op9_minhash_next": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_for_each_row(spark, folder, nothing, rows, name):
    df = queries.queries()[name](spark, folder)
    assert set(COLUMNS.get(name, ["doc_id"])) <= set(df.columns)
    got = df.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for c in set(df.columns) & {"held_out", "score", "predicted", "taken", "size", "fingerprint", "kept", "n_tokens", "text_sha256"} - ({"text_sha256"} if name.startswith("op6") else set()):
        assert all(r[c] is not None for r in got), c
    empty = queries.queries()[name](spark, nothing)
    assert empty.count() == 0 and empty.columns == df.columns


def plain_simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_a_plain_loop(spark, folder, rows):
    got = sorted((str(r.doc_id), r.fingerprint) for r in queries.op4_simhash_groups(spark, folder).collect())
    assert got == sorted((str(r[0]), f"{plain_simhash(r[1]):016x}") for r in rows)


def test_edited_texts_wrap_around(spark, tmp_path):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice("sea map old é ship".split()) for _ in range(rnd.randrange(1, 30))) for i in range(50)} | {50: "", 51: None, 52: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    order, want = sorted(texts, reverse=True), {}
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        x, y = texts[a] or "", texts[b] or ""
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        want[a] = (len(x), hashlib.sha256(e.encode()).hexdigest(), minhash.packed(minhash.fingerprint(x)), minhash.packed(minhash.fingerprint(e)), minhash.likeness(minhash.fingerprint(x), minhash.fingerprint(y)))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in queries.op9_minhash_next(spark, str(tmp_path)).collect()} == want


def plain_toxicity(model, text):
    every = (text or "").lower().split()
    words = [w for w, before in zip(every, ["", *every], strict=False) if w != before]

    def share(word):
        rows = []
        for n in (3, 4, 5):
            m = f"<{word}>"
            for i in range(len(m) - n + 1):
                h = 14695981039346656037 + n
                for c in m[i : i + n]:
                    h = (h ^ ord(c)) * 1099511628211 % 2**64
                rows.append((h ^ (h >> 29)) % (1 << 18))
        return sum(float(model.weight[r]) for r in rows) / max(1, len(rows))

    best = model.bias
    if words:
        windows = [words[at : at + 12] for at in range(0, max(1, len(words) - 6), 6)]
        best = max(model.bias + sum(map(share, w)) / len(w) for w in windows)
    return 1 / (1 + math.exp(-max(-40, min(40, model.slope * best + model.level))))


def test_toxicity_scores_equal_a_plain_loop(spark, docs, rows):
    texts = [r[1] for r in rows if r[1]][:20]
    model = toxicity.fit(texts, [i % 2 for i in range(len(texts))])
    want = sorted((str(r[0]), round(plain_toxicity(model, r[1]), 4)) for r in rows if len(r[1] or "") < 5000)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in toxicity.score_documents(docs, model).collect() if r.doc_id != 104)
    assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], atol=2e-4)


def test_toxicity_learns_from_its_fold_alone(spark, folder):
    docs, labels = queries._documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    picked, share = toxicity.training_rows(docs, labels.where(queries._fold(4) != 2), "toxic")
    own = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert abs(share - sum(y for _, y in own) / len(own)) < 1e-9
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {(t, y) for t, y in picked} <= {(text.get(i) or "", y) for i, y in own}


def plain_isotonic(y):
    blocks = []
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1]]
    return [s / n for s, n in blocks for _ in range(n)]


def test_quality_model_equals_one_dense_solve(spark):
    rnd = np.random.default_rng(8)
    k = len(quality_classifier.STATISTICS)
    x = rnd.normal(size=(400, k))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.7 * rnd.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(400)], f"doc_id long, y int, stats array<double>").repartition(5)  # noqa: F541
    model = quality_classifier.fit(rows)
    kernel = quality_classifier.Kernel(x.mean(axis=0), x.std(axis=0))
    z = kernel(x)
    dense = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, dense, atol=1e-6)
    assert (np.diff(model.levels) >= -1e-12).all()
    assert plain_isotonic([1, 0, 0, 1, 0, 1, 1]) == pytest.approx(quality_classifier.pooled(np.array([1.0, 0, 0, 1, 0, 1, 1]), np.ones(7)).tolist())
    # calibrated: the mean of the levels over the rows is near the share of ones
    assert abs(model.scores(x).mean() - y.mean()) < 0.1
