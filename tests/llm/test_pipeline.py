import collections
import re

import pytest
from test_near_duplicates import brute_lines, components
from test_queries import plain_simhash

NAMES = ["quality rules", "line dedup", "simhash near-dedup", "mixing", "bpe encoding"]


def test_stages(spark, tmp_path, docs):
    import corpus_pipeline

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in own.collect()}
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert not {101, 102, 103, 107} & {r.doc_id for r in out}
    lines = [x for r in out for x in set(re.split("\n", r.decoded)) if x]
    assert lines


def test_each_stage_against_plain_code(spark, tmp_path, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from shelfgraph.llm import mixing, quality_rules
    from shelfgraph.llm.queries import tokenizer_path

    stage = dict(corpus_pipeline.STAGES)

    def through(name, df):
        out = stage[name](spark, df, str(tmp_path))
        if name != NAMES[-1]:
            assert out.columns == df.columns  # further columns with clashing names pass
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    verdict = {(r.doc_id, r.n_words): r.kept for r in quality_rules.score_documents(docs).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    good = through(NAMES[0], docs)
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in docs.collect() if verdict[r.doc_id, size(r.text)])
    plain = [(r.doc_id, r.text) for r in good.collect()]
    deduped = through(NAMES[1], good)
    once, want = set(), []
    kept = brute_lines(plain)
    for key in plain:
        want.append((str(key[0]), kept[key] if key not in once else "\n".join(x for x in key[1].split("\n") if not x.split())))
        once.add(key)
    assert sorted((str(r.doc_id), r.text) for r in deduped.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in deduped.collect())
    before = deduped.collect()
    label = components({plain_simhash(r.text) for r in before})
    near = through(NAMES[2], deduped)
    groups = collections.Counter(label[plain_simhash(r.text)] for r in near.collect())
    assert set(groups) == {label[plain_simhash(r.text)] for r in before} and set(groups.values()) == {1}
    mixed = through(NAMES[3], near)
    copies = {str(r.doc_id): r.copies if r["size"] else 1 for r in mixing.mix(near).collect()}
    got = collections.Counter(str(r.doc_id) for r in mixed.collect())
    assert got == collections.Counter({k: n for k, n in copies.items() if n})
    lib = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {(r.doc_id, r.text): lib.encode(r.text or "", add_special_tokens=False).ids for r in mixed.collect()}
    encoded = through(NAMES[4], mixed)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in encoded.collect()) == sorted((str(r.doc_id), ids[r.doc_id, r.text], lib.decode(ids[r.doc_id, r.text], skip_special_tokens=False)) for r in mixed.collect())


def test_an_empty_table_passes_every_stage(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
