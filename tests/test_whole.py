"""Queries over whole texts and all rows, against brute force."""

from shelfgraph.functions import fuzzy
from shelfgraph.plans import catalog


def test_unique_ignoring_case_reads_whole_texts(spark, tmp_path):
    texts = ["Sea sea\nsea SEA", " ".join(f"w{i % 150} W{i}" for i in range(600)), "  ", "", None, "É é e", "b B a A b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        first: dict = {}
        for w in (t or "").split(" "):
            if w:
                first.setdefault(w.lower(), w)
        want[i] = (len(first), " ".join(first.values()))
    assert {r.doc_id: (r.n, r.words) for r in catalog.unique_ignoring_case(spark, str(tmp_path)).collect()} == want


def test_hybrid_edges_keep_works_without_terms(spark, tmp_path):
    docs = [(0, "river stone river"), (1, "river stone"), (2, None), (3, "unheard"), (5, "stone moss"), (6, "moss")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 1.0], 4: [0.0, 1.0]}
    spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.source, r.target): r.score for r in catalog.hybrid_edges(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2), (3, 4)}
    assert got[0, 2] == got[1, 2] == got[3, 4] == 0.9 and 0.9 < got[0, 1] <= 1.0


def test_fuzzy_edit_ratio_meets_names_without_a_shared_token(spark, tmp_path):
    names = ["fantasy", "fantasie", "tolkien", " tolkein", "Sea stories", "stories sea", "seastories", "x", "quilts", "a very long name of the sea", "", None]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    own = sorted({n.strip() for n in names if n})
    want = {(a, b): (fuzzy.sorted_ratio(a, b), fuzzy.set_ratio(a, b)) for a in own for b in own if a < b}
    want = {k: tuple(round(x, 4) for x in v) for k, v in want.items() if max(v) >= 30}
    assert ("fantasie", "fantasy") in want and ("tolkein", "tolkien") in want
    assert {(r.source, r.candidate): (r.sort_ratio, r.set_ratio) for r in catalog.fuzzy_edit_ratio(spark, str(tmp_path)).collect()} == want
    df = spark.createDataFrame([(n,) for n in names], "n string")
    blocked = fuzzy.edit_pairs(df, "n", 30, block_rows=3).collect()
    assert len(blocked) == len(want) and {(r.source, r.candidate) for r in blocked} == set(want)
    best = {(r.source, r.candidate) for r in fuzzy.edit_pairs(df, "n", 30, limit=1).collect()}
    assert {("fantasie", "fantasy"), ("tolkein", "tolkien"), ("Sea stories", "stories sea")} <= best and len(best) <= len(own)
