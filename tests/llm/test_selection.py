import re

import duckdb
import numpy as np

from shelfgraph.llm import license_scan, mixing, oracle, quality_classifier, quality_rules, toxicity


def duck(rows, sql):
    import pandas as pd

    documents = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    c = duckdb.connect()
    c.register("documents", documents)
    c.execute("create view d2 as select doc_id::bigint as doc_id, text from documents")
    return sorted(map(str, c.execute(sql.replace("FROM documents", "FROM d2")).fetchall()))


def test_quality_rules_equal_sql(docs, rows, empty):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(str(tuple(r)) for r in quality_rules.score_documents(docs).select(*cols).collect())
    assert got == duck(rows, oracle.quality_rules_sql())
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(eval(x)[0].__str__() for x in got if x.endswith("True)"))
    assert quality_rules.score_documents(empty).count() == 0 and quality_rules.keep_documents(empty).count() == 0


def test_license_scan_equals_sql(spark, docs, rows, empty):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    more = [(500, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sub-license") + "\n", None, None, None, None, None), (501, "Text.\nReleased under the MIT Licence\nend", None, None, None, None, None), (502, mit + " x", None, None, None, None, None)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = license_scan.scan(df).collect()
    by = {r.doc_id: r for r in got}
    assert by[500].license == "MIT" and by[501].notices == "MIT" and by[501].license is None and by[502].license is None
    assert sorted(str(tuple(r)) for r in got) == duck([*rows, *more], license_scan.oracle_sql())
    assert license_scan.scan(empty).count() == 0


def test_mix_meets_targets(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target = {s: sum(total.values()) * weight[s] / sum(weight.values()) for s in order}
    while over := [s for s in order if target[s] > 3 * total[s] + 1e-9]:
        excess = sum(target[s] - 3 * total[s] for s in over)
        for s in over:
            target[s] = 3 * total[s]
        free = [s for s in order if target[s] < 3 * total[s]]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 and all(0 <= r.copies <= 3 for r in mine)
        # whole documents: half the largest is the most that can be missing or over
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= max(r.size for r in mine) / 2
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies if r.size else 1 for r in got)


def _sources(spark, n=6000):
    import random

    rnd = random.Random(9)
    rows = [(i, " ".join([f"w{i}"] * int(rnd.lognormvariate(3, 1) + 1)), f"s{rnd.choice([0, 0, 0, 0, 1, 2, 3])}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_takes_a_fixed_number_at_the_stated_odds(spark):
    from pyspark.sql import functions as F

    docs = _sources(spark).select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    classes = docs.withColumn("class", F.floor(F.log2("size"))).groupBy("source", "class").agg(F.sum("size").alias("words"))
    share = {"s0": 0.3, "s1": 0.8, "s2": 0.05, "s3": 0.0}
    total = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum("size")).collect()}
    rest = F.create_map(*[F.lit(x) for s in share for x in (s, share[s] * total[s])])[F.col("source")]
    f = {(r["source"], r["class"]): r["f"] for r in mixing.inclusion(classes.withColumn("rest", rest)).collect()}
    words = {(r["source"], r["class"]): r["words"] for r in classes.collect()}
    for s in share:  # expected words are the rest, by an independent bisection of the scale
        lo, hi = 0.0, 1e9
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1, c * 2 ** (-0.25 * k)) * w for (t, k), w in words.items() if t == s) < share[s] * total[s] else (lo, c)
        assert all(abs(f[t, k] - min(1, lo * 2 ** (-0.25 * k))) < 1e-6 for t, k in words if t == s)
    chance = F.create_map(*[x for (s, k), v in f.items() for x in (F.lit(f"{s}/{k}"), F.lit(v))])[F.concat_ws("/", "source", F.floor(F.log2("size")).cast("string"))]
    u = F.when(F.lit(True), (F.pmod(F.xxhash64("doc_id", "seed"), F.lit(1 << 40)) + 0.5) / float(1 << 40))
    taken, rounds, expect = {}, 12, round(sum(f[r["source"], int(np.log2(r["size"]))] for r in docs.collect()))
    for seed in range(rounds):
        ranked = docs.withColumns({"f": chance, "seed": F.lit(seed)}).withColumn("rank", F.when(F.col("f") > 0, mixing.pareto_rank(u, F.col("f"))).otherwise(1.0))
        got = mixing.pareto_sample(ranked).where("taken").groupBy("source", F.floor(F.log2("size"))).count().collect()
        assert sum(r[2] for r in got) == expect
        for s, k, n in got:
            taken[s, k] = taken.get((s, k), 0) + n
    for (s, k), n in {(r[0], r[1]): r[2] for r in docs.groupBy("source", F.floor(F.log2("size"))).count().collect()}.items():
        p, tries = f[s, k], n * rounds
        assert abs(taken.get((s, k), 0) - p * tries) <= 4.5 * (tries * p * (1 - p)) ** 0.5 + 1


def test_mix_depends_on_the_odds_and_ends_near_its_targets(spark):
    from pyspark.sql import functions as F

    docs = _sources(spark)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    flat = {r.doc_id: r.copies for r in mixing.mix(docs, rank=F.col("u")).collect()}
    assert sum(flat[k] != got[k].copies for k in got) > 100
    for s in ("s0", "s1", "s2", "s3"):
        mine = [r for r in got.values() if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 0.005 * mine[0].target
        low = int(mine[0].target // mine[0].source_size)
        assert {r.copies for r in mine} <= {low, low + 1} and max(r.copies for r in mine) <= 3


def auc(y, s):
    y, s = np.array(y), np.array(s)
    rank = np.argsort(np.argsort(s)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_finds_unseen_spellings():
    import random

    rnd = random.Random(3)
    plain = lambda n: [rnd.choice("ka lo mi ten sar vo pel dri nu oth".split()) + rnd.choice("ar en is um ol".split()) for _ in range(n)]
    bad = ["gruzzle", "blorgify", "snarkwit"]
    texts, labels = [], []
    for i in range(300):
        w = plain(60)
        if i % 5 == 0:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    m = toxicity.fit(texts, labels)
    held = [" ".join([*plain(30), rnd.choice(["gruzzles", "blorgifying", "snarkwits", "xgruzzle"]), *plain(30)]) for _ in range(30)]
    clean = [" ".join(plain(60)) for _ in range(60)]
    s = m.scores([*held, *clean])
    assert auc([1] * 30 + [0] * 60, s) > 0.95
    odd = m.scores([None, "", " ", "gruzzle"])
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1]
    assert (toxicity.fit([], []).scores(["x"]) < 1e-6).all() and (toxicity.fit(["a"], [1]).scores(["x"]) > 0.99).all()


def test_quality_classifier_holds_out(spark, docs, rows, empty):
    import random

    rnd = random.Random(6)
    good = [(1000 + i, " ".join(rnd.choice("the old house by sea was quiet and we went home".split()) for _ in range(50)) + ".", None, None, None, None, None) for i in range(80)]
    bad = [(2000 + i, " ".join(rnd.choice("a### b$$ C|| d%% WORD! x".split()) for _ in range(50)), None, None, None, None, None) for i in range(80)]
    df = docs.unionByName(spark.createDataFrame(good + bad, docs.schema))
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000), 0) for r in good + bad if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality_classifier.score_documents(df, labels).collect() if r.doc_id and r.doc_id >= 1000 and not r.doc_id % 2}
    assert auc([int(k < 2000) for k in got], list(got.values())) > 0.95
    none = quality_classifier.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert quality_classifier.pooled(np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 2, 3])).tolist() == [0.25, 0.25, 1.0, 1.0]
