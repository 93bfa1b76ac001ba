import hashlib
import itertools
import random
import re

import numpy as np

from shelfgraph.llm import line_dedup, minhash, simhash


def components(fps, radius=3):
    label = {f: f for f in fps}
    pairs = [(a, b) for a, b in itertools.combinations(label, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for places in itertools.combinations(range(64), 3):
        differ = signed(sum(1 << i for i in places))
        assert any(m & differ == 0 for m in masks)


def test_components_equal_brute_force(spark):
    rnd = random.Random(8)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in list(fps[:20]):
        x = f
        for _ in range(6):
            for _ in range(rnd.choice([1, 2, 3, 4])):
                x ^= 1 << rnd.randrange(64)
            fps.append(x)
    fps = sorted({signed(f) for f in fps} | {0, 7, -1})
    got = {r.fp: r.label for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = components(fps)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == groups(want)


def test_simhash_rows(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[1]: simhash.fingerprint(r[1]) for r in rows}
    label = components(set(fps.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            c = label[fps[r[1]]]
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), fps[r[1]], str(least.get(label[fps[r[1]]]))) for r in rows)
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_one_row_of_each_group_stays(docs, empty):
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(108) == 0 and ids.count(2) == 1 and ids.count(100) == 1 and 101 not in ids
    assert simhash.first_of_groups(empty).count() == 0


def jaccard(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_against_exact(docs, rows, empty):
    got = {(r.doc_id, r.edited_sha256): r for r in minhash.compare_with_next(docs).collect()}
    assert minhash.compare_with_next(docs).count() == len(rows)
    order = sorted((r for r in rows if r[0] not in (108,)), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for a, b in zip(order, order[1:], strict=False):
        if a[0] == 109 or b[0] is None:
            continue
        x, y = a[1] or "", b[1] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        row = got[(a[0], hashlib.sha256(edited.encode()).hexdigest())]
        assert row.n_chars == len(x) and abs(row.near_edited - jaccard(x, edited)) < 0.13 and abs(row.near_next - jaccard(x, y)) < 0.13
    assert minhash.compare_with_next(empty).count() == 0
    assert (minhash.fingerprint("a b c d e f") == minhash.fingerprint("a b c d e f")).all()


def brute_lines(rows):
    seen, out = [], {}
    exact = set()
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in t.split("\n"):
            s = frozenset(line.encode().lower().split())
            if not s:
                kept.append(line)
                continue
            if s not in exact:
                if not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    kept.append(line)
                exact.add(s)
                seen.append(s)
        out[(d, t)] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark, docs, rows, empty):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    want = brute_lines(rows)
    expect, used = [], set()
    for r in rows:
        key = (r[0], r[1])
        if r[1] is None:
            expect.append((str(r[0]), "None"))
        elif key in used:
            expect.append((str(r[0]), "\n".join(x for x in r[1].split("\n") if not x.split())))
        else:
            expect.append((str(r[0]), want[key]))
            used.add(key)
    assert got == sorted(expect)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_lines_go_in_document_order(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(sorted(set(base) - {rnd.choice(base)} | ({f"x{rnd.randrange(40)}"} if i % 2 else set()))), None) for i in range(60)]
    rows += [(100 + i, " ".join(f"y{rnd.randrange(60)}" for _ in range(12)), None) for i in range(60)]
    df = spark.createDataFrame([(a, b, None, None, None) for a, b, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {d: t for (d, _), t in brute_lines(rows).items()}


def test_no_pair_of_entries_is_lost(monkeypatch):
    """Every pair that passes the filters is emitted, or its later set is handed on; blocks, long windows and many partners included."""
    monkeypatch.setattr(line_dedup, "LONG", 12)
    rnd = np.random.default_rng(7)
    rows = set()
    for word in range(60):
        for _ in range(int(rnd.integers(1, 40))):
            rows.add((int(word), int(rnd.integers(4, 12)), int(rnd.integers(0, 50)), int(rnd.integers(0, 2)), int(rnd.integers(0, 30))))
    rows = sorted(((w << 24) | n, g, g * 3 + (n << 8), p, o) for w, n, g, p, o in rows)
    cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    for size in (7, 50, 10_000):
        window, pairs, left = line_dedup._Window(), set(), set()
        for at in range(0, len(rows), size):
            for a1, a2, b1, b2 in zip(*(c.to_pylist() for c in window.pairs([c[at : at + size] for c in cols], at + size >= len(rows))), strict=True):
                if b1 is None:
                    left.add((a1, a2))
                else:
                    pairs |= {((a1, a2), (b1, b2)), ((b1, b2), (a1, a2))}
        least = {}
        for k, g1, g2, p, o in rows:
            least[k, g1, g2] = (min(o, least.get((k, g1, g2), (99,))[0]), p)
        entries = [(k >> 24, k & 0xFFFFFF, (g1, g2), p, o) for (k, g1, g2), (o, p) in least.items()]
        checked = 0
        for t, n, x, p, o in entries:
            for u, m, y, q, r in entries:
                if t == u and x != y and o >= r and line_dedup.passes(*(np.array([v]) for v in (n, m, p, q)), line_dedup.differing(*(np.array([v]) for v in (n, m, *x, *y))))[0]:
                    checked += 1
                    assert (x, y) in pairs or x in left or (o == r and y in left)
        assert checked > 100 and len(left) < len(least)


def test_names_bound_the_difference_of_sets():
    import pyarrow as pa

    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    for _ in range(300):
        k = rnd.randrange(1, 90)
        a = set(rnd.sample(words, k))
        b = (a - set(rnd.sample(sorted(a), min(len(a) - 1, rnd.randrange(0, 9))))) | set(rnd.sample(words, rnd.randrange(0, 9)))
        s = line_dedup._Sets(pa.array([" ".join(sorted(a)), " ".join(sorted(b, reverse=True)) + " " + next(iter(b))]))
        (a1, b1), (a2, b2) = s.ids()
        assert s.n.tolist() == [len(a), len(b)]
        assert ((a1, a2) == (b1, b2)) == (a == b)
        assert line_dedup.differing(*(np.array([x]) for x in (len(a), len(b), a1, a2, b1, b2)))[0] <= len(a ^ b)
        assert sum(((int(x[0]) ^ int(x[1])) & (2**64 - 1)).bit_count() for x in s.signs()) <= len(a ^ b)


def test_word_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"abcdefgh", b"abcdefgh\x00", b"abcdefghi", b"abcdefghabcdefgh", b"x" * 1024, b"x" * 1025, b"x" * 1026, "é".encode()]
    h, start = line_dedup._hashes(b"\n" + b" ".join(words) + b"\n")
    assert len(set(h.tolist())) == len(words) == len(start)
    again, _ = line_dedup._hashes(b"\n" + b"\t".join(w.upper() for w in words[::-1]) + b"\r\n")
    assert again[::-1].tolist()[:-1] == h.tolist()[:-1]


def test_lines_are_read_in_small_batches(spark, docs, monkeypatch):
    name, seen, sketch = "spark.sql.execution.arrow.maxRecordsPerBatch", [], line_dedup.token_sketch
    before = spark.conf.get(name)
    monkeypatch.setattr(line_dedup, "token_sketch", lambda *a: seen.append(int(spark.conf.get(name))) or sketch(*a))
    line_dedup.kept_lines(docs, sketch_bits=16)
    assert seen == [line_dedup.BATCH_ROWS] and spark.conf.get(name) == before


def test_entries_sorted_by_word_and_size_alone_give_the_same_pairs(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    rows = sorted({(int(rnd.integers(0, 40)) << 24 | int(rnd.integers(8, 12)), int(g := rnd.integers(0, 25)), int(g) * 5, 0, int(rnd.integers(0, 60))) for _ in range(3000)})

    def found(rows, batch):
        cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        parts = [pa.RecordBatch.from_arrays([pa.array(c[at : at + batch]) for c in cols], names=list("kabpo")) for at in range(0, len(rows), batch)]
        return {r for b in line_dedup._compare(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    want = found(rows, len(rows))
    mixed = [rows[i] for i in sorted(range(len(rows)), key=lambda i, order=rnd.permutation(len(rows)): (rows[i][0], order[i]))]
    assert want and found(mixed, len(rows)) == want
    monkeypatch.setattr(line_dedup, "ROWS", 200)
    assert found(mixed, 50) == found(rows, 50)
