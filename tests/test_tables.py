import pytest

from shelfgraph.operators import tables
from shelfgraph.plans import catalog, catalog_graph  # noqa: F401


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_canonical_names_and_closure(spark):
    pairs = spark.createDataFrame([("Tor Books", "Tor"), ("Tor Book", "Tor Books")], "source string, candidate string")
    assert rows(tables.canonical_names(pairs), "source", "canonical") == [("Tor Book", "Tor"), ("Tor Books", "Tor")]
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "source string, canonical string")
    assert rows(tables.map_closure(m), "source", "canonical") == [("a", "c"), ("b", "c")]


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    cycles = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "q")]
    mapping = dict(chain + cycles)

    def walk(name):
        seen = []
        while name in mapping and name not in seen:
            seen.append(name)
            name = mapping[name]
        return name

    m = spark.createDataFrame([*chain, *cycles, ("a", "zz")], "source string, canonical string")
    assert rows(tables.map_closure(m), "source", "canonical") == sorted((k, walk(k)) for k in mapping if walk(k) != k)
    assert tables.map_closure(m.limit(0)).count() == 0


def test_last_rows_are_the_same_for_every_dealing(spark):
    base = spark.createDataFrame([(1, "x", 0)], "id int, a string, at int")
    inc = spark.createDataFrame([(1, "p", 2), (1, "q", 3), (1, "r", 1)], "id int, a string, at int")
    assert rows(tables.keep_last(base, inc, ["id"], ["at"]), "a") == [("q",)]
    assert len({tuple(rows(tables.keep_last(base, inc.repartition(n), ["id"]), "a")) for n in (1, 2, 3)}) == 1
    assert len({tuple(rows(tables.upsert(base, inc.repartition(n), "id"), "a")) for n in (1, 2, 3)}) == 1
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    feed = spark.createDataFrame([("a", "b", "author", 0), ("a", "b", "editor", 1)], "start string, end string, role string, __pos int")
    assert rows(tables.merge_relationships(feed, nodes, nodes), "role") == [("editor",)]


def test_edge_upsert(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    old = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.2)], "start string, end string, score double")
    new = spark.createDataFrame([("a", "b", 0.9), ("a", "z", 0.8), ("a", "c", 0.7)], "start string, end string, score double")
    assert rows(tables.upsert_edges(new, nodes, old), "start", "end", "score") == [("a", "b", 0.9), ("a", "c", 0.7), ("b", "c", 0.2)]
    assert rows(tables.upsert_edges(new, nodes, old, clear_first=True), "start", "end", "score") == [("a", "b", 0.9), ("a", "c", 0.7)]


def test_samples_take_ids_of_any_type(spark):
    df = spark.range(1000).selectExpr("id", "concat('w', id) AS work_id")
    assert tables.sample(df, "work_id", 10, 1).count() == 10
    ids = [r.id for r in tables.sample(df, "id", 500, 3).collect()]
    assert 420 < sum(ids) / 500 < 580 and 200 < sum(i % 2 == 0 for i in ids) < 300


def test_group_by_key(spark):
    df = spark.createDataFrame([(1, "publisher_2", "Tor!", None, 3, "shelf"), (2, "publisher_10", "tor", "US", 2, "keyword")], "pos int, id string, name string, country string, n long, kind string")
    got = tables.group_by_key(df, "name", "id", "pos", ["country"], ["n"], ["kind"]).first()
    assert (got.key, got.id, got.name, got.country, got.n, got.kind) == ("tor", "publisher_10", "Tor!", "US", 5, "keyword;shelf")


def test_merge_differs_from_upsert(spark):
    base = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    inc = spark.createDataFrame([(1, None, "y")], "id int, a string, b string")
    assert rows(tables.keep_last(base, inc, ["id"]), "id", "a", "b") == [(1, None, "y")]
    up = tables.upsert(base, inc, "id")
    assert rows(up, "id", "a", "b") == [(1, "x", "y")]
    assert rows(tables.upsert(up, inc, "id"), "id", "a", "b") == [(1, "x", "y")]


def test_relationships(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    feed = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), (None, "b")], "start string, end string")
    created = tables.merge_relationships(feed, nodes, nodes)
    got = tables.relationship_counts("R", feed, created).first()
    assert (got.attempted, got.created) == (3, 1)
    assert tables.merge_relationships(feed, nodes, nodes, created).count() == 0


def test_language_rule(spark):
    works = spark.createDataFrame([(1, None, 10), (2, "eng", 99), (3, None, 99), (4, "fre", 10)], "work_id int, language string, best_id int")
    ed = spark.createDataFrame([(10, 1, "fre"), (11, 1, "eng"), (12, 3, "en-US")], "book_id int, work_id int, language string")
    assert rows(tables.enforce_english(works, ed), "work_id") == [(2,), (3,)]


def test_tags_and_lists(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in ("to-read", "brown", "sci-fi", "red2019", "1984", "x read-in-2020")], "t string")
    assert rows(df.where(tables.tag_allowed(F.col("t"))), "t") == [("sci-fi",)]
    m = spark.createDataFrame([("a", "b")], "source string, canonical string")
    lists = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "k int, xs array<string>")
    assert rows(tables.apply_map_to_list(lists, "k", "xs", m), "k", "xs") == [(1, ["b", "c"]), (2, [])]
    decisions = spark.createDataFrame([("p", "q", "m", "r")], "source string, candidate string, choice string, manual string")
    pairs = spark.createDataFrame([("p", "q")], "source string, candidate string")
    assert rows(tables.review(pairs, decisions), "source", "canonical") == [("p", "r"), ("q", "r")]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="nope"):
        tables.require_columns(spark.range(1), "id", "nope")


def test_books_are_joined_once_for_all_feeds(spark):
    """rels_counts reads its books as written, so line items are joined and told apart once."""
    plan = catalog.QUERIES["rels_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan and "book_id" in plan
