import pyarrow as pa
from pyspark.sql import functions as F

from shelfgraph.operators import extraction, normalize, text
from shelfgraph.plans import catalog_tables

DATA = "/root/testdata/sf0.001"


def _raw(spark, tmp_path):
    rows = [(i, f"quiet harbour tale number{i % 7} harbour", "eng" if i % 3 else "fra", f"s{i % 4}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return catalog_tables.raw(spark, str(tmp_path))


def test_top_up_ends_with_enough_or_with_all(spark, tmp_path):
    r = _raw(spark, tmp_path)
    every = {x.work_id for x in extraction.extract(**r, k=10_000)["work_final"].collect()}
    known = spark.createDataFrame([(w,) for w in sorted(every)[:20]], "work_id string")
    got = {x.work_id for x in extraction.extract_new(**r, wanted=10, known=known, least=8)["work_final"].collect()}
    assert len(got) >= 10 and not got & set(sorted(every)[:20]) and got <= every
    rest = {x.work_id for x in extraction.extract_new(**r, wanted=10**6, known=known, least=8)["work_final"].collect()}
    assert rest == every - set(sorted(every)[:20])
    empty = extraction.empty_tables(spark, r)
    assert len(empty) == 9 and all(df.count() == 0 for df in empty.values())


def test_normalise_and_merge(spark):
    book = spark.createDataFrame([("1", "w", "ENG", " us", " Tor Two ", ["Sci-Fi", "to-read", "scifi"], [("a", "x"), ("", "y")]), ("1", "w", "ENG", " us", " Tor Two ", ["Sci-Fi", "to-read", "scifi"], [("a", "x"), ("", "y")]), (" ", "w", None, None, None, None, None)],
        "book_id string, work_id string, language_code string, country_code string, publisher string, tags array<string>, authors array<struct<author_id:string,role:string>>")
    book = book.withColumns({"popular_shelves": F.col("tags"), "series_ids": F.array(F.lit(" 7 "), F.lit(""))})
    work = spark.createDataFrame([("w", "1", "1", [" a", "a"], ["s"], ["1"], ["sea stories"])], "work_id string, best_book_id string, original_language_id string, best_book_author_ids array<string>, best_book_series_ids array<string>, associated_book_ids array<string>, tags array<string>")
    publisher = spark.createDataFrame([("p1", "Tor Two", None, None, None), ("p2", "Two Tor", "Q1", None, None), ("p3", "tor two!", None, "US", None)], "publisher_id string, publisher_name string, publisher_wikidata_id string, country string, year_established double")
    tags = spark.createDataFrame([("t1", "sea stories", "shelf", 3), ("t2", "Stories Sea", "keyword", 2), ("t3", "to-read", "shelf", 9)], "tag_id string, tag_name string, tag_type string, occurrences long")
    frames = normalize.normalize({"book_final": book, "work_final": work, "publisher_final": publisher, "tags_final": tags, "other": book})
    row = frames["book_final"].collect()
    assert len(row) == 1 and (row[0].language_code, row[0].country_code, row[0].publisher, row[0].tags, row[0].series_ids) == ("eng", "US", "Tor Two", ["sci-fi", "scifi"], ["7"])
    assert [a.author_id for a in row[0].authors] == ["a"] and frames["other"].count() == 3
    assert frames["work_final"].first().best_book_author_ids == ["a"]
    merged = normalize.merged(frames)
    assert {(p.publisher_name, p.publisher_wikidata_id, p.country) for p in merged["publisher_final"].collect()} == {("Tor Two", "Q1", "US")}
    assert merged["book_final"].first().publisher == "Tor Two"
    assert merged["work_final"].first().tags == ["stories sea"] or merged["work_final"].first().tags == ["sea stories"]
    assert [t.occurrences for t in merged["tags_final"].collect()] == [5]


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("n"), F.col("id") * 7919 % 1000).alias("x"))
    got = extraction.numbered(df.repartition(7), "x", "n").collect()
    assert [x for _, x in sorted((r.n, r.x) for r in got)] == sorted(r.x for r in got) and {r.n for r in got} == set(range(1, 1001))


def test_keyword_list_equals_a_plain_count(spark):
    import collections

    t = "Sea sea map the old old 12 map ship Sea a bb ccc ccc ship " * 3
    words = [w for w in t.lower().split() if len(w) > 2 and w != "the" and not w.isdigit()]
    want = [w for w, _ in sorted(collections.Counter(words).items(), key=lambda x: (-x[1], words.index(x[0])))][:3]
    assert spark.createDataFrame([(t,), (None,)], "t string").select(text.keyword_list(F.col("t"), 3).alias("k")).collect() == [(want,), ([],)]


def test_keywords_are_counted_once_a_text(spark):
    """An explode brings filters on its list, which had each text's words counted three times."""
    none = "cast(null as array<struct<author_id: string, role: string>>)"
    names = [f"cast(null as string) {c}" for c in ("title", "title_without_series", "image_url", "url", "link", "publication_year", "publication_month", "publication_day", "edition_information", "isbn13", "isbn", "num_pages", "publisher", "format", "kindle_asin", "asin", "language_code", "country_code")]
    texts = ["sea map sea", "map map old sea sea", "a 12", None, "x " * 40 + "sea"]
    books = spark.createDataFrame(list(enumerate(texts)), "id long, description string").selectExpr(
        "cast(id as string) book_id", "'1' work_id", "description", *names, f"{none} authors", "cast(array() as array<string>) similar_books", "cast(array() as array<struct<name: string>>) popular_shelves", "cast(array() as array<string>) series")
    table = extraction.book_table(books)
    tags = extraction.tag_table(table, table.limit(0))
    assert sorted((t.tag_name, t.tag_type, t.occurrences) for t in tags.collect()) == [("map", "keyword", 2), ("old", "keyword", 1), ("sea", "keyword", 3)]
    plan = table.select(F.explode("keywords"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_keywords_of_long_texts_and_slices(spark, monkeypatch):
    """Rows of several slices, ties at the cut, rows without words."""
    import collections
    import random

    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(30)}x" for _ in range(rnd.choice([0, 1, 5, 200]))) for _ in range(60)]
    want = [[w for w, _ in collections.Counter(t.split()).most_common(4)] for t in texts]
    lists = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(text, "SLICE", size)
        assert [[x["w"] for x in row] for row in text._most_frequent(4)(lists).to_pylist()] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r["rank"]): (r.keyword, r.n) for r in text.top_keywords(df, 4).collect()}
    assert got == {(i, n + 1): x for i, t in enumerate(texts) for n, x in enumerate(collections.Counter(t.split()).most_common(4))}
