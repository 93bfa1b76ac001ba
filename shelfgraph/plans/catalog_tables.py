"""Registered queries of extraction and normalisation, over raw records made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgraph.constants import DENIED_TAG_PARTS, DENIED_TAG_PATTERNS, DENIED_TAGS, KEYWORD_STOPWORDS
from shelfgraph.operators import extraction, normalize
from shelfgraph.plans.catalog import _in, query, table

#: Every document is an edition of one of 150 works; some works state a language, some have a best edition that isn't there.
_RAW = """
raw_books AS (SELECT doc_id::VARCHAR AS book_id, (doc_id % 150)::VARCHAR AS work_id, 'Title ' || (doc_id % 40) AS title, 'u' || doc_id AS link, CASE WHEN doc_id % 3 = 0 THEN '19' || (10 + doc_id % 80) WHEN doc_id % 3 = 1 THEN '' END AS publication_year,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ' ' || source || CASE WHEN doc_id % 2 = 0 THEN ' Press' ELSE '' END END AS publisher, text AS description, lang AS language_code, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS country_code,
  [(doc_id % 97)::VARCHAR, NULL, (doc_id % 89)::VARCHAR] AS author_ids, [(doc_id % 13)::VARCHAR, ''] AS series, ['To-Read', 'Shelf ' || (doc_id % 7), lang, '1984'] AS shelves FROM documents),
raw_works AS (SELECT DISTINCT (doc_id % 150)::VARCHAR AS work_id, CASE WHEN doc_id % 150 % 9 = 0 THEN '' ELSE 'Work ' || (doc_id % 150) END AS original_title, '1950' AS y, CASE doc_id % 150 % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' WHEN 2 THEN '' END AS original_language_id,
  CASE WHEN doc_id % 150 % 2 = 0 THEN (doc_id % 150 + CASE WHEN doc_id % 150 % 4 = 0 THEN 9000000 ELSE 150 END)::VARCHAR END AS best_book_id FROM documents)"""


def raw(spark, d) -> dict:
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    author = lambda c: F.struct(c.alias("author_id"), F.lit("author").alias("role"))
    books = docs.select(
        text(i).alias("book_id"), text(i % 150).alias("work_id"), F.concat(F.lit("Title "), i % 40).alias("title"), none.alias("title_without_series"), none.alias("image_url"), none.alias("url"), F.concat(F.lit("u"), i).alias("link"),
        F.when(i % 3 == 0, F.concat(F.lit("19"), 10 + i % 80)).when(i % 3 == 1, "").alias("publication_year"), *[none.alias(c) for c in ("publication_month", "publication_day", "edition_information", "isbn", "isbn13", "num_pages", "format", "kindle_asin", "asin")],
        F.when(i % 11 != 0, F.concat(F.lit(" "), "source", F.when(i % 2 == 0, " Press").otherwise(""))).alias("publisher"), F.array(author(text(i % 97)), author(none), author(text(i % 89))).alias("authors"), F.col("text").alias("description"),
        F.array().cast("array<string>").alias("similar_books"), F.transform(F.array(F.lit("To-Read"), F.concat(F.lit("Shelf "), i % 7), "lang", F.lit("1984")), lambda n: F.struct(n.alias("name"))).alias("popular_shelves"),
        F.col("lang").alias("language_code"), F.when(i % 4 == 0, "").otherwise(F.col("lang")).alias("country_code"), F.array(text(i % 13), F.lit("")).alias("series"),
    )
    w = i % 150
    works = docs.select(
        text(w).alias("work_id"), F.when(w % 9 == 0, "").otherwise(F.concat(F.lit("Work "), w)).alias("original_title"), *[F.lit(v).alias(f"original_publication_{p}") for p, v in (("year", "1950"), ("month", "2"), ("day", "3"))],
        F.when(w % 5 == 0, "eng").when(w % 5 == 1, "fre").when(w % 5 == 2, "").alias("original_language_id"), F.when(w % 2 == 0, text(w + F.when(w % 4 == 0, 9000000).otherwise(150))).alias("best_book_id"),
    ).distinct()
    people = spark.range(200).select(text(F.col("id")).alias("author_id"), F.concat(F.lit("Person "), "id").alias("name"), *[none.alias(c) for c in ("average_rating", "ratings_count", "text_reviews_count")])
    series = spark.range(20).select(text(F.col("id")).alias("series_id"), F.concat(F.lit("Series "), "id").alias("title"), F.lit("quiet harbour tales quiet").alias("description"), *[none.alias(c) for c in ("series_works_count", "primary_work_count", "numbered", "note")])
    return {"works": works, "books": books, "authors": people, "series": series}


_ENGLISH = """
elig AS (SELECT * FROM raw_works WHERE original_title <> '' AND (coalesce(original_language_id, '') = '' OR starts_with(original_language_id, 'en'))),
any_en AS (SELECT work_id, bool_or(starts_with(lower(language_code), 'en')) AS en FROM raw_books GROUP BY work_id),
works AS (SELECT w.* FROM elig w LEFT JOIN raw_books b ON b.book_id = w.best_book_id AND b.work_id IN (SELECT work_id FROM elig) LEFT JOIN any_en a ON a.work_id = w.work_id
  WHERE CASE WHEN coalesce(w.original_language_id, '') <> '' THEN true WHEN b.book_id IS NOT NULL THEN starts_with(lower(b.language_code), 'en') ELSE coalesce(a.en, false) END),
books AS (SELECT * FROM raw_books WHERE work_id IN (SELECT work_id FROM works))"""
_WORDS = rf"""
kt AS (SELECT book_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (SELECT book_id, regexp_extract_all(lower(description), '[\p{{L}}\p{{N}}_]+') AS ws FROM books)),
kc AS (SELECT book_id, token, row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, min(pos)) AS r FROM kt WHERE length(token) > 2 AND token NOT IN {_in(KEYWORD_STOPWORDS)} AND NOT regexp_matches(token, '^\p{{Nd}}+$') GROUP BY book_id, token),
kw AS (SELECT book_id, token AS tag FROM kc WHERE r <= 10),
bt AS (SELECT book_id, list_sort(list_distinct(list_concat(shelves, coalesce(k, [])))) AS tags FROM books LEFT JOIN (SELECT book_id, list(tag) AS k FROM kw GROUP BY book_id) USING (book_id))"""


def _tables(spark, d) -> dict:
    r = raw(spark, d)
    return extraction.extract(r["works"], r["books"], r["authors"], r["series"], 1000)


@query("extracted_works", f"""WITH {_RAW}, {_ENGLISH}, {_WORDS},
e AS (SELECT work_id, string_agg(book_id, ',' ORDER BY book_id) AS associated_book_ids, min(book_id) AS f FROM books GROUP BY work_id),
t AS (SELECT work_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT work_id, unnest(tags) AS tag FROM books JOIN bt USING (book_id)) GROUP BY work_id)
SELECT w.work_id, original_title, 1950 AS original_publication_year, original_language_id, w.best_book_id, b.author_ids[1] || ',' || b.author_ids[3] AS best_book_author_ids, b.country_code AS best_book_country_code, array_to_string(b.series, ',') AS best_book_series_ids,
  b.description AS best_book_description, e.associated_book_ids, t.tags FROM works w JOIN e USING (work_id) JOIN t USING (work_id) LEFT JOIN books x ON x.book_id = w.best_book_id JOIN books b ON b.book_id = coalesce(x.book_id, e.f)""")
def extracted_works(spark, d):
    t = _tables(spark, d)["work_final"]
    joined = {c: F.array_join(c, ",") for c in ("best_book_author_ids", "best_book_series_ids", "associated_book_ids", "tags")}
    return t.withColumns(joined).drop("original_publication_month", "original_publication_day", "ddc", "lcc")


@query("extracted_tags", f"""WITH {_RAW}, {_ENGLISH}, {_WORDS}, s AS (SELECT unnest(['quiet', 'harbour', 'tales']) AS tag FROM (SELECT DISTINCT unnest(series) AS x FROM books) WHERE x <> ''),
u AS (SELECT unnest(shelves) AS tag, 'shelf' AS t FROM books UNION ALL SELECT tag, 'keyword' FROM kw UNION ALL SELECT tag, 'keyword' FROM s)
SELECT 'tag_' || row_number() OVER (ORDER BY tag) AS tag_id, tag AS tag_name, string_agg(DISTINCT t, ';' ORDER BY t) AS tag_type, count(*) AS occurrences FROM u GROUP BY tag""")
def extracted_tags(spark, d):
    return _tables(spark, d)["tags_final"]


@query("extracted_values", f"""WITH {_RAW}, {_ENGLISH}
SELECT 'publisher' AS kind, 'publisher_' || row_number() OVER (ORDER BY v) || '/' || v AS value FROM (SELECT DISTINCT publisher AS v FROM books WHERE publisher IS NOT NULL)
UNION ALL SELECT DISTINCT 'year', y::VARCHAR FROM (SELECT publication_year::INT AS y FROM books WHERE publication_year <> '' UNION ALL SELECT 1950 FROM works)
UNION ALL SELECT DISTINCT 'country', country_code FROM books WHERE country_code <> ''
UNION ALL SELECT DISTINCT 'language', l FROM (SELECT language_code AS l FROM books UNION ALL SELECT original_language_id FROM works) WHERE l <> ''
UNION ALL SELECT DISTINCT 'person', a FROM (SELECT unnest(author_ids) AS a FROM books) WHERE a IS NOT NULL
UNION ALL SELECT DISTINCT 'series', s FROM (SELECT unnest(series) AS s FROM books) WHERE s <> ''""")
def extracted_values(spark, d):
    t = _tables(spark, d)
    one = lambda kind, df, value: df.select(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    parts = [one("publisher", t["publisher_final"], F.concat_ws("/", "publisher_id", "publisher_name")), one("year", t["year_final"], F.col("year")), one("country", t["country_final"], F.col("country_code")),
             one("language", t["languages_final"], F.col("language_code")), one("person", t["people_final"], F.col("author_id")), one("series", t["series_final"], F.col("series_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("author_titles", "SELECT author_id, string_agg(DISTINCT title, '|' ORDER BY title) AS titles FROM (SELECT unnest([(doc_id % 97)::VARCHAR, (doc_id % 89)::VARCHAR]) AS author_id, 'Title ' || (doc_id % 40) AS title FROM documents) GROUP BY author_id")
def author_titles(spark, d):
    return extraction.titles_by_author(raw(spark, d)["books"]).select("author_id", F.array_join("titles", "|").alias("titles"))


def _deny(t: str) -> str:
    parts, patterns = "|".join(p.replace("-", "[-]") for p in DENIED_TAG_PARTS), "|".join(DENIED_TAG_PATTERNS)
    return f"NOT ({t} IN {_in(DENIED_TAGS)} OR regexp_matches({t}, '{parts}') OR regexp_matches({t}, '{patterns}') OR regexp_matches({t}, '^\\p{{Nd}}+$'))"


@query("normalized_books", f"""WITH {_RAW}, books AS (SELECT * FROM raw_books), {_WORDS}
SELECT book_id, work_id, lower(trim(language_code)) AS language_code, upper(trim(country_code)) AS country_code, coalesce(trim(publisher), '') AS publisher, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda x: lower(trim(x))), lambda x: length(x) >= 3 AND {_deny('x')}))), ',') AS tags,
  series[1] AS series_ids, author_ids[1] || ',' || author_ids[3] AS authors FROM books JOIN bt USING (book_id)""")
def normalized_books(spark, d):
    own = normalize.books(extraction.book_table(raw(spark, d)["books"]).withColumn("country_code", F.concat(F.lit(" "), "country_code")))
    return own.select("book_id", "work_id", "language_code", "country_code", "publisher", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.array_join("series_ids", ",").alias("series_ids"), F.array_join(F.transform("authors", lambda a: a["author_id"]), ",").alias("authors"))


@query("normalized_tags", f"""WITH {_RAW}, books AS (SELECT * FROM raw_books), {_WORDS},
u AS (SELECT unnest(shelves) AS tag, 'shelf' AS t FROM books UNION ALL SELECT tag, 'keyword' FROM kw),
g AS (SELECT 'tag_' || row_number() OVER (ORDER BY tag) AS tag_id, tag AS tag_name, string_agg(DISTINCT t, ';') AS tag_type, count(*) AS n FROM u GROUP BY tag),
a AS (SELECT *, trim(regexp_replace(lower(tag_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS tag_key FROM g WHERE {_deny('lower(tag_name)')})
SELECT tag_key, min(tag_name) AS tag_name, min(tag_id) AS tag_id, sum(n)::BIGINT AS occurrences, bool_or(contains(tag_type, 'shelf')) AS shelf FROM a GROUP BY tag_key""")
def normalized_tags(spark, d):
    r = raw(spark, d)
    books = extraction.book_table(r["books"])
    own = normalize.tags(extraction.tag_table(books, books.limit(0)))
    return own.select("tag_key", "tag_name", "tag_id", "occurrences", F.col("tag_type").contains("shelf").alias("shelf"))


@query("normalized_values", """
SELECT 'year' AS kind, y::VARCHAR AS value FROM (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders) UNION ALL SELECT DISTINCT 'country', upper(trim(lang)) FROM documents WHERE trim(lang) <> '' UNION ALL SELECT DISTINCT 'language', lower(trim(lang)) FROM documents WHERE trim(lang) <> ''""")
def normalized_values(spark, d):
    year = table(spark, d, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise("")).alias("year"))
    year = year.unionByName(spark.createDataFrame([("x",), (None,), ("",)], "year string"))
    lang = table(spark, d, "documents").select(F.concat(F.lit(" "), "lang").alias("c"))
    out = [normalize.years(year).select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value"))]
    out += [normalize.countries(lang.withColumnRenamed("c", "country_code")).select(F.lit("country").alias("kind"), F.col("country_code").alias("value"))]
    out += [normalize.languages(lang.select(F.upper("c").alias("language_code"))).select(F.lit("language").alias("kind"), F.col("language_code").alias("value"))]
    return out[0].unionByName(out[1]).unionByName(out[2])
