"""Raw records of works, books, authors and series to the nine canonical tables; samples that are topped up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgraph.functions.scalars import is_english, safe_int, string_id
from shelfgraph.operators.tables import enforce_english, filled, sample
from shelfgraph.operators.text import keyword_list
from shelfgraph.session import written

REQUIRED = ("original_title", "work_id", "original_publication_year", "original_publication_month", "original_publication_day")
SHARED = ("year_final", "country_final", "languages_final")


def _truthy(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def matching(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """[JN1-JN3] rows whose key, as an id, is among the one column of ids; blank ids match nothing."""
    known = ids.select(string_id(ids.columns[0]).alias("__id")).where("__id <> ''")
    return df.join(known, string_id(key) == F.col("__id"), "left_semi")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """[JN4] rows whose key, as an id, is not among the one column of ids."""
    known = ids.select(string_id(ids.columns[0]).alias("__id")).where("__id <> ''")
    return df.join(known, string_id(key) == F.col("__id"), "left_anti")


def eligible_works(works: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """[FLT1, FLT2] works with all required fields whose own language, if stated, is English, without known ids."""
    own = filled(works, *REQUIRED).where(~_truthy("original_language_id") | is_english("original_language_id"))
    return own if known is None else without(own, "work_id", known)


def author_ids(books: DataFrame) -> DataFrame:
    """[AGG1] distinct author_id of the books' nested authors."""
    each = books.select(F.explode("authors").alias("a")).select(string_id("a.author_id").alias("author_id"))
    return each.where("author_id <> ''").distinct()


def series_ids(books: DataFrame) -> DataFrame:
    """[AGG2] distinct series_id of the books."""
    each = books.select(F.explode("series").alias("s")).select(string_id("s").alias("series_id"))
    return each.where("series_id <> ''").distinct()


def english_works(works: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[FLT4] works in English by their own language, their best edition's or any edition's, and the books of those."""
    named = works.withColumn("work_id", string_id("work_id")).where("work_id <> ''")
    rule = named.select("work_id", F.col("original_language_id").alias("language"), string_id("best_book_id").alias("best_id"))
    editions = books.select(string_id("book_id").alias("book_id"), string_id("work_id").alias("work_id"), F.col("language_code").alias("language"))
    kept = named.join(enforce_english(rule, editions).select("work_id").distinct(), "work_id", "left_semi").select(*works.columns)
    return kept, matching(books, "work_id", kept.select("work_id"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the place (1, 2, ...) of each row in the order of a column: by range partitions and their sizes, not in one task."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(placed, "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    # a row a partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def book_table(books: DataFrame) -> DataFrame:
    """[AGG3] book_final: numbers parsed, shelf names, and tags: sorted distinct shelves and keywords of the description."""
    shelves = F.filter(F.transform(F.coalesce("popular_shelves", F.array().cast("array<struct<name:string>>")), lambda s: s["name"]), lambda n: n.isNotNull() & (n != ""))
    own = books.withColumn("book_id", string_id("book_id")).where("book_id <> ''").withColumns({"__shelves": shelves, "__keywords": keyword_list(F.col("description"))})
    number = {c: safe_int(c).alias(c) for c in ("publication_year", "publication_month", "publication_day", "num_pages")}
    plain = lambda *names: [F.col(n) for n in names]
    return own.select(
        *plain("book_id", "title", "title_without_series", "image_url"), F.when(_truthy("url"), F.col("url")).otherwise(F.col("link")).alias("goodreads_url"),
        string_id("work_id").alias("work_id"), number["publication_year"], number["publication_month"], number["publication_day"],
        *plain("edition_information", "isbn13", "isbn"), number["num_pages"], *plain("publisher", "authors", "format", "description", "similar_books", "kindle_asin", "asin"),
        F.col("__shelves").alias("popular_shelves"), F.array_sort(F.array_distinct(F.concat("__shelves", "__keywords"))).alias("tags"), F.col("__keywords").alias("keywords"),
        *plain("language_code", "country_code"), F.coalesce("series", F.array().cast("array<string>")).alias("series_ids"),
    )


def work_table(works: DataFrame, books: DataFrame) -> DataFrame:
    """[AGG3, JN5, JN6] work_final from works and book_final: facts of the best edition, or of the first one there is; ids and tags of all editions.

    The first edition is the one of least book id. Lists are of one work's editions.
    """
    facts = F.struct(F.col("country_code").alias("country"), F.col("series_ids").alias("series"), "description", F.filter(F.transform(F.coalesce("authors", F.array().cast("array<struct<author_id:string,role:string>>")), lambda a: a["author_id"]), lambda a: a.isNotNull() & (a != "")).alias("authors"))
    editions = books.where("work_id <> ''").groupBy("work_id").agg(
        F.array_sort(F.collect_list("book_id")).alias("associated_book_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.min_by(facts, "book_id").alias("first"))
    best = books.select(F.col("book_id").alias("best_book_id"), facts.alias("best"))
    own = works.withColumns({"work_id": string_id("work_id"), "best_book_id": F.nullif(string_id("best_book_id"), F.lit(""))}).where("work_id <> ''")
    own = own.join(best, "best_book_id", "left").join(editions, "work_id", "left").withColumn("f", F.coalesce("best", "first"))
    none = F.array().cast("array<string>")
    return own.select(
        "work_id", "original_title", *[safe_int(f"original_publication_{p}").alias(f"original_publication_{p}") for p in ("year", "month", "day")],
        "original_language_id", "best_book_id", F.coalesce("f.authors", none).alias("best_book_author_ids"), F.col("f.country").alias("best_book_country_code"),
        F.coalesce("f.series", none).alias("best_book_series_ids"), F.col("f.description").alias("best_book_description"),
        F.coalesce("associated_book_ids", none).alias("associated_book_ids"), F.coalesce("tags", none).alias("tags"),
        F.lit(None).cast("string").alias("ddc"), F.lit(None).cast("string").alias("lcc"),
    )


def tag_table(books: DataFrame, series: DataFrame) -> DataFrame:
    """[AGG4, AGG5] tags_final: every shelf and keyword with its types and how often it occurs (a repeated shelf of one book counts again)."""
    shelf = books.select(F.explode("popular_shelves").alias("tag_name"), F.lit("shelf").alias("t"))
    words = books.select(F.explode("keywords").alias("tag_name"), F.lit("keyword").alias("t")).unionByName(series.select(F.explode("keywords").alias("tag_name"), F.lit("keyword").alias("t")))
    tags = shelf.unionByName(words).groupBy("tag_name").agg(F.array_join(F.array_sort(F.collect_set("t")), ";").alias("tag_type"), F.count("*").alias("occurrences"))
    return numbered(tags, "tag_name", "__n").select(F.concat(F.lit("tag_"), "__n").alias("tag_id"), "tag_name", "tag_type", "occurrences")


def _values(name: str, *parts: Column | tuple) -> DataFrame:
    out = None
    for df, c in parts:
        part = df.select(c.alias(name)).where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def canonical_tables(works: DataFrame, books: DataFrame, authors: DataFrame, series: DataFrame) -> dict[str, DataFrame]:
    """[AGG3] the nine canonical tables of raw records; those of several readers are written to the shared folder."""
    book = written(book_table(books), "book-final")
    work = written(work_table(works, book), "work-final")
    series_final = series.withColumn("series_id", string_id("series_id")).select(
        "series_id", "title", "description", safe_int("series_works_count").alias("series_works_count"), safe_int("primary_work_count").alias("primary_work_count"), "numbered", "note", keyword_list(F.col("description")).alias("keywords"))
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    people = authors.select(
        string_id("author_id").alias("author_id"), "name", "average_rating", "ratings_count", "text_reviews_count", none("author_wikidata_id"), none("date_of_birth"), none("date_of_death"),
        none("age", "double"), none("year_of_birth", "double"), none("year_of_death", "double"), none("place_of_birth"), none("citizenship"), none("place_of_death"), none("gender"))
    names = book.select(F.col("publisher").alias("publisher_name")).where(_truthy("publisher_name")).distinct()
    publishers = numbered(names, "publisher_name", "__n").select(F.concat(F.lit("publisher_"), "__n").alias("publisher_id"), "publisher_name", none("publisher_wikidata_id"), none("country"), none("year_established", "double"))
    year = _values("year", (book, F.col("publication_year")), (work, F.col("original_publication_year"))).where("year <> 0")
    return {
        "work_final": work, "book_final": book.drop("keywords"), "series_final": series_final, "people_final": people, "publisher_final": publishers, "year_final": year,
        "country_final": _values("country_code", (book, F.col("country_code")), (work, F.col("best_book_country_code"))),
        "languages_final": _values("language_code", (book, F.col("language_code")), (work, F.col("original_language_id").cast("string"))),
        "tags_final": tag_table(book, series_final),
    }


def extract(works: DataFrame, books: DataFrame, authors: DataFrame, series: DataFrame, k: int, seed: int = 42, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """[ORC2] canonical tables of a seeded sample of at most k eligible works, less those that turn out not to be in English."""
    picked = written(sample(eligible_works(works, known), "work_id", k, seed), "picked-works")
    kept, own = english_works(picked, matching(books, "work_id", picked.select("work_id")))
    own = written(own, "picked-books")
    return canonical_tables(kept, own, matching(authors, "author_id", author_ids(own)), matching(series, "series_id", series_ids(own)))


def extract_new(works: DataFrame, books: DataFrame, authors: DataFrame, series: DataFrame, wanted: int, known: DataFrame, seed: int = 42, least: int = 1000) -> dict[str, DataFrame]:
    """[TOP2] canonical tables of at least `wanted` new works, or of all there are: samples of max(3 * remaining, least) until enough pass."""
    spark = works.sparkSession
    seen, kept, own = written(known.select(string_id(known.columns[0]).alias("work_id")), "known-works"), None, None
    count, attempt = 0, 0
    while count < wanted:
        attempt += 1
        picked = written(sample(eligible_works(works, seen), "work_id", max(3 * (wanted - count), least), seed + attempt), "picked-works")
        if picked.isEmpty():
            break
        new, editions = english_works(picked, matching(books, "work_id", picked.select("work_id")))
        new, editions = written(new, "new-works"), written(editions, "new-books")
        count += new.select(string_id("work_id")).distinct().count()
        kept, own = (new, editions) if kept is None else (kept.unionByName(new), own.unionByName(editions))
        # works that failed are not asked again
        seen = written(seen.unionByName(picked.select(string_id("work_id").alias("work_id"))), "known-works")
    if kept is None:
        return canonical_tables(*(spark.createDataFrame([], df.schema) for df in (works, books, authors, series)))
    return canonical_tables(kept, own, matching(authors, "author_id", author_ids(own)), matching(series, "series_id", series_ids(own)))


def titles_by_author(books: DataFrame) -> DataFrame:
    """[AGG19] (author_id, titles): distinct titles of an author's books, sorted."""
    each = books.where("title IS NOT NULL").select(F.explode("authors").alias("a"), "title").select(string_id("a.author_id").alias("author_id"), F.trim("title").alias("title"))
    return each.where("author_id <> '' AND title <> ''").distinct().groupBy("author_id").agg(F.array_sort(F.collect_list("title")).alias("titles"))


def apply_each(frames: dict[str, DataFrame], rules: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """[ER5] each frame through the rule of its name; frames without one pass."""
    return {name: rules[name](df) if name in rules else df for name, df in frames.items()}


def empty_tables(spark: SparkSession, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """[ORC15] the canonical tables without rows, with their columns; raw: works, books, authors, series."""
    return canonical_tables(*(spark.createDataFrame([], raw[n].schema) for n in ("works", "books", "authors", "series")))
