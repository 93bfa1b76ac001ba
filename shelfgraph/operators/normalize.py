"""Normalised copies of the canonical tables, merge suggestions and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.constants import DENIED_TAG_PARTS, DENIED_TAG_PATTERNS, DENIED_TAGS
from shelfgraph.functions.scalars import clean_authors, clean_ids, clean_strings, normalized, string_id
from shelfgraph.operators.extraction import apply_each
from shelfgraph.operators.tables import apply_map, apply_map_to_list, canonical_names, first_rows, group_by_key, map_closure, similar_names, tag_allowed


def _tags(c: str) -> Column:
    return clean_strings(c, True, DENIED_TAGS, True, 3, DENIED_TAG_PARTS, DENIED_TAG_PATTERNS)


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row a key that isn't blank: the first by content."""
    return first_rows(df.where(F.col(key) != ""), [key], [F.xxhash64(*df.columns)])


def _set(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: e for c, e in rules.items() if c in df.columns})


def works(df: DataFrame) -> DataFrame:
    """[AGG10]"""
    ids = {c: string_id(c) for c in ("work_id", "best_book_id", "original_language_id")}
    lists = {c: clean_ids(c) for c in ("best_book_author_ids", "best_book_series_ids", "associated_book_ids")}
    return _once(_set(df, ids | lists | {"tags": _tags("tags")}), "work_id")


def books(df: DataFrame) -> DataFrame:
    """[AGG11] language in lower case, country in upper case, tags and shelves through the deny lists."""
    rules = {"book_id": string_id("book_id"), "work_id": string_id("work_id"), "language_code": normalized("language_code", True), "country_code": F.upper(normalized("country_code")), "publisher": normalized("publisher")}
    lists = {"popular_shelves": _tags("popular_shelves"), "tags": _tags("tags"), "series_ids": clean_ids("series_ids"), "authors": clean_authors(F.coalesce("authors", F.array().cast("array<struct<author_id:string,role:string>>")))}
    return _once(_set(df, rules | lists), "book_id")


def people(df: DataFrame) -> DataFrame:
    return _once(_set(df, {"author_id": string_id("author_id")}), "author_id")


def series(df: DataFrame) -> DataFrame:
    """[AGG12]"""
    return _once(_set(df, {"series_id": string_id("series_id"), "keywords": clean_strings("keywords", True)}), "series_id")


def publishers(df: DataFrame, ascii_key: bool = False) -> DataFrame:
    """[AGG6] one row a match key: first values in the order of names, the least id."""
    own = df.withColumns({"publisher_id": string_id("publisher_id"), "publisher_name": normalized("publisher_name")}).where("publisher_id <> ''")
    own = own.withColumn("__pos", F.struct("publisher_name", "publisher_id"))
    return group_by_key(own, "publisher_name", "publisher_id", "__pos", ["publisher_wikidata_id", "country", "year_established"], ascii_key=ascii_key).withColumnRenamed("key", "publisher_key")


def tags(df: DataFrame, ascii_key: bool = False) -> DataFrame:
    """[AGG7, AGG8] allowed tags, one row a match key: first name, least id, union of types, sum of occurrences."""
    own = df.withColumns({"tag_id": string_id("tag_id"), "tag_name": normalized("tag_name")}).where((F.col("tag_id") != "") & tag_allowed(F.col("tag_name")))
    own = own.withColumn("__pos", F.struct("tag_name", "tag_id"))
    return group_by_key(own, "tag_name", "tag_id", "__pos", sums=["occurrences"], unions=["tag_type"], ascii_key=ascii_key).withColumnRenamed("key", "tag_key")


def years(df: DataFrame) -> DataFrame:
    """[AGG13]"""
    return df.select(F.col("year").cast("string").try_cast("double").cast("int").alias("year")).where("year IS NOT NULL").distinct()


def countries(df: DataFrame) -> DataFrame:
    """[AGG14]"""
    return _once(_set(df, {"country_code": F.upper(normalized("country_code"))}), "country_code")


def languages(df: DataFrame) -> DataFrame:
    """[AGG15]"""
    return _once(_set(df, {"language_code": normalized("language_code", True)}), "language_code")


RULES = {
    "work_final": works, "book_final": books, "series_final": series, "people_final": people, "publisher_final": publishers, "tags_final": tags,
    "year_final": years, "country_final": countries, "languages_final": languages,
}


def suggestions(frames: dict[str, DataFrame], publisher_threshold: float = 90.0, tag_threshold: float = 92.0) -> dict[str, DataFrame]:
    """[ER4] frames with merge suggestions for publishers and tags."""
    return frames | {
        "publisher_merge_suggestions": similar_names(frames["publisher_final"], "publisher_name", publisher_threshold, limit=5),
        "tag_merge_suggestions": similar_names(frames["tags_final"], "tag_name", tag_threshold, limit=5),
    }


def normalize(frames: dict[str, DataFrame], publisher_threshold: float = 90.0, tag_threshold: float = 92.0) -> dict[str, DataFrame]:
    """[ER5, ORC4] each frame by its rule, then merge suggestions."""
    return suggestions(apply_each(frames, RULES), publisher_threshold, tag_threshold)


def merged(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """[ER1, ER3] suggestions accepted: names replaced by their canonical ones in every table that holds them, tables normalised again."""
    publisher, tag = (map_closure(canonical_names(frames[f"{n}_merge_suggestions"])) for n in ("publisher", "tag"))
    # tag lists are in lower case
    tag = tag.select(F.lower("source").alias("source"), F.lower("canonical").alias("canonical"))
    book = apply_map(frames["book_final"], "publisher", publisher)
    for c in ("tags", "popular_shelves"):
        book = book.drop(c).join(apply_map_to_list(book, "book_id", c, tag), "book_id")
    work = frames["work_final"]
    work = work.drop("tags").join(apply_map_to_list(work, "work_id", "tags", tag), "work_id")
    own = frames | {
        "book_final": book, "work_final": work,
        "publisher_final": apply_map(frames["publisher_final"].drop("publisher_key"), "publisher_name", publisher), "tags_final": apply_map(frames["tags_final"].drop("tag_key"), "tag_name", tag),
    }
    return suggestions(apply_each(own, RULES))
