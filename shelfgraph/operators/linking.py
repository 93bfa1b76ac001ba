"""Entity linking from a table of candidates (search results and their statements, gathered beforehand).

Candidates: source_id, query_pos, rank, entity_id, label, aliases, description, and arrays of labels or years
of their statements. String similarity is the native token and character ratio; a caller may pass another
Column function of two texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.functions.scalars import similarity_ratio, title_variants

FLOOR = 45
MOST_CANDIDATES = 6
Ratio = Callable[[Column, Column], Column]


def _ratio(a: Column, b: Column) -> Column:
    return similarity_ratio(a, b)


def best_ratio(ours: Column, theirs: Column, ratio: Ratio = _ratio) -> Column:
    """The largest ratio of any two items; 0 without items."""
    each = F.flatten(F.transform(ours, lambda a: F.transform(theirs, lambda b: ratio(a, b))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def first_candidates(candidates: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """[TOP6] of each source the first `most` distinct entities by query and rank."""
    once = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("source_id", "entity_id").orderBy("query_pos", "rank"))).where("__n = 1")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("query_pos", "rank", "entity_id"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("__n")


def titles(c: str = "") -> Column:
    """[SCL-A15] variants of a candidate's label and aliases."""
    names = F.concat(F.array(F.coalesce(f"{c}label", F.lit(""))), F.coalesce(f"{c}aliases", F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: title_variants(n))))


def _described(words: tuple) -> Column:
    return F.when(F.lower(F.coalesce("description", F.lit(""))).rlike("|".join(words)), 5).otherwise(0)


def _nearest_year(ours: Column, theirs: Column) -> Column:
    return F.array_min(F.flatten(F.transform(ours, lambda a: F.transform(theirs, lambda b: F.abs(a - b)))))


def work_score(ratio: Ratio = _ratio) -> Column:
    """[EL1, EL2] of columns title_variants, author_names, isbns, publishers, years (ours) and c_authors, c_isbns, c_publishers, c_years (theirs)."""
    base = best_ratio(F.col("title_variants"), titles(), ratio)
    author = best_ratio(F.col("author_names"), F.slice("c_authors", 1, 5), ratio)
    by_author = F.when(author >= 85, 25).when(author >= 70, 15).when(author >= 60, 5).when((F.size("author_names") > 0) & (F.size("c_authors") == 0), -5).otherwise(0)
    isbn = F.when(F.arrays_overlap("isbns", "c_isbns"), 30).otherwise(0)
    publisher = F.when(best_ratio(F.col("publishers"), F.slice("c_publishers", 1, 5), ratio) >= 70, 10).otherwise(0)
    gap = _nearest_year(F.col("years"), F.col("c_years"))
    year = F.when(gap <= 1, 5).when(gap >= 10, -5).otherwise(0)
    return F.when(base < 35, base).otherwise(base + _described(("novel", "book", "fiction", "literature")) + by_author + isbn + publisher + year)


def person_score(ratio: Ratio = _ratio) -> Column:
    """[EL3, EL4] of columns name_variants, birth_year (ours) and c_occupations, c_birth_years (theirs)."""
    base = best_ratio(F.col("name_variants"), titles(), ratio)
    job = F.when(F.exists(F.slice("c_occupations", 1, 8), lambda o: F.lower(o).rlike("author|writer|novelist|poet")), 10).otherwise(0)
    gap = F.array_min(F.transform("c_birth_years", lambda y: F.abs(y - F.col("birth_year"))))
    year = F.when(gap <= 2, 10).when(gap > 15, -5).otherwise(0)
    return F.when(base < 40, base).otherwise(base + _described(("author", "writer", "novelist", "journalist", "poet")) + job + year)


def publisher_score(ratio: Ratio = _ratio) -> Column:
    """[EL5, EL6] of columns name_variants, country (ours) and c_countries (theirs)."""
    base = best_ratio(F.col("name_variants"), titles(), ratio)
    country = F.when((F.coalesce("country", F.lit("")) != "") & (best_ratio(F.array("country"), F.col("c_countries"), ratio) >= 70), 10).otherwise(0)
    return F.when(base < 35, base).otherwise(base + _described(("publisher", "publishing", "imprint")) + country)


def link(contexts: DataFrame, candidates: DataFrame, score: Column, floor: float = FLOOR) -> DataFrame:
    """[EL7-EL9, TOP5] (source_id, entity_id, match_score): each source's best candidate at or over floor, the earliest on ties."""
    scored = contexts.join(first_candidates(candidates), "source_id").withColumn("match_score", score)
    best = scored.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("match_score"), "place"))).where("__n = 1")
    return best.where(F.col("match_score") >= floor).select("source_id", "entity_id", "match_score")


def fill(df: DataFrame, enrichment: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """[JN9-JN11, PRJ1] df's columns, where missing filled from enrichment's columns; columns maps ours to theirs. df's own other columns stay."""
    from shelfgraph.functions.scalars import clean

    side = enrichment.select(F.col(key).alias("__key"), *[F.col(theirs).alias(f"__{ours}") for ours, theirs in columns.items()])
    joined = df.join(side, df[key] == side["__key"], "left")
    own = lambda c: F.when(clean(c).isNotNull(), F.col(c)) if c in df.columns else F.lit(None)
    return joined.select(*[c for c in df.columns if c not in columns], *[F.coalesce(own(c), F.col(f"__{c}")).alias(c) for c in columns])
