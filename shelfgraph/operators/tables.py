"""Filters, semi-joins, dedupes, unions and merges of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.constants import DENIED_TAG_PARTS, DENIED_TAG_PATTERNS, DENIED_TAGS
from shelfgraph.functions.scalars import denied, is_english, match_key, sample_key
from shelfgraph.operators.components import connected_components
from shelfgraph.session import checkpointed


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *candidates: str) -> str | None:
    """[PRJ4] the first of the candidates that df has."""
    return next((c for c in candidates if c in df.columns), None)


def filled(df: DataFrame, *names: str) -> DataFrame:
    """[FLT1, FLT5] rows whose columns are neither null nor blank."""
    for n in names:
        df = df.where(F.col(n).isNotNull() & (F.trim(F.col(n).cast("string")) != ""))
    return df


def enforce_english(works: DataFrame, editions: DataFrame) -> DataFrame:
    """[FLT4] works (work_id, language, best_id) whose own language is English, or that have none and whose best edition is,
    or, where that edition isn't there, any edition of editions (book_id, work_id, language)."""
    best = editions.select(F.col("book_id").alias("best_id"), is_english("language").alias("best_en"))
    any_en = editions.groupBy("work_id").agg(F.max(is_english("language").cast("int")).alias("any_en"))
    joined = works.join(best, "best_id", "left").join(any_en, "work_id", "left")
    own = F.trim(F.coalesce(F.col("language").cast("string"), F.lit("")))
    keep = F.when(own != "", is_english("language")).when(F.col("best_en").isNotNull(), F.col("best_en")).otherwise(F.coalesce(F.col("any_en"), F.lit(0)) == 1)
    return joined.where(keep).select(*works.columns)


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """[TOP1, TOP2] k rows, uniform and the same for a seed: least keyed hash first."""
    return df.orderBy(sample_key(key, seed), key).limit(k)


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """[AGG9-AGG12, SRT1] for each key the first row in order."""
    return df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__row = 1").drop("__row")


def group_by_key(df: DataFrame, name: str, row_id: str, pos: str, firsts: list[str] = (), sums: list[str] = (), unions: list[str] = (), ascii_key: bool = False) -> DataFrame:
    """[AGG6-AGG8] rows with one match key become one: the first name, the least id, first values that aren't null, sums, unions of ; lists."""
    keyed = df.withColumn("key", match_key(name, ascii_key))
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(pos)))
    aggs = [F.min_by(name, pos).alias(name), F.min(row_id).alias(row_id)]
    aggs += [value(c).alias(c) for c in firsts] + [F.sum(c).alias(c) for c in sums]
    aggs += [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, ";"))))), ";").alias(c) for c in unions]
    return keyed.groupBy("key").agg(*aggs)


def tag_allowed(tag: Column) -> Column:
    """[FLT6] a tag that no deny list names."""
    t = F.lower(F.trim(tag))
    return ~denied(t, DENIED_TAGS, DENIED_TAG_PARTS, DENIED_TAG_PATTERNS)


def keep_last(base: DataFrame, increment: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """[SET1-SET3] both, columns by name; for each key the increment's row, wholesale: the last by `order`, then by content, if it has several."""
    both = base.withColumn("__side", F.lit(0)).unionByName(increment.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    content = F.xxhash64(*[c for c in both.columns if c != "__side"])
    return first_rows(both, keys, [F.desc("__side"), *map(F.desc, order), content]).drop("__side")


def map_closure(mapping: DataFrame) -> DataFrame:
    """[SCL-C2, SCL-C3] (source, canonical) followed to the end of each chain by pointer doubling; identities go.

    A chain that runs into a cycle ends at the first name of it that it meets; names on a cycle stay as they are. Of
    several targets of one source the least counts. log2(n) rounds of one equi-join each settle every chain that ends;
    what is unsettled then points into cycles, whose names are exactly the targets reached.
    """
    own = checkpointed(mapping.where("source <> canonical").groupBy("source").agg(F.min("canonical").alias("canonical")))
    settled, cur = _doubled(own)
    if not settled:
        on_cycle = checkpointed(cur.join(own.select(F.col("source").alias("canonical")), "canonical", "left_semi").select(F.col("canonical").alias("source")).distinct())
        _, cur = _doubled(checkpointed(own.join(on_cycle, "source", "left_anti")))
    return cur


def _doubled(mapping: DataFrame) -> tuple[bool, DataFrame]:
    """Whether every chain has ended after log2(n) + 1 doublings, and the pointers then."""
    cur = mapping
    for _ in range(max(1, mapping.count()).bit_length() + 1):
        step = cur.alias("a").join(cur.alias("b"), F.col("a.canonical") == F.col("b.source"), "left")
        step = checkpointed(step.select("a.source", F.coalesce("b.canonical", "a.canonical").alias("canonical"), F.col("b.source").isNotNull().alias("moved")))
        cur = step.select("source", "canonical")
        if step.where("moved").isEmpty():
            return True, cur
    return False, cur


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """[JN7, ER3] column's values replaced by their canonical ones."""
    m = mapping.select(F.col("source").alias("__from"), F.col("canonical").alias("__to"))
    return df.join(m, df[column] == m["__from"], "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def apply_map_to_list(df: DataFrame, key: str, column: str, mapping: DataFrame) -> DataFrame:
    """[JN8] (key, column): items replaced by their canonical ones, first occurrences in order."""
    each = df.select(key, F.posexplode(column).alias("pos", "item"))
    mapped = apply_map(each, "item", mapping).groupBy(key, "item").agg(F.min("pos").alias("pos"))
    lists = mapped.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(column))
    return df.select(key).join(lists, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def canonical_names(pairs: DataFrame) -> DataFrame:
    """[ER1] (source, canonical) of suggestion pairs (source, candidate): a component's shortest, then least, name."""
    names = pairs.select(F.col("source").alias("name")).unionByName(pairs.select(F.col("candidate").alias("name"))).distinct()
    found = connected_components(pairs, "source", "candidate").withColumnsRenamed({"node": "name"})
    best = found.groupBy("component").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("canonical"))
    return names.join(found, "name").join(best, "component").where("name <> canonical").select(F.col("name").alias("source"), "canonical")


def review(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """[ER2] (source, canonical) of decisions (source, candidate, choice, manual): 1 keeps the source, 2 the candidate, m the manual name."""
    d = pairs.join(decisions, ["source", "candidate"])
    one = d.where("choice = '1'").select(F.col("candidate").alias("source"), F.col("source").alias("canonical"))
    two = d.where("choice = '2'").select("source", F.col("candidate").alias("canonical"))
    own = d.where("choice = 'm' AND manual <> ''").select(F.explode(F.array("source", "candidate")).alias("source"), F.col("manual").alias("canonical"))
    return map_closure(one.unionByName(two).unionByName(own).where("source <> canonical"))


def similar_names(names: DataFrame, name: str, threshold: float, blocked: bool = True, limit: int | None = None) -> DataFrame:
    """[JN28, ER4] (source, candidate, similarity) of distinct names at or over threshold, source < candidate.

    blocked: names meet only if their first characters agree (an equi-join); without it they meet by any shared
    token, which loses no pair of token Jaccard above 0 but pairs alike in characters alone. limit: best of each name.
    """
    from shelfgraph.functions.scalars import similarity_ratio

    own = names.select(F.trim(name).alias("n")).where("n <> ''").distinct()
    key = F.array(F.lower(F.substring("n", 1, 1))) if blocked else F.array_distinct(F.split(F.lower("n"), r"\s+"))
    keyed = own.select("n", F.explode(key).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.n").alias("source"), F.col("b.n").alias("candidate")).distinct()
    scored = pairs.withColumn("similarity", similarity_ratio("source", "candidate")).where(F.col("similarity") >= threshold)
    if limit is None:
        return scored
    both = scored.unionByName(scored.select(F.col("candidate").alias("source"), F.col("source").alias("candidate"), "similarity"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "candidate"))).where(F.col("r") <= limit)
    return best.select(F.least("source", "candidate").alias("source"), F.greatest("source", "candidate").alias("candidate"), "similarity").distinct()


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """[SNK13, SNK17] rows merged into existing by key: null keys go, a null never replaces a value, of repeated keys the last value (by __pos, if there, then by content) stays."""
    cols = [c for c in rows.columns if c not in (key, "__pos")]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("__pos", F.xxhash64(c)))).alias(c)
    rows = rows if "__pos" in rows.columns else rows.withColumn("__pos", F.lit(0))
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*map(last, cols))
    every = [c for c in dict.fromkeys([*existing.columns, *new.columns]) if c != key]
    e, n = existing.alias("e"), new.alias("n")
    pick = lambda c: F.coalesce(*([F.col(f"n.{c}")] if c in new.columns else []), *([F.col(f"e.{c}")] if c in existing.columns else [])).alias(c)
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"n.{key}", f"e.{key}").alias(key), *map(pick, every))


def merge_relationships(feed: DataFrame, starts: DataFrame, ends: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """[SNK14] distinct (start, end) of feed whose ends both exist as nodes, without those there already; of repeated pairs the last row (by __pos, if there, then by content)."""
    rows = feed.where("start IS NOT NULL AND end IS NOT NULL")
    rows = rows.join(starts.select(F.col(starts.columns[0]).alias("start")), "start", "left_semi").join(ends.select(F.col(ends.columns[0]).alias("end")), "end", "left_semi")
    more = [c for c in rows.columns if c not in ("start", "end", "__pos")]
    if more:
        place = F.struct(*(["__pos"] if "__pos" in rows.columns else []), F.xxhash64(*more).alias("content"))
        rows = rows.groupBy("start", "end").agg(F.max_by(F.struct(*more), place).alias("row")).select("start", "end", "row.*")
    else:
        rows = rows.select("start", "end").distinct()
    return rows if existing is None else rows.join(existing.select("start", "end"), ["start", "end"], "left_anti")


def upsert_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame, clear_first: bool = False) -> DataFrame:
    """[SNK16] (start, end, score): existing edges with the scores of `edges` set over theirs, where both ends are nodes; clear_first drops the existing ones."""
    new = merge_relationships(edges.select("start", "end", "score"), nodes, nodes)
    if clear_first:
        return new
    return existing.select("start", "end", "score").join(new.select("start", "end"), ["start", "end"], "left_anti").unionByName(new)


def relationship_counts(name: str, feed: DataFrame, created: DataFrame) -> DataFrame:
    """[SNK14, SNK19] (relationship, attempted, created): one row."""
    a = feed.where("start IS NOT NULL AND end IS NOT NULL").agg(F.count("*").alias("attempted"))
    c = created.agg(F.count("*").alias("created"))
    return a.join(c, F.lit(True)).select(F.lit(name).alias("relationship"), "attempted", "created")


def relationship_totals(name: str, feed: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """[SNK14, SNK19] (relationship, attempted, created) in one pass over feed: rows with both ends, and distinct pairs whose ends are nodes."""
    rows = feed.where("start IS NOT NULL AND end IS NOT NULL").groupBy("start", "end").agg(F.count("*").alias("n"))
    rows = rows.join(starts.select(F.col(starts.columns[0]).alias("start"), F.lit(1).alias("s")).distinct(), "start", "left").join(ends.select(F.col(ends.columns[0]).alias("end"), F.lit(1).alias("e")).distinct(), "end", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"), F.coalesce(F.sum(F.col("s") * F.col("e")), F.lit(0)).cast("long").alias("created")).select(F.lit(name).alias("relationship"), "attempted", "created")


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """[SNK15] keys that occur more than once; none means the constraint holds."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
