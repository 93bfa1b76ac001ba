"""Entry points: python -m shelfgraph.cli STEP ...; each step reads and writes tables of a folder that Spark can reach."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.constants import PRIMARY_KEYS
from shelfgraph.operators import analysis, community, embedding, extraction, graph, normalize, property_graph, similarity, tables, text
from shelfgraph.plans.pipeline import Config, read_config
from shelfgraph.sources import tables as files

RAW = ("works", "books", "authors", "series")
FINAL = tuple(n for n in PRIMARY_KEYS if n.endswith("_final"))


def _raw(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [files.read_table(spark, folder, n) for n in RAW]


def extract(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC3] raw tables to canonical ones; --known: a folder whose works are left out, then the sample is topped up."""
    if a.known:
        found = extraction.extract_new(*_raw(spark, a.source), a.works, files.read_table(spark, a.known, "work_final", required=("work_id",)).select("work_id"), c.seed)
    else:
        found = extraction.extract(*_raw(spark, a.source), a.works, c.seed)
    files.write_tables(found, a.out)


def normalise(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC4] canonical tables to normalised ones with merge suggestions; --accept applies these."""
    found = normalize.normalize(files.read_catalogue(spark, a.source, FINAL))
    files.write_tables(normalize.merged(found) if a.accept else found, a.out)


def enrich(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC5, TXT9] keywords of works, books and series, and citations of works."""
    found = []
    for kind, table, key, column in (("work", "work_final", "work_id", "best_book_description"), ("book", "book_final", "book_id", "description"), ("series", "series_final", "series_id", "description")):
        words = text.hybrid_keywords(files.read_table(spark, a.source, table), key, column, min_df=c.min_df, max_df=c.max_df, max_terms=c.max_terms)
        found.append(words.select(F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), "keyword", "rank"))
    works = files.read_table(spark, a.source, "work_final")
    sources = works.select(F.lit("work").alias("source_type"), F.col("work_id").alias("source_id"), F.col("best_book_description").alias("text"))
    index = works.select(F.col("original_title").alias("name"), F.lit("work").alias("target_type"), F.col("work_id").alias("target_id"))
    files.write_tables({"extracted_keywords": found[0].unionByName(found[1]).unionByName(found[2]), "citation_mentions": text.citations(sources, index)}, a.out)


def inject(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC6] node and relationship tables with their counts."""
    nodes, rels, stats = property_graph.build(files.read_catalogue(spark, a.source, FINAL))
    files.write_tables({f"node_{k}": v for k, v in nodes.items()} | {f"rel_{k}": v for k, v in rels.items()} | {"counts": stats}, a.out)


def embed(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC7] vectors and term weights of the works' documents."""
    docs = files.read_table(spark, a.source, "work_final").select(F.col("work_id").alias("id"), F.concat_ws(" ", "original_title", "best_book_description", F.array_join("tags", " ")).alias("text"))
    vectors = embedding.embed(docs, a.encoder)
    files.write_tables({"embeddings": vectors.select(F.col("id").alias("work_id"), F.col("vector").alias("embedding"))}, a.out)
    files.write_weights(text.tfidf(docs, "id", "text", c.ngrams, c.min_df, c.max_df, c.max_terms), a.out)


def connect(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC8] edges of the nearest works and their graph's metrics; term weights count where the folder has them."""
    vectors = files.read_vectors(spark, f"{a.source}/embeddings.parquet")
    weight = c.tfidf_weight if files.exists(spark, f"{a.source}/weights.parquet") else 0.0
    if weight > 0:
        terms = files.read_table(spark, a.source, "weights").groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        vectors = similarity.with_terms(vectors, terms)
    edges = graph.canonical_edges(similarity.edges(similarity.neighbours(vectors, c.top_k, c.threshold, weight)))
    files.write_tables({"edges": edges}, a.out)
    files.write_document(graph.metrics(vectors.select("id"), spark.read.parquet(f"{a.out}/edges.parquet")), f"{a.out}/similarity_metrics.json")


def cluster(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC9, FLT10] the best partition's assignments, clusters of at least --smallest."""
    edges = files.read_table(spark, a.source, "edges", required=("source", "target", "score"))
    found = community.communities(edges, c.resolutions, c.seed)
    files.write_tables({"every_resolution": found}, a.out)
    found = files.read_table(spark, a.out, "every_resolution")
    best = community.best_partition(community.evaluate(edges, found, c.resolutions, c.smallest_community), found.select("id").distinct().count())
    chosen = found.join(best.select("resolution"), "resolution", "left_semi")
    files.write_tables({"communities": analysis.exported(chosen, a.smallest)}, a.out)
    files.write_document(best, f"{a.out}/community_metrics.json")


def merge(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC10] an increment's tables merged into a base's by primary key; tables of one side pass."""
    out = {}
    for name, keys in PRIMARY_KEYS.items():
        sides = [files.read_table(spark, f, name) for f in (a.source, a.increment) if files.exists(spark, f"{f}/{name}.parquet") or files.exists(spark, f"{f}/{name}.csv")]
        if sides:
            out[name] = tables.keep_last(*sides, list(keys)) if len(sides) == 2 else sides[0]
    files.write_tables(out, a.out)


def estimate(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    """[ORC11, AGG52, AGG55, AGG56] runs on record, mean step durations, and the time that a sample will take."""
    runs = files.read_runs(spark, f"{a.source}/*.json")
    runs.select("run", "sample_size", "node_count", "total_seconds").show(truncate=False)
    analysis.step_durations(runs).show(truncate=False)
    analysis.runtime_estimate(runs, a.works, a.nodes).show(truncate=False)


STEPS = {"extract": extract, "normalize": normalise, "enrich": enrich, "inject": inject, "embed": embed, "similarity": connect, "communities": cluster, "merge": merge, "estimate": estimate}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="shelfgraph")
    p.add_argument("step", choices=STEPS)
    p.add_argument("--source", required=True, help="folder of the tables read (estimate: of the run logs)")
    p.add_argument("--out", help="folder of the tables written")
    p.add_argument("--config", help="JSON or TOML file of parameters")
    p.add_argument("--works", type=int, default=2000)
    p.add_argument("--nodes", type=int)
    p.add_argument("--known", help="extract: folder whose works are left out")
    p.add_argument("--increment", help="merge: folder of the increment")
    p.add_argument("--accept", action="store_true", help="normalize: apply merge suggestions")
    p.add_argument("--encoder", default="shelfgraph.operators.embedding:hashed_words", help="embed: module:function")
    p.add_argument("--smallest", type=int, default=1, help="communities: least size of a cluster that is written")
    a = p.parse_args(argv)
    if a.step != "estimate" and not a.out:
        p.error("--out is required")
    if a.step == "merge" and not a.increment:
        p.error("--increment is required")
    STEPS[a.step](spark or SparkSession.builder.appName(f"shelfgraph {a.step}").getOrCreate(), a, read_config(a.config))


if __name__ == "__main__":
    main()
