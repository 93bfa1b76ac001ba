"""The batch pipeline's configuration and a driver that times its steps."""

from __future__ import annotations

import json
import time
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from shelfgraph.operators import community, graph, similarity, text


@dataclass(frozen=True)
class Config:
    """Production parameters; one place for each."""

    seed: int = 42
    top_k: int = 20
    threshold: float = 0.5
    tfidf_weight: float = 0.1
    max_terms: int = 25_000
    min_df: int = 2
    max_df: float = 0.95
    ngrams: int = 2
    resolutions: tuple = community.RESOLUTIONS
    smallest_community: int = 3


def read_config(path: str | None) -> Config:
    """[ORC12] a Config with the values of a JSON or TOML file set over the defaults; unknown names are an error."""
    if path is None:
        return Config()
    with open(path, "rb") as f:
        values = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def run_steps(steps: list[tuple[str, Callable[[dict], dict]]], state: dict) -> tuple[dict, list[dict]]:
    """[ORC1a] Runs named steps in order, each adding to state; the first failure ends the run. Returns state and each step's seconds."""
    log = []
    for title, step in steps:
        began = time.time()
        state |= step(state)
        log.append({"title": title, "seconds": round(time.time() - began, 3)})
    return state, log


def analyse(documents: DataFrame, vectors: DataFrame, config: Config | None = None) -> tuple[dict, list[dict]]:
    """[ORC7-ORC9] Embeddings to communities: documents (id, text) and vectors (id, vector) give ranked neighbours, edges, metrics, assignments."""
    c = config or Config()

    def terms(s: dict) -> dict:
        from pyspark.sql import functions as F

        weights = text.tfidf_lists(documents, "id", "text", c.ngrams, c.min_df, c.max_df, c.max_terms).select("id", "terms", "weights")
        return {"rows": similarity.with_terms(vectors, weights)}

    steps = [
        ("tf-idf", terms),
        ("similarity", lambda s: {"ranked": similarity.neighbours(s["rows"], c.top_k, c.threshold, c.tfidf_weight)}),
        ("edges", lambda s: {"edges": graph.canonical_edges(similarity.edges(s["ranked"]))}),
        ("metrics", lambda s: {"metrics": graph.metrics(vectors.select("id"), s["edges"])}),
        ("communities", lambda s: {"assigned": community.communities(s["edges"], c.resolutions, c.seed)}),
        ("evaluation", lambda s: {"evaluated": community.evaluate(s["edges"], s["assigned"], c.resolutions, c.smallest_community)}),
    ]
    return run_steps(steps, {})


def run_log(config: Config, log: list[dict]) -> str:
    """[SRC16's input] a run as JSON."""
    return json.dumps({"config": asdict(config), "steps": log, "total_seconds": sum(x["seconds"] for x in log)})
