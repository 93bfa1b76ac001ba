"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, BPE encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents;
the last returns each document with its ids and the text they decode to. run() applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm import bpe, line_dedup, mixing, quality_rules, simhash
from shelfgraph.llm.queries import tokenizer_path
from shelfgraph.llm.shared import map_batches
from shelfgraph.session import dropped, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps. Null and empty texts go; each of repeated rows is judged alike."""
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood, nearly alike, in an earlier one. Null texts stay null; of repeated rows one keeps its lines; null ids come last."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group; texts without words are one group, of repeated rows one stays."""
    return simhash.first_of_groups(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows without words stay once, null sources are one source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded. A null text is encoded as an empty one."""
    own = docs.select("doc_id", "lang", "source", "text")
    schema = "doc_id long, lang string, source string, ids array<int>, decoded string"
    encoded = map_batches(own, bpe.encoded_rows(tokenizer_path("word_bpe_49k.json")), schema, 4 << 20)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixing_stage),
    ("bpe encoding", encode),
]

#: SQL cannot express the line similarity join, the SimHash and the merges in one statement over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. A stage's table goes as soon as the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            dropped(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
