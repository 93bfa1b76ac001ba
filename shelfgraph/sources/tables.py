"""Reading and writing the catalogue's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.functions.scalars import parsed_list
from shelfgraph.operators.extraction import numbered
from shelfgraph.operators.tables import require_columns


def read_json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """[SRC1] gzip or plain JSON lines; blank and malformed lines are dropped. gzip can't be split, so rows are dealt out again where partitions is given."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.repartition(partitions) if partitions else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, through the file system that Spark would read it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None, lists: tuple = (), required: tuple = ()) -> DataFrame:
    """[SRC2-SRC15, SRC22] name.parquet, else name.csv with its list columns parsed, else, with a schema, an empty table, else an error."""
    if exists(spark, f"{folder}/{name}.parquet"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    elif exists(spark, f"{folder}/{name}.csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}.csv")
        df = df.withColumns({c: parsed_list(c) for c in lists if c in df.columns})
    elif schema is not None:
        df = spark.createDataFrame([], schema)
    else:
        raise FileNotFoundError(f"{folder}/{name}: neither Parquet nor CSV")
    return require_columns(df, *required) if required else df


def read_catalogue(spark: SparkSession, folder: str, names: tuple, schemas: dict[str, str] | None = None, lists: dict[str, tuple] | None = None) -> dict[str, DataFrame]:
    """[SRC4-SRC8] the named tables of a folder; those that are missing are empty where schemas has them, else an error."""
    return {n: read_table(spark, folder, n, (schemas or {}).get(n), (lists or {}).get(n, ())) for n in names}


def read_first(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """[SRC15, SRC22] the first of the candidates that is there."""
    for n in names:
        if exists(spark, f"{folder}/{n}.parquet") or exists(spark, f"{folder}/{n}.csv"):
            return read_table(spark, folder, n)
    raise FileNotFoundError(f"{folder}: none of {', '.join(names)}")


def read_document(spark: SparkSession, path: str) -> DataFrame | None:
    """[SRC21] a JSON document as one row, or None where it is missing."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


def read_vectors(spark: SparkSession, path: str, key: str = "work_id", column: str = "embedding") -> DataFrame:
    """[SRC10] (id, vector of floats)."""
    df = require_columns(spark.read.parquet(path), key, column)
    return df.select(F.col(key).alias("id"), F.col(column).cast("array<float>").alias("vector"))


def read_weights(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """[SRC11] (id, term, weight) of the expected ids; an id without a row is an error."""
    df = require_columns(spark.read.parquet(path), "id", "term", "weight")
    missing = ids.select("id").join(df, "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("expected ids have no weights")
    return df.join(ids.select("id"), "id", "left_semi")


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """[SRC16] (run, sample_size, total_seconds) of run logs; files without a positive size and time are left out."""
    schema = "sample_size long, node_count long, total_seconds double, steps array<struct<title: string, seconds: double>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("run", F.input_file_name())
    return runs.where("sample_size > 0 AND total_seconds > 0")


def created_nodes(spark: SparkSession, pattern: str) -> DataFrame:
    """[SRC17] (nodes) created, summed over a log's map of labels."""
    logs = spark.read.schema("nodes map<string, struct<created: long>>").option("multiLine", True).json(pattern)
    return logs.select(F.aggregate(F.map_values("nodes"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["created"], F.lit(0))).alias("nodes"))


def write_tables(frames: dict[str, DataFrame], folder: str, empty: bool = True) -> None:
    """[SNK1, SNK2, SNK4-SNK7] each table that has columns as Parquet, or as CSV where Parquet can't hold a column's type; without `empty` only those that have rows."""
    for name, df in frames.items():
        if not df.columns or (not empty and df.isEmpty()):
            continue
        try:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            write_csv(df, f"{folder}/{name}.csv")


def write_weights(weights: DataFrame, folder: str) -> None:
    """[SNK6] term weights with the vocabulary (term, column) and the index of ids (id, row), both numbered from 0 in order."""
    weights.write.mode("overwrite").parquet(f"{folder}/weights.parquet")
    for name, key, number in (("vocabulary", "term", "column"), ("index", "id", "row")):
        numbered(weights.select(key).distinct(), key, number).withColumn(number, F.col(number) - 1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    """[SNK3, SNK8, SNK21] CSV with a header, arrays and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """[SNK9-SNK12] a one-row table as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)
