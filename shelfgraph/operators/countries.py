"""Country names: canonical codes, precedence of sources, the dimension of all names seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.scalars import clean, split_multi


def canonical(values: DataFrame, column: str, iso: DataFrame) -> DataFrame:
    """[SCL-C1] values with `code` and `name`: by iso (code, code3, name), any of which the text may be; else two or three letters in upper case; else the text itself."""
    keys = iso.select(F.explode(F.array(F.lower("code"), F.lower("code3"), F.lower("name"))).alias("__key"), F.col("code").alias("__code"), F.col("name").alias("__name")).dropDuplicates(["__key"])
    text = clean(column)
    joined = values.withColumn("__text", text).join(keys, F.lower("__text") == F.col("__key"), "left")
    short = F.when(F.col("__text").rlike(r"^\p{L}{2,3}$"), F.upper("__text")).otherwise(F.col("__text"))
    return joined.withColumn("code", F.coalesce("__code", short)).withColumn("name", F.coalesce("__name", short)).drop("__text", "__key", "__code", "__name")


def precedence(*sources: Column) -> Column:
    """[SCL-C4, SCL-C5, JN12] the first source that isn't missing."""
    return F.coalesce(*[clean(s) for s in sources])


def seen_values(frames: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """[AGG17, AGG18] (value) of all columns, lists cut at semicolons."""
    out = None
    for df, columns in frames:
        for c in columns:
            if c in df.columns:
                part = df.select(F.explode(split_multi(F.col(c).cast("string"))).alias("value"))
                out = part if out is None else out.unionByName(part)
    return out


def dimension(values: DataFrame, iso: DataFrame) -> DataFrame:
    """[AGG16] (code, name): the longest name of each code, ties by text."""
    named = canonical(values, "value", iso).where("code IS NOT NULL")
    return named.groupBy("code").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"))
