"""Readers and writers: CSV, Parquet tables, stored arrays, labelled folders, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.session import spread as deal_out


_FLOATS = (T.DoubleType, T.FloatType)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column and array cell, so there is one notion of missing."""
    def known(f: T.StructField) -> Column:
        if isinstance(f.dataType, _FLOATS):
            return F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, _FLOATS):
            return F.transform(f.name, lambda x: F.when(~F.isnan(x), x)).alias(f.name)
        return F.col(f.name)
    return df.select(*map(known, df.schema.fields))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with an explicit schema; `key` names the row id and is moved to the front."""
    df = spark.read.schema(schema).option("header", header).csv(path)
    if key:
        df = df.select(key, *[c for c in df.columns if c != key])
    return normalize_missing(df)


def load_table(spark: SparkSession, folder: str, name: str, cols: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """A stored table, or some of its columns; `spread` deals a small one out to all cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = normalize_missing(df.select(*cols) if cols else df)
    return deal_out(df) if spread else df


def write_csv(df: DataFrame, path: str, header: bool = True, key: str | None = None,
              keep_key: bool = True, mode: str = "errorifexists") -> None:
    """Write a result file set; `keep_key=False` leaves the row id out."""
    if key and not keep_key:
        df = df.drop(key)
    df.write.mode(mode).option("header", header).csv(path)


def save_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store feature arrays with their keys and labels as Parquet."""
    df.write.mode(mode).parquet(path)


def load_arrays(spark: SparkSession, path: str) -> DataFrame:
    return normalize_missing(spark.read.parquet(path))


def read_labelled_files(spark: SparkSession, root: str, pattern: str = "*", max_classes: int = 10_000) -> DataFrame:
    """One row per file below `root`: path, length, class (parent folder), class index.

    The file bytes are never read: the content column is pruned from the scan.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root)
             .select("path", "length", F.element_at(F.split("path", "/"), -2).alias("class_name")))
    names = [r[0] for r in files.select("class_name").distinct().limit(max_classes + 1).collect()]
    if len(names) > max_classes:
        raise ValueError(f"more than {max_classes} class folders below {root}")
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(sorted(names))],
                                    "class_name string, class_index int")
    return files.join(F.broadcast(classes), "class_name").select("path", "length", "class_name", "class_index")


def save_model(model, path: str) -> None:
    """Store a fitted model, or a fitted chain of stages, as a directory."""
    if not isinstance(model, PipelineModel):
        model = PipelineModel([model])
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
