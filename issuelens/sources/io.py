"""Sources and sinks (SRC-*, SNK-*).

Readers take explicit schemas (no inference). A multi-line CSV cannot be
split inside a file, so ``land_parquet`` converts a batch of CSV files once
into Parquet, which every later job reads splittably with pruning.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE_SCHEMA = T.StructType([
    T.StructField("Key", T.StringType()),
    T.StructField("Summary", T.StringType()),
    T.StructField("Description", T.StringType()),
])
CORPUS_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
CURVE_SCHEMA = T.StructType([
    T.StructField("_c0", T.IntegerType()),
    T.StructField("training_size", T.IntegerType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("fscore", T.DoubleType()),
    T.StructField("model", T.StringType()),
])
#: The project is the file name without its ending.
PROJECT_PATTERN = r"([^/]+?)(?:\.[A-Za-z0-9]+)*$"


def csv_options(reader, sep: str):
    """Header, quoting and multi-line options of every CSV read here (batch or stream)."""
    return (reader.option("header", True).option("sep", sep).option("multiLine", True)
            .option("quote", '"').option("escape", '"'))


def header_of(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of one CSV file (of a folder: its first file), from the header."""
    return csv_options(spark.read, sep).csv(path).columns


def _layouts(spark: SparkSession, paths: Sequence[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header layout.

    One job finds the first line of every file; the reader then parses one
    header for each different first line, so the number of jobs goes with the
    layouts, not with the files.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("line"))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect():
        layouts.setdefault(tuple(header_of(spark, row["files"][0], sep)), []).extend(row["files"])
    return layouts


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: ``_record``, the row's number in its file (a multi-line CSV file is read by one task, in order)."""
    last, seen = None, 0
    for batch in batches:
        files = batch.column("_file").to_numpy(zero_copy_only=False)
        record = np.zeros(len(files), np.int64)
        for part in np.split(np.arange(len(files)), np.flatnonzero(files[1:] != files[:-1]) + 1):
            if len(part):
                seen = seen if files[part[0]] == last else 0
                record[part] = seen + np.arange(len(part))
                last, seen = files[part[0]], seen + len(part)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(record)], names=[*batch.schema.names, "_record"])


def _read_csv(spark: SparkSession, paths: Sequence[str], sep: str, schema: T.StructType | None) -> tuple[DataFrame, set[str]]:
    """One read per header layout, columns taken by name.

    A CSV read with a schema binds by position, so the files are grouped by
    their header line and each group is read under its own names. Columns of
    ``schema`` that a file does not have are null; others are left out. Without
    a schema all columns of all files are taken, as text.
    """
    layouts = _layouts(spark, paths, sep)
    names_in = {n.strip().lower(): n.strip() for names in reversed(layouts) for n in names}
    if schema is None:
        order = dict.fromkeys(n.strip().lower() for names in layouts for n in names)
        schema = T.StructType([T.StructField(names_in[n], T.StringType()) for n in order])
    parts = []
    for names, own in layouts.items():
        read = csv_options(spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])), sep).csv(own)
        have = {n.strip().lower(): n for n in names}
        cols = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema]
        parts.append(read.select(*cols, F.col("_metadata.file_path").alias("_file"),
                                 F.col("_metadata.file_name").alias("_name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, set(names_in)


def read_issues(spark: SparkSession, paths: str | Sequence[str], sep: str = ";",
                schema: T.StructType = ISSUE_SCHEMA) -> DataFrame:
    """SRC-1 / SRC-4: all project files, columns by name; ``project`` is the file name without its ending.

    ``Key`` is optional: if no file has it, the result has no such column (PRJ-2
    then makes keys). ``Summary`` and ``Description`` are required.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df, names = _read_csv(spark, paths, sep, schema)
    missing = [f.name for f in schema if f.name != "Key" and f.name.lower() not in names]
    if missing:
        raise ValueError(f"input has no column {missing}")
    df = df.withColumn("project", F.regexp_extract("_name", PROJECT_PATTERN, 1)).drop("_file", "_name")
    return df if "key" in names else df.drop("Key")


def read_corpus(spark: SparkSession, paths: str | Sequence[str], sep: str = ",",
                schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """SRC-2: a ``text`` corpus with a ``doc_id`` of its own for every row, equal texts included.

    The id is a hash of the file's path and the row's number in it, whatever
    files a task reads together.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df, names = _read_csv(spark, paths, sep, schema)
    if "text" not in names:
        raise ValueError("input must have a 'text' column")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_records, f"{fields}, _record long").withColumn("doc_id", F.xxhash64("_file", "_record")).drop("_file", "_name", "_record")


def read_labelled(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """SRC-3: labelled issues, columns by name whatever their order in a file; ``Summary_Description`` is derived when missing (SRC-5)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df, _ = _read_csv(spark, paths, sep, None)
    return require_columns(df.drop("_file", "_name"), mode="labelled")


def require_columns(df: DataFrame, mode: str = "corpus") -> DataFrame:
    """SRC-5: fail before any job starts when a needed column is missing.

    ``corpus``: ``text`` must exist. ``labelled``: derive ``Summary_Description``
    from ``Summary`` + ``Description`` (separator ``'. '``), else require it.
    """
    cols = set(df.columns)
    if mode == "corpus":
        if "text" not in cols:
            raise ValueError("input must have a 'text' column")
        return df
    if mode == "labelled":
        if {"Summary", "Description"} <= cols:
            return df.withColumn("Summary_Description", F.concat(
                F.coalesce(F.col("Summary"), F.lit("")), F.lit(". "), F.coalesce(F.col("Description"), F.lit(""))))
        if "Summary_Description" not in cols:
            raise ValueError("Summary_Description missing and Summary/Description not available")
        return df
    raise ValueError(f"unknown mode {mode!r}")


def read_curves(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-6 / RES-1: result curves; the unnamed index column is dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return csv_options(spark.read.schema(CURVE_SCHEMA), ",").csv(paths).drop("_c0")


def land_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write once to Parquet (splittable, prunable) — SNK-2 and the CSV landing step."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_labelled(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-1: one output per project (``partitionBy('project')``); ``csv`` uses ``;``."""
    w = df.write.mode("overwrite").partitionBy("project")
    if fmt == "csv":
        w.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_curves(df: DataFrame, path: str) -> None:
    """SNK-3: append to one curve table partitioned by ``model``."""
    df.write.mode("append").partitionBy("model").parquet(path)


def write_ledger(df: DataFrame, path: str) -> None:
    """SNK-4: the labelled ledger (real ``Key``, no always-empty column)."""
    df.write.mode("overwrite").parquet(path)


def run_record(spark: SparkSession, params: dict, metrics: dict, run_id: str | None = None) -> DataFrame:
    """SNK-5: one row ``(run_id, ts, params, metrics)``."""
    row = (run_id or uuid.uuid4().hex, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
           {k: json.dumps(v) if not isinstance(v, str) else v for k, v in params.items()},
           {k: float(v) for k, v in metrics.items()})
    return spark.createDataFrame([row], "run_id string, ts timestamp, params map<string,string>, "
                                        "metrics map<string,double>")


def write_run_record(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
