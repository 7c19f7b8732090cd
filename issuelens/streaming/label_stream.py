"""STR-1: label issue files as they arrive (Structured Streaming).

The labelling operator is stateless and works inside each row (the per-issue
maximum is an ``array_max`` over the issue's own chunks), so the stream needs
no state store and no watermark: every micro-batch is a narrow projection of
the new files. Exactly-once output comes from the file sink plus the
checkpoint location; a lost executor only replays its micro-batch.

An issue that is sent again replaces its earlier label: ``label_changes`` keeps
the newest version of every key in the state store and writes what changes as
rows with ``delta`` +1 and -1. Their sum is LBL-5's count of the newest labels
(``label_counts``) and their remainder the newest labels themselves
(``newest_labels``), in whatever order versions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from issuelens import fixed
from issuelens.operators.labelling import label_issues
from issuelens.sources.io import ISSUE_SCHEMA, PROJECT_PATTERN, csv_options, header_of


def issue_stream(spark: SparkSession, source_dir: str, fmt: str = "csv", sep: str = ";",
                 max_files_per_trigger: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """A streaming issue table from a folder of CSV (``;``) or Parquet files.

    The folder's files have one layout; a CSV stream takes its column names from
    the header of the files there when it starts (or from ``columns``).
    """
    names = list(columns) if columns else None
    r = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        names = names or header_of(spark, source_dir, sep)
        df = csv_options(r.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])), sep).csv(source_dir)
    else:
        df = r.schema(spark.read.parquet(source_dir).schema if names is None else ISSUE_SCHEMA).parquet(source_dir)
    have = {n.strip().lower(): n for n in df.columns}
    missing = [f.name for f in ISSUE_SCHEMA if f.name != "Key" and f.name.lower() not in have]
    if missing:
        raise ValueError(f"input has no column {missing}")
    cols = [F.col(f"`{have[f.name.lower()]}`").alias(f.name) for f in ISSUE_SCHEMA if f.name.lower() in have]
    return df.select(*cols, F.regexp_extract(F.col("_metadata.file_name"), PROJECT_PATTERN, 1).alias("project"),
                     F.col("_metadata.file_modification_time").alias("sent"))


def label_stream(issues: DataFrame, keywords: Sequence[str] = fixed.KEYWORDS["seed_expansion"], *,
                 threshold: float = fixed.THRESHOLD) -> DataFrame:
    """The streaming twin of ``label_issues`` (same expression, same output; ``sent`` stays if it is there)."""
    return label_issues(issues, keywords, threshold=threshold, keep=[c for c in ("project", "sent") if c in issues.columns])


VERSION = ("project string, key string, sent timestamp, mark long, closest_keyword string, similarity_score double, label string")
STATE = "sent timestamp, mark long, closest_keyword string, similarity_score double, label string"


def versions(labelled: DataFrame) -> DataFrame:
    """Labelled issues as versions of their key; ``mark`` orders versions sent at one time.

    A null key is the hash of the text: only an equal text replaces it.
    """
    text = F.coalesce("Summary_Description_Original", F.lit(""))
    return labelled.select("project", F.coalesce("Key", F.concat(F.lit("unknown-"), F.sha2(text, 256))).alias("key"), "sent",
                           F.xxhash64(text).alias("mark"), "closest_keyword", "similarity_score", "label")


def label_changes(labelled: DataFrame) -> DataFrame:
    """The stream of changes ``VERSION + delta``: -1 for the label that a newer version replaces, +1 for the new one.

    State is one row for each (project, key), held by the state store and
    dealt out by the key. A version older than the one held changes nothing.
    """
    names = [f.split()[0] for f in STATE.split(", ")]

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        now = old
        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                row = (row[0].to_pydatetime() if hasattr(row[0], "to_pydatetime") else row[0], *row[1:])
                if now is None or (row[0], row[1]) > (now[0], now[1]):
                    now = row
        if now is not None and now is not old:
            state.update(tuple(now))
            changes = [(*key, *v, d) for v, d in ((old, -1), (now, 1)) if v is not None]
            yield pd.DataFrame(changes, columns=["project", "key", *names, "delta"])

    return versions(labelled).groupBy("project", "key").applyInPandasWithState(
        newest, VERSION + ", delta int", STATE, "append", GroupStateTimeout.NoTimeout)


def newest_labels(changes: DataFrame) -> DataFrame:
    """The newest version of every key from the written changes: what was added and not taken back."""
    names = [f.split()[0] for f in VERSION.split(", ")]
    return changes.groupBy(*names).agg(F.sum("delta").alias("n")).where("n > 0").drop("n")


def label_counts(changes: DataFrame) -> DataFrame:
    """LBL-5 over the newest labels: ``(project, label, n_issues)``, a partial aggregate of the written changes."""
    return changes.groupBy("project", "label").agg(F.sum("delta").alias("n_issues")).where("n_issues > 0")


def start(labelled: DataFrame, sink_dir: str, checkpoint_dir: str, trigger_seconds: int | None = None,
          available_now: bool = False) -> StreamingQuery:
    """Write labelled issues, or their changes, to Parquet partitioned by project."""
    w = (labelled.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).partitionBy("project").outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
