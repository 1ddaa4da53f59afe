"""Text tables as streams. Row-wise operators (verbs other than sort, index and merge of rows in order; gene names; types; validation;
germlines per record, as a stream-static join) take these DataFrames as they are; nothing here keeps state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, columns: list[str], files_per_trigger: int | None = None) -> DataFrame:
    """New tab-separated files of a folder, all with these columns in their header, as text; empty cells are empty text."""
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder).fillna("")


def write_stream(df: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends results as tab-separated files; ``checkpoint`` lets a restarted query go on where it stopped. ``once`` takes what is there and ends."""
    writer = df.writeStream.format("csv").option("sep", "\t").option("header", True).option("emptyValue", "").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(folder)


def run_batches(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``work`` as an ordinary DataFrame, for operators that need whole tables (sort, clones), one batch at a time."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
