"""Tab-separated tables with a header: scans that keep file order, writers, names of output files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"
# Extensions of tables.
EXTENSIONS = (".tab", ".tsv", ".txt")


def read_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, empty cells as empty text, and ``_row``: (place in the list, file name, offset of the split, row in it), which sorts as the
    files do; those of a folder by name.

    Several files must have the same header; use ``merge`` for others. Short rows are filled with empty cells.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, path in enumerate(paths):
        df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        names = df.columns
        df = df.select("*", F.struct(F.lit(i).alias("nth_path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias(ROW))
        df = df.fillna("", subset=names)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no file")
    return out


def write_tsv(df: DataFrame, path: str, fields: list[str] | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    """Text cells, null as empty; ``fields`` chooses and orders columns, and missing ones are empty. In ``_row`` order if there is one.

    ``single`` makes one part file, for small results that people open.
    """
    if ROW in df.columns:
        df = df.orderBy(ROW)
    names = fields or [c for c in df.columns if not c.startswith("_")]
    df = df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in names])
    (df.coalesce(1) if single else df).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_split(df: DataFrame, path: str, passed: Column, failed: bool = False, fields: list[str] | None = None, suffix: tuple[str, str] = ("pass", "fail")) -> None:
    """Rows that pass below ``path``/pass and, if asked for, the others below ``path``/fail."""
    write_tsv(df.where(passed), f"{path}/{suffix[0]}", fields)
    if failed:
        write_tsv(df.where(~F.coalesce(passed, F.lit(False))), f"{path}/{suffix[1]}", fields)


def output_name(path: str, label: str | None, extension: str | None = None, folder: str | None = None, name: str | None = None) -> str:
    """<name>_<label>.<extension> beside the input, or in ``folder``, or by another ``name``."""
    head, tail = os.path.split(path)
    stem, ext = os.path.splitext(tail)
    stem = name or stem
    out = f"{stem}_{label}" if label else stem
    return os.path.join(folder or head, f"{out}.{(extension or ext.lstrip('.')).lstrip('.')}")


def header(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def check_fields(df: DataFrame, fields: list[str]) -> None:
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def count_rows(df: DataFrame) -> int:
    n = df.count()
    if not n:
        raise ValueError("the table is empty")
    return n


def summary(df: DataFrame, passed: Column) -> dict[str, int]:
    """Numbers of records, of those that pass and of those that fail, in one job."""
    row = df.agg(F.count("*").alias("records"), F.count_if(F.coalesce(passed, F.lit(False))).alias("passed")).first()
    return {"records": row["records"], "pass": row["passed"], "fail": row["records"] - row["passed"]}
