"""Relational verbs over text tables. Cells are text; null counts as empty. Every verb is one lazy projection, filter or sort."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonarium.plans.store import stash
from clonarium.sources.tsv import ROW, check_fields

# What ``delete`` removes unless told otherwise.
EMPTY = ("", "NA")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def add(df: DataFrame, fields: list[str], values: list[str]) -> DataFrame:
    """Constant columns; a column that is there keeps its values."""
    _pairs(fields, values)
    return df.withColumns({f: F.lit(v) for f, v in zip(fields, values, strict=True) if f not in df.columns})


def drop(df: DataFrame, fields: list[str]) -> DataFrame:
    check_fields(df, fields)
    return df.drop(*fields)


def rename(df: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    """In place, one after the other; a name that is taken is refused, as renaming would lose that column."""
    _pairs(fields, names)
    check_fields(df, fields)
    out = list(df.columns)
    for f, n in zip(fields, names, strict=True):
        if n in out:
            raise ValueError(f"column {n} is there already")
        out[out.index(f)] = n
    return df.toDF(*out)


def matches(df: DataFrame, fields: list[str], values: list[str], logic: str = "any", regex: bool = False) -> Column:
    """Whether any or all of the fields equal (or, with ``regex``, hold a match of) any of the values."""
    check_fields(df, fields)
    if logic not in ("any", "all"):
        raise ValueError("logic is any or all")
    one = (lambda f: reduce(or_, [_text(f).rlike(v) for v in values])) if regex else (lambda f: _text(f).isin(*values))
    return reduce(or_ if logic == "any" else and_, [one(f) for f in fields])


def select(df: DataFrame, fields: list[str], values: list[str], logic: str = "any", regex: bool = False) -> DataFrame:
    return df.where(matches(df, fields, values, logic, regex))


def delete(df: DataFrame, fields: list[str], values: list[str] = list(EMPTY), logic: str = "any", regex: bool = False) -> DataFrame:
    return df.where(~matches(df, fields, values, logic, regex))


def update(df: DataFrame, field: str, values: list[str], updates: list[str]) -> DataFrame:
    """Pairs are applied in turn, each to what the ones before have made."""
    _pairs(values, updates)
    check_fields(df, [field])
    return df.withColumn(field, reduce(lambda c, p: F.when(c == p[0], p[1]).otherwise(c), zip(values, updates, strict=True), _text(field)))


def sort_key(field: str, numeric: bool = False, descend: bool = False) -> Column:
    """By code point, or as numbers with empty as 0; other text raises then."""
    key = F.when(_text(field) == "", F.lit(0.0)).otherwise(_text(field).cast("double")) if numeric else _text(field)
    return key.desc() if descend else key.asc()


def sort(df: DataFrame, field: str, numeric: bool = False, descend: bool = False, order: str = ROW) -> DataFrame:
    """Stable both ways: ties keep the order of ``order``."""
    check_fields(df, [field])
    return df.orderBy(sort_key(field, numeric, descend), F.col(order).asc())


def place(df: DataFrame, field: str) -> DataFrame:
    """A running number from 1 in the rows' present order (after ``sort``, say), without bringing all rows into one task: rows are written
    as they stand, and numbers are counts of the partitions before and places within each."""
    kept = stash(df.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id()), "index")
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__nth").alias("__first"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    return kept.join(F.broadcast(counts), "__part").withColumn(field, F.col("__ahead") + F.col("__nth") - F.col("__first") + 1).drop("__part", "__nth", "__ahead", "__first")


def index(df: DataFrame, field: str = "INDEX", order: str | list[str] = ROW) -> DataFrame:
    """A running number from 1 in the order of ``order``: a range sort, then ``place``."""
    return place(df.orderBy(*([order] if isinstance(order, str) else order)), field)


def merge(frames: list[DataFrame], drop: bool = False) -> DataFrame:
    """All rows, by column name: all columns, empty where a table has none, or with ``drop`` those that all have.

    Columns come in the order of their first appearance, rows (by ``_row``) in that of the tables.
    """
    names = list(dict.fromkeys(c for df in frames for c in df.columns if not c.startswith("_")))
    if drop:
        names = [c for c in names if all(c in df.columns for df in frames)]
    out = []
    for i, df in enumerate(frames):
        cols = [(_text(c) if c in df.columns else F.lit("")).alias(c) for c in names]
        place = [F.struct(F.lit(i).alias("table"), F.col(ROW).alias("place")).alias(ROW)] if ROW in df.columns else []
        out.append(df.select(*cols, *place))
    return reduce(DataFrame.unionByName, out)


def split(df: DataFrame, field: str, threshold: float | None = None) -> DataFrame:
    """Adds ``_split``: the value, cleaned for a file name, or with a threshold ``under`` or ``atleast``."""
    check_fields(df, [field])
    if threshold is None:
        return df.withColumn("_split", F.regexp_replace(_text(field), r"[^A-Za-z0-9.+=@-]+", "_"))
    return df.withColumn("_split", F.when(_text(field).cast("double") < threshold, "under").otherwise("atleast"))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each ``_split``, in one pass."""
    df.drop(ROW).write.partitionBy("_split").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", nullValue="")


def _pairs(a: list[str], b: list[str]) -> None:
    if len(a) != len(b):
        raise ValueError("as many fields as values are needed")
