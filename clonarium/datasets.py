"""A deterministic synthetic repertoire derived from the driver's ``lineitem`` table; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonarium.plans.store import partitions

REPERTOIRE = """
SELECT concat('R', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(5)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(cast(l_quantity as bigint) as varchar(5))) AS sequence_id,
 concat('IGHV', cast(1 + l_partkey % 5 as varchar(5)), '-', cast(1 + l_suppkey % 7 as varchar(5)), '*0', cast(1 + l_linenumber % 3 as varchar(5)),
   CASE WHEN l_quantity >= 45 THEN concat(',IGHV', cast(1 + l_partkey % 5 as varchar(5)), '-', cast(1 + (l_suppkey + 1) % 7 as varchar(5)), '*01') ELSE '' END) AS v_call,
 concat('IGHJ', cast(1 + l_partkey % 6 as varchar(5)), '*01') AS j_call,
 concat('TGT', substr(translate(md5(cast(l_partkey % 400 as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(18 + 3 * (l_partkey % 4) as int)),
   substr('ACGT', cast(1 + l_linenumber % 4 as int), 1), CASE WHEN l_discount >= 0.09 THEN 'N' ELSE substr('ACGT', cast(1 + l_orderkey % 4 as int), 1) END, 'TGG') AS junction,
 CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'T' END AS productive,
 l_returnflag AS sample_id
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id (unique), v_call, j_call, junction, productive, sample_id.

    The table's file may be a single row group, which one task reads; its few columns are dealt out before sequences are made of them.
    """
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    lineitem = lineitem.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism))
    return spark.sql(REPERTOIRE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
