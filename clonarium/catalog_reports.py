"""Registered queries of the report scans, validation, records and sequence export, with their SQL.

Reports are written from the driver's ``orders`` table: ``READS`` (one SQL text for Spark and DuckDB) makes a read of a V segment, letters between,
sometimes a D segment, and a J segment, and what an aligner says of it; the report's text is written to the shared folder and scanned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonarium.catalog import _CODON, _WEIGHTS, SQL, _nodes, _rep, query
from clonarium.datasets import REPERTOIRE, repertoire, table
from clonarium.functions import distance as D
from clonarium.functions import genes as G
from clonarium.functions import records as R
from clonarium.functions import sequences as S
from clonarium.operators import clones as C
from clonarium.operators import germlines as L
from clonarium.plans.store import new_folder, ship
from clonarium.sources import aligners as A
from clonarium.sources import export as X
from clonarium.sources import tsv

# Fixed values of the demonstrations: segments of a read.
V1, V2, D_SEQ, J_SEQ = "CAGGTGCAGCTGGTGCAG", "GAGGTGCAGCTGGTGGAG", "GGTATAACTGG", "ACTACTTTGACTACTGGGGCCAAGGAACC"

READS = f"""
SELECT concat('Q', cast(k AS varchar(20))) AS name, k, np, d, ins, vseq, concat(substr(vseq, 1, 9), '...', substr(vseq, 10)) AS vgap, vcall, jcall, strand, prod, cdr3,
 CASE WHEN d = 1 THEN '{D_SEQ}' ELSE '' END AS dseq, CASE WHEN d = 1 THEN 'A' ELSE '' END AS tail,
 concat('TTT', vseq, ins, CASE WHEN d = 1 THEN '{D_SEQ}A' ELSE '' END, '{J_SEQ}', 'GCC') AS seq
FROM (SELECT o_orderkey AS k, cast(o_orderkey % 4 AS int) AS np, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS d, substr('CCAG', 1, cast(o_orderkey % 4 AS int)) AS ins,
 CASE WHEN o_orderkey % 2 = 0 THEN '{V1}' ELSE '{V2}' END AS vseq, CASE WHEN o_orderkey % 2 = 0 THEN 'IGHV1-1*01' ELSE 'IGHV1-2*01' END AS vcall, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'IGHJ1*01' END AS jcall,
 CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS prod, cast(10 + o_orderkey % 6 AS int) AS cdr3 FROM orders)
"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _sql(body: str) -> str:
    return f"WITH reads AS ({READS}) {body}"


def _references(spark: SparkSession) -> DataFrame:
    gap = lambda v: f"{v[:9]}...{v[9:]}ACG"
    return spark.createDataFrame([("IGHV1-1*01", gap(V1)), ("IGHV1-2*01", gap(V2)), ("IGHD1-1*01", D_SEQ), ("IGHJ1*01", J_SEQ)], "allele string, sequence string")


def _inputs(reads: DataFrame) -> DataFrame:
    """Sequences as they were given to the aligner: on the other strand where the report says so."""
    return reads.select(F.col("name").alias("description"), F.when(F.col("strand") == "-", S.reverse_complement("seq")).otherwise(F.col("seq")).alias("sequence"))


_FIELDS = "# Fields: query id, subject id, % identity, alignment length, mismatches, gap opens, gaps, q. start, q. end, s. start, s. end, evalue, bit score, query seq, subject seq, BTOP"


def _hit(kind: str, name: Column, q: Column, text: Column, score: str = "90.5") -> Column:
    n = F.length(text)
    cells = [F.lit(kind), F.col("name"), name, F.lit("98.5"), n, F.lit(0), F.lit(0), F.lit(0), q, q + n - 1, F.lit(1), n, F.lit("1e-9"), F.lit(score), text, text, n]
    return F.concat_ws("\t", *[c.cast("string") for c in cells])


def _block_report(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A nucleotide block report and its input sequences."""
    reads = _reads(spark, sf_dir)
    has_j, has_d = F.col("jcall") != "", F.col("d") == 1
    call = lambda c: F.when(c == "", "N/A").otherwise(c)
    head = F.concat(F.lit("# IGBLASTN 2.6.1+\n# Query: "), "name", F.lit("\n# Database: x\n\n# V-(D)-J rearrangement summary for query sequence (Top V gene match, Top D gene match, Top J gene match, Chain type, stop codon, V-J frame, Productive, Strand).  More text.\n"))
    summary = F.concat_ws("\t", "vcall", F.when(has_d, "IGHD1-1*01").otherwise("N/A"), call(F.col("jcall")), F.lit("VH"), F.lit("No"), F.lit("In-frame"), "prod", "strand")
    sub = F.concat(F.lit("\n\n# Sub-region sequence details (nucleotide sequence, translation, start, end)\nCDR3\t"), F.substring("seq", F.col("cdr3"), F.lit(9)), F.lit("\tAAA\t"), F.col("cdr3").cast("string"), F.lit("\t"), (F.col("cdr3") + 8).cast("string"), F.lit("\t"))
    hits = [_hit("V", F.col("vcall"), F.lit(4), F.col("vseq")), F.when(has_d, _hit("D", F.lit("IGHD1-1*01"), 22 + F.col("np"), F.lit(D_SEQ))), F.when(has_j, _hit("J", F.col("jcall"), 22 + F.col("np") + 12 * F.col("d"), F.lit(J_SEQ), "50.0"))]
    body = F.concat(F.lit(f"\n\n# Hit table (the first field indicates the chain type of the hit)\n{_FIELDS}\n# hits found\n"), F.concat_ws("\n", *hits), F.lit("\n"))
    path = new_folder(spark, "report")
    reads.select(F.concat(head, summary, sub, body)).write.text(path)
    return path, _inputs(reads)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, inputs = _block_report(spark, sf_dir)
    return A.read_blocks(spark, path, inputs, _references(spark))


_BETWEEN = "concat(ins, dseq, tail)"
# Letters after the last segment are no part of the alignment.
_VDJ = f"CASE WHEN jcall <> '' THEN concat(vseq, {_BETWEEN}, '{J_SEQ}') WHEN d = 1 THEN concat(vseq, ins, dseq) ELSE vseq END"
_GAPPED = _VDJ.replace("vseq", "vgap")


@query(_sql("SELECT name AS sequence_id, vcall AS v_call, CASE WHEN d = 1 THEN 'IGHD1-1*01' END AS d_call, nullif(jcall, '') AS j_call, 'IGH' AS locus, prod = 'Yes' AS functional, false AS stop, true AS in_frame, strand = '-' AS rev_comp, false AS indels FROM reads"))
def scan_blocks_calls(spark, sf_dir):
    return _blocks(spark, sf_dir).select("sequence_id", "v_call", "d_call", "j_call", "locus", "functional", "stop", "in_frame", "rev_comp", "indels")


@query(
    _sql(
        "SELECT name AS sequence_id, 4 AS v_seq_start, 18 AS v_seq_length, 1 AS v_germ_start_imgt, 21 AS v_germ_length_imgt, CASE WHEN d = 1 OR jcall <> '' THEN np END AS np1_length, "
        "CASE WHEN d = 1 THEN 22 + np END AS d_seq_start, CASE WHEN d = 1 THEN 11 END AS d_seq_length, CASE WHEN d = 1 AND jcall <> '' THEN 1 END AS np2_length, "
        "CASE WHEN jcall <> '' THEN 22 + np + 12 * d END AS j_seq_start, CASE WHEN jcall <> '' THEN 29 END AS j_seq_length, CASE WHEN jcall <> '' THEN 1 END AS j_germ_start FROM reads"
    )
)
def scan_blocks_positions(spark, sf_dir):
    names = ["v_seq_start", "v_seq_length", "v_germ_start_imgt", "v_germ_length_imgt", "np1_length", "d_seq_start", "d_seq_length", "np2_length", "j_seq_start", "j_seq_length", "j_germ_start"]
    return _blocks(spark, sf_dir).select("sequence_id", *[F.col(n).cast("int").alias(n) for n in names])


@query(_sql(f"SELECT name AS sequence_id, seq AS sequence_input, {_VDJ} AS sequence_vdj, {_GAPPED} AS sequence_imgt FROM reads"))
def scan_blocks_sequences(spark, sf_dir):
    return _blocks(spark, sf_dir).select("sequence_id", "sequence_input", "sequence_vdj", "sequence_imgt")


@query(_sql("SELECT name AS sequence_id, substr(seq, cdr3 - 3, 15) AS junction, 15 AS junction_length, cdr3 - 3 AS junction_start, cdr3 + 11 AS junction_end, substr(seq, cdr3, 9) AS cdr3_igblast, 'AAA' AS cdr3_igblast_aa FROM reads"))
def scan_blocks_junction(spark, sf_dir):
    return _blocks(spark, sf_dir).select("sequence_id", "junction", "junction_length", "junction_start", "junction_end", "cdr3_igblast", "cdr3_igblast_aa")


@query(
    _sql(
        "SELECT name AS sequence_id, 90.5 AS v_score, 0.985 AS v_identity, '3S18=' AS v_cigar, CASE WHEN d = 1 THEN concat(cast(21 + np AS varchar), 'S11=') END AS d_cigar, CASE WHEN jcall <> '' THEN 50.0 END AS j_score, "
        "CASE WHEN jcall <> '' THEN concat(cast(21 + np + 12 * d AS varchar), 'S29=') END AS j_cigar FROM reads"
    ).replace("90.5 AS", "cast(90.5 AS double) AS").replace("0.985 AS", "cast(0.985 AS double) AS").replace("THEN 50.0 END", "THEN cast(50.0 AS double) END")
)
def scan_blocks_scores(spark, sf_dir):
    return _blocks(spark, sf_dir).select("sequence_id", "v_score", "v_identity", "v_cigar", "d_cigar", "j_score", "j_cigar")


@query(_sql("SELECT name AS sequence_id, vcall AS v_call, 'IGH' AS locus, cast(80 AS double) AS v_score, 1 AS v_seq_aa_start, 6 AS v_seq_aa_length, 'QVQLVQ' AS sequence_aa_vdj, 'QVQ.LVQ' AS sequence_aa_imgt, '6=' AS v_cigar, false AS stop FROM reads"))
def scan_protein_blocks(spark, sf_dir):
    """Two hits: the better one counts."""
    reads = _reads(spark, sf_dir)
    row = lambda name, text, score: F.concat_ws("\t", F.lit("V"), F.col("name"), name, F.lit("98.5\t6\t0\t0\t0\t1\t6\t1\t6\t1e-9"), F.lit(score), F.lit(text), F.lit(text), F.lit("6"))
    text = F.concat(F.lit("# IGBLASTP 1.14\n# Query: "), "name", F.lit(f"\n\n# Hit table (x)\n{_FIELDS}\n# 2 hits found\n"), row(F.lit("IGHV9-9*01"), "QVQLVA", "50"), F.lit("\n"), row(F.col("vcall"), "QVQLVQ", "80"), F.lit("\n"))
    path = new_folder(spark, "report")
    reads.select(text).write.text(path)
    refs = spark.createDataFrame([("IGHV1-1*01", "QVQ.LVQ"), ("IGHV1-2*01", "QVQ.LVQ")], "allele string, sequence string")
    out = A.read_protein_blocks(spark, path, reads.select(F.col("name").alias("description"), F.lit("QVQLVQ").alias("sequence")), refs)
    return out.select("sequence_id", "v_call", "locus", "v_score", F.col("v_seq_aa_start").cast("int").alias("v_seq_aa_start"), F.col("v_seq_aa_length").cast("int").alias("v_seq_aa_length"), "sequence_aa_vdj", "sequence_aa_imgt", "v_cigar", "stop")


def _semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir)
    j = F.col("jcall") != ""
    cells = ["name", F.when(F.col("k") % 11 == 0, "NA - V too short").otherwise(F.col("vcall")), F.when(F.col("d") == 1, "IGHD1-1*01").otherwise("NO_DGENE_ALIGNMENT"), F.when(j, F.col("jcall")).otherwise("NO_JGENE_ALIGNMENT"), "vseq", "ins",
             F.when(F.col("d") == 1, f"..{D_SEQ}").otherwise(""), "tail", F.when(j, f"{J_SEQ}..").otherwise(""), *["0"] * 4, F.when(F.col("prod") == "Yes", "true").otherwise("false"), "5", "0", "0.1", "-9.5", "0", "0", "0", "4", "290", "0.2"]
    cells = [c if isinstance(c, Column) else F.col(c) if c.isalpha() else F.lit(c) for c in cells]
    path = new_folder(spark, "report")
    reads.select(F.concat_ws(";", *[F.concat(F.lit('"'), c, F.lit('"')) for c in cells])).write.text(path)
    return A.read_semicolon(spark, path, reads.select(F.col("name").alias("description"), F.col("seq").alias("sequence")), _references(spark))


_GOOD = "k % 11 <> 0"


@query(
    _sql(
        f"SELECT name AS sequence_id, CASE WHEN {_GOOD} THEN vcall END AS v_call, CASE WHEN {_GOOD} AND d = 1 THEN 'IGHD1-1*01' END AS d_call, CASE WHEN {_GOOD} THEN nullif(jcall, '') END AS j_call, "
        f"CASE WHEN {_GOOD} THEN prod = 'Yes' AND jcall <> '' END AS functional, CASE WHEN {_GOOD} THEN np END AS np1_length, CASE WHEN {_GOOD} AND d = 1 THEN 22 + np END AS d_seq_start, CASE WHEN {_GOOD} AND d = 1 THEN 2 END AS d_germ_start, "
        f"CASE WHEN {_GOOD} THEN concat(vseq, {_BETWEEN}, CASE WHEN jcall <> '' THEN '{J_SEQ}' ELSE '' END) END AS sequence_vdj, CASE WHEN {_GOOD} THEN concat(vgap, {_BETWEEN}, CASE WHEN jcall <> '' THEN '{J_SEQ}' ELSE '' END) END AS sequence_imgt FROM reads"
    )
)
def scan_semicolon(spark, sf_dir):
    whole = lambda n: F.col(n).cast("int").alias(n)
    return _semicolon(spark, sf_dir).select("sequence_id", "v_call", "d_call", "j_call", "functional", whole("np1_length"), whole("d_seq_start"), whole("d_germ_start"), "sequence_vdj", "sequence_imgt")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables, in one order of rows, each in several part files."""
    reads = _reads(spark, sf_dir)
    rows = "k % 13 = 0"
    cell = lambda c: F.when(F.expr(rows), "").otherwise(c)
    vdj = F.lower(F.concat("vseq", "ins", "dseq", "tail", F.lit(J_SEQ)))
    gapped = F.lower(F.concat("vgap", "ins", "dseq", "tail", F.lit(J_SEQ)))
    text = lambda x: F.lit(x).cast("string")
    frames = {
        "summary": {"Sequence ID": F.col("name"), "V-DOMAIN Functionality": F.when(F.expr(rows), "No results").when(F.col("prod") == "Yes", "productive (see comment)").otherwise("unproductive"), "V-DOMAIN Functionality comment": cell(F.when(F.col("prod") == "Yes", "").otherwise("stop codons")),
                    "V-GENE and allele": cell(F.concat(F.lit("Homsap "), "vcall", F.lit(" F"))), "D-GENE and allele": cell(F.when(F.col("d") == 1, "Homsap IGHD1-1*01 F").otherwise("")), "J-GENE and allele": cell(F.lit("Homsap IGHJ1*01 F, or Homsap IGHJ2*01 F (see comment)")), "Orientation": cell(F.col("strand")), "JUNCTION frame": cell(F.lit("in-frame")),
                    "V-REGION potential ins/del": text(""), "V-REGION insertions": text(""), "V-REGION deletions": text(""), "Sequence": F.col("seq"), "V-REGION score": cell(F.lit("900")), "V-REGION identity %": cell(F.lit("98.5")), "J-REGION score": text(""), "J-REGION identity %": text("")},
        "gapped": {"Sequence ID": F.col("name"), "V-D-J-REGION": cell(gapped), "V-J-REGION": text(""), "V-REGION": cell(F.lower("vgap")), "J-REGION": cell(F.lit(J_SEQ.lower()))},
        "ntseq": {"Sequence ID": F.col("name"), "V-D-J-REGION": cell(vdj), "V-J-REGION": text(""), "V-REGION": cell(F.lower("vseq")), "J-REGION": cell(F.lit(J_SEQ.lower())), "V-REGION start": cell(F.lit("4"))},
        "junction": {"Sequence ID": F.col("name"), "JUNCTION": cell(F.lower(F.substring("seq", 7, 12))), "JUNCTION (AA)": cell(F.lit("CA")), "N1-REGION-nt nb": cell(F.col("np").cast("string")), "N2-REGION-nt nb": cell(F.length("tail").cast("string")), "D-REGION-nt nb": cell(F.length("dseq").cast("string")), "P3'V-nt nb": cell(F.lit("1")),
                     "N-REGION-nt nb": text(""), "P5'D-nt nb": text(""), "P3'D-nt nb": text(""), "P5'J-nt nb": text(""), "5'D-REGION trimmed-nt nb": cell(F.lit("2")), "5'J-REGION trimmed-nt nb": cell(F.lit("4")), "D-REGION reading frame": cell(F.lit("reading frame 2"))},
    }
    paths = {}
    for name, columns in frames.items():
        paths[name] = new_folder(spark, name)
        reads.orderBy("k").select(*[c.alias(n) for n, c in columns.items()]).write.csv(paths[name], sep="\t", header=True, emptyValue="")
    return A.read_tables(spark, paths)


_RESULT = "k % 13 <> 0"


@query(
    _sql(
        f"SELECT name AS sequence_id, CASE WHEN {_RESULT} THEN prod = 'Yes' END AS functional, CASE WHEN {_RESULT} THEN true END AS in_frame, CASE WHEN {_RESULT} THEN prod <> 'Yes' END AS stop, CASE WHEN {_RESULT} THEN strand = '-' END AS rev_comp, "
        f"CASE WHEN {_RESULT} THEN concat('Homsap ', vcall, ' F') END AS v_call, CASE WHEN {_RESULT} AND d = 1 THEN 'Homsap IGHD1-1*01 F' END AS d_call, CASE WHEN {_RESULT} THEN 'Homsap IGHJ1*01 F,Homsap IGHJ2*01 F' END AS j_call, CASE WHEN {_RESULT} THEN 'IGH' END AS locus FROM reads"
    )
)
def scan_tables_calls(spark, sf_dir):
    out = _tables(spark, sf_dir)
    return out.select("sequence_id", "functional", "in_frame", "stop", "rev_comp", *[F.trim(c).alias(c) for c in ("v_call", "d_call", "j_call")], "locus")


@query(
    _sql(
        f"SELECT name AS sequence_id, CASE WHEN {_RESULT} THEN 4 END AS v_seq_start, CASE WHEN {_RESULT} THEN 18 ELSE 0 END AS v_seq_length, CASE WHEN {_RESULT} THEN 21 ELSE 0 END AS v_germ_length_imgt, CASE WHEN {_RESULT} THEN np + 1 ELSE 0 END AS np1_length, "
        f"CASE WHEN {_RESULT} THEN 23 + np ELSE 0 END AS d_seq_start, CASE WHEN {_RESULT} THEN 11 * d ELSE 0 END AS d_seq_length, CASE WHEN {_RESULT} THEN 3 ELSE 1 END AS d_germ_start, CASE WHEN {_RESULT} THEN d ELSE 0 END AS np2_length, "
        f"CASE WHEN {_RESULT} THEN 23 + np + 12 * d ELSE 0 END AS j_seq_start, CASE WHEN {_RESULT} THEN 5 ELSE 1 END AS j_germ_start, CASE WHEN {_RESULT} THEN 29 ELSE 0 END AS j_seq_length, CASE WHEN {_RESULT} THEN 2 END AS d_frame FROM reads"
    )
)
def scan_tables_positions(spark, sf_dir):
    names = ["v_seq_start", "v_seq_length", "v_germ_length_imgt", "np1_length", "d_seq_start", "d_seq_length", "d_germ_start", "np2_length", "j_seq_start", "j_germ_start", "j_seq_length", "d_frame"]
    return _tables(spark, sf_dir).select("sequence_id", *[F.col(n).cast("int").alias(n) for n in names])


@query(_sql(f"SELECT name AS sequence_id, CASE WHEN {_RESULT} THEN concat(vseq, {_BETWEEN}, '{J_SEQ}') END AS sequence_vdj, CASE WHEN {_RESULT} THEN concat(vgap, {_BETWEEN}, '{J_SEQ}') END AS sequence_imgt, CASE WHEN {_RESULT} THEN substr(seq, 7, 12) ELSE '' END AS junction, CASE WHEN {_RESULT} THEN 12 ELSE 0 END AS junction_length FROM reads"))
def scan_tables_sequences(spark, sf_dir):
    return _tables(spark, sf_dir).select("sequence_id", "sequence_vdj", "sequence_imgt", "junction", F.col("junction_length").cast("int").alias("junction_length"))


# Sequence files, tables and identifiers.


@query(_sql("SELECT concat(name, '|NP=', cast(np AS varchar)) AS description, seq AS sequence FROM reads"))
def scan_fasta(spark, sf_dir):
    path = new_folder(spark, "fasta")
    _reads(spark, sf_dir).select(F.concat(F.lit(">"), "name", F.lit("|NP="), F.col("np").cast("string"), F.lit("\n"), X.wrap("seq", 20))).write.text(path)
    return A.read_fasta(spark, path)


@query(_sql("SELECT concat('>', name) AS value FROM reads UNION ALL SELECT seq FROM reads"))
def scan_fastq(spark, sf_dir):
    path = new_folder(spark, "fastq")
    _reads(spark, sf_dir).select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "@"))).write.text(path)
    return A.fastq_to_fasta(spark, path).select("value")


@query(_sql("SELECT substr(replace(concat(name, ' a b/c ', seq, seq), ' ', '_'), 1, 49) AS short, concat(name, ' a b/c ', seq, seq) AS description FROM reads"))
def short_ids(spark, sf_dir):
    return A.short_ids(_reads(spark, sf_dir).select(F.concat("name", F.lit(" a b/c "), "seq", "seq").alias("description")))


@query(_sql("SELECT name AS contig_id, CASE WHEN np = 0 THEN '' ELSE cast(np AS varchar) END AS umis, vcall AS v_gene FROM reads"))
def scan_cell_ranger(spark, sf_dir):
    path = new_folder(spark, "cells")
    _reads(spark, sf_dir).select(F.col("name").alias("contig_id"), F.when(F.col("np") == 0, "None").otherwise(F.col("np").cast("string")).alias("umis"), F.col("vcall").alias("v_gene")).write.csv(path, header=True)
    return A.read_cell_ranger(spark, path)


@query(_sql("SELECT concat('IGHV', cast(1 + k % 97 AS varchar), '-', cast(k % 89 AS varchar), '*01') AS allele, min(upper(vgap)) AS sequence FROM reads GROUP BY 1"))
def scan_germlines(spark, sf_dir):
    """Repeated names are written sorted by sequence, so that the first one in file order is the least."""
    path = new_folder(spark, "germlines")
    names = _reads(spark, sf_dir).select(F.expr("concat('IGHV', cast(1 + k % 97 as string), '-', cast(k % 89 as string), '*01')").alias("allele"), "vgap").orderBy("allele", "vgap")
    names.select(F.concat(F.lit(">X|"), "allele", F.lit("|Homo\n"), F.lower("vgap"))).write.option("lineSep", "\n").text(path)
    return L.read_germlines(spark, _named(spark, path))


def _named(spark: SparkSession, path: str) -> str:
    """The folder with its part files renamed to .fasta, in their order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.split(".")[0] + ".fasta"))
    return path


def _exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the exchange format, as text, written and scanned again."""
    reads = _reads(spark, sf_dir)
    columns = {"sequence_id": F.col("name"), "sequence": F.lower("seq"), "productive": F.when(F.col("prod") == "Yes", "T").otherwise("F"), "rev_comp": F.when(F.col("strand") == "-", "TRUE").otherwise("x"), "v_call": F.col("vcall"), "j_call": F.col("jcall"),
               "v_sequence_start": F.lit("4"), "v_sequence_end": F.lit("21"), "v_germline_end": F.lit("312"), "np1_length": F.when(F.col("np") == 0, "").otherwise(F.col("np").cast("string")), "junction": F.when(F.col("np") == 3, "None").otherwise(F.substring("seq", 7, 12)), "junction_length": F.lit("12"), "v_score": F.when(F.col("np") == 1, "bad").otherwise("1.5"), "note": F.lit("A b")}
    path = new_folder(spark, "table")
    tsv.write_tsv(reads.select(*[c.alias(n) for n, c in columns.items()]), path)
    return tsv.read_tsv(spark, path)


@query(
    _sql(
        "SELECT name AS sequence_id, seq AS sequence_input, prod = 'Yes' AS functional, CASE WHEN strand = '-' THEN true END AS rev_comp, nullif(np, 0) AS np1_length, CASE WHEN np = 3 THEN '' ELSE substr(seq, 7, 12) END AS junction, 18 AS v_seq_length, "
        "19 AS junction_start, 30 AS junction_end, CASE WHEN np <> 1 THEN cast(1.5 AS double) END AS v_score, 'A b' AS note FROM reads"
    )
)
def scan_exchange(spark, sf_dir):
    out = R.typed(_exchange(spark, sf_dir), "airr")
    return out.select("sequence_id", "sequence_input", "functional", "rev_comp", "np1_length", "junction", "v_seq_length", "junction_start", "junction_end", "v_score", "note")


@query(_sql("SELECT name AS \"SEQUENCE_ID\", CASE WHEN prod = 'Yes' THEN 'T' ELSE 'F' END AS \"FUNCTIONAL\", CASE WHEN strand = '-' THEN 'T' ELSE '' END AS \"REV_COMP\", '4' AS \"V_SEQ_START\", '18' AS \"V_SEQ_LENGTH\", CASE WHEN np = 0 THEN '' ELSE cast(np AS varchar) END AS \"NP1_LENGTH\", CASE WHEN np = 3 THEN '' ELSE substr(seq, 7, 12) END AS \"JUNCTION\", CASE WHEN np = 1 THEN '' ELSE '1.5' END AS \"V_SCORE\" FROM reads"))
def convert_to_legacy(spark, sf_dir):
    """Lengths come in where the exchange format has ends."""
    return R.convert(_exchange(spark, sf_dir), "airr", "legacy").select("SEQUENCE_ID", "FUNCTIONAL", "REV_COMP", "V_SEQ_START", "V_SEQ_LENGTH", "NP1_LENGTH", "JUNCTION", "V_SCORE")


@query(_sql("SELECT name AS sequence_id, CASE WHEN prod = 'Yes' THEN 'T' ELSE 'F' END AS productive, '4' AS v_sequence_start, '21' AS v_sequence_end, cast(22 + np AS varchar) AS j_sequence_start, cast(50 + np AS varchar) AS j_sequence_end FROM reads"))
def convert_to_exchange(spark, sf_dir):
    """Ends come in before lengths."""
    legacy = _reads(spark, sf_dir).select(F.col("name").alias("SEQUENCE_ID"), F.when(F.col("prod") == "Yes", "TRUE").otherwise("FALSE").alias("FUNCTIONAL"), F.lit("4").alias("V_SEQ_START"), F.lit("18").alias("V_SEQ_LENGTH"), (22 + F.col("np")).cast("string").alias("J_SEQ_START"), F.lit("29").alias("J_SEQ_LENGTH"))
    return R.convert(legacy, "legacy", "airr").select("sequence_id", "productive", "v_sequence_start", "v_sequence_end", "j_sequence_start", "j_sequence_end")


@query(_sql("SELECT count(*) AS records, sum(CASE WHEN prod = 'Yes' THEN 1 ELSE 0 END) AS passed, 14 AS columns FROM reads").replace("sum(", "cast(sum(").replace("END) AS passed", "END) AS bigint) AS passed"))
def table_summary(spark, sf_dir):
    df = _exchange(spark, sf_dir)
    tsv.check_fields(df, ["sequence_id", "productive"])
    s = tsv.summary(df, F.col("productive") == "T")
    return spark.createDataFrame([(s["records"], s["pass"], len(tsv.header(df)))], "records long, passed long, columns int")


# Validation and assembly.

_LONG = "concat(repeat('A', 309), substr(seq, 7, 12), 'CCC')"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _reads(spark, sf_dir)
    return d.select(F.concat("name", F.lit("|CONSCOUNT="), F.col("np").cast("string")).alias("sequence_id"), F.col("name").alias("contig"), F.when(F.col("np") != 2, F.col("vcall")).alias("v_call"), F.lit(None).cast("string").alias("d_call"), "jcall", F.when(F.col("k") % 8 != 5, F.col("prod") == "Yes").alias("functional"), F.expr(_LONG).alias("sequence_imgt"), F.when(F.col("k") % 9 == 4, "TGTTGT").otherwise(F.substring("seq", 7, 12)).alias("junction")).withColumnRenamed("jcall", "j_call")


_THERE = "np <> 2 AND jcall <> '' AND k % 8 <> 5"


@query(_sql(f"SELECT name AS sequence_id, cast(np AS varchar) AS conscount, {_THERE} AND (k % 9 <> 4 OR substr(seq, 7, 6) = 'TGTTGT') AS strict, {_THERE} AS gentle, np <> 2 OR jcall <> '' AS partial FROM reads"))
def validate_records(spark, sf_dir):
    out = A.finish(_parsed(spark, sf_dir))
    there = {k: F.coalesce(A.passes(out, k), F.lit(False)).alias(k) for k in ("strict", "gentle", "partial")}
    return out.select("sequence_id", F.try_element_at("annotations", F.lit("CONSCOUNT")).alias("conscount"), *there.values())


@query(_sql("SELECT name AS sequence_id, CASE WHEN k % 2 = 0 THEN concat('cell', cast(np AS varchar)) END AS cell FROM reads"))
def attach_cells(spark, sf_dir):
    cells = _reads(spark, sf_dir).where("k % 2 = 0").select(F.col("name").alias("contig_id"), F.concat(F.lit("cell"), F.col("np").cast("string")).alias("cell"))
    return A.finish(_parsed(spark, sf_dir), cells=cells).select("sequence_id", "cell")


@query(_sql("SELECT concat(name, ' a b/c ', seq, seq) AS sequence_id FROM reads"))
def attach_full_ids(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    ids = A.short_ids(reads.select(F.concat("name", F.lit(" a b/c "), "seq", "seq").alias("description")))
    parsed = ids.select(F.col("short").alias("sequence_id"), *[F.lit(None).cast("string").alias(c) for c in ("v_call", "d_call", "j_call", "sequence_imgt", "junction")], F.lit(None).cast("boolean").alias("functional"))
    return A.finish(parsed, ids=ids, parse_id=False).select("sequence_id")


_DGERM = f"CASE WHEN jcall <> '' THEN concat(vgap, repeat('N', np), dseq, CASE WHEN d = 1 THEN 'N' ELSE '' END, '{J_SEQ}') WHEN d = 1 THEN concat(vgap, repeat('N', np), dseq) ELSE vgap END"
_DMASK = f"CASE WHEN jcall <> '' THEN concat(vgap, repeat('N', np + 12 * d), '{J_SEQ}') WHEN d = 1 THEN concat(vgap, repeat('N', np + 11)) ELSE vgap END"
_DREGIONS = "CASE WHEN jcall <> '' THEN concat(repeat('V', 21), repeat('N', np), repeat('D', 11 * d), repeat('N', d), repeat('J', 29)) WHEN d = 1 THEN concat(repeat('V', 21), repeat('N', np), repeat('D', 11)) ELSE repeat('V', 21) END"


@query(_sql(f"SELECT name AS sequence_id, {_DGERM} AS germline_full, {_DMASK} AS germline_dmask, {_DREGIONS} AS germline_regions, cast(NULL AS varchar) AS germline_error FROM reads"))
def germline_of_scanned(spark, sf_dir):
    """Germlines with D segments, from a scanned report."""
    return L.attach_germlines(_blocks(spark, sf_dir), _references(spark)).select("sequence_id", "germline_full", "germline_dmask", "germline_regions", "germline_error")


@query(_sql(f"SELECT name AS sequence_id, concat(vgap, '{J_SEQ}') AS sequence_imgt, 21 AS v_germ_length_imgt, concat(vgap, '{J_SEQ}') AS germline_imgt FROM reads"))
def renumber_records(spark, sf_dir):
    d = _reads(spark, sf_dir).select(F.col("name").alias("sequence_id"), F.concat("vseq", F.lit(J_SEQ)).alias("sequence_imgt"), F.col("vcall").alias("v_call"), F.lit("IGHJ1*01").alias("j_call"), F.lit(1).alias("v_germ_start_imgt"), F.lit(18).alias("v_germ_length_imgt"), F.lit(1).alias("j_germ_start"), F.lit(29).alias("j_germ_length"))
    return A.renumber(d, _references(spark)).select("sequence_id", "sequence_imgt", F.col("v_germ_length_imgt").cast("int").alias("v_germ_length_imgt"), "germline_imgt")


# Sequence export.


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _reads(spark, sf_dir).where("jcall <> ''")
    return d.select(F.col("name").alias("sequence_id"), F.concat(F.lit("NN"), F.expr("substring(seq, 3)")).alias("sequence_input"), F.col("vcall").alias("v_call"), F.when(F.col("d") == 1, "IGHD1-1*01").alias("d_call"), F.col("jcall").alias("j_call"), F.lit(4).alias("v_seq_start"), F.lit(18).alias("v_seq_length"),
                    F.when(F.col("d") == 1, 22 + F.col("np")).alias("d_seq_start"), F.when(F.col("d") == 1, 11).alias("d_seq_length"), (22 + F.col("np") + 12 * F.col("d")).alias("j_seq_start"), F.lit(29).alias("j_seq_length"), F.lit(7).alias("junction_start"), F.lit(18).alias("junction_end"), F.col("np").cast("string").alias("n"))


_LAST = "(22 + np + 12 * d + 28 - 2)"


@query(
    _sql(
        f"SELECT name AS sequence_id, concat('>Features ', name, chr(10), cast({_LAST} + 1 AS varchar), chr(9), '>', cast({_LAST} + 3 AS varchar), chr(9), 'C_region', chr(10), '2', chr(9), cast({_LAST} AS varchar), chr(9), 'V_region', chr(10), "
        f"'2', chr(9), cast({_LAST} AS varchar), chr(9), 'misc_feature', chr(10), chr(9), chr(9), chr(9), 'note', chr(9), 'immunoglobulin heavy chain variable region', chr(10), "
        "'2', chr(9), '19', chr(9), 'V_segment', chr(10), chr(9), chr(9), chr(9), 'gene', chr(9), split_part(vcall, '*', 1), chr(10), chr(9), chr(9), chr(9), 'allele', chr(9), '01', chr(10), "
        "CASE WHEN d = 1 THEN concat(cast(20 + np AS varchar), chr(9), cast(30 + np AS varchar), chr(9), 'D_segment', chr(10), chr(9), chr(9), chr(9), 'gene', chr(9), 'IGHD1-1', chr(10), chr(9), chr(9), chr(9), 'allele', chr(9), '01', chr(10)) ELSE '' END, "
        f"cast(20 + np + 12 * d AS varchar), chr(9), cast({_LAST} AS varchar), chr(9), 'J_segment', chr(10), chr(9), chr(9), chr(9), 'gene', chr(9), 'IGHJ1', chr(10), chr(9), chr(9), chr(9), 'allele', chr(9), '01', chr(10), "
        "'<5', chr(9), '>16', chr(9), 'CDS', chr(10), chr(9), chr(9), chr(9), 'function', chr(9), 'JUNCTION', chr(10), chr(9), chr(9), chr(9), 'product', chr(9), 'immunoglobulin heavy chain junction region', chr(10), chr(9), chr(9), chr(9), 'codon_start', chr(9), '1') AS features FROM reads WHERE jcall <> ''"
    )
)
def submission_features(spark, sf_dir):
    return X.submission(_submitted(spark, sf_dir)).select("sequence_id", F.col("table").alias("features"))


@query(_sql(f"SELECT name AS sequence_id, concat('>', name, ' [organism=x] [moltype=mRNA] {X.KEYWORDS} [note=AIRR_READ_COUNT:', cast(np AS varchar), ']', chr(10), CASE WHEN length(seq) > 62 THEN concat(substr(seq, 3, 60), chr(10), substr(seq, 63)) ELSE substr(seq, 3) END) AS fasta FROM reads WHERE jcall <> ''"))
def submission_sequences(spark, sf_dir):
    return X.submission(_submitted(spark, sf_dir), count_field="n", sample={"organism": "x"}).select("sequence_id", "fasta")


@query(_sql("SELECT name AS sequence_id, cast(length(regexp_replace(vgap, '[ACGT]', '', 'g')) AS int) AS missing, translate(vgap, '.', 'N') AS filled, reverse(translate(seq, 'ACGT', 'TGCA')) AS reversed FROM reads"))
def sequence_checks(spark, sf_dir):
    d = _reads(spark, sf_dir)
    return d.select(F.col("name").alias("sequence_id"), S.missing_letters("vgap").alias("missing"), S.gaps_to_n("vgap").alias("filled"), S.reverse_complement("seq").alias("reversed"))


@query(_sql("SELECT name AS sequence_id, vgap AS gapped, 1 AS start, 21 AS length FROM reads"))
def number_v(spark, sf_dir):
    """The reference's gaps put into the V part of a read."""
    d = A._with_reference(_reads(spark, sf_dir), _references(spark), F.col("vcall"), "ref").withColumn("g", S.gap_v("vseq", F.lit(1), F.lit(18), "ref"))
    return d.select(F.col("name").alias("sequence_id"), F.col("g.sequence").alias("gapped"), F.col("g.start").cast("int").alias("start"), F.col("g.length").cast("int").alias("length"))


# Names, texts and alignments.

_KINDS = {k: p.replace("(IG[HLK]|TR[ABGD])", "(?:IG[HLK]|TR[ABGD])") for k, p in G.PATTERNS.items()}


@query(
    _rep(
        f"SELECT sequence_id, nullif(regexp_extract(v_call, '{_KINDS['v_allele']}'), '') AS v, nullif(regexp_extract(j_call, '{_KINDS['v_allele']}'), '') AS not_v, "
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(v_call, '{_KINDS['allele']}'))), ',') AS alleles, array_to_string(list_sort(list_distinct(regexp_extract_all(concat(v_call, ',', j_call), '{_KINDS['family']}'))), ',') AS families, "
        "regexp_replace(split_part(v_call, ',', 1), '\\*[^*]*$', '') AS gene_as_is, regexp_extract(split_part(v_call, ',', 1), '\\*([^*]*)$', 1) AS number_as_is FROM rep"
    )
)
def gene_kinds(spark, sf_dir):
    gene, number = G.split_as_is(G.first_as_is("v_call"))
    return repertoire(spark, sf_dir).select(
        "sequence_id", G.v_allele("v_call").alias("v"), G.v_allele("j_call").alias("not_v"), F.array_join(G.allele("v_call", "set"), ",").alias("alleles"),
        F.array_join(G.family(F.concat("v_call", F.lit(","), "j_call"), "set"), ",").alias("families"), gene.alias("gene_as_is"), number.alias("number_as_is"),
    )


@query(_rep("SELECT sequence_id, regexp_replace(concat('NN', junction, 'N'), '^N+|N+$', '', 'g') AS trimmed, translate(concat(sample_id, ' (a:b,c)'), ',:)( ', '----_') AS cleaned, replace(concat(sample_id, '_x_'), '_', '') AS bare, cast(length(junction) - 3 - CASE WHEN junction LIKE '%N%' THEN 1 ELSE 0 END - length(regexp_replace(substr(junction, 4), '[^T]', '', 'g')) AS int) AS unlike FROM rep"))
def sequence_text(spark, sf_dir):
    """Texts for submission and tree files; places unlike those of TGTTTT.., where both are known."""
    other = F.concat(F.substring("junction", 1, 3), F.repeat(F.lit("T"), F.length("junction") - 3))
    return repertoire(spark, sf_dir).select(
        "sequence_id", S.trim_n(F.concat(F.lit("NN"), "junction", F.lit("N"))).alias("trimmed"), S.clean_id(F.concat("sample_id", F.lit(" (a:b,c)"))).alias("cleaned"),
        S.clean_metadata(F.concat("sample_id", F.lit("_x_"))).alias("bare"), S.unlike_places("junction", other).alias("unlike"),
    )


@query(_sql("SELECT name AS sequence_id, concat(cast(np + 2 AS varchar), 'S', cast(3 * d + 4 AS varchar), 'N18=', cast(np + 1 AS varchar), 'X3I2D') AS cigar, np + 2 AS q_start, 18 + np + 1 + 3 AS q_length, 3 * d + 4 AS r_start, 18 + np + 1 + 2 AS r_length FROM reads"))
def cigar_positions(spark, sf_dir):
    """An alignment read from its text, with more clipped at its start, and its places."""
    text = F.concat(F.lit("2S4N18="), (F.col("np") + 1).cast("string"), F.lit("X3I2D"))
    d = _reads(spark, sf_dir).withColumn("a", S.pad_alignment(S.decode_cigar(text), F.col("np"), 3 * F.col("d"))).withColumn("p", S.alignment_positions("a"))
    return d.select(F.col("name").alias("sequence_id"), S.encode_cigar("a").alias("cigar"), *[F.col(f"p.{c}").cast("int").alias(c) for c in ("q_start", "q_length", "r_start", "r_length")])


# Distances of the other models.

_OTHER = "VALUES ('A','G',0.32),('C','T',0.32),('A','T',1.17),('C','G',1.17),('A','C',1.51),('G','T',1.51)"


@query(SQL["distance_weighted_pairs"].replace(_WEIGHTS, _OTHER).replace("<= 7)", "<= 12)").replace("<= 0.12", "<= 0.1"))
def distance_other_pairs(spark, sf_dir):
    found = C.close_pairs(_nodes(spark, sf_dir), "mk_rs1nf", 0.1, "len")
    parts = F.from_json("pre", "v string, j string")
    return found.select(parts["v"].alias("v"), parts["j"].alias("j"), F.col("u").alias("a"), F.col("v").alias("b"), F.round("distance", 6).alias("distance"))


_COMPAT = "VALUES ('A','G',1.0),('C','T',1.0),('A','T',1.75),('C','G',1.75),('A','C',2.08),('G','T',2.08)"
_ALLELES = "SELECT DISTINCT v_call AS v, j_call AS j, length(junction) AS n, junction AS s FROM rep WHERE regexp_matches(junction, '^[ACGT]+$')"


@query(
    f"WITH rep AS ({REPERTOIRE}), nodes AS ({_ALLELES}), w(x, y, d) AS ({_COMPAT}), both_w AS (SELECT x, y, d FROM w UNION ALL SELECT y, x, d FROM w), "
    "near AS (SELECT a.v, a.j, a.n, a.s AS a, b.s AS b, unnest(range(1, a.n + 1)) AS i FROM nodes a JOIN nodes b ON a.v = b.v AND a.j = b.j AND a.n = b.n AND a.s < b.s) "
    "SELECT near.v AS v_call, near.j AS j_call, a, b, round(cast(sum(d) / count(*) AS double), 6) AS distance FROM near JOIN both_w ON substr(a, cast(i AS int), 1) = x AND substr(b, cast(i AS int), 1) = y GROUP BY near.v, near.j, a, b"
)
def distance_matrix(spark, sf_dir):
    """All pairs of distinct junctions of equal calls and length, by matrix: the mean weight of their unlike places."""
    ship(spark)
    nodes = repertoire(spark, sf_dir).where(C.few_missing(F.col("junction"))).select("v_call", "j_call", F.length("junction").alias("n"), "junction").distinct()

    def run(rows):
        own = rows.sort_values("junction", ignore_index=True)
        found = D.pairwise(own["junction"].tolist(), D.model("hs1f_compat"), "mut", "min")
        i, j = np.triu_indices(len(own), 1)
        text = own["junction"].to_numpy()
        return pd.DataFrame({"v_call": own["v_call"][0], "j_call": own["j_call"][0], "a": text[i], "b": text[j], "distance": np.round(found[i, j], 6)})

    return nodes.groupBy("v_call", "j_call", "n").applyInPandas(run, "v_call string, j_call string, a string, b string, distance double")


@query(
    f"WITH rep AS ({REPERTOIRE}), t AS (SELECT DISTINCT v_call AS v, j_call AS j, array_to_string(list_transform(range(0, cast((length(junction) + 2) // 3 AS int)), lambda i: {_CODON.replace('3 * i', 'cast(3 * i AS int)').replace('junction', 'rpad(junction, cast((length(junction) + 2) // 3 * 3 AS int), chr(78))')}), '') AS s FROM rep WHERE regexp_matches(junction, '^[ACGT]+$')) "
    "SELECT a.v AS v_call, a.j AS j_call, a.s AS a, b.s AS b, cast(len(list_filter(range(1, length(a.s) + 1), lambda i: substr(a.s, cast(i AS int), 1) <> substr(b.s, cast(i AS int), 1) AND substr(a.s, cast(i AS int), 1) <> 'X' AND substr(b.s, cast(i AS int), 1) <> 'X')) AS double) AS distance "
    "FROM t a JOIN t b ON a.v = b.v AND a.j = b.j AND length(a.s) = length(b.s) AND a.s < b.s"
)
def distance_residues(spark, sf_dir):
    """All pairs of distinct proteins of equal calls and length: unlike residues. The last codon may be incomplete, and then counts as X."""
    ship(spark)
    d = repertoire(spark, sf_dir).where(C.few_missing(F.col("junction")))
    nodes = d.select("v_call", "j_call", C.node(F.col("junction"), "aa").alias("s")).distinct().withColumn("n", F.length("s"))

    def run(rows):
        own = rows.sort_values("s", ignore_index=True)
        found = D.pairwise(own["s"].tolist(), D.model("aa"), None)
        i, j = np.triu_indices(len(own), 1)
        text = own["s"].to_numpy()
        return pd.DataFrame({"v_call": own["v_call"][0], "j_call": own["j_call"][0], "a": text[i], "b": text[j], "distance": found[i, j]})

    return nodes.groupBy("v_call", "j_call", "n").applyInPandas(run, "v_call string, j_call string, a string, b string, distance double")
