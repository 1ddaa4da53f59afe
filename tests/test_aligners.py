from __future__ import annotations

import re
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clonarium import catalog, catalog_reports  # noqa: F401
from clonarium.sources import aligners as A

V = "CAGGTGCAGCTGGTGCAG"
D_SEQ = "GGTATAACTGG"
J = "ACTACTTTGACTACTGGGGCCAAGGAACC"
READ = "TTT" + V + "CC" + D_SEQ + "A" + J + "GCC"
FIELDS = "# Fields: query id, subject id, % identity, alignment length, mismatches, gap opens, gaps, q. start, q. end, s. start, s. end, evalue, bit score, query seq, subject seq, BTOP"


def hit(kind, name, q, s, text, subject=None, gaps=0, score=90, btop=None):
    end = q + len(text.replace("-", "")) - 1
    return "\t".join(map(str, (kind, "r", name, "99.0", len(text), 0, gaps, gaps, q, end, s, s + len((subject or text).replace("-", "")) - 1, "1e-9", score, text, subject or text, btop or len(text))))


def block(name, calls, hits, strand="+", cdr3=True, d=True):
    heavy = "Top V gene match, Top D gene match, Top J gene match" if d else "Top V gene match, Top J gene match"
    parts = [f"# IGBLASTN 2.6.1+\n# Query: {name}\n# Database: x", f"# V-(D)-J rearrangement summary for query sequence ({heavy}, Chain type, stop codon, V-J frame, Productive, Strand).  More text.\n" + "\t".join([*calls, "VH", "No", "In-frame", "Yes", strand])]
    if cdr3:
        parts.append("# Sub-region sequence details (nucleotide sequence, translation, start, end)\nCDR3\tGCTACT\tAT\t10\t15\t")
    parts.append(f"# Hit table (the first field indicates the chain type of the hit)\n{FIELDS}\n# {len(hits)} hits found\n" + "\n".join(hits))
    return "\n\n".join(parts) + "\n\n"


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([("IGHV1-1*01", V[:9] + "..." + V[9:] + "ACG"), ("IGHJ1*01", J)], "allele string, sequence string")


def test_block_report(spark, refs, tmp_path):
    hits = [hit("V", "IGHV1-1*01", 4, 1, V), hit("D", "IGHD1-1*01", 24, 1, D_SEQ), hit("J", "IGHJ1*01", 36, 1, J)]
    over = [hit("V", "IGHV1-1*01", 4, 1, V + "CC"), hit("D", "IGHD1-1*01", 22, 3, "CC" + D_SEQ)]
    cut = [hit("V", "IGHV1-1*01", 4, 1, V[:6] + "GG" + V[6:], V[:6] + "--" + V[6:], 1, btop="6G-G-12")]
    text = block("full", ("IGHV1-1*01,IGHV1-1*02", "IGHD1-1*01", "IGHJ1*01"), hits) + block("overlap", ("IGHV1-1*01", "IGHD1-1*01", "N/A"), over, cdr3=False) + block("gap", ("IGHV1-1*01", "N/A"), cut, cdr3=False, d=False)
    text += block("unknown", ("IGHV9-9*01", "N/A"), hits[:1], d=False, cdr3=False) + "# IGBLASTN 2.6.1+\n# Query: nothing\n# Database: x\n# 0 hits found\n\n"
    (tmp_path / "r.fmt7").write_text(text)
    names = ("full", "overlap", "unknown", "nothing")
    seqs = spark.createDataFrame([(n, READ) for n in names] + [("gap", "TTT" + V[:6] + "GG" + V[6:])], "description string, sequence string")
    out = {r.sequence_id: r for r in A.read_blocks(spark, str(tmp_path / "r.fmt7"), seqs, refs).collect()}
    r = out["full"]
    assert (r.v_call, r.d_call, r.j_call, r.locus) == ("IGHV1-1*01,IGHV1-1*02", "IGHD1-1*01", "IGHJ1*01", "IGH")
    assert (r.v_seq_start, r.v_seq_length, r.np1_length, r.d_seq_start, r.np2_length, r.j_seq_start) == (4, 18, 2, 24, 1, 36)
    assert r.sequence_vdj == V + "CC" + D_SEQ + "A" + J and r.v_cigar == "3S18="
    assert r.sequence_imgt == V[:9] + "..." + V[9:] + "CC" + D_SEQ + "A" + J and (r.v_germ_start_imgt, r.v_germ_length_imgt) == (1, 21)
    assert r.junction == READ[6:18] and r.junction_length == 12 and r.junction_start == 7 and r.functional and not r.stop and not r.rev_comp
    r = out["overlap"]
    assert (r.np1_length, r.d_seq_start, r.d_seq_length, r.d_germ_start, r.d_germ_length) == (0, 24, 11, 5, 11)
    assert r.sequence_vdj == V + "CC" + D_SEQ and r.j_call is None and r.j_seq_start is None
    r = out["gap"]
    assert r.indels and r.sequence_vdj == V[:6] + "GG" + V[6:] and r.sequence_imgt.replace(".", "") == V and r.v_cigar == "3S6=2D12="
    assert out["unknown"].sequence_imgt is None and out["unknown"].v_call == "IGHV9-9*01"
    assert out["nothing"].v_call is None and out["nothing"].sequence_input == READ
    inferred = {r.sequence_id: r for r in A.read_blocks(spark, str(tmp_path / "r.fmt7"), seqs, refs, infer_junction=True).collect()}
    assert inferred["full"].junction == out["full"].junction
    with pytest.raises(PySparkException):
        A.read_blocks(spark, str(tmp_path / "r.fmt7"), seqs.where("description <> 'full'"), refs).collect()


def test_reverse_strand(spark, refs, tmp_path):
    (tmp_path / "r.fmt7").write_text(block("rc", ("IGHV1-1*01", "N/A"), [hit("V", "IGHV1-1*01", 4, 1, V)], strand="-", cdr3=False, d=False))
    seqs = spark.createDataFrame([("rc", "AACG")], "description string, sequence string")
    r = A.read_blocks(spark, str(tmp_path / "r.fmt7"), seqs, refs).first()
    assert r.rev_comp and r.sequence_input == "CGTT"


def test_protein_report_takes_ties(spark, tmp_path):
    hits = [hit("V", "IGHV2*02", 1, 1, "QVQ", score=50), hit("V", "IGHV1-1*01", 1, 1, "QVQLV", score=80), hit("V", "IGHV1-1*03", 2, 1, "VQLV", score=80)]
    (tmp_path / "p.fmt7").write_text("# IGBLASTP 1.14\n# Query: p1\n\n# Hit table (x)\n" + FIELDS + "\n# 3 hits found\n" + "\n".join(hits) + "\n\n")
    refs = spark.createDataFrame([("IGHV1-1*01", "Q.VQLVQ")], "allele string, sequence string")
    r = A.read_protein_blocks(spark, str(tmp_path / "p.fmt7"), spark.createDataFrame([("p1", "QVQLVQ")], "description string, sequence string"), refs).first()
    assert r.v_call == "IGHV1-1*01,IGHV1-1*03" and r.v_seq_aa_length == 5 and r.sequence_aa_imgt == "Q.VQLV" and r.locus == "IGH" and not r.stop


def test_semicolon_table(spark, tmp_path, refs):
    good = ["s1", "IGHV1-1*01", "IGHD1-1*01", "IGHJ1*01", V, "CC", ".." + D_SEQ, "A", J + "..", "0", "0", "0", "0", "true", "5", "0", "0.1", "-9.5", "0", "0", "0", "3", "290", "0.2"]
    bad = ["s2", "NA - V too short", *["NA"] * 17]
    (tmp_path / "i.csv").write_text("\n".join(";".join(f'"{c}"' for c in r) + "\n" for r in (good, bad)))
    seqs = spark.createDataFrame([("s1", READ), ("s2", "ACGT")], "description string, sequence string")
    out = {r.sequence_id: r for r in A.read_semicolon(spark, str(tmp_path / "i.csv"), seqs, refs).collect()}
    r = out["s1"]
    assert (r.v_seq_start, r.v_seq_length, r.np1_length, r.d_seq_start, r.d_germ_start, r.d_germ_length, r.j_germ_start) == (3, 18, 2, 23, 2, 11, 0)
    assert r.sequence_vdj == V + "CC" + D_SEQ + "A" + J and r.functional and r.vdj_score == -9.5 and r.locus == "IGH" and r.sequence_imgt.startswith(V[:9] + "...")
    assert out["s2"].v_call is None and out["s2"].functional is None and out["s2"].sequence_input == "ACGT"


SUMMARY = ["Sequence ID", "V-DOMAIN Functionality", "V-DOMAIN Functionality comment", "V-GENE and allele", "D-GENE and allele", "J-GENE and allele", "Orientation", "JUNCTION frame", "V-REGION potential ins/del", "V-REGION insertions", "V-REGION deletions", "Sequence", "V-REGION score", "V-REGION identity %", "J-REGION score", "J-REGION identity %"]
JUNCTION = ["Sequence ID", "JUNCTION", "JUNCTION (AA)", "P3'V-nt nb", "N-REGION-nt nb", "N1-REGION-nt nb", "P5'D-nt nb", "P3'D-nt nb", "N2-REGION-nt nb", "P5'J-nt nb", "D-REGION-nt nb", "5'D-REGION trimmed-nt nb", "5'J-REGION trimmed-nt nb", "D-REGION reading frame"]


def tables(folder, third="s2"):
    seq = lambda v, vdj: ["", vdj, v, "ACGT"]
    rows = {
        "1_Summary.txt": [SUMMARY, ["s1", "productive (see comment)", "", "Homsap IGHV1-1*01 F, or Homsap IGHV1-1*02 F (see comment)", "", "Homsap IGHJ1*01 F", "+", "in-frame", "", "", "", READ, "900", "98.5", "200", ""], ["s2", "No results", "", "", "", "", "", "", "", "", "", "ACGT", "", "", "", ""]],
        "2_IMGT-gapped-nt-sequences.txt": [["Sequence ID", "V-J-REGION", "V-D-J-REGION", "V-REGION", "J-REGION"], ["s1", *seq("cag...gtg", "cag...gtgcc")], ["s2", "", "", "", ""]],
        "3_Nt-sequences.txt": [["Sequence ID", "V-J-REGION", "V-D-J-REGION", "V-REGION", "J-REGION", "V-REGION start"], ["s1", *seq("caggtg", "caggtgcc"), "4"], [third, "", "", "", "", ""]],
        "6_Junction.txt": [JUNCTION, ["s1", "tgtgcg", "CA", "1", "", "2", "1", "0", "3", "1", "5", "2", "4", "reading frame 2"], ["s2", *[""] * 13]],
    }
    for name, table in rows.items():
        (folder / name).write_text("\n".join("\t".join(r) for r in table) + "\n")


def test_four_tables(spark, tmp_path):
    folder = tmp_path / "report"
    folder.mkdir()
    tables(folder)
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for p in folder.iterdir():
            z.write(p, f"deep/{p.name}")
    (tmp_path / "out").mkdir()
    for source in (folder, tmp_path / "r.zip"):
        out = {r.sequence_id: r for r in A.read_tables(spark, A.unpack_tables(str(source), str(tmp_path / "out"))).collect()}
        r = out["s1"]
        assert (r.functional, r.in_frame, r.stop, r.rev_comp, r.indels) == (True, True, False, False, False)
        assert r.v_call.strip() == "Homsap IGHV1-1*01 F,Homsap IGHV1-1*02 F" and r.locus == "IGH"
        assert (r.v_seq_start, r.v_seq_length, r.v_germ_length_imgt, r.np1_length, r.d_seq_start, r.d_seq_length, r.d_germ_start, r.np2_length, r.j_seq_start, r.j_germ_start) == (4, 6, 9, 4, 14, 5, 3, 4, 23, 5)
        assert (r.n1_length, r.n2_length, r.d_frame, r.v_identity, r.j_identity, r.junction, r.sequence_imgt) == (2, 3, 2, 0.985, None, "TGTGCG", "CAG...GTGCC")
        assert out["s2"].functional is None and out["s2"].v_call is None
    with pytest.raises(ValueError, match="exactly four"):
        (folder / "6_Junction.txt").unlink()
        A.unpack_tables(str(folder), str(tmp_path / "out"))


def test_tables_meet_without_a_broadcast_of_rows(spark, tmp_path):
    """However small a table's files are, no join has its rows sent to the driver; counts by partition alone are."""
    tables(tmp_path)
    out = A.read_tables(spark, A.unpack_tables(str(tmp_path), str(tmp_path))).select("sequence_id", "np1_length")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, .*_nth.* rightHint=\(strategy=merge\)", plan)) == 3
    assert sorted(r.sequence_id for r in out.collect()) == ["s1", "s2"]
    ran = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("SortMergeJoin") == 3


def steps(plan):
    """All steps of a plan that has run."""
    inside = {"AdaptiveSparkPlan": "executedPlan", "BroadcastQueryStage": "plan", "ShuffleQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName())
    children = plan.children()
    yield plan
    for x in [getattr(plan, inside)()] if inside else [children.apply(i) for i in range(children.size())]:
        yield from steps(x)


def scanned(spark, folder, name, n=400):
    """The rows of a registered query over ``n`` orders, those of its SQL, and how many rows each broadcast of its plan held."""
    spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{folder}/orders.parquet").createOrReplaceTempView("orders")
    out = catalog.QUERIES[name](spark, str(folder))
    rows = sorted(map(tuple, out.collect()))
    held = [x.metrics().apply("numOutputRows").value() for x in steps(out._jdf.queryExecution().executedPlan()) if x.nodeName() == "BroadcastExchange"]
    wanted = sorted(map(tuple, spark.sql(catalog.SQL[name]).select(out.columns).collect()))
    spark.catalog.dropTempView("orders")
    return rows, wanted, held


def test_scan_tables_calls_holds_no_rows_in_the_driver(spark, tmp_path):
    rows, wanted, held = scanned(spark, tmp_path, "scan_tables_calls")
    assert rows == wanted and len(rows) == 400
    assert len(held) == 4 and max(held) <= 4  # partitions of each table


def test_scan_tables_sequences_holds_no_rows_in_the_driver(spark, tmp_path):
    rows, wanted, held = scanned(spark, tmp_path, "scan_tables_sequences")
    assert rows == wanted and len(rows) == 400
    assert len(held) == 4 and max(held) <= 4  # partitions of each table


def test_tables_that_disagree(spark, tmp_path):
    tables(tmp_path, third="other")
    with pytest.raises(PySparkException):
        A.read_tables(spark, A.unpack_tables(str(tmp_path), str(tmp_path))).collect()


def test_finish_validates_and_annotates(spark):
    seq = "A" * 309 + "TGTGCG" + "CCC"
    df = spark.createDataFrame([("s1|CONSCOUNT=2", "IGHV1-1*01", None, "IGHJ1*01", True, seq, "TGTGCG"), ("s2", "IGHV1-1*01", None, "IGHJ1*01", True, seq, "TGTGCC"), ("s3", "IGHV1-1*01", None, None, None, "", "")], "sequence_id string, v_call string, d_call string, j_call string, functional boolean, sequence_imgt string, junction string")
    cells = spark.createDataFrame([("s1", "c9")], "contig_id string, cell string")
    out = {r.sequence_id: r for r in A.finish(df, cells=cells).collect()}
    assert out["s1"].passed and out["s1"].annotations == {"CONSCOUNT": "2"} and out["s1"].cell == "c9"
    assert not out["s2"].passed and not out["s3"].passed
    assert {r.sequence_id for r in A.finish(df, check="gentle").where("passed").collect()} == {"s1", "s2"} and A.finish(df, check="partial").where("passed").count() == 3
    with pytest.raises(PySparkException):
        A.finish(df, cells=cells, strict_cells=True).collect()


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one two|K=V\nAC\nGT\n>x\nTT\n")
    assert {tuple(r) for r in A.read_fasta(spark, str(tmp_path / "a.fasta")).collect()} == {("one two|K=V", "ACGT"), ("x", "TT")}
    (tmp_path / "b.fasta").write_text(">x\nAC\n>x\nGT\n")
    with pytest.raises(ValueError):
        A.read_fasta(spark, str(tmp_path / "b.fasta"))
    (tmp_path / "q.fastq").write_text("@r1\nACGT\n+\n!!!!\n@r2\nTT\n+\n!!\n")
    assert [r.value for r in A.fastq_to_fasta(spark, str(tmp_path / "q.fastq")).orderBy("_row").collect()] == [">r1", "ACGT", ">r2", "TT"]
    (tmp_path / "cells.csv").write_text("contig_id,c_gene\nx,None\ny,IGHM\n")
    assert {tuple(r) for r in A.read_cell_ranger(spark, str(tmp_path / "cells.csv")).collect()} == {("x", ""), ("y", "IGHM")}
    ids = A.short_ids(spark.createDataFrame([("a b/c" + "z" * 60,)], "description string"))
    assert ids.first().short == "a_b/c" + "z" * 44


def test_renumber(spark, refs):
    df = spark.createDataFrame([("s", V + J, "IGHV1-1*01", "IGHJ1*01", 1, 18, 1, 29)], "sequence_id string, sequence_imgt string, v_call string, j_call string, v_germ_start_imgt int, v_germ_length_imgt int, j_germ_start int, j_germ_length int")
    r = A.renumber(df, refs).first()
    assert r.sequence_imgt == V[:9] + "..." + V[9:] + J and r.v_germ_length_imgt == 21 and r.germline_imgt == r.sequence_imgt
