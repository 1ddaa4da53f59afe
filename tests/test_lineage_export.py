from __future__ import annotations

import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonarium.operators import lineage as T
from clonarium.sources import export as X
from clonarium.sources import external as E


def test_equal_records_pass_unmasked():
    assert T.mask_codons("CAGGTG...CAG", "TTCAGGTGCAGCC", 3) == ("CAGGTG...CAG", None, [], [], [])


def test_split_codon_is_masked():
    # The read has an insertion in frame; the codon beside it does not match and is masked.
    out, fail, sites, *_ = T.mask_codons("CAGGTGCAGCTG", "CAGGTTTTGCAGCTG", 1)
    assert fail is None and out == "CAGNNNCAGCTG" and sites == [2]


def test_open_codon_and_ends():
    # A first codon that lacks letters is masked where the read has them, and filled up where the read lacks them as well.
    assert T.mask_codons("..GGTGCAG", "CAGGTGCAG", 1)[:2] == ("NNNGTGCAG", None)
    assert T.mask_codons("..GGTGCAG", "GGTGCAG", 1)[:2] == ("NNGGTGCAG", None)
    assert T.mask_codons("CAGGTGCA", "CAGGTGCAG", 1)[0] == "CAGGTGNNN"
    assert T.mask_codons("CAGGTG..", "CAGGTG", 1)[0] == "CAGGTG..."


def test_failures():
    assert T.mask_codons("CAG-GTGCAG", "CAGGTGCAG", 1)[1] == "FRAME-SHIFTING DELETION"
    assert T.mask_codons("CAG---GTG", "CAGGTG", 1)[:2] == ("CAG...GTG", None)
    assert T.mask_codons("CAGGTGCAGCTGGTG", "CAGGTGACAGCTGGTG", 1)[1] == "SINGLE FRAME-SHIFTING INSERTION"
    assert T.mask_codons("CAGGTGCCCTTTAAA", "CAGATATATATATATA", 1)[1].startswith("FAILED_MATCH_QSTRING")


def records(spark):
    base = "CAGGTGCAGCTG"
    rows = [("r1", "c1", base, base, True, 3), ("r2", "c1", base, base, True, 1), ("r3", "c1", base[:-3] + "NNN", base[:-3] + "NNN", True, 5), ("r4", "c1", "CAGGTGCAGAAA", "CAGGTGCAGAAA", True, None), ("r5", "c1", "CAGTAGCAGCTG", "CAGTAGCAGCTG", True, 1), ("r6", "c1", base, base, False, 1), ("r7", "c2", base, base, True, 2)]
    df = spark.createDataFrame(rows, "sequence_id string, clone string, sequence_imgt string, sequence_input string, functional boolean, dupcount int")
    return df.withColumns({"v_seq_start": F.lit(1), "junction_length": F.lit(None).cast("int"), "v_call": F.lit("IGHV1-1*01"), "j_call": F.lit("IGHJ1*01"), "germline_imgt_d_mask": F.lit(base)})


def test_gates_collapse_and_files(spark, tmp_path):
    masked = {r.sequence_id: r for r in T.mask_records(records(spark)).collect()}
    assert masked["r5"].fail_reason == masked["r6"].fail_reason == "NONFUNCTIONAL/PTC" and masked["r1"].fail_reason is None and masked["r4"].dupcount == 1
    out = {r.sequence_id: r for r in T.align_clones(T.mask_records(records(spark)), collapse=True).collect()}
    assert out["r2"].fail_reason == "Duplication of r1" and out["r3"].fail_reason.startswith("Collapsed with") and out["r1"].kept and out["r4"].kept
    assert sum(r.dupcount for r in out.values() if r.kept and r.clone == "c1") == 10 and out["r1"].clone_size == 2
    small = {r.sequence_id: r for r in T.align_clones(T.mask_records(records(spark)), collapse=True, least=2).collect()}
    assert small["r7"].fail_reason == "Clone too small: 1" and small["r7"].clone_size == -1
    manifest = T.write_clone_files(T.align_clones(T.mask_records(records(spark))), str(tmp_path / "trees"))
    lines = open(manifest).read().splitlines()
    assert lines[0] == "2" and lines[1].startswith(str(tmp_path / "trees" / "c1.fasta"))
    assert (tmp_path / "trees" / "c2.fasta").read_text() == ">r7\nCAGGTGCAGCTG\n>r7_1\nCAGGTGCAGCTG\n>c2_GERM\nCAGGTGCAGCTG\n"
    assert (tmp_path / "trees" / "c1.part.txt").read_text().splitlines()[:5] == ["2 4", "FWR:IMGT", "CDR:IMGT", "IGHV1-1", "IGHJ1"]


def test_clone_alignment_removes_gap_codons_and_cdr3():
    rows = pd.DataFrame({"clone": "c", "sequence_id": ["a", "b"], "masked": ["CAG...GTGAAA", "CAG...GTG"], "labels": [[13] * 12, [13] * 9], "dupcount": 1, "g": "CAG...GTGAA", "v_call": "v*1", "j_call": "j*1"})
    out = T.align_clone(rows, "g", [], False, False, 1)
    assert out["sequence"].tolist() == ["CAGGTGAAA", "CAGGTGNNN"] and out["germline"][0] == "CAGGTGAAN" and out["sites"][0] == [13, 13, 13]
    cut = T.align_clone(rows.iloc[[0]].assign(labels=[[13] * 9 + [108] * 3]), "g", [], False, True, 1)
    assert cut["sequence"].tolist() == ["CAGGTG"] and cut["sites"][0] == [13, 13]
    with pytest.raises(ValueError, match="labels differ"):
        T.align_clone(rows.assign(labels=[[13] * 12, [30] * 9]), "g", [], False, False, 1)
    rows["g"] = ["CAG", "CCC"]
    with pytest.raises(ValueError, match="germlines differ"):
        T.align_clone(rows, "g", [], False, False, 1)
    with pytest.raises(ValueError, match="whole codons"):
        T.align_clone(rows.assign(masked=["CAGG", "CAG"], labels=[[13] * 4, [13] * 3], g="CAG"), "g", [], False, False, 1)


def test_collapse_takes_the_least_ambiguous_partner():
    assert T.collapse_targets(["ANG", "ACG", "NNG", "TTT"], [()] * 4) == {0: 1, 2: 1}
    assert T.collapse_targets(["ANG", "ACG"], [("x",), ("y",)]) == {}


def test_fasta(spark):
    df = spark.createDataFrame([("s1", "A" * 61, "x", 1), ("s2", "", "x", 2), (None, "AC", "y", 3)], "sequence_id string, sequence_alignment string, sample string, _row int")
    out = X.fasta(df, fields=["sample"]).orderBy("_row").collect()
    assert out[0].fasta == f">s1|SAMPLE=x\n{'A' * 60}\nA" and [r.passed for r in out] == [True, False, False]
    assert X.fasta(df.withColumn("sequence_alignment", F.lit("A" * 60))).first().fasta.count("\n") == 1


def test_clonal_fasta(spark):
    df = spark.createDataFrame([("a", "AA", "GG", "c1", 1), ("b", "AC", "GG", "c1", 2), ("c", "TT", "CC", "c2", 3)], "sequence_id string, sequence_alignment string, germline_alignment_d_mask string, clone string, _row int")
    assert [r.fasta for r in X.clonal_fasta(df, cluster="clone").orderBy("_row").collect()] == [">>c1\nGG\n>a\nAA", ">b\nAC", ">>c2\nCC\n>c\nTT"]


def test_clonal_fasta_of_unsorted_clusters_and_without_a_cluster(spark):
    rows = [(f"r{i}", "AC", f"G{'ACGT'[i % 4]}", None if i % 11 == 0 else f"c{i // 3 % 4}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_alignment string, germline_alignment_d_mask string, clone string, _row int").repartition(5)
    got = [r.fasta for r in X.clonal_fasta(df, cluster="clone").orderBy("_row").collect()]
    before = object()
    for (name, seq, germ, clone, _), text in zip(rows, got, strict=True):
        lead = f">>{clone or ''}\n{germ}\n" if clone != before else ""
        assert text == f"{lead}>{name}\n{seq}"
        before = clone
    alone = [r.fasta for r in X.clonal_fasta(df, fields=["clone"]).orderBy("_row").collect()]
    assert alone == [f">>{n}|CLONE={c or ''}\n{g}\n>{n}|CLONE={c or ''}\n{s}" for n, s, g, c, _ in rows]


def test_feature_table(spark):
    seq = "NN" + "A" * 30 + "TGTGCGAGAGGTTGG" + "C" * 20 + "GGG"
    cells = {"sequence_id": "s1 more", "sequence_input": seq, "v_call": "IGHV1-1*01", "d_call": None, "j_call": "IGHJ1*02", "v_seq_start": 3, "v_seq_length": 32, "d_seq_start": None, "d_seq_length": None, "j_seq_start": 43, "j_seq_length": 25, "junction_start": 33, "junction_end": 47, "n": "7"}
    kinds = ", ".join(f"{k} {'string' if k in ('sequence_id', 'sequence_input', 'v_call', 'd_call', 'j_call', 'n') else 'int'}" for k in cells)
    df = spark.createDataFrame([tuple(cells.values())], kinds)
    r = X.submission(df, inference="tool", db_xref="IMGT", count_field="n", sample={"organism": "x"}).first()
    lines = r.table.split("\n")
    assert lines[0] == ">Features s1" and "66\t>68\tC_region" in lines and "1\t65\tV_region" in lines and "1\t32\tV_segment" in lines and "41\t65\tJ_segment" in lines
    assert "<31\t>45\tCDS" in lines and "\t\t\tgene\tIGHV1-1" in lines and "\t\t\tallele\t02" in lines and not any("D_segment" in x for x in lines)
    assert r.fasta.startswith(">s1 [organism=x] [moltype=mRNA]") and "[note=AIRR_READ_COUNT:7]" in r.fasta and "\nNN" not in r.fasta
    stop = df.withColumn("sequence_input", F.lit(seq.replace("TGTGCGAGA", "TGTTAAAGA")))
    assert X.features(stop).first().features is None or X.features(stop, allow_stop=True).first().features[-1]["key"] in ("CDS", "misc_feature")
    assert X.features(df.withColumn("v_call", F.lit("x"))).first().features is None


def fake(sequences):
    width = max(map(len, sequences))
    return [s.ljust(width, "-") for s in sequences]


def test_alignment_of_groups_and_rows(spark):
    df = spark.createDataFrame([("a", "IGHV1-1*01", "AC", "ACGT"), ("b", "IGHV1-1*02", "ACG", "A"), ("c", "IGHV2-1*01", "", "A"), ("d", None, "A", "C")], "sequence_id string, v_call string, x string, y string")
    across = {r.sequence_id: r for r in E.align_records(df, ["x", "y"], fake, "across", ["v"]).collect()}
    assert (across["a"].x_align, across["b"].y_align, across["a"].passed) == ("AC-", "A---", True) and not across["c"].passed and not across["d"].passed
    whole = {r.sequence_id: r for r in E.align_records(df, ["x", "y"], fake, "block", ["v"]).collect()}
    assert (whole["a"].x_align, whole["b"].y_align) == ("AC--", "A---")
    within = {r.sequence_id: r for r in E.align_records(df, ["x", "y"], fake, "within").collect()}
    assert (within["a"].x_align, within["d"].passed, within["c"].passed) == ("AC--", True, False)


def test_commands(spark, tmp_path):
    command = E.igblast_command("igblastn", "q", "o", "/base", loci="tr", threads=3)
    assert command[:5] == ["igblastn", "-query", "q", "-out", "o"] and "TCR" in command and "/base/database/imgt_human_tr_v" in command
    assert "-germline_db_J" not in E.igblast_command("igblastp", "q", "o", "/base", protein=True)
    done = subprocess.CompletedProcess([], 0, stdout="igblastn: 1.17.1\n Package: x")
    assert E.version("igblastn", lambda *a, **k: done) == (1, 17, 1)
    with pytest.raises(RuntimeError):
        E.check_version((1, 17, 1), "constant")
    seqs = spark.createDataFrame([(f"s{i}", "ACGT") for i in range(6)], "description string, sequence string").repartition(2)
    reports = E.run_partitions(seqs, lambda q, o: ["cp", q, o]).collect()
    assert sum(r.report.count(">s") for r in reports) == 6
    first, second = E.igphyml_commands("m.tsv", asr=0.1)
    assert "GY" in first and second[-2:] == ["--ASRc", "0.1"]
