from __future__ import annotations

import pytest

from clonarium.operators import germlines as L

REFS = [("IGHV1-1*01", "CAG...GTGCAG"), ("IGHV2-1*01", "TTT...GTGCAG"), ("IGHD1-1*01", "GGTACC"), ("IGHJ1*01", "ACTACTTTG")]
COLS = "sequence_id string, clone string, sequence_imgt string, v_call string, d_call string, j_call string, v_germ_start_imgt int, v_germ_length_imgt int, np1_length int, d_germ_start int, d_germ_length int, np2_length int, j_germ_start int, j_germ_length int"


@pytest.fixture
def refs(spark):
    return spark.createDataFrame(REFS, "allele string, sequence string")


def rec(name, seq, v="IGHV1-1*01", d="IGHD1-1*01", j="IGHJ1*01", clone="c", **k):
    k = {"vs": 1, "vl": 12, "n1": 2, "ds": 2, "dl": 3, "n2": 1, "js": 1, "jl": 6} | k
    return (name, clone, seq, v, d, j, k["vs"], k["vl"], k["n1"], k["ds"], k["dl"], k["n2"], k["js"], k["jl"])


def build(spark, refs, *rows, **options):
    return {r.sequence_id: r for r in L.attach_germlines(spark.createDataFrame(list(rows), COLS), refs, **options).collect()}


def test_full_masked_and_regions(spark, refs):
    r = build(spark, refs, rec("a", "x" * 24))["a"]
    assert r.germline_full == "CAG...GTGCAG" + "NN" + "GTA" + "N" + "ACTACT"
    assert r.germline_dmask == "CAG...GTGCAG" + "N" * 6 + "ACTACT" and r.germline_vonly == "CAG...GTGCAG"
    assert r.germline_regions == "V" * 12 + "NN" + "DDD" + "N" + "J" * 6 and r.germline_error is None


def test_padding_and_missing_calls(spark, refs):
    out = build(spark, refs, rec("pad", "x" * 27, vl=15), rec("nov", "x" * 24, v=None), rec("nod", "x" * 21, d=None, dl=3), rec("shift", "x" * 21, vs=4, vl=9), rec("bad", "x" * 12, n1=None, ds=None, dl=None, n2=None, js=None, jl=None))
    assert out["pad"].germline_full.startswith("CAG...GTGCAGNNNNN") and out["nov"].germline_full.startswith("N" * 14 + "GTA")
    assert out["nod"].germline_full == "CAG...GTGCAG" + "NNN" + "ACTACT" and out["shift"].germline_vonly == "...GTGCAG"
    assert out["bad"].germline_full == "CAG...GTGCAG" and out["bad"].germline_dmask == "CAG...GTGCAG"


def test_errors_in_order(spark, refs):
    out = build(spark, refs, rec("v", "", v="IGHV9-9*01", j="IGHJ9*01"), rec("j", "", j="IGHJ9*01"), rec("empty", ""), rec("long", "x" * 25))
    assert "IGHV9-9*01" in out["v"].germline_error and "IGHJ9*01" in out["j"].germline_error
    assert out["empty"].germline_error == "Sequence is missing from the sequence_imgt field"
    assert out["long"].germline_error.endswith("by 1 characters.") and out["long"].germline_full is None


def test_empty_j_compat(spark, refs):
    row = rec("e", "x" * 18, jl=0)
    assert build(spark, refs, row)["e"].germline_dmask == "CAG...GTGCAG" + "N" * 6
    assert build(spark, refs, row, compat=True)["e"].germline_dmask == "CAG...GTGCAG" + "N" * 6 + build(spark, refs, row)["e"].germline_full


def test_detailed_junction_regions(spark, refs):
    df = spark.createDataFrame([(*rec("a", "x" * 24), 1, 0, 1, 0, 1, 0), (*rec("b", "x" * 24), None, 0, 1, 0, 1, 0)], COLS + ", n1_length int, p3v_length int, p5d_length int, p3d_length int, n2_length int, p5j_length int")
    out = {r.sequence_id: r.germline_regions for r in L.attach_germlines(df, refs).collect()}
    assert out["a"] == "V" * 12 + "NP" + "DDD" + "N" + "J" * 6 and out["b"] == "V" * 12 + "NN" + "DDD" + "N" + "J" * 6


def test_clonal_consensus_pads_all_members(spark, refs):
    rows = [
        rec("b", "x" * 24), rec("a", "x" * 24), rec("c", "x" * 26, v="IGHV2-1*01", jl=8), rec("d", "x" * 22, jl=4),
        rec("s", "x" * 24, clone="single"), rec("p", "x" * 24, clone="tie", v="IGHV2-1*01"), rec("q", "x" * 24, clone="tie"), rec("lost", "x" * 24, clone=None),
        rec("m", "x" * 24, clone="none", v="IGHV1-1*01", j="IGHJ2*01"), rec("n", "x" * 24, clone="none", v="IGHV1-1*01", j="IGHJ2*01"), rec("o", "x" * 24, clone="none", v="IGHV2-1*01", j="IGHJ1*01"),
    ]
    out = {r.sequence_id: r for r in L.attach_clonal_germlines(spark.createDataFrame(rows, COLS), refs).collect()}
    assert set(out) == {"a", "b", "c", "d", "s", "p", "q", "m", "n", "o"}
    # The longest record lacks the consensus V, so the least id among the others stands for the clone, filled up to its length.
    assert {out[k].germline_consensus for k in "abcd"} == {"a"} and {len(out[k].sequence_imgt) for k in "abcd"} == {26}
    assert out["d"].sequence_imgt == "x" * 22 + "NNNN" and out["d"].j_germ_length == 8 and out["a"].j_germ_length == 8
    assert out["a"].germline_full == "CAG...GTGCAG" + "NN" + "GTA" + "N" + "ACTACTTT"
    assert out["s"].germline_consensus == "s" and out["p"].germline_consensus == out["q"].germline_consensus == "p"
    assert "IGHJ2*01" in out["m"].germline_error


def test_read_germlines(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">X1|IGHV1-1*01|Homo sapiens\ncag...\ngtg\n>X2|IGHV1-1*01|again\nAAA\n>none\nCCC\n")
    (tmp_path / "notes.txt").write_text(">X9|IGHV9-9*01\nAAA\n")
    refs = L.read_germlines(spark, str(tmp_path))
    assert [tuple(r) for r in refs.collect()] == [("IGHV1-1*01", "CAG...GTG")] and L.gapped(refs)
    assert {r.allele for r in L.read_germlines(spark, str(tmp_path), as_is=True).collect()} == {"X1|IGHV1-1*01|Homo", "X2|IGHV1-1*01|again", "none"}


def test_protein_guard(spark):
    df = spark.createDataFrame([("QVQLE",), ("ACGT",)], "sequence_imgt string")
    assert L.looks_like_protein(df) and not L.looks_like_protein(df.where("sequence_imgt = 'ACGT'"))
