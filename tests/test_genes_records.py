from __future__ import annotations

from pyspark.sql import functions as F

from clonarium.functions import genes as G
from clonarium.functions import records as R


def values(spark, column, *calls):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, v_call string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_calls(spark):
    calls = ("IGHV6-1*02,IGHV6-1*01", "Homsap TRBV6-6*01 F, or TRBV6-6*01", "", None, "princess,banana,hammock", "IGHJ6*02", "IGKC*01")
    assert values(spark, G.allele("v_call"), *calls) == ["IGHV6-1*02", "TRBV6-6*01", None, None, None, "IGHJ6*02", None]
    assert values(spark, G.allele("v_call", "set"), *calls)[:3] == [["IGHV6-1*01", "IGHV6-1*02"], ["TRBV6-6*01"], None]
    assert values(spark, G.allele("v_call", "list"), *calls)[1] == ["TRBV6-6*01", "TRBV6-6*01"]
    assert values(spark, G.gene("v_call"), *calls)[:2] == ["IGHV6-1", "TRBV6-6"]
    assert values(spark, G.family("v_call"), *calls)[:2] == ["IGHV6", "TRBV6"]
    assert values(spark, G.allele_number("v_call"), *calls)[:3] == ["02", "01", None]
    assert values(spark, G.j_allele("v_call"), *calls)[5] == "IGHJ6*02" and values(spark, G.v_allele("v_call"), *calls)[5] is None
    assert values(spark, G.c_gene("v_call"), *calls)[6] == "IGKC"


def test_alpha_delta_locus(spark):
    assert values(spark, G.locus("v_call"), "TRAV14/DV4*01", "TRAV38-2/DV8*01", "IGHV1-2*01", "x") == ["TRA/TRD", "TRA/TRD", "IGH", None]
    assert values(spark, G.locus("v_call", "set"), "TRAV14/DV4*01") == [["TRA", "TRD"]]


def test_as_is(spark):
    gene, allele = G.split_as_is("v_call")
    assert values(spark, gene, "a*b*c", "plain") == ["a*b", "plain"] and values(spark, allele, "a*b*c", "plain") == ["c", None]
    assert values(spark, G.first_as_is("v_call"), "x y,z") == ["x y"]


def test_types(spark):
    assert values(spark, R.parse(F.col("v_call"), "logical"), "T", "FALSE", "t", "", None) == [True, False, None, None, None]
    assert values(spark, R.parse(F.col("v_call"), "integer"), " 7 ", "3.0", "", "abc") == [7, None, None, None]
    assert values(spark, R.parse(F.col("v_call"), "double"), "1.5", "x") == [1.5, None]
    assert values(spark, R.parse(F.col("v_call"), "nucleotide"), "acg", "NA", None, "None") == ["ACG", "", "", ""]


def test_names_go_both_ways():
    for name in R.REQUIRED["airr"] + R.REQUIRED["airr-aa"]:
        assert R.from_attribute(R.to_attribute(name, "airr"), "airr") == name
    for name in R.REQUIRED["legacy"] + R.REQUIRED["legacy-aa"]:
        assert R.from_attribute(R.to_attribute(name, "legacy"), "legacy") == name
    assert R.to_attribute("productive", "airr") == "functional" and R.to_attribute("v_germline_start", "airr") == "v_germ_start_imgt"
    assert R.to_attribute("PRCONS", "legacy") == "prcons" and R.to_attribute("Own_Field", "airr") == "own_field"
    assert R.kind("v_seq_length") == "integer" and R.kind("fwr1_aa_imgt") == "aminoacid" and R.kind("prcons") == "identity"


def test_conversion_makes_ends_and_lengths(spark):
    legacy = spark.createDataFrame([("s1", "T", "5", "20", "acgt", "own")], "SEQUENCE_ID string, FUNCTIONAL string, V_SEQ_START string, V_SEQ_LENGTH string, JUNCTION string, PRCONS string")
    there = R.convert(legacy, "legacy", "airr")
    row = there.first()
    assert there.columns == ["sequence_id", "productive", "v_sequence_start", "v_sequence_end", "v_sequence_length", "junction", "prcons"]
    assert (row.productive, row.v_sequence_end, row.junction, row.prcons) == ("T", "24", "ACGT", "own")
    back = R.convert(there, "airr", "legacy").first()
    assert (back.V_SEQ_START, back.V_SEQ_LENGTH, back.SEQUENCE_ID) == ("5", "20", "s1")


def test_junction_start_follows_from_v(spark):
    df = spark.createDataFrame([("1", "299", "1", "320", "30", "ACG.TT")], "v_sequence_start string, v_sequence_end string, v_germline_start string, v_germline_end string, junction_length string, junction string")
    r = R.typed(df, "airr").first()
    assert r.v_seq_length == 299 and r.junction_start == 299 - 10 and r.junction_end == 289 + 30 - 1 - 1
