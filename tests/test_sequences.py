from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clonarium.functions import sequences as S


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cells.items()))
    r = df.select(column.alias("x")).first().x
    return [tuple(y) for y in r] if isinstance(r, list) and r and hasattr(r[0], "asDict") else r


@pytest.mark.parametrize(("btop", "want"), [("7AGAC39", [("=", 7), ("X", 2), ("=", 39)]), ("7A-39", [("=", 7), ("D", 1), ("=", 39)]), ("6-G-A41", [("=", 6), ("I", 2), ("=", 41)]), ("AG8-GC-CTCT", [("X", 1), ("=", 8), ("I", 1), ("D", 1), ("X", 2)])])
def test_btop(spark, btop, want):
    assert one(spark, S.decode_btop("a"), a=btop) == want


@pytest.mark.parametrize(("q", "r", "plain", "led"), [(0, 0, "", "4S16N"), (5, 0, "5S", "9S16N"), (0, 3, "3N", "4S19N"), (5, 3, "5S3N", "9S19N")])
def test_padding(spark, q, r, plain, led):
    pad = lambda c: one(spark, S.encode_cigar(S.pad_alignment(S.decode_cigar("a"), F.lit(q), F.lit(r))), a=c)
    assert pad("30M1I69M3D") == plain + "30M1I69M3D" and pad("4S16N30M1I69M3D") == led + "30M1I69M3D"


def test_positions_and_cigar(spark):
    assert tuple(one(spark, S.alignment_positions(S.decode_cigar("a")), a="30M1I69M3D")) == (0, 100, 0, 102)
    assert tuple(one(spark, S.alignment_positions(S.decode_cigar("a")), a="4S16N30M1I69M3D")) == (4, 100, 16, 102)
    assert one(spark, S.encode_cigar(S.decode_cigar("a")), a="3=2X") == "3=2X" and one(spark, S.encode_cigar(S.decode_cigar("a", compat=True)), a="3=2X") == "2X"
    with pytest.raises(PySparkException):
        one(spark, S.pad_alignment(S.decode_cigar("a"), F.lit(1), F.lit(1)), a="")


def test_translate_and_stops(spark):
    assert one(spark, S.translate("a"), a="TGTGCNTARRAYATHNNNA-GCC") == "CA*BIXXX"[:7]
    assert one(spark, S.translate("a"), a="AC") == "" and one(spark, S.translate("a"), a="atggcc") == "MA"
    assert one(spark, S.first_stop("a"), a="ATGTARCCC") == 3 and one(spark, S.first_stop("a"), a="ATGTAYTA") == -1
    assert one(spark, S.reverse_complement("a"), a="ACGTRN-") == "-NYACGT"


def test_unlike_places(spark):
    assert one(spark, S.unlike_places("a", "b"), a="ACGTN-A", b="ACCTAAT") == 2
    with pytest.raises(PySparkException):
        one(spark, S.unlike_places("a", "b"), a="AC", b="A")


def gap_brute(seq, start, length, ref):
    out, added = "." * (start - 1) + seq, start - 1
    for i, c in enumerate(ref):
        if c == ".":
            if i >= length + added:
                break
            out, added = out[:i] + "." + out[i:], added + 1
    return out, 1, length + added


def test_gap_v_equals_step_by_step_insertion(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        ref = "".join(rng.choice("ACGT...") for _ in range(rng.randint(0, 60)))
        rows.append(("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60))), rng.randint(1, 9), rng.randint(1, 40), ref))
    df = spark.createDataFrame(rows, "seq string, start int, n int, ref string")
    got = df.select("*", S.gap_v("seq", F.col("start"), F.col("n"), "ref").alias("g")).collect()
    for r in got:
        want = gap_brute(r.seq, r.start, r.n, r.ref)
        assert (r.g.sequence, r.g.start, r.g.length) == want, (r, want)


def test_regions_slice_and_clip(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(380))
    df = spark.createDataFrame([(seq, 48), (seq[:200], 48), (seq, None), (None, 48)], "s string, n int")
    got = df.select(*[c.alias(k) for k, c in S.regions("s", F.col("n")).items()]).collect()
    r = got[0]
    assert r.fwr1 + r.cdr1 + r.fwr2 + r.cdr2 + r.fwr3 + r.cdr3 + r.fwr4 == seq and (len(r.fwr1), len(r.cdr3)) == (78, 42)
    assert got[1].cdr3 == "" and got[1].fwr3 == seq[195:200] and got[2].cdr3 is None and got[2].fwr3 == seq[195:312] and got[3].fwr1 is None


def test_infer_junction(spark):
    j = "ACTACTTTGACTACTGGGGCCAAGGAACC"
    seq = "A" * 309 + "TGTGCGAGA" + j[:26]
    got = spark.createDataFrame([(seq, j)], "s string, ref string").select(S.infer_junction("s", F.lit(1), F.lit(26), "ref").alias("x")).first().x
    assert got.junction == seq[309:309 + 9 + j.index("TGGGGCCAAGG") + 3] and got.junction_length == len(got.junction)
    none = spark.createDataFrame([(seq, "ACGT", None)], "s string, ref string, gone string").select(S.infer_junction("s", F.lit(1), F.lit(26), "ref").alias("x"), S.infer_junction("s", F.lit(1), F.lit(26), "gone").alias("y")).first()
    assert none.x.junction == seq[309:] and none.y is None


def test_headers(spark):
    assert one(spark, S.header_fields("a"), a="s1|CONSCOUNT=5|PRIMER=x=y") == {"CONSCOUNT": "5", "PRIMER": "x=y"}
    assert one(spark, S.header_fields("a"), a="s1|plain") is None and one(spark, S.header_id("a"), a="s1|K=V") == "s1"
