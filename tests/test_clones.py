from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonarium.functions import distance as D
from clonarium.operators import clones as C

BASE = "TGTGCGAGAGGTAACTACTACGGTATGGACGTCTGGGGCCAAGGGACC"


def repertoire(spark):
    one, many = "IGHV1-1*01", "IGHV1-1*01, IGHV2-1*01, IGHV3-1*01"
    rows = [
        ("A1", one, BASE, "x", "a"), ("A2", many, BASE, "y", "b"), ("A3", "IGHV3-1*01", BASE, "y", "c"), ("A4", one, BASE[:-5] + "NNNNN", "y", "c"),
        ("B1", "IGHV2-1*01", BASE[:20] + "AAA" + BASE[23:], "x", "b"), ("B2", many, BASE[:20] + "NNN" + BASE[23:], "z", "b"), ("B3", "IGHV9-1*01", BASE, "x", None), ("B4", "IGHV9-1*01", BASE, "", "a"),
    ]
    return spark.createDataFrame([(*r[:2], "IGHJ6*01", *r[2:], i) for i, r in enumerate(rows)], "sequence_id string, v_call string, j_call string, junction string, f1 string, f2 string, _row int")


def groups(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.pre].add(r.sequence_id)
    failed = out.pop(None, set())
    return {frozenset(g) for g in out.values()}, failed


def sets(*names):
    return {frozenset(n.split()) for n in names}


def test_grouping(spark):
    df = repertoire(spark)
    assert groups(C.key_first(df)) == (sets("A1 A4 A2 B2", "A3", "B1", "B3 B4"), set())
    assert groups(C.key_set(df)) == (sets("A1 A2 A3 A4 B1 B2", "B3 B4"), set())
    assert groups(C.key_first(df, fields=["f1", "f2"])) == (sets("A1", "A2", "A3", "A4", "B1", "B2"), {"B3", "B4"})
    # A3 and A4 share the further fields, but no V gene.
    assert groups(C.key_set(df, fields=["f1", "f2"])) == (sets("A1", "A2", "A3", "A4", "B1", "B2"), {"B3", "B4"})
    assert groups(C.key_sequential(df, "_row")) == groups(C.key_set(df))


def test_missing_letters_and_routing(spark):
    out = {r.sequence_id: r for r in C.assign_clones(repertoire(spark), 0.1).collect()}
    assert not out["A4"].passed and not out["B2"].passed and out["A1"].clone == out["A2"].clone == out["A3"].clone == out["B1"].clone
    strict = {r.sequence_id: r for r in C.assign_clones(repertoire(spark), 0.01).collect()}
    assert strict["A1"].clone != strict["B1"].clone
    lenient = {r.sequence_id: r for r in C.assign_clones(repertoire(spark), 0.0, max_missing=5).collect()}
    assert lenient["A4"].clone == lenient["A1"].clone


def test_numbers_follow_first_rows(spark):
    out = C.number_clones(C.assign_clones(repertoire(spark), 0.01), "_row").orderBy("_row").collect()
    assert [r.clone for r in out] == ["1", "1", "1", None, "2", None, "3", "3"]


@pytest.mark.parametrize(("name", "want"), [("ham", [0, 4, 15, 2]), ("hh_s1f", None), ("mk_rs1nf", None)])
def test_distances(name, want):
    a = "CGACCTACTACTACG"
    others = [a, "CGTCTTACAACTCCG", "ATCTAACATATACAT"[:15], "CGACCTACTACTAAT"]
    m = D.model(name)
    got = D.pairwise([a, *others], m, None)[0, 1:]
    table = {(x, y): m.table[m.letters.index(x), m.letters.index(y)] for x in "ACGT" for y in "ACGT"}
    for g, o in zip(got, others, strict=True):
        assert abs(g - sum(table[x, y] for x, y in zip(a, o, strict=True))) < 1e-9
    assert (np.diag(D.pairwise([a, *others], m, "len")) == 0).all()


def test_letters_and_lengths_are_checked():
    with pytest.raises(IndexError):
        D.pairwise(["ACG", "AC"], D.model("ham"))
    with pytest.raises(KeyError):
        D.pairwise(["AC!", "ACG"], D.model("ham"))
    assert D.pairwise(["ARN-", "AGTT"], D.model("ham"), None)[0, 1] == 0
    assert D.pairwise(["BX*", "DW*"], D.model("aa"), None)[0, 1] == 0


def test_window_model(tmp_path):
    words = [a + b + c for a in "ACGTN" for b in "ACGTN" for c in "ACGTN"]
    value = lambda c, w: 0.0 if w[1] == c else 1 + (ord(c) + 3 * ord(w[0])) % 5 / 10
    path = tmp_path / "model.tsv"
    path.write_text("\t" + "\t".join(words) + "\n" + "\n".join(c + "\t" + "\t".join(str(value(c, w)) for w in words) for c in "ACGTN"))
    m = D.model(str(path))
    a, b = "ACGTA", "ATGTC"
    one = [value(a[1], "ATG"), value(b[1], "ACG")]
    two = [value(a[4], "TCN"), value(b[4], "TAN")]
    assert abs(D.pairwise([a, b], m, None, "avg")[0, 1] - (sum(one) + sum(two)) / 2) < 1e-9
    assert abs(D.pairwise([a, b], m, "mut", "min")[0, 1] - (min(one) + min(two)) / 2) < 1e-9


def naive(distance, threshold, kind):
    own = [[i] for i in range(len(distance))]
    score = {"average": np.mean, "complete": np.max, "single": np.min}[kind]
    while len(own) > 1:
        best = min(((score(distance[np.ix_(a, b)]), i, j) for i, a in enumerate(own) for j, b in enumerate(own) if i < j), key=lambda x: x[0])
        if best[0] > threshold:
            break
        own[best[1]] += own.pop(best[2])
    return {frozenset(x) for x in own}


@pytest.mark.parametrize("kind", ["single", "average", "complete"])
def test_linkage_equals_naive(kind):
    rng = np.random.default_rng(8)
    for n in (2, 3, 10, 25):
        x = rng.random((n, 3))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        for t in (0.1, 0.4, 0.8):
            label = D.single_linkage(d, t) if kind == "single" else D.agglomerate(d, t, kind)
            assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == naive(d, t, kind)


def test_segments_equal_matrix(spark):
    rng = random.Random(4)
    seqs = {"".join(rng.choice("ACGT") for _ in range(24)) for _ in range(40)}
    for s in list(seqs):
        for _ in range(3):
            i = rng.randrange(24)
            s = s[:i] + rng.choice("ACGT") + s[i + 1 :]
            seqs.add(s)
    df = spark.createDataFrame([(str(i), "IGHV1-1*01", "IGHJ1*01", s) for i, s in enumerate(sorted(seqs))], "sequence_id string, v_call string, j_call string, junction string")
    for model, t, linkage in (("ham", 0.1, "single"), ("hh_s1f", 0.08, "single"), ("aa", 0.2, "single"), ("ham", 0.15, "average"), ("hh_s1f", 0.1, "complete")):
        a = {r.sequence_id: r.clone for r in C.assign_clones(df, t, model, linkage).collect()}
        b = {r.sequence_id: r.clone for r in C.assign_clones(df, t, model, linkage, large=0).collect()}
        assert a == b and len(set(a.values())) > 5


@pytest.mark.parametrize(("model", "norm", "threshold", "length"), [("ham", "len", 0.2, 40), ("mk_rs1nf", "len", 0.1, 70), ("hh_s1f", None, 2.5, 33), ("ham", None, 12.0, 9), ("aa", "len", 0.34, 40)])
def test_close_pairs_equal_all_pairs(spark, model, norm, threshold, length):
    rng = random.Random(length)
    letters = "ACDEFGHIKLMNPQRSTVWY*" if model == "aa" else "ACGT"
    first = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(12)]
    seqs = {s for f in first for s in [f, *("".join(c if rng.random() > 0.12 else rng.choice(letters) for c in f) for _ in range(12))]}
    seqs |= {s[:-1] for s in list(seqs)[:20]}
    got = {(r.u, r.v): r.distance for r in C.close_pairs(spark.createDataFrame([("p", s) for s in seqs], "pre string, seq string"), model, threshold, norm).collect()}
    want = {}
    for n in (length, length - 1):
        own = sorted(s for s in seqs if len(s) == n)
        d = D.pairwise(own, D.model(model), norm)
        want |= {(own[i], own[j]): d[i, j] for i in range(len(own)) for j in range(i + 1, len(own)) if d[i, j] <= threshold}
    assert set(got) == set(want) and want
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_one_large_group_with_common_ends(spark):
    """Junctions of one group that share their first and last codons: no segment is one hot key, so candidates stay few."""
    rng = random.Random(9)
    seqs = {"TGTGCG" + "".join(rng.choice("ACGT") for _ in range(30)) + "TTCTGG" for _ in range(50_000)}
    twins = {s[:20] + ("A" if s[20] != "A" else "C") + s[21:] for s in sorted(seqs)[:100]}
    rows = [("p", s) for s in sorted(seqs | twins)]
    nodes = spark.createDataFrame(rows, "pre string, seq string").repartition(8)
    found = {(r.u, r.v) for r in C.close_pairs(nodes, "ham", 0.05, "len").collect()}
    assert {(min(p), max(p)) for p in ((s, s[:20] + ("A" if s[20] != "A" else "C") + s[21:]) for s in sorted(seqs)[:100])} <= found
    assert len(found) < 400


def test_a_matrix_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST", 3)
    df = repertoire(spark)
    with pytest.raises(Exception, match="one distance matrix"):
        C._by_matrix(df.select(F.lit("p").alias("pre"), F.col("sequence_id").alias("seq")), "ham", 0.1, "average", "len", "avg").collect()


def test_sized_and_subsample(spark):
    df = spark.createDataFrame([(str(i), "x" if i < 5 else "y" if i < 7 else "z", i % 2 == 0) for i in range(8)], "sequence_id string, clone string, ok boolean")
    assert {r.clone for r in C.sized(df, 2).collect()} == {"x", "y"} and {r.clone for r in C.sized(df, 2, only=["y", "z"]).collect()} == {"y"}
    assert C.subsample(df, 3, passed=df.ok).count() == 3
