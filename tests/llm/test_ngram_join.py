from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonarium.llm import ngram_join
from clonarium.llm.ngram_join import REST, SMALL, _packed, _signatures, _unpacked, bands, keep_one, similar_sets
from tests.llm.fixtures import SCHEMA, corpus, lower, words


def brute(rows, k, num, den):
    sets = []
    for doc, text, *_ in rows:
        w = words(lower(text or ""))
        sets.append((doc, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_equals_all_pairs(spark, k, num, den):
    rows = corpus(seed=k)
    got = similar_sets(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "n"), k, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, num, den)


def test_drifting_group_is_linked_along_chains(spark):
    base = [f"w{i}" for i in range(200)]
    rows, text = [], list(base)
    for i in range(40):
        text = list(text)
        text[(7 * i) % 200] = f"new{i}"
        rows.append((i, " ".join(text), "a"))
    got = {r.doc_id: r.component_id for r in similar_sets(spark.createDataFrame(rows, SCHEMA), 3, 9, 10).collect()}
    assert got == {d: c for d, _, c in brute(rows, 3, 9, 10)}


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_signatures_share_a_part_up_to_the_bound(num, den):
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9, 12, 40, 90, 150, 300):
        for _ in range(60):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            least = next(m for m in range(size + 1) if den * m >= num * size)
            b = a[: rng.integers(least, size + 1)]
            keys = defaultdict(set)
            h = [np.sort(a), np.sort(b)]
            row, key = _signatures(np.repeat([0, 1], [len(h[0]), len(h[1])]), np.concatenate(h), np.array([len(h[0]), len(h[1])]), num, den)
            for r, x in zip(row.tolist(), key.tolist(), strict=True):
                keys[r].add(x)
            assert not len(b) or keys[0] & keys[1]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_parts_exceed_the_largest_difference(num, den):
    first, parts = bands(num, den)
    for u in (1, 9, 10, 57, 200):
        worst = max(u + m - 2 * i for m in range(1, u + 1) for i in range(m + 1) if den * i >= num * (u + m - i))
        assert parts[np.searchsorted(first, u, "right") - 1] > worst


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_untouched_parts_of_large_sketches_are_hardly_ever_all_empty(num, den):
    """Similar sets agree in the parts that no differing shingle touches. In sketches of more than SMALL parts these count only if some
    shingle is in them; the chance that none is, for the smallest sets and their largest difference."""
    first, parts = bands(num, den)
    at = int(np.argmax(parts > SMALL))
    n, t = int(first[at]), int(parts[at])
    worst = max(2 * n - 2 * i for i in range(n + 1) if den * i >= num * (2 * n - i))
    touched = np.zeros(worst + 1)
    touched[0] = 1.0
    for _ in range(worst):
        k = np.arange(worst + 1)
        touched = touched * k / t + np.r_[0, (touched * (t - k) / t)[:-1]]
    common = n - worst // 2
    assert float((touched * (np.arange(worst + 1) / t) ** common).sum()) < 1e-15


def test_left_over_pairs_of_a_large_bucket_are_dealt_to_many_places(spark, monkeypatch):
    """One bucket of rows that drift: each links with its neighbours only. Every pair is compared once, in parts of few rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    n = 300
    rows = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.lit(n).cast("long").alias("c"), "id", F.col("id").alias("comp"))
    sketches = spark.range(n).select("id", F.lit(1).alias("n"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(ngram_join.FOLD)])
    got = ngram_join.left_over(rows, sketches, "abs(here.id - there.id) <= 3")
    pairs = [tuple(sorted(x)) for x in got.select("here.id", "there.id").collect()]
    assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 4))]
    # No place holds more than two parts.
    seen = got.groupBy("here.lo", "here.hi").agg(F.countDistinct("here.id").alias("rows")).agg(F.max("rows")).first()[0]
    assert seen <= 3 * 16


@pytest.mark.parametrize(("num", "den"), [(4, 5)])
def test_a_hot_bucket_that_pivots_do_not_resolve(spark, monkeypatch, num, den):
    """Texts that share a passage but are unlike otherwise meet in hot buckets; those that drift are linked all the same."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CROSS", 10**9)
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(60):
        own = [f"w{i}x{j}" for j in rng.integers(0, 10**6, 12)]
        rows.append((i, " ".join(passage + own), "a"))
        rows.append((1000 + i, " ".join([*passage, *own[:-1], "end"]), "a"))
    got = sorted((tuple(r) for r in similar_sets(spark.createDataFrame(rows, SCHEMA), 3, num, den).collect()), key=str)
    assert got == brute(rows, 3, num, den)


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for d, _, c in brute(rows, 5, 4, 5) if d is not None}
    assert kept.where("doc_id is null").count() == 2


def test_keep_one_tells_rows_by_their_texts_where_ids_repeat(spark):
    prose = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(1, prose(1), "a"), (5, prose(1), "b"), (5, prose(2), "c"), (5, prose(2), "c"), (5, prose(2), "d"), (7, prose(2) + " tail", "e"), (None, prose(3), "f"), (None, prose(3), "f"), (None, prose(1), "g"), (None, None, "h"), (9, prose(3), "i"), (2, prose(4), "j"), (2, prose(5), "k")]
    want = [(1, prose(1)), (5, prose(2)), (None, None), (9, prose(3)), (2, prose(4)), (2, prose(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = keep_one(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    again = keep_one(docs.repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_texts_and_signatures_are_shuffled_sparingly(spark):
    """Signatures move packed, and a text moves to its id and to where it is verified: bytes shuffled for a byte of text, half of the texts near copies."""
    rng = np.random.default_rng(8)
    prose = lambda n: [f"{x:05x}" for x in rng.integers(0, 1 << 20, n).tolist()]
    rows = []
    for i in range(300):
        own = prose(500)
        rows += [(2 * i, " ".join(own), "a"), (2 * i + 1, " ".join([*own[:-3], "end"]), "a")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def stages() -> dict[int, int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in similar_sets(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {d: d - d % 2 for d, _, _ in rows}
    moved = sum(x for s, x in stages().items() if s not in before)
    # Before, 11.8; now 9.0.
    assert moved < 10 * sum(len(t) for _, t, _ in rows)


@pytest.mark.parametrize("ids", [[5], [7, 300, 1], [0, 70_000], [-(2**63), 2**63 - 1, 0, -1]])
def test_packed_signatures_come_back(ids):
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 1 << REST + 3, 500, dtype=np.uint64))
    a = rng.choice(np.array(ids, np.int64), 500)
    batch = _packed(key, a)
    assert batch.num_rows == len(np.unique(key >> np.uint64(REST)))
    for part in (batch, batch.slice(2, 3)):
        got = _unpacked(part)
        own = np.isin((key >> np.uint64(REST)).astype(np.int64), part.column(1).to_numpy())
        assert (got[0] == key[own]).all() and (got[1] == a[own]).all()
