from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from clonarium.llm import mixing
from clonarium.llm.mixing import PLACE, cuts, mix, mixed_rows, split_quotas, taken, write_shards
from tests.llm.fixtures import SCHEMA, corpus, words


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        level = (total - sum(capped.values())) / max(1e-12, sum(weight[s] for s in sizes if s not in capped))
        new = {s: 3 * sizes[s] for s in sizes if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: capped.get(s, level * weight[s]) for s in sizes}
        capped |= new


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(900)] + corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = taken(docs).collect()
    assert len(got) == len(rows)
    again = taken(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, size_of = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
        size_of[s] = max(size_of[s], len(words(t)))
    want = brute_targets(sizes)
    by = defaultdict(int)
    for r in mix(docs).collect():
        assert len(r.shards) <= 3 and all(0 <= x < 16 for x in r.shards)
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        by[r.source] += len(r.shards) * r["size"]
    for s, n in by.items():
        # half of the document at the cut; one that stands three times in the table is taken three times or not at all
        assert abs(n - want[s]) <= 3 * size_of[s] / 2 + 1
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == sum(by.values())


def test_taken_is_counted_over_written_shards(spark, tmp_path):
    rows = [(i, f"{i} " + "w " * (i % 300), f"s{i % 4}") for i in range(2000)] + corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    path = f"file://{tmp_path}/mix"
    write_shards(docs, path, shards=5)
    found = spark.read.parquet(path).select("shard", "order", "doc.*", "size").collect()
    counted = Counter()
    for r in found:
        assert r["size"] == len(words(r.text))
        counted[r.doc_id] += len(words(r.text))
    got = Counter()
    for r in taken(docs, shards=5).collect():
        got[r.doc_id] += r.taken
    assert +got == +counted
    # Shards are even in blocks, so none is empty, and passes of a document lie apart.
    assert {r.shard for r in found} == set(range(5))


@pytest.mark.parametrize("rows_left", [100_000, 3, -1])
def test_cut_is_where_the_plain_order_has_it(spark, monkeypatch, rows_left):
    """The radix search, to its end or until few rows are left, against a sort of all places."""
    monkeypatch.setattr(mixing, "FEW", rows_left)
    rows = spark.createDataFrame([(s, (i * 7919) % 97, (i * 2654435761 * (1 + s)) % (1 << PLACE)) for s in range(3) for i in range(500)], "source int, size long, place long").withColumn("source", F.col("source").cast("string"))
    aim = spark.createDataFrame([("0", 1000.5), ("1", 0.0), ("2", 20000.0)], "source string, missing double")
    got = {r.source: r.cut for r in cuts(rows, aim, True).collect()}
    assert set(got) == {"0", "2"}
    for source, missing in (("0", 1000.5), ("2", 20000.0)):
        before = 0
        for place, size in sorted((r.place, r["size"]) for r in rows.where(F.col("source") == source).collect()):
            assert (place <= got[source]) == (before + size / 2 <= missing)
            before += size


def test_tree_keeps_quotas_and_even_shards():
    for shards in (1, 2, 5, 16):
        quotas = np.array([1000, 3, 0, 77])
        tree = split_quotas(quotas, shards, 1)
        assert tree.sum(axis=0).tolist() == quotas.tolist() and (tree >= 0).all()
        assert np.ptp(tree.sum(axis=1)) <= shards
        assert (tree == split_quotas(quotas, shards, 1)).all()


def test_rows_repeat_as_taken(spark):
    rows = [(i, "w " * 40, "small" if i < 5 else "large") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r.doc_id: len(r.shards) for r in mix(docs).collect()}
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    have = Counter(r.doc_id for r in got.collect())
    assert have == Counter({d: c for d, c in copies.items() if c})


def test_columns_that_clash_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i % 50, "w " * (i % 40), "a" if i % 5 else None, 7, 1, "p", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _copies long, shard long, place string, doc string")
    copies = Counter()
    for r in mix(docs).collect():
        copies[r.doc_id] += len(r.shards)
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +copies and copies[None] > 0
    assert len(taken(docs).collect()) == len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert taken(empty).collect() == [] and mixed_rows(empty).collect() == []
