from __future__ import annotations

import numpy as np
import pytest

from clonarium.llm.topk import build_block, search_block, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out, asked = [], set()
    for i, q in good:
        if i % 100 == 0 and i not in asked:
            asked.add(i)
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), "x") for i in range(700)]
    same = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(1000 + i, same, "x") for i in range(60)]
    rows += [(2000, None, "x"), (2001, [1.0, None] + [0.0] * 10, "x"), (2100, [float("nan")] * 12, "x"), (2101, [float("inf")] * 12, "x"), (2102, [], "x"), (2200, [], "x"), (None, same, "x"), (2103, [0.5] * 7, "x"), rows[5], rows[5]]
    got = top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 100 = 0")
    assert [c for c, _ in got.dtypes] == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_fewer_rows_than_k(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [0.5, 0.5], "x")]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 100 = 0").collect()] == [(0, 1, 1, 1024 * 512 + 2048 * 512)]
    assert top_k(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0").collect() == []


def test_condition_repeated_ids_and_large_values(spark):
    rows = [(1, [1.0, 2.0], "ask vec_id"), (1, [0.5, 9.0], "ask vec_id"), (2, [3.0, 1.0], "no"), (3, [0.0, 5.0], "no")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "id2")
    got = [tuple(r) for r in top_k(df, "score = 'ask vec_id' and id2 > 0", k=2, scale=1.0, id_col="id2").collect()]
    assert got == [(1, 1, 3, 45), (1, 2, 2, 9)]  # the least of its vectors asks
    large = spark.createDataFrame([(0, [3e9], "x"), (1, [3e9], "x")], "vec_id long, embedding array<double>, score string")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(large, "vec_id % 100 = 0")
    assert [tuple(r) for r in top_k(large, "vec_id % 100 = 0", scale=1 / 64).collect()] == [(0, 1, 1, 46_875_000**2)]


def test_block_search_over_value_ranges():
    rng = np.random.default_rng(9)
    for high in (1, 3, 60, 5000, 10**6):
        rows = rng.integers(-high, high + 1, (130, 6))
        queries = rng.integers(-high, high + 1, (9, 6))
        at, ids, score = search_block(build_block(np.arange(130), rows), queries, np.full(9, -1), 5)
        for i, q in enumerate(queries):
            want = sorted(zip((-(rows @ q)).tolist(), range(130), strict=True))[:5]
            assert [(-int(s), int(j)) for s, j in zip(score[at == i], ids[at == i], strict=True)] == want
