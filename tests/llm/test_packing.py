from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from clonarium.llm import packing
from clonarium.llm.packing import CAPACITIES, cost, pack, plan, word_ids
from tests.llm.fixtures import SCHEMA, corpus, words


def check(bins, capacities):
    """Bins hold their pieces side by side and have the least capacity that holds them; (id, piece, start) -> tokens."""
    found = Counter()
    for b in bins:
        assert sum(b.lengths) == b.used == len(b.tokens) and b.capacity == min(c for c in capacities if c >= b.used)
        at = 0
        for d, start, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            found[d, start, tuple(b.tokens[at : at + n])] += 1
            at += n
    return found


def cut(rows, size):
    """{(id, start, tokens)} of documents of tokens, cut into pieces."""
    return Counter((d, i, tuple(t[i : i + size])) for d, t in rows for i in range(0, len(t), size))


def test_bins_hold_the_tokens_of_all_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "length")
    got = pack(docs).collect()
    ids = [(r.doc_id, r.t) for r in docs.select("doc_id", word_ids().alias("t")).collect()]
    assert sorted(len(t) for _, t in ids) == sorted(len(words(t)) + 1 for _, t, _ in rows)
    assert check(got, CAPACITIES) == cut(ids, max(CAPACITIES))
    assert len({b.bin for b in got}) == len(got)
    again = pack(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_own_tokens_many_ties_and_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    monkeypatch.setattr(packing, "RUNS", 3)
    rng = random.Random(6)
    rows = [(i, [i] * rng.choice([1, 2, 3, 5, 5, 5, 8, 20, 33])) for i in range(400)] + [(1000, None), (1001, []), (None, [4, 4])]
    got = pack(spark.createDataFrame(rows, "doc_id long, ids array<int>"), (8, 16), F.col("ids"), text_col="ids").collect()
    assert check(got, (8, 16)) == cut([(d, t or []) for d, t in rows], 16)
    histogram = Counter(len(t[i : i + 16]) for _, t in rows if t for i in range(0, len(t), 16))
    assert Counter(b.capacity for b in got) == Counter({c: n for c, n in brute(histogram, (8, 16))[0].items()})


def brute(histogram, capacities):
    """Best-fit decreasing, one item at a time over a list of open bins: (bins by capacity, bins by capacity and what is left)."""
    left = Counter(histogram)
    bins = []  # [room, held]
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [b for b in bins if b[0] >= n]
            if fits:
                b = min(fits)
            else:

                def ahead(room):
                    """What a bin with so much room would still take, the longest that fits first."""
                    taken, mine = 0, Counter(left)
                    for m in sorted(mine, reverse=True):
                        if mine[m] - (m == n) > 0 and m <= room:
                            k = min(room // m, mine[m])
                            taken, room = taken + k * m, room - k * m
                    return taken

                c = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / (n + ahead(c - n)), -c))
                b = [c, 0]
                bins.append(b)
            b[0] -= n
            b[1] += n
            left[n] -= 1
    least = lambda held: min(c for c in capacities if c >= held)
    return Counter(least(b[1]) for b in bins), Counter((least(b[1]), b[1]) for b in bins)


def test_plan_equals_best_fit_by_item():
    rng = random.Random(2)
    for _ in range(300):
        histogram = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 9), 33, 16]) for _ in range(rng.randint(1, 120)))
        made, used = plan(dict(histogram), (16, 32, 64)), Counter()
        got = Counter()
        for capacity, n, contents in made:
            held = sum(length * each for length, each in contents)
            got[capacity, held] += n
            for length, each in contents:
                used[length] += n * each
        assert used == histogram
        assert got == brute(histogram, (16, 32, 64))[1]


def test_plan_by_groups_grows_with_lengths_only():
    assert len(plan({n: 10**9 for n in range(1, 65)}, (64,))) < 1000


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
