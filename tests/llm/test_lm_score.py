from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import clonarium.llm.lm_score as lm
from tests.llm.fixtures import SCHEMA, corpus, lower, words


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def byte_model(texts):
    two = defaultdict(Counter)
    for t in texts:
        b = b"\xff\xff" + t.encode() + b"\xff"
        for i in range(2, len(b)):
            two[b[i - 2 : i]][b[i]] += 1
    one, zero = defaultdict(Counter), Counter()
    for c, x in two.items():
        one[c[1:]].update(x)
        zero.update(x)

    def p(context, byte):
        out, gone = 1.0, set()
        for seen in (two.get(context), one.get(context[1:]), zero):
            left = {k: v for k, v in (seen or {}).items() if k not in gone}
            if not left:
                continue
            if byte in left:
                return out * left[byte] / (sum(left.values()) + len(left))
            out *= len(left) / (sum(left.values()) + len(left))
            gone |= set(left)
        return out / (256 - len(gone))

    return p


def test_both_models_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    train, texts = Counter(), []
    for d, t, _ in rows:
        if not held(d):
            train.update([*words(lower(t or "")), None])
            texts.append(t or "")
    n, v, p = sum(train.values()), len(train), byte_model(texts)
    monkeypatch.setattr(lm, "FREQUENT", 20)  # most words are then joined
    got = lm.score_documents(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "word")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for d, t, _ in rows:
        by[d].append(t or "")
    for r in got:
        choices = []
        for t in by[r.doc_id]:
            w = [*words(lower(t)), None]
            base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
            choices.append((len(w), sum(train[x] > 0 for x in w), base, t))
        match = [c for c in choices if c[0] == r.n_tokens and c[1] == r.n_known and abs(c[2] - r.base_score) < 1e-6 * abs(c[2])]
        assert match and r.train_tokens == n and r.held_out == held(r.doc_id)
        if len(match[0][3]) < 2000:
            b = b"\xff\xff" + match[0][3].encode() + b"\xff"
            want = sum(math.log10(p(b[i - 2 : i], b[i])) for i in range(2, len(b)))
            assert abs(r.score - want) < 1e-4 * abs(want)


def test_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 103, 60) << 16 | rng.integers(97, 103, 60) << 8 | rng.integers(97, 103, 60))
    row_of, table = lm.escape_table(keys, rng.integers(1, 9, len(keys)).astype(float))
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert row_of.max() < len(table)


def test_held_out_text_of_the_same_kind_scores_better_than_noise(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 3, "a") for i in range(30)] + [(100, "the dog sat on the mat", "a"), (101, "zq xj vkw pfq jx qzv kx", "a")]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA), held_out="{id} >= 100").collect()}
    assert got[100].score / 23 > got[101].score / 24
    assert not got[0].held_out and got[101].held_out


def test_empty_and_untrained(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    r = lm.score_documents(spark.createDataFrame([(1, "ab", "x")], SCHEMA), held_out="true").first()
    assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-4


def deep_model(texts):
    tables = {k: defaultdict(Counter) for k in (4, 2, 1, 0)}
    for t in texts:
        b = b"\xff" * 4 + t.encode() + b"\xff"
        for i in range(4, len(b)):
            for k, x in tables.items():
                x[b[i - k : i]][b[i]] += 1

    def p(context, byte):
        out, gone = 1.0, set()
        for k, x in tables.items():
            left = {s: n for s, n in x.get(context[4 - k :], {}).items() if s not in gone}
            if not left:
                continue
            if byte in left:
                return out * left[byte] / (sum(left.values()) + len(left))
            out *= len(left) / (sum(left.values()) + len(left))
            gone |= set(left)
        return out / (256 - len(gone))

    return p


def test_contexts_of_four_bytes_equal_brute_force(spark, monkeypatch):
    rows = [(i, t, "x") for i, (_, t, _) in enumerate(corpus()) if len(t or "") < 2000][:80]
    p = deep_model([t or "" for d, t, _ in rows if not held(d)])
    docs = spark.createDataFrame(rows, SCHEMA)
    for size in (0, 300, 1 << 19):  # none, some and all contexts are broadcast
        monkeypatch.setattr(lm, "DEEP", size)
        got = {r.doc_id: r.score for r in lm.score_documents(docs, order=4).collect()}
        assert len(got) == len(rows)
        for d, t, _ in rows:
            b = b"\xff" * 4 + (t or "").encode() + b"\xff"
            want = sum(math.log10(p(b[i - 4 : i], b[i])) for i in range(4, len(b)))
            assert abs(got[d] - want) < 1e-4 * abs(want)
