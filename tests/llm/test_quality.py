from __future__ import annotations

import re
from collections import Counter

import numpy as np

from clonarium.llm.quality import ABSTAIN, BAD, GOOD, RULES, THRESHOLD, assess, fit, keep_good
from tests.llm.fixtures import SCHEMA, corpus, words


def brute(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered, seen, repeated = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_statistics_equal_brute_force(spark):
    rows = corpus() + [(5000, "a b c d e a b c d e", "x"), (5001, "same line\nsame line\n\nsame line # $ | <b>", "x"), (5002, "p q r s t u p q r s t " * 9, "x"), (5003, "a b c d e", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "quality")
    got = assess(docs).collect()
    assert len(got) == len(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == sorted((str(d), *brute(t)) for d, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert 0 <= r.quality <= 1


def by_hand(r):
    """A row's votes: 1 good, 0 bad, 2 none; the rules written out once more."""
    long = r.n_words >= 50
    return [
        0 if r.word_chars < 2 * r.n_words or r.word_chars > 20 * r.n_words else 2,
        0 if 100 * r.n_symbols > 5 * r.word_chars else 1 if 100 * r.n_symbols <= r.word_chars else 2,
        0 if 100 * r.n_dup_lines > 30 * r.n_lines else 2,
        0 if long and 100 * r.n_letters < 80 * r.word_chars else 1 if 100 * r.n_letters >= 90 * r.word_chars else 2,
        0 if r.n_words >= 20 and 100 * r.n_upper > 50 * r.n_letters else 2,
        0 if long and r.n_distinct < 2.5 * r.n_words**0.6 else 1 if long and r.n_distinct >= 4 * r.n_words**0.6 else 2,
    ]


def test_posterior_and_verdict_equal_expectation_maximisation_by_document(spark):
    rows = corpus() + [(6000 + i, "###$$$%%% &&& |" * (5 + i), "a") for i in range(9)] + [(7000 + i, f"BUY {i} NOW!! " * 30, "a") for i in range(9)]
    got = assess(spark.createDataFrame(rows, SCHEMA)).collect()
    votes = np.array([by_hand(r) for r in got])
    n, k = votes.shape
    weight = 10_000 / n
    start = [np.array([0.2, 12.0, 8.0]), np.array([8.0, 4.0, 8.0])]
    model = [[start[c] / start[c].sum() for _ in range(k)] for c in (0, 1)]
    share, q = 0.9, None
    for _ in range(200):
        odds = np.full(n, np.log(share / (1 - share)))
        for i in range(k):
            # Only the last rule votes good on long texts alone, so that it abstains is no evidence.
            counts = np.ones(n, bool) if i != 5 else votes[:, i] != 2
            odds += np.where(counts, np.log(model[0][i][votes[:, i]]) - np.log(model[1][i][votes[:, i]]), 0.0)
        q = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        for c, p in ((0, q), (1, 1 - q)):
            for i in range(k):
                seen = start[c] + weight * np.bincount(votes[:, i], weights=p, minlength=3)
                model[c][i] = seen / seen.sum()
        share = (9 + weight * q.sum()) / (10 + 10_000)
    assert np.abs(np.array([r.quality for r in got]) - q).max() < 1e-3
    assert [r.kept for r in got] == [bool(not r.base_failed and r.quality >= 0.1) for r in got]
    assert {r.doc_id for r in got if r.quality < 0.1} >= set(range(6002, 6009))


def test_clean_prose_stays_and_junk_goes(spark):
    clean = [(i, " ".join(f"wort{(i * 37 + j * 11) % 997} satz" for j in range(60)).replace("7 ", "7. "), "a") for i in range(60)]
    clean = [(i, re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], t), s) for i, t, s in clean]
    junk = [(1000 + i, " ".join("###$$$%%%" for _ in range(80)) + str(i), "a") for i in range(8)] + [(2000 + i, "BUY NOW!! " * 60, "a") for i in range(4)]
    kept = {r.doc_id for r in keep_good(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert kept == {d for d, *_ in clean}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert assess(empty).collect() == [] and keep_good(empty).collect() == []


def test_fit_separates_two_kinds():
    good, bad = sum(GOOD * 3**i for i in range(len(RULES))), sum(BAD * 3**i for i in range(len(RULES)))
    posterior, model, share = fit({good: 900, bad: 100})
    assert posterior[good] > 0.99 and posterior[bad] < 0.01 and 0.85 < share < 0.95
    assert all(abs(sum(p) - 1) < 1e-9 for pair in model for p in pair)


def test_verdicts_do_not_depend_on_the_number_of_rows():
    def pattern(**votes):
        return sum(votes.get(name, ABSTAIN) * 3**i for i, (name, *_) in enumerate(RULES))

    long = pattern(symbols=GOOD, alphabetic=GOOD, distinct=GOOD)
    short = pattern(symbols=GOOD, alphabetic=GOOD)
    noisy = pattern(symbols=BAD, alphabetic=BAD, distinct=GOOD)
    for counts in ({long: 9000, short: 1000}, {long: 8600, short: 1000, noisy: 400}):
        for times in (1, 100, 10_000):
            posterior, *_ = fit({p: c * times for p, c in counts.items()})
            assert {p for p, q in posterior.items() if q >= THRESHOLD} == {long, short}, times
