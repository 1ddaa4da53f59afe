from __future__ import annotations

import math

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from clonarium.llm import token_counts
from clonarium.llm.token_counts import Vocabulary, count_tokens, trie_counts
from tests.llm.fixtures import SCHEMA, corpus, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
_model = sentencepiece.SentencePieceProcessor(model_file=PATH)
_pieces = [_model.id_to_piece(i) for i in range(3, _model.get_piece_size()) if not _model.is_byte(i)]
UNIT = 2**30
SCORES = {p: -round(math.log(r + 2.7) * UNIT) for r, p in enumerate(_pieces)}
BYTE = -round(math.log(len(_pieces) + 2.7) * UNIT)
LONGEST = max(map(len, _pieces))


def best_count(word):
    """Fewest tokens among the segmentations with the best score, by a forward search over all pieces."""
    best = {0: (0, 0)}
    for at in range(len(word)):
        score, number = best[at]
        size = len(word[at].encode())
        steps = [(at + 1, score + size * BYTE, number - size)]
        steps += [(end, score + SCORES[word[at:end]], number - 1) for end in range(at + 1, min(len(word), at + LONGEST) + 1) if word[at:end] in SCORES]
        for end, s, n in steps:
            best[end] = max(best.get(end, (-math.inf, 0)), (s, n))
    return -best[len(word)][1]


def test_equals_the_plain_recursion(spark):
    rows = [r for r in corpus() if r[0] != 3006]
    memo = {}

    def tokens(w):
        if w not in memo:
            memo[w] = best_count("▁" + w)
        return memo[w]

    got = count_tokens(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "id"), PATH).collect()
    want = sorted((str(d), len(words(t)), sum(tokens(w) for w in words(t)), len((t or "").encode())) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_bytes) for r in got) == want


def test_trie_shares_prefixes_and_reaches_long_words():
    vocabulary = Vocabulary(PATH)
    some = ["▁inter", "▁international", "▁internationally", "▁日本語", "▁🙂🙂", "▁" + "ab" * 40, "▁", "▁zzzzqqqq"]
    assert trie_counts(some, vocabulary).tolist() == [best_count(w) for w in some]


def test_counts_do_not_depend_on_the_length_at_which_words_leave_the_trie(monkeypatch):
    vocabulary = Vocabulary(PATH)
    some = ["▁" + x * n for x in ("ab", "the", "xyzzy", "日本", "é", "internation") for n in range(1, 12)]
    whole = trie_counts(some, vocabulary).tolist()
    monkeypatch.setattr(token_counts, "LONG", 5)
    assert trie_counts(some, vocabulary).tolist() == whole == [best_count(w) for w in some]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string").withColumn("text", F.expr("cast(concat(cast(text as binary), X'FF20C3') as string)"))
    (r,) = count_tokens(docs, PATH).collect()
    assert (r.n_words, r.n_bytes) == (3, 7)
    assert r.n_tokens == sum(best_count("▁" + w) for w in ("ab", "c\ufffd", "\ufffd"))


def test_best_segmentation_has_the_best_score():
    vocabulary = Vocabulary(PATH)

    def all_scores(word):
        if not word:
            yield 0.0, 0
        for i in range(1, len(word) + 1):
            if (s := vocabulary.scores.get(word[:i])) is not None:
                for score, n in all_scores(word[i:]):
                    yield s + score, n + 1

    for word in ("▁token", "▁trees", "▁unlock"):
        best = max(all_scores(word), key=lambda x: (x[0], -x[1]))
        assert best_count(word) == best[1]


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []
