"""Unigram token counts by dynamic programming over a trie of distinct words.

The best segmentation of a word extends best segmentations of its prefixes, and words share prefixes. Distinct words of a batch
are put into a trie level by level; the forward score of a prefix is made once, at its node, and each word reads the number of tokens
at its terminal node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonarium.llm import _kernels as K
from clonarium.plans.store import ship

U = np.uint64
#: Words up to so many code points go through the shared trie. Longer ones share no prefix worth a node and go through the same
#: recursion one by one; scores are whole numbers, so both give the same counts, ties included.
LONG = 48
#: Units of a score of 1.
UNIT = 1 << 30
_NONE = -(1 << 62)
#: Distinct words that a worker collects before it runs a trie.
TRIE = 200_000
#: Counts that a worker keeps by word hash.
KEPT = 1_500_000
#: Code points that the polynomial of a piece is made of.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = np.array([pow(_BASE, i, 2**64) for i in range(LONG + 64)], U)


class Vocabulary:
    """Pieces with unigram scores: the logarithm of a Zipf weight by rank, 1 / (rank + 2.7), as public vocabularies come in order of
    merging and the file has no counts. Scores are rounded to multiples of 1 / ``UNIT`` and added up as whole numbers, so sums are exact in
    any order. Characters without a piece cost one token for each UTF-8 byte, at the score of the last rank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {p: -round(math.log(r + 2.7) * UNIT) for r, p in enumerate(pieces)}
        self.byte = -round(math.log(len(pieces) + 2.7) * UNIT)
        self.longest = max(map(len, self.scores))
        codes = np.array([self.hash(p) for p in self.scores], U)
        order = np.argsort(codes)
        self.codes, self.values = codes[order], np.array(list(self.scores.values()), np.int64)[order]
        # A bit for each of the lower bits of a piece's mixed hash: most substrings are no pieces.
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(K.mix(self.codes) >> U(42)).astype(np.int64)] = True

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Scores of pieces by hash; ``_NONE`` where there is none."""
        out = np.full(len(codes), _NONE)
        may = np.flatnonzero(self.bloom[(K.mix(codes) >> U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.codes, codes[may]), len(self.codes) - 1)
        hit = self.codes[at] == codes[may]
        out[may[hit]] = self.values[at[hit]]
        return out


def _line_count(word: str, vocabulary: Vocabulary) -> int:
    """Tokens of the best segmentation of one word. Ties go to fewer tokens."""
    scores, longest, byte = vocabulary.scores, vocabulary.longest, vocabulary.byte
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode("utf-8", "replace"))
        option = (best[end - 1][0] + size * byte, best[end - 1][1] - size)
        for start in range(max(0, end - longest), end):
            if (score := scores.get(word[start:end])) is not None:
                option = max(option, (best[start][0] + score, best[start][1] - 1))
        best.append(option)
    return -best[-1][1]


def trie_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of the best segmentation of each of the distinct words, over one trie."""
    out = np.zeros(len(words), np.int64)
    size = np.array([len(w) for w in words])
    short = np.flatnonzero((size > 0) & (size <= LONG))
    for i in np.flatnonzero(size > LONG):
        out[i] = _line_count(words[i], vocabulary)
    if not len(short):
        return out
    table = np.array([words[i] for i in short], f"U{LONG}").view(np.uint32).reshape(len(short), LONG)
    size = size[short]
    deep = int(size.max())
    # Level by level: node of each word's prefix, and each node's parent, prefix hash, forward score and tokens (negative).
    node = np.zeros(len(short), np.int64)
    parents, hashes = [np.zeros(1, np.int64)], [np.zeros(1, U)]
    scores, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    alive = np.arange(len(short))
    for depth in range(1, deep + 1):
        alive = alive[size[alive] >= depth]
        letter = table[alive, depth - 1].astype(np.int64)
        edge, first, back = np.unique(node[alive] << 21 | letter, return_index=True, return_inverse=True)
        parent = edge >> 21
        char = edge & 0x1FFFFF
        node[alive] = back
        own = hashes[-1][parent] * U(_BASE) + (char.astype(U) + U(1))
        width = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        best = scores[-1][parent] + width * vocabulary.byte
        count = tokens[-1][parent] - width
        ancestor = np.arange(len(edge))
        parents.append(parent)
        for back_ in range(1, min(depth, vocabulary.longest) + 1):
            ancestor = parents[depth - back_ + 1][ancestor]
            found = vocabulary.find(own - hashes[depth - back_][ancestor] * _POWER[back_])
            at = np.flatnonzero(found > _NONE)
            if not len(at):
                continue
            score, number = scores[depth - back_][ancestor[at]] + found[at], tokens[depth - back_][ancestor[at]] - 1
            better = (score > best[at]) | ((score == best[at]) & (number > count[at]))
            best[at[better]], count[at[better]] = score[better], number[better]
        hashes.append(own)
        scores.append(best)
        tokens.append(count)
        done = alive[size[alive] == depth]
        out[short[done]] = -count[node[done]]
    return out


_vocabularies: dict[str, Vocabulary] = {}
_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _vocabularies:
            _vocabularies[path] = Vocabulary(path)
        vocabulary = _vocabularies[path]
        for batch in batches:
            data, at = K.text_buffers(batch.column(1))
            for lo, hi, part, off in K.chunks(data, at):
                starts, ends, row = K.cut_words(part, off)
                code = K.hash_spans(part, starts, ends)
                codes, first, back = np.unique(code, return_index=True, return_inverse=True)
                counts = np.zeros(len(codes), np.int64)
                keys, values = _known.get(path, (np.zeros(0, U), np.zeros(0, np.int64)))
                there = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
                hit = keys[there] == codes if len(keys) else np.zeros(len(codes), bool)
                counts[hit] = values[there[hit]] if len(keys) else 0
                new = np.flatnonzero(~hit)
                raw = part.tobytes()
                for a in range(0, len(new), TRIE):
                    some = new[a : a + TRIE]
                    words = ["▁" + raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[some]]
                    counts[some] = trie_counts(words, vocabulary)
                if len(keys) + len(new) > KEPT:
                    keys, values = keys[:0], values[:0]
                keys, values = np.concatenate([keys, codes[new]]), np.concatenate([values, counts[new]])
                order = np.argsort(keys, kind="stable")
                _known[path] = keys[order], values[order]
                words = np.bincount(row, minlength=hi - lo)
                tokens = np.bincount(row, weights=counts[back], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(tokens), pa.array(np.diff(off))], names=["id", "n_words", "n_tokens", "n_bytes"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_tokens (sum over its words of the tokens of the best unigram segmentation), n_bytes.

    Words are runs without ASCII white space, each with the mark of a word's start before it. No shuffle: each task shares one trie among
    the new distinct words of a stretch of text and keeps their counts for the next.

    * Null or empty text: zeros. Null ids and repeated rows are counted like others. An empty table gives an empty result.
    * Ties between segmentations go to fewer tokens. Words of any length are counted; bytes that are not UTF-8 are read as replacement characters.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary_path), "id long, n_words long, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)
