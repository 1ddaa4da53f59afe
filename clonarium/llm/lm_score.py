"""Document scores: prediction by partial matching over bytes, and an add-one word model beside it.

The byte model is a trie of contexts of up to two bytes with the counts of the bytes that follow. Where a context has not seen the
next byte, the model escapes to the shorter one (method C: as many escapes as distinct bytes), and bytes that the longer context
has seen are excluded there. It is pretrained on all training documents; its size is bounded by the alphabet (256 ** 3 counts), so it can be
broadcast whatever the corpus. With ``order=4``, contexts of four bytes come before it, as a distributed table that grows with the
corpus; they escape to those of two bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonarium.llm import _kernels as K
from clonarium.plans.store import ship, stash

U = np.uint64
#: Stands for the end of a text and for what precedes its start; no UTF-8 text has it.
EDGE = 0xFF
SYMBOLS = 256
#: Words, the most frequent ones, whose counts are broadcast; all others are joined.
FREQUENT = 1 << 18
#: Counts in contexts of four bytes, of the most frequent contexts, that are broadcast; all other contexts are joined.
DEEP = 1 << 19
#: Distinct words that a task holds before it hands their counts on.
HELD = 1_500_000


def sequence(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each closed by ``EDGE``; the two bytes before each as one number; where texts start."""
    starts = at[:-1] + np.arange(len(at) - 1)
    out = np.full(len(data) + len(at) - 1, EDGE, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[1:] + np.arange(len(at) - 1)] = False
    out[inner] = data
    one = np.empty(len(out), np.int32)
    one[:1] = EDGE
    one[1:] = out[:-1]
    two = np.empty(len(out), np.int32)
    two[:1] = EDGE
    two[1:] = one[:-1]
    two[starts] = EDGE
    return out, two << 8 | one, starts


def deep_keys(out: np.ndarray, context: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The four bytes before each byte, and the byte, as one number; its last three bytes are the key of the shorter context."""
    before = np.full(len(out), EDGE << 8 | EDGE, np.int64)
    before[2:] = context[:-2]
    before[starts] = before[np.minimum(starts + 1, len(out) - 1)] = EDGE << 8 | EDGE
    return before << 24 | context.astype(np.int64) << 8 | out


def escape_table(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context of two bytes, byte) -> (row of each context, log10 probabilities by row and byte).

    Rows: the contexts of two bytes that were seen, then those of one byte, then none. Order 0 escapes to equal
    shares of the bytes not seen at all.
    """
    two, sym = keys >> 8, keys & 0xFF
    n0 = np.bincount(sym, weights=counts, minlength=SYMBOLS)
    n1 = np.bincount((two & 0xFF) << 8 | sym, weights=counts, minlength=SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
    seen0, seen1 = n0 > 0, n1 > 0

    def shares(n: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of seen bytes and of the escape, by row, with the bytes in ``out`` excluded."""
        n = np.where(out, 0, n)
        distinct = (n > 0).sum(axis=1, keepdims=True)
        whole = n.sum(axis=1, keepdims=True) + distinct
        none = whole == 0
        return n / np.where(none, 1, whole), np.where(none, 1.0, distinct / np.where(none, 1, whole))

    def order0(out: np.ndarray) -> np.ndarray:
        """Probabilities by byte for each row of excluded bytes."""
        p, escape = shares(n0[None, :], out)
        fresh = ~seen0[None, :] & ~out
        free = fresh.sum(axis=1, keepdims=True)
        escape = np.where(free == 0, 0.0, escape)
        p = p / np.where(free == 0, np.maximum(p.sum(axis=1, keepdims=True), 1e-300), 1.0)
        return p + fresh * escape / np.maximum(free, 1)

    def order1(rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        p, escape = shares(n1[rows], out)
        known = seen1[rows] | out
        return np.where(n1[rows] * ~out > 0, p, escape * order0(known))

    contexts = np.unique(two)
    row_of = np.full(SYMBOLS**2, -1, np.int32)
    row_of[contexts] = np.arange(len(contexts))
    any1 = seen1.any(axis=1)
    low = np.where(any1, len(contexts) + np.arange(SYMBOLS), len(contexts) + SYMBOLS)
    row_of = np.where(row_of >= 0, row_of, low[np.arange(SYMBOLS**2) & 0xFF]).astype(np.int32)
    table = np.zeros((len(contexts) + SYMBOLS + 1, SYMBOLS), np.float32)
    nothing = np.zeros((1, SYMBOLS), bool)
    order = np.argsort(keys, kind="stable")
    two, sym, counts = two[order], sym[order], counts[order]
    for lo in range(0, len(contexts), 512):  # a few rows at a time: little memory
        some = contexts[lo : lo + 512]
        a, b = np.searchsorted(two, some[0]), np.searchsorted(two, some[-1], "right")
        n2 = np.zeros((len(some), SYMBOLS))
        n2[np.searchsorted(some, two[a:b]), sym[a:b]] = counts[a:b]
        p, escape = shares(n2, np.zeros_like(n2, bool))
        table[lo : lo + len(some)] = np.log10(np.maximum(np.where(n2 > 0, p, escape * order1(some & 0xFF, n2 > 0)), 1e-300))
    table[len(contexts) : -1] = np.log10(np.maximum(order1(np.arange(SYMBOLS), np.zeros((SYMBOLS, SYMBOLS), bool)), 1e-300))
    table[-1:] = np.log10(np.maximum(order0(nothing), 1e-300))
    return row_of, table


class _Held:
    """Counts of codes, merged when there are many."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, code: np.ndarray, count: np.ndarray) -> None:
        self.codes.append(code)
        self.times.append(count)
        self.size += len(code)

    def merge(self) -> None:
        k, c = np.concatenate(self.codes), np.concatenate(self.times)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        lead = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        self.codes, self.times, self.size = [k[lead]], [np.add.reduceat(c, lead)], len(lead)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.codes[0], self.times[0]
        self.__init__()
        return out


def _learn(deep: bool):
    """Rows (kind, key, count): kind 0 for words by hash, 1 for bytes in their context, 2 for texts, 3 for bytes in contexts of four."""

    def emit(kind: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), 100_000):
            k = np.ascontiguousarray(key[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(count[lo : lo + 100_000].astype(np.int64))], names=["kind", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = np.zeros(SYMBOLS**3, np.int32)
        held = {0: _Held(), 3: _Held()}
        texts = seen = 0
        for batch in batches:
            data, at = K.text_buffers(batch.column(0))
            texts += batch.num_rows
            for _, _, part, off in K.chunks(data, at):
                out, context, first = sequence(part, off)
                np.add.at(follow, context << 8 | out, 1)
                seen += len(out)
                starts, ends, _ = K.cut_words(part, off)
                held[0].add(*np.unique(K.hash_spans(K.LOWER[part], starts, ends), return_counts=True))
                if deep:
                    held[3].add(*np.unique(deep_keys(out, context, first), return_counts=True))
                for kind, h in held.items():
                    if h.size > 2 * HELD:
                        h.merge()
                        if h.size > HELD:
                            yield from emit(kind, *h.take())
                if seen > 1 << 30:  # below the range of the counters
                    key = np.flatnonzero(follow)
                    yield from emit(1, key, follow[key])
                    follow[:] = 0
                    seen = 0
        for kind, h in held.items():
            if h.size:
                yield from emit(kind, *h.take())
        key = np.flatnonzero(follow)
        yield from emit(1, key, follow[key])
        if texts:
            yield from emit(2, np.zeros(1, np.int64), np.array([texts]))

    return run


def deep_contexts(counts: DataFrame) -> DataFrame:
    """(ctx, n, d, a, b, bytes) of each context of four bytes: its count, its distinct bytes with their log10 probabilities, and what other
    bytes add to their log10 probability in the context of two bytes: ``a`` if that has seen them, else ``b``.

    Bytes that the longer context has seen are excluded in the shorter one, so its count and escapes are less by theirs.
    """
    two = counts.where("kind = 1").select(F.col("key").alias("tri"), F.col("c").alias("n2"))
    whole = two.groupBy(F.shiftright("tri", 8).alias("low")).agg(F.sum("n2").alias("wn"), F.count("*").alias("wd"))
    rows = counts.where("kind = 3").select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("tri"), "c").join(two, "tri")
    d = rows.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("n2").alias("gone"), F.collect_list(F.struct(F.col("tri").bitwiseAND(F.lit(0xFF)).alias("s"), "c")).alias("bytes"))
    d = d.withColumn("low", F.col("ctx").bitwiseAND(F.lit(0xFFFF))).join(whole, "low")
    a = "log10(d / (n + d)) + log10(wn + wd) - log10(wn - gone + wd - d)"
    b = "log10(d / (n + d)) + log10((wn + wd) / wd) + case when wd > d then log10((wd - d) / (wn - gone + wd - d)) else 0D end"
    return d.select("ctx", "n", "d", F.expr(f"case when wd > d then {a} else 0D end").alias("a"), F.expr(b).alias("b"), F.expr("transform(bytes, x -> struct(x.s as s, log10(x.c / (n + d)) as p))").alias("bytes"))


_ROWS = "kind tinyint, row long, id long, held_out boolean, n_tokens long, n_known long, logs double, score double, word long, times long"
_ARROW = pa.schema([("kind", pa.int8()), ("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("word", pa.int64()), ("times", pa.int64())])


def _score(model):
    """Rows of three kinds: one for each document, with what frequent words and the byte model give; one for each of its other words; and, with
    deeper contexts, one for each byte in a context that isn't broadcast (``held_out``: whether the context of two bytes has seen it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, table, keys, counts, ends_seen, deep = model.value
        flat, logs = table.ravel(), np.log10(counts + 1.0)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = K.text_buffers(batch.column(2))
            for lo, hi, part, off in K.chunks(data, at):
                n = hi - lo
                out, context, first = sequence(part, off)
                cell = row_of[context].astype(np.int64) * SYMBOLS + out
                value = flat[cell].astype(np.float64)
                if deep:
                    seen, deep_key, deep_log, deep_ctx, deep_a, deep_b = deep
                    key = deep_keys(out, context, first)
                    place = np.minimum(np.searchsorted(deep_key, key), len(deep_key) - 1)
                    hit = deep_key[place] == key
                    value[hit] = deep_log[place[hit]]
                    miss = np.flatnonzero(~hit)
                    place = np.minimum(np.searchsorted(deep_ctx, key[miss] >> 8), len(deep_ctx) - 1)
                    hit = deep_ctx[place] == key[miss] >> 8
                    value[miss[hit]] += np.where(seen[cell[miss[hit]]], deep_a[place[hit]], deep_b[place[hit]])
                    left = miss[~hit]
                    left_row, left_key, left_seen, left_value = np.searchsorted(first, left, "right") - 1, key[left], seen[cell[left]], value[left]
                    value[left] = 0
                score = np.add.reduceat(value, first)
                starts, ends, row = K.cut_words(part, off)
                code = K.hash_spans(K.LOWER[part], starts, ends)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                    known_word = keys[place] == code
                else:
                    place, known_word = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
                sums = np.bincount(row[known_word], weights=logs[place[known_word]], minlength=n) + np.log10(ends_seen + 1.0)
                known = np.bincount(row[known_word], minlength=n) + (ends_seen > 0)
                tokens = np.bincount(row, minlength=n) + 1
                rows = number + np.arange(n)
                number += n
                none = lambda k, size: pa.nulls(size, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(rows), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(score), none(pa.int64(), n), none(pa.int64(), n)], schema=_ARROW)
                if deep:
                    order = np.lexsort((left_key, left_row))
                    r, k = left_row[order], left_key[order]
                    lead = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]) if len(k) else np.zeros(0, np.int64)
                    times = np.diff(np.r_[lead, len(k)])
                    for a in range(0, len(lead), 100_000):
                        some = lead[a : a + 100_000]
                        m = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int8)), pa.array(rows[r[some]]), none(pa.int64(), m), pa.array(left_seen[order[some]]), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), pa.array(left_value[order[some]]), pa.array(k[some]), pa.array(times[a : a + 100_000])], schema=_ARROW)
                rest_row, rest = row[~known_word], code[~known_word]
                order = np.lexsort((rest, rest_row))
                rest_row, rest = rest_row[order], rest[order]
                lead = np.flatnonzero(np.r_[True, (rest_row[1:] != rest_row[:-1]) | (rest[1:] != rest[:-1])]) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.r_[lead, len(rest)])
                for a in range(0, len(lead), 100_000):
                    some = lead[a : a + 100_000]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.array(rows[rest_row[some]]), none(pa.int64(), m), none(pa.bool_(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.float64(), m), pa.array(rest[some].view(np.int64)), pa.array(times[a : a + 100_000])], schema=_ARROW)

    return run


def score_documents(docs: DataFrame, held_out: str = "crc32(coalesce(cast({id} as string), '')) % 7 = 2", id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from every document for which the SQL condition ``held_out`` is false, and score every document whole.

    * base_score: sum over the tokens (lower-cased words and one end) of log10((c + 1) / (N + V + 1)), with c the token's count, N
      all and V the distinct ones in the training documents. n_known: tokens with c > 0.
    * score: log10 probability of the text's bytes and its end under the byte model (prediction by partial matching), by contexts
      of two, one and no bytes, and with ``order`` 4 of four bytes before these.
    * Null or empty text: just the end. Null ids are training documents. Repeated rows count as often as they stand, and each is scored.
    * An empty table gives an empty result. With no training document N = V = 0, and bytes are equally likely.

    Word counts stay distributed. The ``FREQUENT`` most frequent words' counts are broadcast (a bound in number), every other word of a
    document is joined to its count; so no word that many documents hold is shuffled. Words are told apart by 64-bit hashes.
    """
    if order not in (2, 4):
        raise ValueError("order must be 2 or 4")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", F.expr(held_out.format(id="id")))
    learned = rows.where("not held_out").select("text").mapInArrow(_learn(order == 4), "kind tinyint, key long, c long")
    counts = stash(learned.groupBy("kind", "key").agg(F.sum("c").alias("c")), "counts")
    words = counts.where("kind = 0").select("key", "c")
    sums = {r["kind"]: (r["n"], r["s"]) for r in counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    texts = sums.get(2, (0, 0))[1]
    n = sums.get(0, (0, 0))[1] + texts
    v = sums.get(0, (0, 0))[0] + (texts > 0)

    # The least count that keeps the frequent words within their number, from a histogram of counts by their logarithm.
    steps = sorted(((r["b"], r["n"]) for r in words.groupBy(F.floor(F.log(F.col("c").cast("double")) * 16).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    number, least = 0, None
    for b, k in steps:
        if number + k > FREQUENT:
            break
        number, least = number + k, b
    often = F.floor(F.log(F.col("c").cast("double")) * 16) >= (least if least is not None else 1 << 30)
    common = words.where(often).toArrow()
    keys = common["key"].to_numpy().astype(np.int64).view(U)
    by_key = np.argsort(keys)
    follow = counts.where("kind = 1").select("key", "c").toArrow()
    row_of, table = escape_table(follow["key"].to_numpy().astype(np.int64), follow["c"].to_numpy().astype(np.float64)) if follow.num_rows else (np.zeros(SYMBOLS**2, np.int32), np.full((1, SYMBOLS), -np.log10(SYMBOLS), np.float32))
    deep = joined = None
    if order == 4 and 3 in sums:
        contexts = stash(deep_contexts(counts), "contexts")
        bucket = F.floor(F.log(F.col("n").cast("double")) * 16)
        steps = sorted(((r["b"], r["n"]) for r in contexts.groupBy(bucket.alias("b")).agg(F.sum("d").alias("n")).collect()), reverse=True)
        number, least = 0, 1 << 30
        for at, k in steps:
            if number + k > DEEP:
                break
            number, least = number + k, at
        top = contexts.where(bucket >= least).select("ctx", "a", "b").toArrow().sort_by("ctx")
        keyed = contexts.where(bucket >= least).select("ctx", F.explode("bytes").alias("x")).select(F.expr("shiftleft(ctx, 8) | x.s").alias("key"), "x.p").toArrow().sort_by("key")
        joined = contexts.where(bucket < least).select("ctx", "a", "b", "bytes")
        key = follow["key"].to_numpy()
        seen = np.zeros(table.size, bool)
        seen[row_of[key >> 8].astype(np.int64) * SYMBOLS + (key & 0xFF)] = True
        numbers = lambda t, c: t[c].to_numpy() if t.num_rows else np.full(1, -1.0 if c in "abp" else -1)
        deep = (seen, numbers(keyed, "key").astype(np.int64), numbers(keyed, "p"), numbers(top, "ctx").astype(np.int64), numbers(top, "a"), numbers(top, "b"))
    model = spark.sparkContext.broadcast((row_of, table, keys[by_key], common["c"].to_numpy().astype(np.float64)[by_key], texts, deep))

    scored = stash(rows.select("id", "held_out", "text").mapInArrow(_score(model), _ROWS), "scored")
    rare = words.where(~often).select(F.col("key").alias("word"), "c")
    extra = scored.where("kind = 1").select("row", "word", "times").join(rare, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = scored.where("kind = 0").join(extra, "row", "left")
    score = F.col("score")
    if joined is not None:
        left = scored.where("kind = 2").select("row", "times", F.shiftright("word", 8).alias("ctx"), F.col("word").bitwiseAND(F.lit(0xFF)).alias("s"), F.col("held_out").alias("known"), F.col("score").alias("value"))
        value = F.expr("coalesce(get(filter(bytes, x -> x.s = s), 0).p, value + case when known then a else b end, value)")
        out = out.join(left.join(joined, "ctx", "left").groupBy("row").agg(F.sum(F.col("times") * value).alias("deeper")), "row", "left")
        score = score + F.coalesce("deeper", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        score.alias("score"),
    )
