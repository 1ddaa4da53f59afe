"""Exact top-k inner products by a bit-sliced index.

Rows are held in blocks. For each attribute a block has bit slices: bitmap b holds bit b of the attribute's offset
from the block minimum, for all rows of the block. A query's scores are added up slice by slice with bitmap arithmetic (ripple-carry
adders over whole bitmaps); coarse slices give a lower bound and a known error. The k best lower bounds are selected from the most
significant slice of the sum downward; rows that the error leaves open are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonarium.plans.store import partitions, ship, stash

#: Rows of an index block, queries of a query block.
ROWS, QUERIES = 8192, 256
#: Slices kept of each attribute, from the most significant one, and bits kept of each query component.
SLICES, QUERY_BITS = 6, 10

_BLOCK = "part int, n int, dim int, ids binary, rows binary, low binary, shift binary, slices binary"
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def build_block(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Bit slices of one block; ``rows`` (n, dim) of whole numbers."""
    n, dim = rows.shape
    low = rows.min(axis=0)
    span = rows.max(axis=0) - low
    bits = np.array([int(s).bit_length() for s in span])
    shift = np.maximum(bits - SLICES, 0)
    coarse = ((rows - low) >> shift).astype(np.uint8)  # below 2 ** SLICES
    words = (n + 63) // 64
    padded = np.zeros((words * 64, dim), np.uint8)
    padded[:n] = coarse
    slices = np.stack([np.packbits((padded >> b) & 1, axis=0, bitorder="little").T.copy().view(np.uint64) for b in range(SLICES)], axis=1)  # (dim, SLICES, words)
    return {"n": n, "dim": dim, "ids": ids.astype(np.int64).tobytes(), "rows": rows.astype(np.int64).tobytes(), "low": low.astype(np.int64).tobytes(), "shift": shift.astype(np.int64).tobytes(), "slices": slices.tobytes()}


def _add(total: list[np.ndarray], other: list[np.ndarray], at: int) -> None:
    """total += other << at, over bitmaps; ``total`` grows as needed."""
    carry = None
    i = at
    while i - at < len(other) or carry is not None:
        x = other[i - at] if i - at < len(other) else None
        if i >= len(total):
            total += [np.zeros_like(total[0] if total else other[0]) for _ in range(i + 1 - len(total))]
        s = total[i]
        if x is None:
            total[i], carry = s ^ carry, s & carry
        elif carry is None:
            total[i], carry = s ^ x, s & x
        else:
            half = s ^ x
            total[i], carry = half ^ carry, (s & x) | (half & carry)
        if i - at >= len(other) - 1 and not carry.any():
            break
        i += 1


def search_block(block: dict, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, score) of each query's k best rows of the block, ties to the smaller id. own: ids that the queries don't count."""
    n, dim = block["n"], block["dim"]
    ids = np.frombuffer(block["ids"], np.int64)
    rows = np.frombuffer(block["rows"], np.int64).reshape(n, dim)
    low, shift = np.frombuffer(block["low"], np.int64), np.frombuffer(block["shift"], np.int64)
    words = (n + 63) // 64
    slices = np.frombuffer(block["slices"], np.uint64).reshape(dim, SLICES, words)
    q = queries[:, :dim] if queries.shape[1] >= dim else np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
    count = len(q)

    # Sum of |q| times (offset, or for a negative q the offset from the top), all cut to their upper bits. Bits of |q| are kept at a
    # common shift for each query and attribute shift at that of the attribute: both are powers of two, so they only move slices.
    size = np.abs(q)
    keep = np.maximum(np.array([int(x).bit_length() for x in size.max(axis=1)]) - QUERY_BITS, 0)
    cut = size >> keep[:, None]
    floor_ = int(shift.min())
    total: list[np.ndarray] = [np.zeros((count, words), np.uint64)]
    negative = q < 0
    for d in range(dim):
        if not cut[:, d].any():
            continue
        flip = np.where(negative[:, d], _FULL, np.uint64(0))[:, None]
        planes = [slices[d, b][None, :] ^ flip for b in range(SLICES)]
        for j in range(QUERY_BITS):
            bit = (cut[:, d] >> j) & 1
            if bit.any():
                mask = np.where(bit == 1, _FULL, np.uint64(0))[:, None]
                _add(total, [p & mask for p in planes], j + int(shift[d]) - floor_)

    # The k best sums, from the most significant slice downward: rows surely in (above), and rows equal so far (level).
    real = np.zeros(words * 64, np.uint8)
    real[:n] = 1
    here = np.packbits(real, bitorder="little").view(np.uint64)
    level = np.repeat(here[None, :], count, axis=0)
    for i, x in enumerate(own):
        for at in np.flatnonzero(ids == x).tolist():
            level[i, at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
    able = level.copy()
    threshold = np.zeros(count, object)
    need = np.minimum(k, np.bitwise_count(able).sum(axis=1).astype(np.int64))
    for b in range(len(total) - 1, -1, -1):
        set_ = level & total[b]
        have = np.bitwise_count(set_).sum(axis=1).astype(np.int64)
        up = have >= need  # the k-th best has this bit
        threshold = threshold + np.where(up, 1 << b, 0)
        level = np.where(up[:, None], set_, level & ~total[b])
        need = np.where(up, need, need - have)

    # In full units a sum S stands for a true value in [S * unit, S * unit + error]: rows from threshold - error on stay open.
    top = ((1 << SLICES) - 1) << shift  # largest offset that slices hold
    left = (1 << shift) - 1
    # |q| u = (cut << keep) (coarse << shift) + cut part times the offset's lost bits + lost bits of |q| times the offset
    lost = size - (cut << keep[:, None])
    error = ((cut << keep[:, None]) * left).sum(axis=1) + (lost * (top + left)).sum(axis=1)
    out_q, out_id, out_score = [], [], []
    for i in range(count):
        unit = 1 << (int(keep[i]) + floor_)
        least = int(threshold[i]) - -(-int(error[i]) // unit)
        open_ = able[i].copy()
        if least > 0:
            # sum >= least, compared from the top slice downward
            more, equal = np.zeros(words, np.uint64), np.full(words, _FULL)
            for b in range(max(len(total), least.bit_length()) - 1, -1, -1):
                t = total[b][i] if b < len(total) else np.zeros(words, np.uint64)
                if least >> b & 1:
                    equal = equal & t
                else:
                    more |= equal & t
                    equal = equal & ~t
            open_ &= more | equal
        at = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little")[:n])
        score = rows[at] @ q[i]
        best = np.lexsort((ids[at], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_id.append(ids[at][best])
        out_score.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def _blocks(scale: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            some, x = np.concatenate(ids), np.concatenate(rows)
            b = build_block(some, x)
            return pa.RecordBatch.from_pylist([{"part": 0} | b], schema=_arrow())

        held = 0
        for batch in batches:
            own, x = _matrix(batch, scale, dim)
            while len(own):
                take = ROWS - held
                ids.append(own[:take])
                rows.append(x[:take])
                held += len(ids[-1])
                own, x = own[take:], x[take:]
                if held == ROWS:
                    yield flush()
                    ids, rows, held = [], [], 0
        if held:
            yield flush()

    return run


def _matrix(batch: pa.RecordBatch, scale: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-number vectors, padded to ``dim``; rows come filtered."""
    own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.floor(scale * flat).astype(np.int64)
    if len(size) and (size == dim).all():
        return own, whole.reshape(-1, dim)
    out = np.zeros((len(own), dim), np.int64)
    row = np.repeat(np.arange(len(own)), size)
    out[row, np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)] = whole
    return own, out


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), *((x, pa.binary()) for x in ("ids", "rows", "low", "shift", "slices"))])


def _query_blocks(scale: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES):
                own, x = _matrix(batch.slice(lo, QUERIES), scale, dim)
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["qids", "q"])

    return run


def _search(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                own = np.frombuffer(x["qids"], np.int64)
                q = np.frombuffer(x["q"], np.int64).reshape(-1, dim)
                at, ids, score = search_block(x, q, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` rows with the highest inner product: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x). Queries are the rows for which the SQL condition ``is_query`` over the table's columns holds;
    candidates are all rows but those with the query's own id. Ties go to the smaller id; fewer rows come back if there are fewer.

    * Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id.
    * Shorter vectors count as padded with zeros, empty ones too. Components so large that a sum could leave 64 bits raise an error.
    * Repeated rows are candidates of their own; an id is asked once, with the least of its vectors. An empty table gives an empty result.

    Every pair of a query block and an index block is searched once, so the work is queries times rows; each search returns k rows for each query.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.expr(is_query).alias("asked"))
    rows = rows.where("id is not null and v is not null").where("not exists(v, x -> x is null or isnan(x) or x = double('infinity') or x = double('-infinity'))")
    dim, largest = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if dim is None:
        return spark.createDataFrame([], empty)
    dim = max(dim, 1)
    # Sums of products of a component and an offset from a minimum, both below this number and twice this number.
    if 4 * dim * (scale * (largest or 0.0) + 1) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {largest} make sums beyond 64 bits at a scale of {scale}")
    index = stash(rows.select("id", "v").mapInArrow(_blocks(scale, dim), _BLOCK), "slices")
    queries = stash(rows.where("asked").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_query_blocks(scale, dim), "qids binary, q binary"), "queries")
    # Both sides are dealt over a grid: index blocks to groups, query blocks to each group; a task joins one group.
    groups = max(1, min(index.count(), 4 * partitions(spark)))
    dealt = index.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    spread = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = spread.hint("shuffle_hash").join(dealt, "part").select(*dealt.columns, "qids", "q").mapInArrow(_search(k, dim), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
