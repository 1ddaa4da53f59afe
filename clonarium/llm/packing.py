"""Best-fit packing of token sequences into bins of several permitted lengths.

The plan is made on the histogram of piece lengths: items of equal length and bins of equal contents are handled as groups, so
the driver's work and memory depend on the largest permitted length, not on the number of documents. Each group then gets its
items by their rank among the pieces of a length, and each bin's tokens are put together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonarium.llm.mixing import BLANKS
from clonarium.plans.store import ship, stash

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its length: the fixed part of a step for one sequence.
OVERHEAD = 16
#: Pieces that a task ranks, and their tokens, about.
PART, PART_TOKENS = 5_000, 1 << 22
#: Runs of ranks that are broadcast at once: 48 bytes each.
RUNS = 500_000
#: Beyond any rank.
RANK = 1 << 44


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def _lookahead(space: int, lengths: list[int], left: dict[int, int], own: int) -> int:
    """What a bin with so much space would still take of the items left, the longest fitting one first."""
    used = 0
    i = bisect_left(lengths, space + 1) - 1
    while i >= 0 and space > 0:
        n = lengths[i]
        if n <= space and left.get(n, 0) - (n == own) > 0:
            take = min(space // n, left[n])
            used += take * n
            space -= take * n
        i = min(i - 1, bisect_left(lengths, space + 1) - 1)
    return used


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """{length: items} -> [(final capacity, bins, [(length, items in each bin)])]: best-fit decreasing over all permitted capacities.

    From the longest length down, items go to the open bins with the least space that holds them. What is left opens new bins:
    of each permitted capacity that holds the item, what it would further take of the items left is looked up, and the capacity
    with the least cost for a token opens. Last, each bin shrinks to the least permitted capacity that holds its contents.
    """
    caps = sorted(capacities)
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and max(left) > caps[-1]:
        raise ValueError("an item is longer than the largest capacity")
    ascending = sorted(left)
    # Groups of equal bins by the space they have; contents are kept as tuples and shared.
    space: dict[int, list[tuple[int, int, tuple]]] = defaultdict(list)
    spaces: list[int] = []

    def put(room: int, capacity: int, bins: int, contents: tuple) -> None:
        if not space[room]:
            insort(spaces, room)
        space[room].append((capacity, bins, contents))

    for n in reversed(ascending):
        count = left[n]
        while count:
            at = bisect_left(spaces, n)
            if at < len(spaces):
                room = spaces[at]
                capacity, bins, contents = space[room].pop()
                if not space[room]:
                    spaces.pop(at)
                # The bin with the least space takes items until none fits, then the next one does.
                each = room // n
                use = min(bins, count // each)
                if not use:
                    use, each = 1, count
                if use < bins:
                    put(room, capacity, bins - use, contents)
                put(room - each * n, capacity, use, (*contents, (n, each)))
                count -= use * each
                left[n] = count
            else:
                best = min((c for c in caps if c >= n), key=lambda c: (cost(c) / (n + _lookahead(c - n, ascending, left, n)), -c))
                each = min(best // n, count)
                put(best - each * n, best, count // each, ((n, each),))
                if rest := count % each:
                    # Fewer than a full bin are left over: they take the cheapest bin for themselves.
                    count = left[n] = rest
                    continue
                count = left[n] = 0
    out = []
    for room, groups in space.items():
        for capacity, bins, contents in groups:
            held = capacity - room
            out.append((next(c for c in caps if c >= held), bins, list(contents)))
    return sorted(out, key=lambda g: (-g[0], g[2]))


def word_ids(text: str = "text") -> Column:
    """A document as numbers: a hash of each word (runs without white space), 1 at least, and 0 as its end. Stands in for a tokenizer's ids."""
    bare = F.btrim(F.col(text).cast("string"), F.lit(BLANKS))
    words = F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.concat(F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit((1 << 31) - 2)) + 1).cast("int")), F.array(F.lit(0)))


def _assign(runs):
    """Rows of pieces with their rank among those of a length -> bin, capacity and offset. Runs of ranks are looked up by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lo, each, first, capacity, at = runs.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * RANK + rank, "right") - 1
            nth = rank - lo[i]
            made = {"bin": first[i] + nth // each[i], "capacity": capacity[i].astype(np.int32), "offset": (at[i] + nth % each[i] * length).astype(np.int32)}
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *map(pa.array, made.values())], names=[*kept, *made])

    return run


def place_pieces(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece (from 0), start and length (tokens of the document), tokens, bin, capacity, offset (place in the bin).

    ``tokens`` gives a document's ids as an array of int; by default ``word_ids``. Documents longer than the largest capacity are cut into
    pieces of that size and a rest; nothing is dropped. See ``pack`` for the cases.
    """
    spark = docs.sparkSession
    ship(spark)
    most = max(capacities)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), (tokens if tokens is not None else word_ids(f"`{text_col}`")).alias("t"))
    cut = F.expr(f"transform(sequence(0, (size(t) - 1) div {most}), i -> named_struct('start', i * {most}, 'tokens', slice(t, i * {most} + 1, {most})))")
    pieces = rows.where("size(t) > 0").select("row", "id", F.posexplode(cut).alias("piece", "x")).select("row", "id", "piece", "x.*").withColumn("length", F.size("tokens"))
    pieces = stash(pieces.withColumn("place", F.xxhash64("id", "piece", "tokens")), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    bins = plan(histogram, capacities)

    # A length may hold most of the pieces: they are ranked in parts, by ranges of their place, whose number grows with the length's pieces.
    parts = F.get(F.split(F.lit(" ".join(str(max(1, -(-histogram.get(n, 0) // PART), histogram.get(n, 0) * n // PART_TOKENS)) for n in range(most + 1))), " "), F.col("length")).cast("int")
    pieces = pieces.withColumn("part", F.floor((F.col("place") / F.lit(float(1 << 64)) + 0.5) * parts).cast("int"))
    counts = pieces.groupBy("length", "part").count()
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    counts = stash(counts.withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))), "counts")
    order = Window.partitionBy("length", "part").orderBy("place", "id", "piece", "row")
    # Counts are dealt as the ranked pieces are, so the join moves none of them.
    ranked = pieces.withColumn("nth", F.row_number().over(order) - 1).join(counts.select("length", "part", "before").hint("merge"), ["length", "part"])
    ranked = ranked.select("id", F.col("piece").cast("int").alias("piece"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("tokens").cast("array<int>").alias("tokens"), (F.col("nth") + F.col("before")).cast("long").alias("rank"))

    given: dict[int, int] = defaultdict(int)
    first = 0
    runs = []
    for capacity, number, contents in bins:
        at = 0
        for length, each in contents:
            runs.append((length, given[length], each, first, capacity, at))
            given[length] += number * each
            at += length * each
        first += number
    runs.sort()
    schema = f"id {pieces.schema['id'].dataType.simpleString()}, piece int, start long, length long, tokens array<int>, bin long, capacity int, offset int"
    out = None
    for lo in range(0, max(len(runs), 1), RUNS):
        # Runs are broadcast, RUNS of them at a time; a length's runs may be in two of these, and then its ranks tell which.
        some = runs[lo : lo + RUNS]
        table = np.array(some, np.int64).reshape(-1, 6).T
        model = spark.sparkContext.broadcast((table[0] * RANK + table[1], *table[1:]))
        key = F.col("length") * RANK + F.col("rank")
        own = ranked
        if lo:
            own = own.where(key >= some[0][0] * RANK + some[0][1])
        if lo + RUNS < len(runs):
            own = own.where(key < runs[lo + RUNS][0] * RANK + runs[lo + RUNS][1])
        made = own.mapInArrow(_assign(model), schema)
        out = made if out is None else out.unionAll(made)
    return out


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each bin: bin, capacity, used, the ids, pieces, starts and lengths of what is in it, and its tokens, one piece behind the other.

    * Null or empty text: just the end mark. A document whose ``tokens`` are null or empty has no piece. Null ids are packed like others.
    * Repeated rows are documents of their own. Ties: pieces of a length go to bins in the order of a hash of id, piece and tokens.
    * An empty table gives an empty result. Only the histogram of lengths (the largest capacity bounds it) reaches the driver.
    """
    placed = place_pieces(docs, capacities, tokens, id_col, text_col)
    one = F.struct("offset", "id", "piece", "start", "length", "tokens")
    bins = placed.groupBy("bin", "capacity").agg(F.sort_array(F.collect_list(one)).alias("x"))
    each = lambda c: F.transform("x", lambda p: p[c])
    return bins.select("bin", "capacity", F.size(F.flatten(each("tokens"))).alias("used"), each("id").alias(f"{id_col}s"), each("piece").alias("pieces"), each("start").alias("starts"), each("length").alias("lengths"), F.flatten(each("tokens")).alias("tokens"))
