"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

A source's documents stand in a keyed permutation, cut into blocks. A draw takes one block; whole passes over a source draw all its blocks,
the last pass those up to a cut. The tree splits the numbers of draws of all sources exactly among the output shards; each shard takes the
next run of each source's draws, and its documents in a shuffled order. All of that is arithmetic on a document's place once the
cuts are known, so no document is joined to its block, and no group of documents meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonarium.plans.store import new_folder, partitions, stash

BLANKS = " \t\n\x0b\x0c\r"
#: Words of a block, about; a block is what one draw takes. Sources hold ``BLOCKS`` blocks together at most (larger ones, if need be), so that
#: their numbers stay in the range of the generator.
BLOCK, BLOCKS = 20_000, 1 << 28
#: A source's words are used so many times at most.
REPEATS = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def size_of(text: str = "text") -> Column:
    """Number of runs without white space in a text; 0 for null."""
    bare = F.btrim(F.col(text).cast("string"), F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> with ``target``: weighted shares of the sum of all sizes, none above ``repeats`` times its
    source's size; what lies above is shared out again by weight until none is above.

    That fixed point is a water level: with sources in the order of cap per weight, a prefix is capped and
    all others get the same amount per unit of weight. One row for each source, so the windows without a key stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size").cast("double") * repeats)
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    d = d.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    d = d.withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    return d.withColumn("target", F.when(F.col("open"), F.col("water") * F.col("w")).otherwise(F.col("cap"))).select("source", "source_size", "target")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources,) exact quotas -> (shards, sources): recursively, the left half of the shards gets a multivariate
    hypergeometric draw of the quotas and the right half the rest, so rows sum to equal shares and columns to the quotas."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        draw = int(own.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros(len(own), np.int64)
        rest, need = int(own.sum()), draw
        for i, n in enumerate(own):  # source by source: no bound on the sum of quotas
            rest -= int(n)
            left[i] = need if rest == 0 else (rng.hypergeometric(int(n), rest, need) if need and n else 0)
            need -= int(left[i])
        stack += [(mid, hi, own - left), (lo, mid, left)]
    return out


#: Bits of a document's place in the permutation of its source, and those that one step of the search for a cut looks at.
PLACE, DIGIT = 48, 8
#: Words of a written part of a shard, about.
LANE = 1 << 22
#: Sources up to which tables with a row for each source are broadcast.
FEW = 100_000


def _joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source; beyond ``FEW`` sources by a join that adaptive execution can split."""
    other = sources.withColumnRenamed("source", "_of")
    return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def _rows(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc (all columns), id, source, size and place of each row; the place follows from the row's id, source and text."""
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    d = doc.select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{source_col}`").cast("string").alias("source"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    return d.select("doc", "id", "source", size_of("text").alias("size"), F.pmod(F.xxhash64(F.lit(seed), "id", "source", "text"), F.lit(1 << PLACE)).alias("place"))


def cuts(rows: DataFrame, aim: DataFrame, few: bool) -> DataFrame:
    """(source, cut): the last place that the partial pass of a source takes. Sources without such a pass have no row.

    A radix search: each step adds up sizes by source and the next ``DIGIT`` bits of the place, among the rows whose place begins as the
    cut does. A step shuffles at most 2 ** DIGIT sums for each source and task, whatever a source holds. Once ``FEW`` rows are left or less,
    one step looks at their whole places.
    """
    run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    state, known = aim.where("missing > 0").select("source", "missing", F.lit(0).cast("long").alias("lead")), 0
    while True:
        live = _joined(rows.select("source", "size", "place"), state, few).where(F.expr(f"shiftright(place, {PLACE - known}) = lead"))
        # The last step looks at whole places: of the few rows that are left, or the last bits.
        last = known + DIGIT >= PLACE or (known > 0 and left <= FEW)
        bits = 0 if last else PLACE - known - DIGIT
        sums = live.groupBy("source", F.expr(f"shiftright(place, {bits})").alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("missing").alias("missing"))
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        if last:  # the last place whose middle lies within the missing words; if there is none, the place before the first
            return stash(sums.groupBy("source").agg(F.expr("coalesce(max(case when before + words / 2 <= missing then digit end), min(digit) - 1)").alias("cut")), "cut")
        # the digit at which the missing words run out
        step = sums.groupBy("source").agg(F.expr("coalesce(min(case when before + words > missing then struct(digit, before, n) end), max(struct(digit, before, n)))").alias("x"), F.first("missing").alias("missing"))
        state = stash(step.select("source", (F.col("missing") - F.col("x.before")).alias("missing"), F.col("x.digit").alias("lead"), F.col("x.n").alias("n")), "cut")
        left, known = state.agg(F.sum("n")).first()[0] or 0, known + DIGIT
        state = state.drop("n")


def _plan(rows: DataFrame, weights: tuple[int, ...], repeats: int, shards: int, seed: int) -> tuple[DataFrame, bool]:
    """One row for each source: source_size, target, passes, blocks, cut, and the draws at which each shard's run ends. And whether they are few."""
    spark = rows.sparkSession
    total = stash(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = total.limit(FEW + 1).count() <= FEW
    words = total.agg(F.sum("source_size")).first()[0] or 0
    block = float(max(BLOCK, -(-words // BLOCKS)))
    aim = targets(total, weights, repeats).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block))).cast("long"))
    aim = aim.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aim = stash(aim.withColumn("missing", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    cut = cuts(rows, aim, few).withColumnRenamed("source", "_of")
    plan = aim.join(cut, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    plan = stash(plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.when(F.col("cut") >= 0, _block("cut") + 1).otherwise(0)), "quotas")
    quotas = plan.select("source", "quota").orderBy(F.col("source").isNull(), F.encode("source", "utf-8")).collect()
    tree = split_quotas(np.array([r["quota"] for r in quotas], np.int64), shards, seed) if quotas else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(r["source"], e) for r, e in zip(quotas, np.cumsum(tree, axis=0).T.tolist(), strict=True)], "_of string, ends array<long>")
    return stash(plan.join(ends, F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "quota", "missing"), "plan"), few


def _block(place: str) -> Column:
    return F.floor(F.col(place) / F.lit(float(1 << PLACE)) * F.col("blocks")).cast("long")


def _dealt(rows: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """Rows with the shards of their draws, one for each copy. Draw number ``pass * blocks + block`` of a source lies in the run of one shard."""
    d = _joined(rows, plan, few).withColumn("block", _block("place"))
    shard = "size(filter(ends, e -> e <= j * blocks + block))"
    whole = f"case when passes > 0 then transform(sequence(0L, passes - 1), j -> {shard}) else cast(array() as array<int>) end"
    return d.withColumn("shards", F.expr(f"concat({whole}, case when place <= cut then transform(array(passes), j -> {shard}) else cast(array() as array<int>) end)"))


def _drawn(rows: DataFrame, plan: DataFrame, few: bool, shards: int, seed: int) -> DataFrame:
    """One row for each copy, dealt to its shard and shuffled there: the columns of ``rows``, shard and order. A shard has as many parts as its
    words ask for; which part a copy goes to, and its place there, follow from its order."""
    d = _dealt(rows, plan, few, seed).select(*rows.columns, F.posexplode("shards").alias("nth", "shard"))
    d = d.withColumn("order", F.xxhash64(F.lit(seed + 1), "id", "place", "nth")).drop("nth")
    words = plan.agg(F.sum("target")).first()[0] or 0
    lanes = max(1, -(-partitions(rows.sparkSession) // shards), -int(-words // (shards * LANE)))
    return d.repartitionById(shards * lanes, (F.col("shard") * lanes + F.pmod("order", F.lit(lanes))).cast("int")).sortWithinPartitions("shard", "order")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = 16, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, source, size, source_size, target, and shards (one for each copy that the mix takes).

    Sources come in the order of their names by code point, null last, and weigh ``weights`` in turn. A target is reached by whole passes over
    the source's blocks, then by the documents of one more pass up to a cut, the one whose middle lies within what is still missing.

    * Null text: size 0; such documents are taken like others and count nothing. Null source: a source of its own, last.
    * Null ids are like others. Rows that repeat id, source and text have one place, so each is taken equally often. An empty table gives an empty result.
    * Reruns agree: every choice follows from ``seed``, ids, sources and texts. What reaches the driver is one number for each source.
    """
    rows = stash(_rows(docs, seed, id_col, source_col, text_col).drop("doc"), "sizes")
    plan, few = _plan(rows, weights, repeats, shards, seed)
    return _dealt(rows, plan, few, seed).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "shards")


def write_shards(docs: DataFrame, path: str, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = 16, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Writes the mix below ``path``: a folder for each shard, its documents in shuffled order, with columns doc (all columns of ``docs``), id,
    source, size, place and order. Returns id, source, size, place, source_size and target of each input row."""
    rows = _rows(docs, seed, id_col, source_col, text_col)
    seen = stash(rows.drop("doc"), "sizes")
    plan, few = _plan(seen, weights, repeats, shards, seed)
    _drawn(rows, plan, few, shards, seed).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return _joined(seen, plan.select("source", "source_size", "target"), few)


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken: the words of it that stand in the written shards, repeats counted."""
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    rows = write_shards(docs, path, id_col=id_col, **options)
    schema = "id string, source string, size long, place long"
    # A source or table may be empty, and then no shard is written.
    found = spark.read.schema(schema.replace("id string", f"id {rows.schema['id'].dataType.simpleString()}")).parquet(path)
    same = [F.col("r.id").eqNullSafe(F.col("g.id")), F.col("r.source").eqNullSafe(F.col("g.source")), F.col("r.place") == F.col("g.place")]
    both = rows.select("id", "source", "place", F.lit(1).alias("rows"), F.lit(0).cast("long").alias("words")).unionAll(found.select("id", "source", "place", F.lit(0), "size"))
    # Rows that repeat id, source and text share what is found of them.
    got = both.groupBy("id", "source", "place").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    d = rows.alias("r").join(got.alias("g"), same[0] & same[1] & same[2], "left")
    return d.select(F.col("r.id").alias(id_col), "r.size", "r.source_size", "r.target", F.expr("g.words div g.rows").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = 16, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, shard by shard in shuffled order: whole passes repeat a row, a missed draw drops it."""
    rows = _rows(docs, seed, id_col, source_col, text_col)
    plan, few = _plan(stash(rows.drop("doc"), "sizes"), weights, repeats, shards, seed)
    return _drawn(rows, plan, few, shards, seed).select("doc.*")
