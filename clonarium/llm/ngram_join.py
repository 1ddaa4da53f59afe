"""N-gram Jaccard join by parity sketches.

Every document's set of word shingles is split by hash over the parts of a sketch. Each part is a parity vector:
a shingle flips one position, so documents whose sets differ in d shingles differ in at most d parts, and in
at most d bits of any folding of the vector (the Hamming distance bounds the symmetric difference from below).
Within a band of set sizes, similar sets differ in at most t shingles; the sketch has t+1 parts, so
similar documents agree in at least one whole part (pigeonhole). Agreement in a part is an equi-join on its
fingerprint. Candidates are then filtered by the Hamming distance of folded sketches, and verified on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonarium.llm import _kernels as K
from clonarium.plans.store import drop_stash, partitions, ship, stash
from clonarium.plans.components import components

U = np.uint64
#: 64-bit words of the folded sketch that the Hamming filter compares.
FOLD = 16
#: Repeated ids up to which their table is broadcast.
FEW = 100_000
#: Rows of an Arrow batch with texts; a batch is held on either side of a worker's pipe.
TEXTS = 300
#: Signatures that a task holds before it sorts and emits them.
HELD = 400_000

#: Parts up to which a sketch's empty parts take part in the join.
SMALL = 32
#: Pairs of different components that a bucket has for each of its rows, on average, before they are compared one by one.
CROSS = 4
#: Rows of a bucket that are compared with each other in one place; those of a larger bucket are dealt into parts, and pairs of parts are dealt to tasks.
BLOCK = 4096

#: Pairs of one document that are verified in one place, about; its text goes to each place.
SLOT = 64

_META, _SIGNATURE, _PAIR = 0, 1, 2
#: A key is the number of its range and a rest of 32 bits. Unlike signatures that meet in a key are told apart by the verification.
RANGES, REST = 12, 32
_PAIR_SCHEMA = "kind tinyint, key long, a long, b long, n long"
_SIGN_SCHEMA = f"{_PAIR_SCHEMA}, rests binary, ids binary"
_PAIR_ARROW = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_SIGN_ARROW = pa.schema([*_PAIR_ARROW, ("rests", pa.binary()), ("ids", pa.binary())])
_STORE_SCHEMA = "id long, n long, " + ", ".join(f"s{i} long" for i in range(FOLD)) + ", ztext binary"


@lru_cache
def bands(num: int, den: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and the parts that a sketch has in it: one more than the largest
    symmetric difference of two sets up to the band's last size with a Jaccard similarity of num/den.

    Bands grow by den/num at least, so that similar sets lie in one band or in two neighbouring ones.
    """
    first = [1]
    while first[-1] < top:
        first.append(max(first[-1] + 1, first[-1] * 8 // 5, -(-first[-1] * den // num)))
    parts = [2 * (hi - 1) * (den - num) // (den + num) + 1 for hi in first[1:]]
    return np.array(first[:-1]), np.array(parts)


def lowered(data: np.ndarray, lower: bool) -> np.ndarray:
    return K.LOWER[data] if lower else data


def sets(data: np.ndarray, at: np.ndarray, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = lowered(data, lower)
    starts, ends, row = K.cut_words(data, at)
    return K.shingles(K.hash_spans(data, starts, ends), row, len(at) - 1, k)


def _signatures(row: np.ndarray, h: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each part of each sketch; a set also takes part in the next band if a partner may be there."""
    first, parts = bands(num, den)
    own = np.searchsorted(first, n, "right") - 1
    out_row, out_key = [], []
    for step in (0, 1):
        take = n > 0
        if step:
            take &= n * den >= num * first[np.minimum(own + 1, len(first) - 1)]
        band = np.minimum(own + step, len(first) - 1)
        width = np.where(take, parts[band], 0)
        base = np.cumsum(width) - width
        total = int(width.sum())
        if not total:
            continue
        mine = take[row]
        r, g = row[mine], h[mine]
        slot = base[r] + ((g >> U(32)) * width[r].astype(U) >> U(32)).astype(np.int64)
        print_ = np.zeros(total, U)
        np.bitwise_xor.at(print_, slot, K.mix(g, 2))
        filled = np.bincount(slot, minlength=total) > 0
        owner = np.repeat(np.arange(len(n)), width)
        part = np.arange(total) - base[owner]
        seed = K.mix(band[owner].astype(U) * U(1 << 40) + part.astype(U), 3)
        out_row.append(owner[filled])
        out_key.append(K.mix(print_[filled] ^ seed[filled], 4))
        # A part without any shingle is no evidence. Sets that agree in such parts only agree somewhere in a second, independent
        # dealing of the shingles as well: in small sketches, an empty part gets one key for each part of that dealing.
        # Larger sketches need none: similar sets leave more than a third of the parts untouched, and with more than SMALL parts the
        # chance that all of those are empty is below 1e-15, less than that of a hash collision.
        hollow = np.flatnonzero(~filled & (width[owner] <= SMALL))
        if len(hollow):
            who = np.unique(owner[hollow])
            some = np.zeros(len(n), bool)
            some[who] = True
            again = some[r]
            r2, g2 = r[again], K.mix(g[again], 5)
            second = np.zeros(total, U)
            np.bitwise_xor.at(second, base[r2] + ((g2 >> U(32)) * width[r2].astype(U) >> U(32)).astype(np.int64), K.mix(g2, 6))
            times = width[owner[hollow]]
            lead = np.repeat(hollow, times)
            inner = np.arange(len(lead)) - np.repeat(np.cumsum(times) - times, times)
            out_row.append(owner[lead])
            out_key.append(K.mix(K.mix(second[base[owner[lead]] + inner] + inner.astype(U), 7) ^ seed[lead], 8))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(out_row), np.concatenate(out_key)


def _emit(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, n: np.ndarray | None = None, schema: pa.Schema = _PAIR_ARROW) -> pa.RecordBatch:
    as_long = lambda x: pa.nulls(len(key), pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), *map(as_long, (key, a, b, n)), *(pa.nulls(len(key), pa.binary()) for _ in schema.names[5:])], schema=schema)


def _packed(key: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their documents, a row for each range of keys: the rests of its keys, and the distances of its documents from the least
    one (``a``) in ``n`` bytes each."""
    base = int(a.min())
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max()) - base < 1 << 8 * w)
    rests = (key & U((1 << REST) - 1)).astype(np.uint32)
    ids = (a.view(U) - U(base % (1 << 64))).astype(f"u{width}")
    ranges = key >> U(REST)
    at = np.r_[np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]), len(key)]
    rows = len(at) - 1
    binary = lambda x: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    columns = [np.full(rows, _SIGNATURE, np.int8), ranges[at[:-1]].view(np.int64), np.full(rows, base), None, np.full(rows, width)]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()) if c is None else pa.array(c) for c in columns] + [binary(rests), binary(ids)], schema=_SIGN_ARROW)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of rows of ``_packed``."""
    keys, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for r, base, width, rests, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6)), strict=True):
        keys.append(np.frombuffer(rests, np.uint32).astype(U) | U(r << REST))
        docs.append((np.frombuffer(ids, f"u{width}").astype(U) + U(base % (1 << 64))).view(np.int64))
    return np.concatenate(keys), np.concatenate(docs)


def _slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of moderate size: each is held whole on the other side."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _sign(k: int, num: int, den: int, lower: bool, bits: int = RANGES):
    """Rows of three kinds: one for each document (set size and hash), signatures packed by range of keys (there are 2 ** ``bits``), and pairs
    that share a signature among those held together. Of these, a key is sent once."""

    def flush(ids: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, key = np.concatenate(ids), np.concatenate(keys) >> U(64 - REST - bits)
        order = np.lexsort((a, key))
        a, key = a[order], key[order]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        yield from _slices(_packed(key[lead], a[lead]), TEXTS)
        pivot = a[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        rest = ~lead & (pivot != a)
        if rest.any():
            yield from _slices(_emit(_PAIR, key[rest], pivot[rest], a[rest], schema=_SIGN_ARROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = K.text_buffers(batch.column(1))
            for lo, hi, part, off in K.chunks(data, at):
                row, h, n = sets(part, off, k, lower)
                one, two = np.zeros(hi - lo, U), np.zeros(hi - lo, U)
                full = np.flatnonzero(n)
                if len(row):
                    at_row = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    one[full], two[full] = np.add.reduceat(K.mix(h, 10), at_row), np.add.reduceat(K.mix(h, 11), at_row)
                own = doc[lo:hi]
                yield _emit(_META, one, own, two, n, _SIGN_ARROW)
                # Equal sets within the task: the smallest id stands for them in the join.
                order = np.lexsort((own, two, one))
                head = np.ones(len(order), bool)
                head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                stands = np.zeros(hi - lo, bool)
                stands[order[head]] = True
                r, key = _signatures(row, h, np.where(stands, n, 0), num, den)
                ids.append(own[r])
                keys.append(key)
                held += len(key)
                if held > HELD:
                    yield from flush(ids, keys)
                    ids, keys, held = [], [], 0
        if held:
            yield from flush(ids, keys)

    return run


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and key: links each document of a key to the key's first one. Holds one range of keys."""

    def linked(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, a = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((a, key))
        key, a = key[order], a[order]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        pivot = a[lead][np.cumsum(lead) - 1]
        rest = pivot != a
        if rest.any():
            yield from _slices(_emit(_PAIR, key[rest], pivot[rest], a[rest]))

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        if (keep := kind != _SIGNATURE).any():
            yield batch.filter(pa.array(keep)).select(_PAIR_ARROW.names)
        if keep.all():
            continue
        part = batch.filter(pa.array(~keep))
        ranges = part.column(1).to_numpy(zero_copy_only=False)
        at = np.r_[np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]), len(ranges)]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if parts and ranges[lo] != last:
                yield from linked(parts)
                parts = []
            parts.append(_unpacked(part.slice(lo, hi - lo)))
            last = ranges[lo]
    if parts:
        yield from linked(parts)


def _keep_text(k: int, lower: bool):
    """Set size, folded parity sketch and packed text of documents that stand in some pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = K.text_buffers(batch.column(1))
            for lo, hi, part, off in K.chunks(data, at):
                row, h, n = sets(part, off, k, lower)
                fold = np.zeros((hi - lo) * FOLD, U)
                np.bitwise_xor.at(fold, row * FOLD + ((h >> U(8)) % U(FOLD)).astype(np.int64), U(1) << (h & U(63)))
                fold = fold.reshape(-1, FOLD).view(np.int64)
                raw = part.tobytes()
                texts = [pack.compress(raw[off[i] : off[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi]), pa.array(n), *(pa.array(np.ascontiguousarray(fold[:, i])) for i in range(FOLD)), pa.array(texts, pa.binary())], names=["id", "n", *(f"s{i}" for i in range(FOLD)), "ztext"])

    return run


def _verify(k: int, num: int, den: int, lower: bool):
    """(u, slot, v, text) -> (u, v) of those that pass. Within a slot of u, its own texts (v is null) come first and then those of its partners;
    an id has several texts if its rows have. The sets of one u are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def own(z: bytes) -> np.ndarray:
            data = np.frombuffer(unpack.decompress(z), np.uint8)
            return sets(data, np.array([0, len(data)]), k, lower)[1]

        def alike(one: np.ndarray, two: np.ndarray) -> bool:
            both = len(np.intersect1d(one, two, assume_unique=True))
            return both * den >= num * (len(one) + len(two) - both)

        place, mine = None, []
        for batch in batches:
            u, slot, v = (batch.column(i).to_pylist() for i in range(3))
            good = []
            for i, z in enumerate(batch.column(3)):
                if (u[i], slot[i]) != place:
                    place, mine = (u[i], slot[i]), []
                made = own(z.as_py())
                if v[i] is None:
                    mine.append(made)
                elif any(alike(x, made) for x in mine):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], names=["u", "v"])

    return run


def left_over(rows: DataFrame, sketches: DataFrame, close: str) -> DataFrame:
    """Pairs (``here``, ``there``) of rows of a bucket (key, c, id, comp) that lie in different components and pass the filter.

    A bucket of more than ``BLOCK`` rows is dealt into parts of about that size, and each row goes to the pairs of parts that its own is in: a
    task compares two parts, however large the bucket. Comparisons are conditions of the join; only pairs that pass come out of it.
    """
    d = rows.join(sketches, "id").withColumn("parts", F.ceil(F.col("c") / F.lit(float(BLOCK))).cast("int"))
    d = d.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    first = d.withColumn("other", F.explode(F.expr("sequence(part, parts - 1)"))).withColumn("lo", F.col("part")).withColumn("hi", F.col("other"))
    second = d.withColumn("other", F.explode(F.expr("sequence(0, part)"))).withColumn("lo", F.col("other")).withColumn("hi", F.col("part"))
    # Within a part, a pair counts once; between parts, the one side is of the lower part.
    once = "(here.lo < here.hi or here.id < there.id)"
    return first.alias("here").join(second.alias("there"), F.expr(f"here.key = there.key and here.lo = there.lo and here.hi = there.hi and {once} and here.comp <> there.comp and {close}"))


def similar_sets(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose sets of ``k``-word shingles have a Jaccard similarity of num/den or more.

    Returns for each input row: ``id_col``, n_shingles (set size), component_id (the smallest id that links reach, its own included).

    * Words are runs without the six ASCII white space characters; with ``lower``, A-Z are lower-cased first.
    * Null or empty text, or one of white space: n_shingles 0, linked with nothing. Fewer than ``k`` words: the sequence is the one shingle.
    * Repeated rows stay, and share their id's component. Rows with a null id are returned with a null component.
    * An empty table gives an empty result. Columns other than the two named are not looked at.

    Exact: no link is lost to bands, buckets or groups. A first pass compares each member of a bucket with its smallest one, further
    passes with other members; whatever then lies in different components of a shared bucket is compared as well, after the Hamming filter.
    Equal sets count as one. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = base.where("id is not null")
    parts = partitions(spark)

    bits = max(RANGES, (parts - 1).bit_length())
    signed = known.mapInArrow(_sign(k, num, den, lower, bits), _SIGN_SCHEMA)
    # Signatures meet by the range of their key; other rows are spread.
    route = F.when(F.col("kind") == _SIGNATURE, F.shiftright(F.col("key") * parts, bits)).otherwise(F.pmod(F.xxhash64("key", "a", "b"), F.lit(parts)))
    paired = stash(signed.repartitionById(parts, route.cast("int")).sortWithinPartitions("kind", "key").mapInArrow(_pair_up, _PAIR_SCHEMA), "pairs")

    meta = paired.where(F.col("kind") == _META).select(F.col("a").alias("id"), "n", F.col("key").alias("h1"), F.col("b").alias("h2"))
    classes = meta.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    stands = stash(meta.join(classes, ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "stands")
    # An id that comes with several texts is one node with several sets.
    of = stands.where("n > 0").select("id", "rep", "n").distinct()
    lead = of.select(F.col("id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    other = of.select(F.col("id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    shared = paired.where(F.col("kind") == _PAIR).select("key", "a", "b").join(lead, "a").join(other, "b").where("ra <> rb")
    shared = stash(shared.select("key", "ra", "na", "rb", "nb").distinct(), "shared")

    sizes = f"least(na, nb) * {den} >= greatest(na, nb) * {num}"
    first = shared.where(sizes).select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).distinct()
    ids = shared.select(F.col("ra").alias("id")).unionAll(shared.select(F.col("rb").alias("id"))).distinct()
    store = stash(known.join(ids, "id").mapInArrow(_keep_text(k, lower), _STORE_SCHEMA), "store", TEXTS)

    if stands.groupBy("id").count().where("count > 1").head(1):
        store, whole = stash(store.distinct(), "store", TEXTS), store
        drop_stash(whole)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that pass. A text moves to its id, and from there once to each place where pairs of it are verified."""
        slots = pairs.groupBy("u").agg(F.expr(f"count(*) div {SLOT} + 1").alias("slots"))
        dealt = stash(pairs.join(slots, "u").select("u", F.pmod(F.xxhash64("v"), "slots").alias("slot"), "v"), "dealt")
        own = dealt.select(F.col("u").alias("id"), "u", "slot", F.lit(None).cast("long").alias("v")).distinct()
        texts = store.select("id", "ztext").join(own.unionAll(dealt.select(F.col("v").alias("id"), "u", "slot", "v")), "id").select("u", "slot", "v", "ztext")
        found = stash(texts.repartition(parts, "u", "slot").sortWithinPartitions("u", "slot", "v").mapInArrow(_verify(k, num, den, lower), "u long, v long"), "links", TEXTS)
        drop_stash(dealt)
        return found

    same = stands.where("rep <> id").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    tested, links = [first], [verified(first)]
    group = components(links[0])
    members = stash(shared.select("key", F.col("ra").alias("id")).unionAll(shared.select("key", F.col("rb").alias("id"))).distinct(), "members")
    sketches = store.drop("ztext").distinct()
    close = lambda a, b: f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num} and (" + " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(FOLD)) + f") * {den + num} <= ({a}.n + {b}.n) * {den - num}"
    last = None
    while True:
        placed = members.join(group.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        by = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
        # A bucket of two was compared as a whole by the first pass.
        open_keys = by.where("c > 2 and same < c * c")
        rows = stash(placed.join(open_keys.withColumn("cross", F.expr("(cast(c as double) * c - same) / 2")).select("key", "cross", "c"), "key"), "open")
        cross, held = rows.agg(F.sum(F.col("cross") / F.col("c")), F.count("*")).first()
        # Cross pairs of a bucket are compared one by one only once comparing with single members has brought them down, or no longer does.
        if not held or cross <= CROSS * held or (last is not None and cross > 0.9 * last):
            break
        last = cross
        pivot = rows.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(len(tested)))).alias("p")).select("key", F.col("p.id").alias("pid"), F.col("p.comp").alias("pcomp"))
        # The same two documents meet in many buckets: their sketches are fetched once.
        met = rows.join(pivot, "key").where("comp <> pcomp").select(F.least("id", "pid").alias("u"), F.greatest("id", "pid").alias("v")).distinct()
        near = met.alias("m").join(sketches.alias("here"), F.expr("m.u = here.id")).join(sketches.alias("there"), F.expr(f"m.v = there.id and {close('here', 'there')}"))
        pairs = near.select("m.u", "m.v").distinct()
        for done in tested:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = stash(pairs, "tested")
        tested.append(pairs)
        links.append(verified(pairs))
        drop_stash(rows)
        before, group = group, components(group.unionAll(links[-1]))
        drop_stash(before)
    near = left_over(rows, sketches, close("here", "there"))
    later = near.select(F.least("here.id", "there.id").alias("u"), F.greatest("here.id", "there.id").alias("v")).distinct()
    for done in tested:
        later = later.join(done, ["u", "v"], "left_anti")
    later = stash(later, "tested")
    tested.append(later)
    links.append(verified(later))
    whole = components(group.unionAll(links[-1]).unionAll(same))
    drop_stash(paired, shared, store, group, members, rows, *links, *tested[1:])
    whole = whole.select(F.col("u").alias("id"), F.col("v").alias("comp"))

    known_rows = stands.join(whole, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    unknown = base.where("id is null").mapInArrow(_sizes(k, lower), "id long, n long, comp long")
    return known_rows.unionAll(unknown).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def _sizes(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.text_buffers(batch.column(1))
            for lo, hi, part, off in K.chunks(data, at):
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(sets(part, off, k, lower)[2]), none], names=["id", "n", "comp"])

    return run


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group, the document with the smallest id stays.

    Rows that repeat an id are documents of their own where their texts differ (the one with the smaller hash of id and text goes first); of
    rows with equal id and text one stays, by a hash of its other columns. So it is with null ids, which come after all others.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    twice = stash(ids.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("_id")), "repeated")
    number = twice.limit(FEW + 1).count()
    if not number:
        found = similar_sets(docs, k, num, den, id_col=id_col, text_col=text_col).where(F.col(f"`{id_col}`") != F.col("component_id")).select(F.col(f"`{id_col}`").alias("_id"))
        return docs.join(found, F.col(f"`{id_col}`") == F.col("_id"), "left_anti")
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = doc.select("doc", F.col(f"doc.`{id_col}`").cast("long").alias("id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    rows = rows.join(F.broadcast(twice) if number <= FEW else twice, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("again", F.col("_id").isNotNull() | F.col("id").isNull()).drop("_id")
    rows = rows.withColumn("node", F.when(F.col("again"), F.xxhash64("id", "text")).otherwise(F.col("id")))
    group = similar_sets(rows.select("node", "text"), k, num, den, id_col="node").distinct().select("node", "component_id")
    place = F.struct(F.col("id").isNull(), "id", "node")
    named = stash(rows.select("id", "node").distinct().join(group, "node"), "named")
    first = named.groupBy("component_id").agg(F.min(place).alias("p")).select("p.node", F.lit(True).alias("stays"))
    gone = named.select("node").distinct().join(first, "node", "left_anti").select(F.col("node").alias("_node"))
    rest = rows.join(gone, F.col("node") == F.col("_node"), "left_anti")
    single = rest.where("not again").select("doc.*")
    some = rest.where("again").groupBy("node", "id", "text").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return single.unionByName(some.select("doc.*"))
