"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of sections, each followed by one line feed (the separator of Spark's text writer, which commits the
files; any store that Spark can write to will do). A section:

    magic "PFR1" | header length u32 | header (JSON, UTF-8) | payload

The header has the number of documents, of ids and of blocks, and of documents without an id, which come last; the payload, in this order
and little-endian:

    document ids i64 | ids per document u32 | block starts u64 (byte offsets of the blocks in the block area) | block area

A block holds up to ``BLOCK`` ids: minimum u32 | count u16 | width u8 | exceptions u16 | packed differences
| exception places u16 | exception values u32. Differences from the minimum are packed at the width that holds the
given percentile of them, or a larger one if that is smaller in all; larger differences are exceptions and stand whole in the list.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonarium.llm import _kernels as K
from clonarium.plans.store import new_folder, partitions, ship, small_batches

MAGIC = b"PFR1"
BLOCK = 4096
PERCENTILE = 90
#: Text bytes of a section, about: what a task holds at once.
SECTION = 2 << 20
#: Sections of a file, at most, so that a task can read one whole.
FILE = 64
#: Encoded parts that a worker keeps, at about 40 bytes each.
KEPT = 1_200_000
_HEAD = struct.Struct("<IHBH")


def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids.astype(np.int64) - low).astype(np.uint32)
    bits = np.frexp(rest.astype(np.float64))[1]  # bit lengths
    count = np.bincount(bits, minlength=33)
    beyond = len(ids) - np.cumsum(count)  # exceptions at each width
    widths = np.arange(33)
    cost = (widths[: len(beyond)] * len(ids) + 7) // 8 + 6 * beyond[:33]
    least = int(np.searchsorted(np.cumsum(count), len(ids) * percentile / 100))
    width = least + int(np.argmin(cost[least:]))
    out = np.flatnonzero(bits > width)
    packed = rest.copy()
    packed[out] = 0
    body = b""
    if width:
        bits32 = np.unpackbits(packed.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        body = np.packbits(bits32[:, :width].ravel(), bitorder="little").tobytes()
    return _HEAD.pack(low, len(ids), width, len(out)) + body + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def unpack_block(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where it ends."""
    low, n, width, exceptions = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    wide = np.zeros((n, 32), np.uint8)
    if width:
        wide[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    at += 2 * exceptions
    rest[places] = np.frombuffer(data, "<u4", exceptions, at)
    return rest + np.uint32(low), at + 4 * exceptions


def pack_section(docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    starts, area, at = [], [], 0
    for lo in range(0, len(ids), BLOCK):
        area.append(pack_block(ids[lo : lo + BLOCK]))
        starts.append(at)
        at += len(area[-1])
    header = json.dumps({"docs": len(docs), "unnamed": unnamed, "ids": len(ids), "blocks": len(starts), "block": BLOCK, "bytes": at}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, docs.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), np.array(starts, "<u8").tobytes(), *area])


class Section:
    """A section of a file. Ids are decoded on demand, and only the blocks that hold them, which the index of block starts finds."""

    def __init__(self, view: memoryview, at: int):
        if view[at : at + 4] != MAGIC:
            raise ValueError(f"no section at byte {at}")
        (size,) = struct.unpack_from("<I", view, at + 4)
        self.head = head = json.loads(bytes(view[at + 8 : at + 8 + size]))
        at += 8 + size
        self.docs = np.frombuffer(view, "<i8", head["docs"], at)
        at += 8 * head["docs"]
        self.counts = np.frombuffer(view, "<u4", head["docs"], at)
        at += 4 * head["docs"]
        self.starts = np.frombuffer(view, "<u8", head["blocks"], at).astype(np.int64)
        self.area = at + 8 * head["blocks"]
        self.view, self.end = view, self.area + head["bytes"] + 1

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids from place ``lo`` to before ``hi`` of the section."""
        hi = self.head["ids"] if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint32)
        size = self.head["block"]
        first = lo // size
        some = [unpack_block(self.view, self.area + int(s))[0] for s in self.starts[first : -(-hi // size)]]
        return np.concatenate(some)[lo - first * size : hi - first * size]

    def named(self, low: int | None, high: int | None) -> tuple[int, int]:
        """First and last (exclusive) place of the documents with ids from ``low`` to ``high``; of all, if both are None."""
        if low is None and high is None:
            return 0, len(self.docs)
        own = self.docs[: len(self.docs) - self.head["unnamed"]]
        return (0 if low is None else int(np.searchsorted(own, low))), (len(own) if high is None else int(np.searchsorted(own, high, "right")))


def sections(data: bytes) -> Iterator[Section]:
    view, at = memoryview(data), 0
    while at < len(view):
        yield (section := Section(view, at))
        at = section.end


class Encoder:
    """Encodes texts with a byte-level tokenizer file, parts of them from memory where it can.

    The tokenizer's pre-tokenisation starts a new piece at each space or line feed that stands alone between other
    characters, so a text is the sum of its parts cut there. Parts are told apart by 64-bit hashes; those not met before are
    encoded by the tokenizers library, many in one string with line feeds between, and parts with more white space inside or with an added
    token one by one. Bytes that are not UTF-8 are read as replacement characters.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        #: Added tokens are found in a text before it is cut into pieces. Parts that hold one are encoded on their own.
        added = list(self.tool.get_added_tokens_decoder().values())
        self.added = [t.content.encode() for t in added]
        self.kept = kept
        self.clear()
        line, after = self.ids("\n x"), self.ids("\nx")
        cuts = line[1:] == self.ids(" x") and after[1:] == self.ids("x") and line[0] == after[0]
        cuts &= not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
        #: The id of a line feed; None if the tokenizer does not cut as described, and then texts are not cut.
        self.line = line[0] if cuts else None

    def clear(self) -> None:
        self.codes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, text: str) -> list[int]:
        return self.tool.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _joined(self, parts: list[bytes], before: bytes, skip: int) -> list[np.ndarray]:
        """Ids of parts without white space but for their first byte; ``before`` makes each begin with a line feed's id, ``skip`` drops it."""
        out = []
        for lo in range(0, len(parts), 20_000):
            some = parts[lo : lo + 20_000]
            ids = np.array(self.ids((before + before.join(some)).decode("utf-8", "replace")), np.uint32)
            cut = np.flatnonzero(ids == self.line)
            if len(cut) != len(some):
                out += [np.array(self.ids(p.decode("utf-8", "replace")), np.uint32) for p in some]
            else:
                out += [x[skip:] for x in np.split(ids, cut[1:])]
        return out

    def _learn(self, code: np.ndarray, parts: list[bytes], solid: np.ndarray, added: bool) -> None:
        """``added``: whether the text that the parts are from holds an added token."""
        lined = np.array([p[:1] == b"\n" for p in parts], bool)
        if added:
            solid = solid & ~np.array([any(x in p for x in self.added) for p in parts], bool)
        ids: list[np.ndarray] = [None] * len(parts)  # type: ignore[list-item]
        for own, before, skip in ((solid & ~lined, b"\n", 1), (solid & lined, b"", 0)):
            at = np.flatnonzero(own)
            if len(at):
                for i, x in zip(at.tolist(), self._joined([parts[i] for i in at], before, skip), strict=True):
                    ids[i] = x
        for i in np.flatnonzero(~solid).tolist():
            ids[i] = np.array(self.ids(parts[i].decode("utf-8", "replace")), np.uint32)
        if len(self.codes) + len(code) > self.kept:
            self.clear()
        size = np.array([len(x) for x in ids])
        start = np.cumsum(size) - size + len(self.flat)
        at = np.searchsorted(self.codes, code)
        self.codes, self.starts, self.sizes = np.insert(self.codes, at, code), np.insert(self.starts, at, start), np.insert(self.sizes, at, size)
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, data: np.ndarray, at: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of texts -> (ids of all texts, number of each text's ids), with ``end`` after each text if given."""
        rows = len(at) - 1
        counts = np.zeros(rows, np.int64)
        ids = np.zeros(0, np.uint32)
        if len(data):
            space = K.SPACE[data]
            first = np.zeros(len(data) + 1, bool)
            if self.line is not None and len(data) > 2:
                first[1:-2] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:]
                first[at[1:-1] - 1] = False  # a blank that ends a text; one that begins a text begins a part anyway
            first[at] = True
            first[len(data)] = False
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(data))
            row = np.searchsorted(at, starts, "right") - 1
            code = K.hash_spans(data, starts, ends)
            distinct, sample, back = np.unique(code, return_index=True, return_inverse=True)
            known = np.zeros(len(distinct), bool)
            if len(self.codes):
                place = np.minimum(np.searchsorted(self.codes, distinct), len(self.codes) - 1)
                known = self.codes[place] == distinct
            if not known.all():
                if len(self.codes) + int((~known).sum()) > self.kept:
                    self.clear()
                    known[:] = False
                new = sample[~known]
                blanks = np.cumsum(space)
                lead = space[starts[new]] & ((data[starts[new]] == 32) | (data[starts[new]] == 10)) & (ends[new] - starts[new] > 1)
                solid = (blanks[ends[new] - 1] - blanks[starts[new]] + space[starts[new]] == lead) & (self.line is not None)
                raw = data.tobytes()
                self._learn(distinct[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], solid, any(x in raw for x in self.added))
            place = np.searchsorted(self.codes, distinct)[back]
            size, start = self.sizes[place], self.starts[place]
            ids = self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            counts = counts + 1
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            data, at = K.text_buffers(batch.column(1))
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, part, off in K.chunks(data, at, SECTION):
                ids, counts = tool.encode(part, off, end)
                yield pa.RecordBatch.from_arrays([pa.array([pack_section(docs[lo:hi], counts, ids, int((~named[lo:hi]).sum()))], pa.binary())], names=["section"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write its ids, closed by ``end``, into files below ``path`` in ascending document id order.

    File names ascend with the document ids, and a file has ``FILE`` sections at most. Null text is empty: just the end id. Rows without an
    id come last. Repeated ids stand next to each other, in the order of a hash of their texts. An empty table writes no section.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.asc_nulls_last("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    made = rows.mapInArrow(_write(tokenizer_path, end), "section binary")
    # The text writer puts the bytes of a string into the file as they are.
    with small_batches(docs.sparkSession):
        made.select(F.col("section").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE).text(path)


def _read(want_ids: bool, low: int | None, high: int | None):
    names = ["path", "doc_id", "n_tokens", "before"] + (["ids"] if want_ids else ["ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for part in sections(content.as_py()):
                    a, b = part.named(low, high)
                    ends = np.cumsum(part.counts.astype(np.int64))
                    begins = ends - part.counts
                    if a < b:
                        base = int(begins[a])
                        raw = part.ids(base, int(ends[b - 1])).astype("<u4").tobytes()
                        own = [raw[4 * (x - base) : 4 * (y - base)] for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                        last = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())) if want_ids else pa.array([zlib.crc32(x) for x in own], pa.int64())
                        unnamed = np.arange(a, b) >= len(part.docs) - part.head["unnamed"]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), pa.array(part.docs[a:b], pa.int64(), mask=unnamed), pa.array(part.counts[a:b].astype(np.int64)), pa.array(before + begins[a:b]), last], names=names)
                    before += part.head["ids"]

    return run


def read_token_files(spark: SparkSession, path: str, want_ids: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, or their ids_crc32, of each document in the files below ``path``.

    With ``low`` or ``high``, of the documents with ids in that range: of all other blocks, none is decoded. A task reads one file whole.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    last = "ids array<int>" if want_ids else "ids_crc32 long"
    rows = files.mapInArrow(_read(want_ids, low, high), f"path string, doc_id long, n_tokens long, before long, {last}")
    # One row for each file: its ids, from the headers of its sections.
    sizes = files.mapInArrow(_totals, "path string, total long")
    ahead = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("total").over(ahead), F.lit(0))).select("path", "ahead")
    return rows.join(sizes, "path").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", last.split()[0])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        totals = [sum(part.head["ids"] for part in sections(content.as_py())) for content in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(totals, pa.int64())], names=["path", "total"])


def round_trip(docs: DataFrame, tokenizer_path: str, end: int = 2, want_ids: bool = False) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end)
    return read_token_files(spark, path, want_ids)
