"""WARC files: writing with revisit records, and reading by boundary chains.

A reader that looks for record heads in the bytes also finds those inside payloads. Here each candidate names its successor, the
place right behind the record that it would be; by pointer jumping from the start of the file, only candidates that the chain reaches are
records. A head inside a payload is reached by no record before it. Files are read split by split, whatever their size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonarium.plans.store import new_folder, ship, small_batches, stash

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
#: Payloads from so many bytes on are kept once; equal ones revisit the record that keeps them.
REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record, up to the last byte of its closing CRLF CRLF. A revisit has an empty block but full digest and length."""
    name = lambda x, of: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}:{of}')}>"
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", name(page, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Page-ID", "" if page is None else str(page)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers, digest)), ("WARC-Refers-To-Page-ID", str(refers))]
    body = payload if refers is None else b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte: its last byte is that of its length, which is zero below 16 MiB; else an empty member follows."""
    out = zlib.compress(data, 4, wbits=31)
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _records(compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, digest, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            done, held = [], 0
            for i, payload in enumerate(batch.column(2)):
                rec = record(page[i], url[i], payload.as_py(), digest[i], refers[i])
                # The text writer closes each row with its separator, so that byte is left to it.
                done.append(member(rec)[:-1] if compress else rec[:-2])
                held += len(done[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])

    return run


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page, url, payload, digest, refers): digests first, payloads joined to the one row in each group that keeps them.

    Only ids and digests are grouped; minima are pre-aggregated, so a payload that many pages share is no hot group.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.encode(F.col(f"`{payload_col}`").cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    big = rows.where(F.col("size") >= REVISIT).select("page", "digest", "size")
    last = big.groupBy("digest", "size").agg(F.max("page").alias("refers"), F.count("*").alias("c")).where("c > 1 and refers is not null")
    # A page is told by its payload as well: an id may come with several.
    revisits = big.join(last, ["digest", "size"]).where("page is null or page <> refers").select("page", "digest", "size", "refers").distinct()
    same = F.col("p.page").eqNullSafe(F.col("r.page")) & (F.col("p.digest") == F.col("r.digest")) & (F.col("p.size") == F.col("r.size"))
    return rows.alias("p").join(revisits.alias("r"), same, "left").select("p.page", "p.url", "p.payload", "p.digest", "r.refers")


def write_warc(pages: DataFrame, path: str, compress: bool = True, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record for each page into files below ``path``; Spark's committer makes them whole or not at all.

    Of pages with equal payloads of ``REVISIT`` bytes or more, the one with the largest id is a response and the others revisit it; smaller
    payloads are all responses. Null payload: empty. Null url: empty. A null id is smaller than any other; where all of a payload's ids are
    null, all are responses. Rows that repeat an id with an equal payload are alike responses, or alike revisits; with unlike payloads each
    goes by its own.
    """
    ship(pages.sparkSession)
    records = plan_revisits(pages, id_col, url_col, payload_col).mapInArrow(_records(compress), "record binary")
    with small_batches(pages.sparkSession, 200):
        records.select(F.col("record").cast("string")).write.option("lineSep", "\0" if compress else "\r\n").text(path)


def _head(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Named fields of a record head at ``at``, and where its block begins."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or end < 0:
        return None
    out = {}
    for line in data[at + len(VERSION) : end].split(b"\r\n"):
        key, sep, value = line.partition(b":")
        if not sep:
            return None
        out[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (out, end + 4) if out.get("content-length", "").isdigit() else None


#: Successors of candidates that are none, and of those whose end is not in the bytes at hand and cannot be told.
NONE, OPEN = -1, -2
#: Bytes of a record's head, at most.
HEAD = 1 << 20


def plain_candidate(data: bytes, at: int) -> tuple[int, tuple[dict[str, str], int, int] | None]:
    """Successor of what looks like a record at ``at``, with its fields and block; without these if the successor lies beyond the bytes."""
    if not (head := _head(data, at)):
        # An incomplete head is one as long as each of its whole lines has a name.
        lines = data[at + len(VERSION) :].split(b"\r\n") if len(data) - at < HEAD and data.find(b"\r\n\r\n", at) < 0 else [b"", b""]
        return (OPEN if all(b":" in x for x in lines[:-1]) else NONE), None
    fields, body = head
    end = body + int(fields["content-length"])
    if end + 4 > len(data):
        return end + 4, None
    return (end + 4 if data[end : end + 4] == b"\r\n\r\n" else NONE), (fields, body, end)


#: Bytes given to a decompressor at once, so that a candidate doesn't copy the rest of its file.
_STEP = 1 << 16


def gzip_candidate(data: bytes, at: int) -> tuple[int, bytes | None]:
    """Successor of what looks like a gzip member at ``at``, with its contents."""
    tool, out, end, view = zlib.decompressobj(wbits=31), [], at, memoryview(data)
    try:
        while not tool.eof and end < len(data):
            out.append(tool.decompress(view[end : end + _STEP]))
            end += _STEP
    except zlib.error:
        return NONE, None
    return (min(end, len(data)) - len(tool.unused_data), b"".join(out)) if tool.eof else (OPEN, None)


def candidates(data: bytes, compress: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """Start and successor of each place that looks like a record, with what it holds; places that cannot be records are left out."""
    mark, one = (GZIP, gzip_candidate) if compress else (VERSION, plain_candidate)
    starts, nexts, found = [], [], []
    at = data.find(mark)
    while at >= 0:
        to, what = one(data, at)
        if to != NONE:
            starts.append(at)
            nexts.append(to)
            found.append(what)
        at = data.find(mark, at + 1)
    return np.array(starts, np.int64), np.array(nexts, np.int64), found


def _pointers(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Number of each candidate's successor; ``len(starts)`` where that is no candidate."""
    n = len(starts)
    to = np.minimum(np.searchsorted(starts, nexts), max(n - 1, 0))
    return np.append(np.where(starts[to] == nexts, to, n) if n else to, n)


def reachable(starts: np.ndarray, nexts: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
    """Which candidates the chains from ``entries`` (default: byte 0) reach. Pointer jumping: pointers double their reach in each round."""
    n = len(starts)
    seen = np.append(starts == 0 if entries is None else np.isin(starts, entries), False)
    to = _pointers(starts, nexts)
    for _ in range(n.bit_length() + 1):
        seen[to[seen]] = True
        to = to[to]
    return seen[:n]


def exits(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate first goes that is no candidate here: the end of the split, or nowhere."""
    n = len(starts)
    to = _pointers(starts, nexts)
    last = np.arange(n + 1)  # the last candidate of the chain, within so many steps
    for _ in range(n.bit_length() + 1):
        last = np.where(to < n, to, last)[last] if n else last
        to = np.where(to < n, to[np.minimum(to, n)], n)
    return nexts[last[:n]]


_CANDIDATE, _SIZE, _TAIL, _OPEN, _FAR = 0, 1, 2, 3, 4
_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_SCAN = f"kind tinyint, file string, block long, at long, next long, {_FIELDS}"
_SCAN_ARROW = pa.schema([("kind", pa.int8()), ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _record_fields(what: object, data: bytes, compress: bool) -> tuple | None:
    """Fields and payload of a candidate; None if a gzip member holds no record."""
    if compress:
        if not (head := _head(what, 0)):
            return None
        fields, block = head[0], what[head[1] : head[1] + int(head[0]["content-length"])]
    else:
        fields, block = what[0], data[what[1] : what[2]]
    whole = fields.get("warc-type") == "response"
    digest = hashlib.sha1(block).hexdigest() if whole else fields.get("warc-payload-digest", "").partition(":")[2]
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    return number("warc-page-id"), fields.get("warc-target-uri"), fields.get("warc-type"), len(block) if whole else number("warc-payload-length"), digest, number("warc-refers-to-page-id"), block


def _found(data: bytes, file: str, block: int, shift: int, compress: bool, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of what stands in a split's bytes, ``shift`` from their places: candidates, those that end beyond, where this is told by the head or
    not, and the bytes from the first of these on.

    ``only``: starts that count. In the first split of a file, only what the chain from byte 0 reaches counts.
    """
    empty = (None,) * 7

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SCAN_ARROW.types, strict=True)], schema=_SCAN_ARROW)

    starts, nexts, what = candidates(data, compress)
    counts = np.isin(starts, only) if only is not None else reachable(starts, nexts) if block == 0 else np.ones(len(starts), bool)
    rows, held, tail = [], 0, None
    for i in np.flatnonzero(counts).tolist():
        at, to = int(starts[i]), int(nexts[i])
        if to == OPEN or what[i] is None:
            tail = at if tail is None else tail
            rows.append((_OPEN if to == OPEN else _FAR, file, block, at + shift, None if to == OPEN else to + shift, *empty))
        else:
            own = _record_fields(what[i], data, compress)
            rows.append((_CANDIDATE, file, block, at + shift, to + shift, *(own or empty)))
            held += len(own[-1]) if own else 0
        if held > 4 << 20:
            yield emit(rows)
            rows, held = [], 0
    if tail is not None:
        rows.append((_TAIL, file, block, tail + shift, None, *empty[:-1], data[tail:]))
    if rows:
        yield emit(rows)


def _scan(mark: bytes, compress: bool):
    """Pieces between marks, in the order of a split -> rows of ``_found``, and the size of each split. Holds one split's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            file, block = place
            # A later split begins right behind a mark, which the split before counts.
            lead = b"" if block == 0 else mark
            yield from _found(lead + mark.join(parts), file, block, -len(lead), compress)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((_SIZE, file, block, 0, sum(map(len, parts)) + len(parts) * len(mark), *(None,) * 7), _SCAN_ARROW.types, strict=True)], schema=_SCAN_ARROW)

        place, parts = None, []
        for batch in batches:
            for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if place != (file, block):
                    if place:
                        yield from close()
                    place, parts = (file, block), []
                parts.append(value.as_py())
        if place:
            yield from close()

    return run


def _joined_pieces(pieces: pa.Table, mark: bytes) -> bytes:
    """A later split's bytes from its pieces: a mark before each."""
    return b"".join(mark + x for x in pieces.sort_by("nth").column("value").to_pylist())


def _continue(mark: bytes, compress: bool):
    """Tails of splits with the pieces of the split behind each: open candidates are looked at again."""

    def run(tails: pa.Table, pieces: pa.Table) -> pa.Table:
        more, out = _joined_pieces(pieces, mark), []
        for t in tails.to_pylist():
            opens = np.array(sorted(t["opens"]), np.int64) - t["at"]
            out += _found(t["payload"] + more, t["file"], t["block"], t["at"], compress, opens)
        return pa.Table.from_batches(out, schema=_SCAN_ARROW)

    return run


def _assemble(mark: bytes):
    """Records that end beyond their split, with the bytes of the next one: the record, or what is there so far."""

    def run(far: pa.Table, pieces: pa.Table) -> pa.Table:
        more, out = _joined_pieces(pieces, mark), []
        for r in far.to_pylist():
            data, size = r["payload"] + more, r["next"] - r["at"]
            row = {k: r[k] for k in ("file", "block", "at", "next")}
            if len(data) < size:
                out.append(row | {"kind": _FAR, "payload": data})
            elif (found := plain_candidate(data[:size], 0))[1]:
                out.append(row | {"kind": _CANDIDATE} | dict(zip(_SCAN_ARROW.names[5:], _record_fields(found[1], data, False), strict=True)))
        return pa.Table.from_pylist(out, schema=_SCAN_ARROW)

    return run


def _pieces(spark: SparkSession, path: str, mark: bytes) -> DataFrame:
    """What stands between marks, as the text reader splits files: value, file, and where the split begins."""
    text = spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "part-*").text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


#: False candidates up to which their places are broadcast.
FEW = 100_000


def read_warc(spark: SparkSession, path: str, compress: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of each record in the files ``part-*`` below ``path``.

    Tasks read files split by split, and write down each place that looks like a record, with its successor; in a file's first split they
    follow the chain from byte 0 themselves. Where files have several splits, a candidate's chain is followed to the end of its split, and from
    split to split by jumping pointers in joins on (file, offset); what no chain from byte 0 reaches is no record. A candidate that
    goes on beyond its split is looked at again with the bytes of the next one, as often as needed.

    Digests of responses are made anew from their payloads. A file whose first bytes are no record gives none, and neither does what follows a broken
    record. With ``compress``, records are gzip members; files named .gz would be decompressed by the reader, and are plain then.
    """
    ship(spark)
    mark = GZIP if compress else VERSION
    # All of a file's splits are cut alike in each scan, as sizes and settings are the same.
    seen = stash(_pieces(spark, path, mark).mapInArrow(_scan(mark, compress), _SCAN), "scan")
    names = [c.split()[0] for c in _FIELDS.split(", ")]
    records = seen.where(F.col("kind") == _CANDIDATE).where("record_type is not null").select(*names)
    if not seen.where((F.col("kind") == _SIZE) & (F.col("block") > 0)).limit(1).count():
        return records
    by = Window.partitionBy("file").orderBy("block")  # one row for each split
    splits = seen.where(F.col("kind") == _SIZE).select("file", "block", F.col("next").alias("size"))
    splits = stash(splits.select("file", "block", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("block").over(by).alias("after")), "splits")
    placed = seen.where(F.col("kind") != _SIZE).join(splits.select("file", "block", "base"), ["file", "block"])
    found = [stash(placed.withColumn("at", F.col("at") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).drop("base"), "placed")]
    at_block = splits.select("file", "block", "after")
    # Candidates without an end in their split: with the split behind, then with the one behind that.
    while found[-1].where(F.col("kind") == _OPEN).limit(1).count():
        tails = found[-1].where(F.col("kind") == _TAIL).select("file", "block", "at", "payload")
        opens = found[-1].where(F.col("kind") == _OPEN).groupBy("file", "block").agg(F.collect_list("at").alias("opens"))
        tails = tails.join(opens, ["file", "block"]).join(at_block, ["file", "block"]).where("after is not null")
        wanted = tails.select("file", F.col("after").alias("block")).distinct()
        some = _pieces(spark, path, mark).withColumn("nth", F.monotonically_increasing_id()).join(wanted, ["file", "block"], "left_semi")
        # In what comes back, the last split that was looked at stands as the block; a candidate stays where it began by its offset.
        again = tails.select("file", F.col("after").alias("block"), "at", "payload", "opens").groupBy("file", "block").cogroup(some.groupBy("file", "block")).applyInArrow(_continue(mark, compress), _SCAN)
        found.append(stash(again, "placed"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    nodes = every.where(F.col("kind").isin(_CANDIDATE, _FAR)).select("file", "at", "next").distinct()
    # The split that a candidate begins in, by its offset: splits of a file are few.
    starts = splits.groupBy("file").agg(F.sort_array(F.collect_list("base")).alias("bases"))
    nodes = stash(nodes.join(starts, "file").withColumn("split", F.expr(f"size(filter(bases, b -> b - {len(mark)} <= at))")).drop("bases"), "nodes")

    def leave(rows):
        rows = rows.sort_values("at")
        rows["next"] = exits(rows["at"].to_numpy(), rows["next"].to_numpy())
        return rows[["file", "at", "next"]]

    jump = stash(nodes.groupBy("file", "split").applyInPandas(leave, "file string, at long, next long"), "jump")
    reached = stash(nodes.where("at = 0").select("file", "at"), "reached")
    count = reached.count()
    while True:
        new = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        reached = stash(reached.unionAll(new).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        jump = stash(jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file and a.next = b.at")).select("a.file", "a.at", "b.next"), "jump")

    def walk(rows):
        rows = rows.sort_values("at")
        seen_ = reachable(rows["at"].to_numpy(), rows["next"].to_numpy(), rows.loc[rows["entry"], "at"].to_numpy())
        return rows.loc[~seen_, ["file", "at"]]

    marked = nodes.join(reached.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    false = stash(marked.groupBy("file", "split").applyInPandas(walk, "file string, at long"), "false")
    records = every.where(F.col("kind") == _CANDIDATE).where("record_type is not null")
    not_false = F.broadcast(false) if false.limit(FEW + 1).count() <= FEW else false
    out = records.join(not_false, ["file", "at"], "left_anti").select(*names)
    # Records that the chain reaches and that end beyond their split, one of a split at most: put together split by split.
    far = every.where(F.col("kind") == _FAR).select("file", "block", "at", "next").join(not_false, ["file", "at"], "left_anti")
    tails = every.where(F.col("kind") == _TAIL).select("file", "block", F.col("at").alias("from"), "payload")
    far = far.join(tails, ["file", "block"]).withColumn("payload", F.expr("substring(payload, cast(at - from + 1 as int), length(payload))")).drop("from")
    far = stash(far.join(at_block, ["file", "block"]).where("after is not null").select("file", F.col("after").alias("block"), "at", "next", "payload"), "far")
    while far.limit(1).count():
        wanted = far.select("file", "block").distinct()
        some = _pieces(spark, path, mark).withColumn("nth", F.monotonically_increasing_id()).join(wanted, ["file", "block"], "left_semi")
        # A later split begins right behind a mark.
        made = stash(far.groupBy("file", "block").cogroup(some.groupBy("file", "block")).applyInArrow(_assemble(mark), _SCAN), "made")
        out = out.unionByName(made.where((F.col("kind") == _CANDIDATE) & F.col("record_type").isNotNull()).select(*names))
        far = made.where(F.col("kind") == _FAR).join(at_block, ["file", "block"]).where("after is not null")
        far = stash(far.select("file", F.col("after").alias("block"), "at", "next", "payload"), "far")
    return out


def round_trip(pages: DataFrame, compress: bool = True, **columns: str) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path, compress, **columns)
    return read_warc(spark, path, compress)
