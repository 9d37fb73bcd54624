"""WARC archives with a two-level capture index.

Writing: every task writes gzip members, one per record, to archives of its own in the shared folder and returns where
each record lies.  Records with equal payloads of at least ``REVISIT_BYTES`` are written once; the others revisit it.

Index, level one: capture lines sorted by reversed-host URL key (and page id), in compressed blocks of ``BLOCK_LINES``
lines.  Level two: a sparse directory with the first and last key of each block and where the block lies.  A look-up
bisects the directory, reads one block (a range read), bisects its lines and reads the record (another range read).
Many look-ups at once do the same in tasks: the first keys of up to ``FENCES`` blocks, sorted, are what every task
bisects; beyond as many, they are those of blocks chosen by hash, and a join finds the blocks between two of them.
Reading everything back deals the directory out to tasks; a task reads its blocks and then its records.

A file's name holds its task attempt, and only the attempt that Spark commits is named in the written tables; what a
lost executor left behind is never read.  Payloads are taken for equal if their SHA-1 and length are.

Defined results: a null html is an empty payload.  A null url is kept as an empty URL with key ``)/``.  Of equal large
payloads, rows that repeat the largest page_id are all responses.  Rows without a page_id are responses.  An empty
table gives an empty archive.  A very long html is one record, held once by the task that writes or reads it.  Further
columns of ``pages`` are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, new_path, small, text_batches

REVISIT_BYTES, BLOCK_LINES, FILE_BYTES, FENCES = 1000, 3000, 1 << 30, 100_000
CAPTURED = "2020-01-01T00:00:00Z"
_LINE_BYTES = 600  # of an index partition's share, roughly


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.org:80/x?y#z -> org,a,www)/x?y"""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # not a URL: the whole text is the path
        return ")/" + quote(url or "", safe="/:?#=&%")
    if not host:
        return ")/" + quote((url or "").strip().lstrip("/"), safe="/:?#=&%")
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = quote(parts.path or "/", safe="/:@!$&'()*+,;=%~")
    return ",".join(reversed(host.split("."))) + port_text + ")" + path + (f"?{quote(parts.query, safe='/:@!$&()*+,;=%~?')}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: quote(m[0]), url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


class Capture(NamedTuple):
    page_id: int | None
    url: str
    kind: str
    digest: str  # as the header says
    length: int  # of the full payload
    payload: bytes  # empty for a revisit
    refers_to: int | None


def _id(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def parse(member: bytes) -> Capture:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return Capture(_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), length, payload, _id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Out:
    """A file of this task attempt, made when first written to."""

    def __init__(self, folder: str, kind: str):
        task = TaskContext.get()
        self.store, self.root = _store(folder)
        self.stem, self.kind, self.n, self.at, self.file, self.name = f"{task.partitionId():05d}-{task.taskAttemptId()}", kind, 0, 0, None, ""

    def write(self, data: bytes) -> tuple[str, int]:
        if self.file is None or self.at > FILE_BYTES:
            self.close()
            self.name, self.at = f"{self.stem}-{self.n}.{self.kind}", 0
            self.file, self.n = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None), self.n + 1
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _record_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(folder, "warc.gz")
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                member = record(page, url, payload, digest, refers)
                rows.append((surt(url), page, *out.write(member), len(member)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "page_id", "file", "at", "size"])
        out.close()

    return run


def _block_writer(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _Out(folder, "cdx.z"), []

        def block(part: list[tuple]) -> tuple:
            body = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in row) for row in part).encode())
            return part[0][0], part[-1][0], *out.write(body), len(body), len(part)

        def table(blocks: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], k) for i, k in enumerate(kinds)], ["first", "last", "file", "at", "size", "lines"])

        for batch in batches:
            held += list(zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size")), strict=True))
            whole = len(held) // lines * lines
            if whole:
                yield table([block(held[i : i + lines]) for i in range(0, whole, lines)])
                held = held[whole:]
        if held:
            yield table([block(held)])
        out.close()

    return run


class Archive(NamedTuple):
    folder: str
    directory: DataFrame  # first, last, file, at, size, lines: one row per block


def write_archive(pages: DataFrame, block_lines: int = BLOCK_LINES) -> Archive:
    """Records and index of every row of ``pages`` (page_id, url, html) in a new folder below the shared one."""
    spark = pages.sparkSession
    text_batches(spark)
    folder = new_path(spark, "warc")
    _make(folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("_n", F.length("payload"))
    large = F.length("payload") >= REVISIT_BYTES
    shared = cut(rows.where(large).groupBy("digest", "_n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "_n", "top"), "shared")
    n_shared = shared.count()
    refers = F.when(large & (F.col("page_id") != F.col("top")), F.col("top"))
    typed = rows.join(small(shared, n_shared), ["digest", "_n"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to")) if n_shared else rows.drop("_n").withColumn("refers_to", F.lit(None).cast("long"))
    lines = cut(typed.mapInArrow(_record_writer(folder), "key string, page_id long, file string, at long, size long"), "captures")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // block_lines)))
    ordered = lines.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    directory = cut(ordered.mapInArrow(_block_writer(folder, block_lines), "first string, last string, file string, at long, size long, lines long"), "directory")
    return Archive(folder, directory)


def _make(folder: str) -> None:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)


def _range(store: fs.FileSystem, root: str, open_files: dict, name: str, at: int, size: int) -> bytes:
    if name not in open_files:
        if len(open_files) >= 64:
            open_files.pop(next(iter(open_files))).close()
        open_files[name] = store.open_input_file(f"{root}/{name}")
    return open_files[name].read_at(size, at)


def _lines(block: bytes) -> list[tuple[str, str, str, int, int]]:
    return [(k, p, f, int(a), int(s)) for k, p, f, a, s in (x.split("\t") for x in zlib.decompress(block).decode().split("\n"))]


def lookup(archive: Archive, url: str) -> list[Capture]:
    """All captures of a URL: bisection of the directory (up to ``FENCES`` blocks, else by ``search``), range read of the blocks that can hold it, bisection, range reads."""
    key, out = surt(url), []
    n = archive.directory.count()
    near = archive.directory.where((F.col("first") <= key) & (F.col("last") >= key)) if n > FENCES else archive.directory
    directory = sorted(tuple(r) for r in near.select("first", "last", "file", "at", "size").collect())
    store, root = _store(archive.folder)
    files: dict = {}
    i = bisect.bisect_right(directory, key, key=lambda b: b[0])
    while i and directory[i - 1][1] >= key:
        i -= 1
        lines = _lines(_range(store, root, files, *directory[i][2:]))
        out += [parse(_range(store, root, files, *line[2:])) for line in _of_key(lines, key)]
    for f in files.values():
        f.close()
    return out


def _of_key(lines: list[tuple], key: str) -> list[tuple]:
    """Of a block's lines, which are sorted."""
    lo, hi = (side(lines, key, key=lambda x: x[0]) for side in (bisect.bisect_left, bisect.bisect_right))
    return lines[lo:hi]


_FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(captures: list[Capture]) -> pa.RecordBatch:
    rows = []
    for c in captures:
        digest = hashlib.sha1(c.payload).hexdigest() if c.kind == "response" else c.digest
        if digest != c.digest:
            raise ValueError(f"record of page {c.page_id}: its payload has digest {digest}, its header says {c.digest}")
        rows.append((c.page_id, c.url, len(c.payload) if c.kind == "response" else c.length, digest, c.kind, c.refers_to))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        files: dict = {}
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                lines = sorted(_lines(_range(store, root, files, name, at, size)), key=lambda x: x[2:4])
                yield _rows([parse(_range(store, root, files, *line[2:])) for line in lines])
        for f in files.values():
            f.close()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string())], ["key"])


def _cells(spread, columns: tuple[str, ...]):
    """Adds, for each of the columns, between which of the sorted fences its key lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fences = spread.value
        for batch in batches:
            cells = [pa.array([bisect.bisect_right(fences, k) for k in batch.column(c).to_pylist()], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, *[f"{c}_cell" for c in columns]])

    return run


def _searcher(folder: str):
    """Rows come sorted by block and key; one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        files: dict = {}
        block, lines = None, []
        for batch in batches:
            for name, at, size, key in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size", "key")), strict=True):
                if block != (name, at):
                    block, lines = (name, at), _lines(_range(store, root, files, name, at, size))
                if own := _of_key(lines, key):
                    yield _rows([parse(_range(store, root, files, *line[2:])) for line in own])
        for f in files.values():
            f.close()

    return run


def search(archive: Archive, urls: DataFrame) -> DataFrame:
    """The captures of all URLs in the column ``url``, each once: a bisection of the directory for every key, then range reads block by block."""
    spark = urls.sparkSession
    text_batches(spark)
    n = archive.directory.count()
    chosen = archive.directory if n <= FENCES else archive.directory.where(F.pmod(F.xxhash64("file", "at"), F.lit(-(-2 * n // FENCES))) == 0)
    fences = spark.sparkContext.broadcast(sorted(r["first"] for r in chosen.select("first").distinct().collect()))  # some FENCES keys at most
    keys = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(_keys, "key string").distinct()
    asked = keys.mapInArrow(_cells(fences, ("key",)), "key string, key_cell long")
    blocks = archive.directory.select("first", "last", "file", "at", "size").mapInArrow(_cells(fences, ("first", "last")), "first string, last string, file string, at long, size long, first_cell long, last_cell long")
    blocks = blocks.select("first", "last", "file", "at", "size", F.explode(F.sequence("first_cell", "last_cell")).alias("key_cell"))
    hits = asked.join(small(blocks, n), "key_cell").where("first <= key and key <= last").select("file", "at", "size", "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(parts, "file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(_searcher(archive.folder), _FOUND)


def read_archive(archive: Archive) -> DataFrame:
    """Every record, through the index; payload digests are checked."""
    parts = int(archive.directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = archive.directory.select("file", "at", "size").repartition(parts)
    return dealt.mapInArrow(_reader(archive.folder), _FOUND)
