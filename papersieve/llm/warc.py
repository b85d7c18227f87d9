"""WARC archives with a two-level capture index.

Writers put one gzip member per record into archive files and report where each record lies. The
index sorts captures by reversed-host URL key and page: range partitions become shard files of
compressed blocks of lines, each closed by a sparse directory of its blocks' first keys. A request
goes to the shard whose key range covers it, finds its block by binary search in the directory,
reads that block alone, and then the byte ranges of its records, archive by archive in order of
offset.

Files are named by the attempt that writes them, and only files named in a committed manifest are
ever read, so a task that is run again leaves at most a file nobody refers to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.common import look_up
from papersieve.session import materialize

#: An archive file is closed once it holds so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Lines of a compressed index block.
BLOCK_LINES = 3000
#: Byte ranges of one archive no farther apart than GAP are read at once, up to READ_BYTES.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Capture date of tables that have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    """Where an archive set lies: its folder, and (file, first key, first page, last key, last page) of every index shard."""

    folder: str
    shards: list[tuple]


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder or file."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def clean_url(url: str) -> str:
    """The URL with control characters and spaces escaped, as it stands in headers and keys."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host parts reversed, then port, path and query; other strings stand for themselves.

    http://www.Example.com:80/a?b becomes com,example,www:80)/a?b. A null URL has the empty key.
    """
    if url is None:
        return ""
    url = clean_url(url)
    try:
        split = urlsplit(url)
        host = split.hostname
        port = f":{split.port}" if split.port is not None else ""
    except ValueError:
        return url
    if not host:
        return url
    rest = (split.path or "/") + (f"?{split.query}" if split.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + rest


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(of))}>"


def capture_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, keeper: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response's page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Record-ID", _urn(page_id, url, digest, revisit)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", clean_url(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return _record("response", headers, http + payload)
    headers.append(("WARC-Profile", PROFILE))
    if keeper is not None:
        headers.append(("X-Refers-To-Page-ID", str(keeper)))
    return _record("revisit", headers, http)


def parse_record(member: bytes) -> dict:
    """Type, page, URL, digest, payload and payload size of a record; the payload of a response must fit its digest."""
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    size = next((int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), len(payload))
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


def _decided(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, payload, keeper, copies): which page holds the payload of each row; equal keepers meet in one row."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("content", F.sha2("payload", 256))
    shared = (
        rows.groupBy("content", "page_id", "url").agg(F.count("*").alias("copies"))
        .groupBy("content").agg(F.max(F.struct("page_id", "url", "copies")).alias("keeper"), F.sum("copies").alias("rows"))
        .filter("rows > 1")
    )
    shared = materialize(shared)
    rows = look_up(rows, shared, "content", "keeper", "rows", "page_id")
    if not shared.filter("keeper.copies > 1").isEmpty():
        repeat = (
            (F.col("keeper.copies") > 1) & F.col("page_id").eqNullSafe(F.col("keeper.page_id")) & F.col("url").eqNullSafe(F.col("keeper.url"))
        )
        repeat = F.coalesce(repeat, F.lit(False))
        once = rows.filter(repeat).groupBy("page_id", "url", "content").agg(
            F.first("payload").alias("payload"), F.first("keeper").alias("keeper"), F.count("*").alias("copies")
        )
        rows = rows.filter(~repeat).withColumn("copies", F.lit(1).cast("long")).unionByName(once)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    return rows.select("page_id", "url", "payload", "keeper", "copies")


class _Writer:
    """Archive files of one task attempt."""

    def __init__(self, folder: str):
        self.fs, self.folder = place(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stream = None

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.offset >= ARCHIVE_BYTES:
            self.close()
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            info = _record("warcinfo", [("WARC-Record-ID", _urn(self.name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self.stream.write(info)
            self.offset = len(info)
        at = self.offset
        self.stream.write(member)
        self.offset += len(member)
        return self.name, at, len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row below ``folder``/archives; (key, page_id, file, offset, length) of every record.

    Of rows with equal payloads that with the largest page_id (then URL) is a response, the others
    are revisits of it; of wholly equal rows one. Payloads meet by SHA-256 and only as digests; where
    more payloads are shared than may be broadcast, rows meet their keeper in a join that spreads hot
    payloads.
    """
    archives = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(archives)
        for batch in batches:
            found = []
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                keeper, own = row["keeper"], (row["page_id"], row["url"])
                first = keeper is None or own == (keeper["page_id"], keeper["url"])
                for copy in range(row["copies"]):
                    revisit = not first or copy > 0
                    member = capture_record(*own, row["payload"], revisit, keeper["page_id"] if revisit else None)
                    found.append((url_key(row["url"]), row["page_id"], *writer.add(member)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])],
                ["key", "page_id", "file", "offset", "length"],
            )
        writer.close()

    schema = "key string, page_id long, file string, offset long, length long"
    _decided(pages, page_id, url, html).mapInArrow(write, schema).write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(schema).parquet(f"{folder}/captures")


def _order(key: str, page_id: int | None) -> tuple:
    """Index order: by key, then page, null first, as Spark sorts them."""
    return key, page_id is not None, page_id or 0


def build_index(captures: DataFrame, folder: str) -> Archive:
    """Sort captures into index shards below ``folder``/index; the driver keeps one row per shard.

    Captures of one URL are told apart by page and place, so a URL with very many captures spreads
    over shards like any other keys.
    """
    index = f"{folder}/index"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = stream = None
        held: list[tuple] = []
        directory: list[tuple] = []
        offset, first, last = 0, None, None

        def flush():
            nonlocal offset
            text = "".join(f"{k}\t{'-' if p is None else p}\t{f}\t{o}\t{n}\n" for k, p, f, o, n in held)
            packed = zlib.compress(text.encode())
            directory.append((held[0][0], held[0][1], offset, len(packed)))
            stream.write(packed)
            offset += len(packed)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    store, path = place(index)
                    store.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.cdx.z"
                    stream = store.open_output_stream(f"{path}/{name}", compression=None)
                    first = row
                held.append(row)
                last = row
                if len(held) == BLOCK_LINES:
                    flush()
        if stream is not None:
            if held:
                flush()
            footer = zlib.compress("".join(f"{k}\t{'-' if p is None else p}\t{o}\t{n}\n" for k, p, o, n in directory).encode())
            stream.write(footer + struct.pack("<q", len(footer)))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_key": first[0], "first_page": first[1], "last_key": last[0], "last_page": last[1]}], schema=pa.schema([
                ("file", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()),
            ]))

    columns = ["key", "page_id", "file", "offset"]
    (
        captures.select(*columns, "length").repartitionByRange(*columns).sortWithinPartitions(*columns)
        .mapInArrow(write, "file string, first_key string, first_page long, last_key string, last_page long")
        .write.parquet(f"{folder}/shards")
    )
    rows = captures.sparkSession.read.parquet(f"{folder}/shards").collect()
    return Archive(folder, sorted((tuple(r) for r in rows), key=lambda s: _order(s[1], s[2])))


class _Shard:
    """Reads blocks of one index shard; holds its directory and the block read last."""

    def __init__(self, uri: str):
        store, path = place(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<q", self.file.read_at(8, size - 8))
        lines = zlib.decompress(self.file.read_at(n, size - 8 - n)).decode().split("\n")[:-1]
        self.blocks = [(k, None if p == "-" else int(p), int(o), int(m)) for k, p, o, m in (x.split("\t") for x in lines)]
        self.keys = [_order(k, p) for k, p, *_ in self.blocks]
        self.held, self.entries = -1, []

    def block(self, i: int) -> list[tuple]:
        if i != self.held:
            _, _, offset, length = self.blocks[i]
            lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")[:-1]
            self.entries = [
                (k, None if p == "-" else int(p), f, int(o), int(n)) for k, p, f, o, n in (x.split("\t") for x in lines)
            ]
            self.orders, self.held = [_order(k, p) for k, p, *_ in self.entries], i
        return self.entries

    def find(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """Entries between two places of the order, both included."""
        i = max(0, bisect.bisect_left(self.keys, low) - 1)
        while i < len(self.blocks) and self.keys[i] <= high:
            entries = self.block(i)
            for j in range(bisect.bisect_left(self.orders, low), bisect.bisect_right(self.orders, high)):
                yield entries[j]
            i += 1


def locate(archive: Archive, requests: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of the captures of ``requests`` (key string, page_id long, any_page boolean).

    A request for any page of a key may span shards and goes to each of them.
    """
    shards = archive.shards
    firsts = [_order(s[1], s[2]) for s in shards]
    lasts = [_order(s[3], s[4]) for s in shards]
    after = ("", 2, 0)  # behind all pages of a key

    def bounds(key: str, page: int | None, any_page: bool) -> tuple[tuple, tuple]:
        return ((key, False, 0), (key, *after[1:])) if any_page else (_order(key, page), _order(key, page))

    def route(batches):
        for batch in batches:
            rows = []
            for key, page, any_page in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = bounds(key, page, any_page)
                rows += [(s, key, page, any_page) for s in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int32(), pa.string(), pa.int64(), pa.bool_()])],
                ["shard", "key", "page_id", "any_page"],
            )

    def search(batches):
        at, shard = None, None
        for batch in batches:
            found = []
            for s, key, page, any_page in zip(*(c.to_pylist() for c in batch.columns)):
                if s != at:
                    at, shard = s, _Shard(f"{archive.folder}/index/{shards[s][0]}")
                found += shard.find(*bounds(key, page, any_page))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])],
                ["key", "page_id", "file", "offset", "length"],
            )

    return (
        requests.select("key", "page_id", "any_page").distinct()
        .mapInArrow(route, "shard int, key string, page_id long, any_page boolean")
        .repartition("shard").sortWithinPartitions("shard", "key", "page_id")
        .mapInArrow(search, "key string, page_id long, file string, offset long, length long")
    )


def read_records(archive: Archive, located: DataFrame, payload: bool = True) -> DataFrame:
    """The parsed records at the given places: an archive's ranges are read by one task in order, near ones together."""
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else []),
    ]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (
        ", payload binary" if payload else ""
    )

    def runs(batches) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, run = None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                end = run[-1][0] + run[-1][1] if run else 0
                if run and (file, offset) == (name, run[-1][0]):  # asked for twice
                    continue
                if run and (file != name or offset > end + GAP or offset + length - run[0][0] > READ_BYTES):
                    yield name, run
                    run = []
                name = file
                run.append((offset, length))
        if run:
            yield name, run

    def read(batches):
        at = file = None
        for name, run in runs(batches):
            if name != at:
                store, path = place(f"{archive.folder}/archives/{name}")
                at, file = name, store.open_input_file(path)
            start = run[0][0]
            raw = file.read_at(run[-1][0] + run[-1][1] - start, start)
            rows = [parse_record(raw[o - start : o - start + n]) for o, n in run]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])

    return located.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Archives and index of ``pages`` below ``folder``, which all executors must reach by pyarrow's file systems."""
    return build_index(write_archives(pages, folder, page_id, url, html), folder)


def keys(urls: DataFrame, url: str = "url", page_id: str | None = None) -> DataFrame:
    """Requests for the captures of URLs, or of pages of URLs where ``page_id`` names their column."""

    def make(batches):
        for batch in batches:
            found = [url_key(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), batch.column("page_id"), pa.array([page_id is None] * len(found), pa.bool_())],
                ["key", "page_id", "any_page"],
            )

    page = F.col(page_id) if page_id else F.lit(None)
    return urls.select(F.col(url).cast("string").alias("url"), page.cast("long").alias("page_id")).mapInArrow(
        make, "key string, page_id long, any_page boolean"
    )


def fetch(spark: SparkSession, archive: Archive, requests: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``requests`` (see ``keys``), each once: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    return read_records(archive, locate(archive, requests), payload)


def archive_round_trip(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row, then look up and read back every page: a row per row of ``pages``.

    A null html is an empty payload; empty payloads are payloads like others. A null page_id is
    smaller than all ids and is refers_to null where it is the response; a null URL has no target
    and the empty key. Repeated rows have a record each. Very long texts travel one record at a
    time within a batch. Other columns of the input are not read; an empty table gives no rows.
    """
    archive = write_archive(pages, folder, page_id, url, html)
    return fetch(pages.sparkSession, archive, keys(pages, url, page_id), payload=False)
