"""WARC archives of web pages, with a two-level capture index.

Writing: each task writes its pages, in the order in which it reads them, to archive files of its own in the shared folder, one gzip member for
each record, so that a record can be read without the rest. Of pages with equal payloads one is a response, the others are revisits
that name it. No payload is shuffled as long as the repeated payloads' hashes fit a broadcast; beyond that one shuffle joins them.

Index: keys are URLs with the host reversed, so a site's captures stand together. Sorted lines (key, page, file, offset, length) are
cut into blocks, each a gzip member of an index file. The directory holds each block's first key and its place; it is kept sparse by larger
blocks, so that it always fits a broadcast.

Reading: a lookup searches the directory by bisection, reads the blocks' ranges, searches these, and gives places in archives;
places sorted by file and offset are read in ranges, those that touch in one. Files are named by the task that wrote them, and only rows of
tasks that Spark commits name files, so tasks may run again or twice: what a lost one left behind, nothing reads.

Files are written and read through ``pyarrow.fs``, so the shared folder may be any that it opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, shared_dir, written

#: Repeated payloads that are broadcast at most (about 100 bytes each), lines of a block at least, entries of the directory (about 200 bytes each) at most.
BROADCAST_ROWS, BLOCK_LINES, DIRECTORY_ROWS = 200_000, 3000, 200_000
#: Bytes after which a task begins another archive, bytes read at once, blocks that a task keeps.
ARCHIVE_BYTES, RANGE_BYTES, KEPT_BLOCKS = 1 << 30, 8 << 20, 4
#: Bytes of archives that a task reads at least, and the most tasks of one reading.
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000
#: Words of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)(?::(\d*))?([^#]*)"
_NAMES = uuid.UUID("6f1c2a9e-52d6-4b0a-9f0a-3c4b5d6e7f80")
_PLACE = "file string, offset long, length long"


def url_key(url: Column) -> Column:
    """The URL with its host reversed (``com,example)/path?query``): no scheme, user, ``www``, default port or fragment. A null one is empty; one without a host stays as it is."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\d*\.(?=.*\.)", "")
    turned = F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    port, rest = F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host == "", url).otherwise(F.concat(turned, port, F.lit(")"), path))


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_name(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}|{digest}')}>"


def record(page, url, payload: bytes, refers_to=None) -> bytes:
    """A WARC record: a response, or with ``refers_to`` a revisit of that page's response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = urllib.parse.quote(url, safe="!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") if url else f"urn:x-page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if value}


def parsed(data: bytes) -> dict | None:
    """What a record says of its page; none if it is of another type. The digest of a response is computed from its payload, ``intact`` tells whether the header has the same."""
    head, _, rest = data.partition(b"\r\n\r\n")
    told = _headers(head)
    if told.get("warc-type") not in ("response", "revisit"):
        return None
    block = rest[: int(told["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(_headers(http).get("content-length", len(payload)))
    digest = told.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda name: int(told[name]) if name in told else None
    out = {"page_id": number("x-page-id"), "url": told.get("warc-target-uri"), "record_type": told["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": full, "payload_digest": digest, "payload": None, "intact": None}
    if told["warc-type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out |= {"payload": payload, "payload_digest": own, "payload_bytes": len(payload), "intact": own == digest and len(payload) == full}
    return out


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"
_TYPES = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "intact": pa.bool_()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _TYPES.items()], list(_TYPES))


def _archives(folder: str):
    """Pages (key, id, url, payload, refers_to) written to archives of this task: (key, id, file, offset, length) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places: list[tuple] = []
                for page, url, payload, first in zip(*(batch.column(n).to_pylist() for n in ("id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, info = store.open_output_stream(f"{top}/{name}", compression=None), b"software: parcelkit\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        packed = _member(head.encode() + info + b"\r\n\r\n")
                        out.write(packed)
                        at = len(packed)
                    packed = _member(record(page, url, payload, first))
                    out.write(packed)
                    places.append((name, at, len(packed)))
                    at += len(packed)
                columns = list(zip(*places, strict=True)) if places else [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["key", "id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


_ESCAPED, _PLAIN = {"%": "%25", "\t": "%09", "\n": "%0A"}, {"%25": "%", "%09": "\t", "%0A": "\n"}


def _line(key: str, page, file: str, offset: int, length: int) -> str:
    for a, b in _ESCAPED.items():
        key = key.replace(a, b)
    return f"{key}\t{'' if page is None else page}\t{file}\t{offset}\t{length}\n"


def _lines(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """The block's (key, page) in order, and each one's (file, offset, length)."""
    keys, places = [], []
    for x in zlib.decompress(data, 31).decode().split("\n")[:-1]:
        key, page, file, offset, length = x.split("\t")
        for b in ("%09", "%0A", "%25"):
            key = key.replace(b, _PLAIN[b])
        keys.append((key.encode(), *_page(int(page) if page else None)))
        places.append((file, int(offset), int(length)))
    return keys, places


def _page(page) -> tuple[int, int]:
    """Sorts pages as Spark does: null first."""
    return (0, 0) if page is None else (1, page)


def _blocks(folder: str, lines: int):
    """Sorted captures written to an index file of this task: first key and page, file, offset, length and lines of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        name, out, at = f"{uuid.uuid4().hex}.cdx.gz", None, 0
        held: list[tuple] = []
        rows: list[tuple] = []
        try:
            for more in _and_end(batches):
                if more is not None:
                    held += zip(*(more.column(n).to_pylist() for n in ("key", "id", "file", "offset", "length")), strict=True)
                while held and (len(held) >= lines or more is None):
                    block, held = held[:lines], held[lines:]
                    packed = _member("".join(_line(*x) for x in block).encode())
                    out = out or store.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(packed)
                    rows.append((block[0][0], block[0][1], name, at, len(packed), len(block)))
                    at += len(packed)
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["key", "id", "file", "offset", "length", "lines"])

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _search(folder: str, sent):
    """Queries (key, id, any_page), sorted as a rule: the places of the captures that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        firsts, where = sent.value
        kept: dict[int, tuple] = {}
        files: dict = {}

        def block(b: int) -> tuple[list[tuple], list[tuple]]:
            if b not in kept:
                while len(kept) >= KEPT_BLOCKS:
                    kept.pop(next(iter(kept)))
                file, offset, length = where[b]
                if file not in files:
                    files.clear()
                    files[file] = store.open_input_file(f"{top}/{file}")
                kept[b] = _lines(files[file].read_at(length, offset))
            return kept[b]

        for batch in batches:
            found: list[tuple] = []
            for key, page, every in zip(*(batch.column(n).to_pylist() for n in ("key", "id", "any_page")), strict=True):
                low = (key.encode(),) if every else (key.encode(), *_page(page))
                high = (key.encode(), 2) if every else low
                b = max(0, bisect.bisect_left(firsts, low) - 1)
                while b < len(firsts) and firsts[b] <= high:
                    keys, places = block(b)
                    found += places[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]
                    b += 1
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["file", "offset", "length"])

    return run


def _read(folder: str):
    """Records at places sorted by file and offset; ranges that touch are read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(places):
                file, begin, length = places[at]
                end, to = begin + length, at + 1
                while to < len(places) and places[to][:2] == (file, end) and end - begin < RANGE_BYTES:
                    end += places[to][2]
                    to += 1
                if file != name:
                    name, source = file, store.open_input_file(f"{top}/{file}")
                data = source.read_at(end - begin, begin)
                rows = [parsed(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in places[at:to]]
                yield _batch([r for r in rows if r])
                at = to

    return run


def _walk(folder: str):
    """All records of archives named by ``file``, from first to last, as any reader of the format finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(f"{top}/{file}", compression=None) as source:
                    rest = source.read(RANGE_BYTES)
                    while rest:
                        packer, data = zlib.decompressobj(31), b""
                        while True:
                            data += packer.decompress(rest)
                            if packer.eof:
                                break
                            if not (rest := source.read(RANGE_BYTES)):
                                raise ValueError(f"{file} ends inside a record")
                        rest = packer.unused_data or source.read(RANGE_BYTES)
                        if row := parsed(data):
                            yield _batch([row])

    return run


class Archive:
    """Archives of a table of pages with their capture index, in one folder."""

    def __init__(self, spark: SparkSession, folder: str, captures: DataFrame, directory: DataFrame, size: int) -> None:
        self.spark, self.folder, self.captures, self.directory, self.size = spark, folder, captures, directory, size
        rows = sorted(((r["key"].encode(), *_page(r["id"])), (r["file"], r["offset"], r["length"])) for r in directory.collect())
        self._sent = spark.sparkContext.broadcast(([k for k, _ in rows], [w for _, w in rows]))

    def places(self, queries: DataFrame) -> DataFrame:
        """(file, offset, length) of the captures that ``queries`` (key, id, any_page) name: a page of a URL, or with any_page all of the URL's. Each query counts once."""
        ordered = queries.select("key", "id", "any_page").distinct().repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        return ordered.mapInArrow(_search(self.folder, self._sent), _PLACE)

    def records(self, places: DataFrame, size: int | None = None) -> DataFrame:
        """The records at ``places``, each as often as it stands there. ``size``: bytes of these records, if known; places are so small that Spark would put too many into a task."""
        tasks = [] if size is None else [min(MOST_TASKS, 1 + size // TASK_BYTES)]
        return places.repartitionByRange(*tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(self.folder), RECORD)

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """All captures of the URLs (by their keys, so without regard to scheme, www or fragment); unknown ones give nothing."""
        queries = urls.select(url_key(F.col(url_col)).alias("key"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("any_page"))
        return self.records(self.places(queries).distinct())

    def pages(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """The captures of these pages, by id and URL."""
        return self.records(self.places(pages.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).cast("long").alias("id"), F.lit(False).alias("any_page"))), self.size)

    def every_record(self) -> DataFrame:
        """All records, archive by archive, without the index."""
        return self.captures.select("file").distinct().repartition("file").mapInArrow(_walk(self.folder), RECORD)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> Archive:
    """Write ``pages`` as WARC archives with their index into the shared folder.

    Payloads are the html in UTF-8; a null one is empty. Of pages with equal payloads of at least ``least`` bytes that of the smallest id is
    a response and the others revisit it; all smaller ones are responses. Rows that share that smallest id are all responses; so are rows with a null
    id, unless a row with an id has their payload. Repeated rows give a record each. A null URL has an empty key. Other columns are ignored; an empty table gives no files.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, top = _opened(folder)
    store.create_dir(top, recursive=True)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", url_key(F.col("url"))).withColumn("hash", F.unhex(F.sha2("payload", 256)))
    again = rows.where(F.octet_length("payload") >= least).groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = written(again.select("hash", "first"), "payloads")
    told = rows.join(again.hint("broadcast" if again.count() <= BROADCAST_ROWS else "merge"), "hash", "left")
    revisits = F.when((F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    told = told.select("key", "id", "url", "payload", revisits.alias("refers_to"))
    captures = written(told.mapInArrow(_archives(folder), f"key string, id long, {_PLACE}"), "captures")
    forget(again)
    n, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    lines = max(BLOCK_LINES, -(-n // DIRECTORY_ROWS))
    order = ["key", "id", "file", "offset"]
    directory = written(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(folder, lines), f"key string, id long, {_PLACE}, lines long"), "directory")
    return Archive(spark, folder, captures, directory, size)
