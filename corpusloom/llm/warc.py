"""WARC archives with a two-level capture index.

Records are gzip members, so each can be read by itself. A payload that occurs again is
written once, as the response of its smallest page_id; the other captures are revisit
records that refer to it. The index is sorted by URL key (reversed host, then path): its
lines stand in compressed blocks, and each index file ends with a sparse directory of its
blocks' first keys. A look-up searches the index files' first keys, then a directory, by
halving, and reads one range of the index and one of an archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, file_system, left_join_hot, new_dir, staged

#: Index lines of a block, captures of an index file, and bytes read at once.
BLOCK_LINES, INDEX_CAPTURES, READ_BYTES = 256, 250_000, 4 << 20
#: Rows after which a look-up hands its batch on.
BATCH_ROWS = 4096
#: The tables have no capture time.
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of a URL; its own text where it has no host.

    A URL and what ``quote`` makes of it in a record have one key: the host is lower-cased
    without its escapes and then quoted.
    """
    url = url or ""
    _, found, rest = url.partition("://")
    if not found:
        return quote(url, safe="%/?#=&:,;@!$'()*+~[]") + ")"
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = unquote(rest[:cut].rpartition("@")[2], errors="surrogateescape").lower()
    host, port = quote(host.encode(errors="surrogateescape"), safe=":[]=&,;@!$'()*+~"), ""
    name, colon, digits = host.rpartition(":")
    if colon and digits.isdigit():
        host, port = name, ":" + digits
    return ",".join(reversed(host.split("."))) + port + ")" + quote(rest[cut:] or "/", safe="%/?#=&:,;@!$'()*+~[]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: str, url: str | None, digest: str, payload: bytes, size: int, refers_to: str | None, refers_url: str | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    safe = "%/?#=&:,;@!$'()*+~[]"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=safe)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {quote(refers_url or '', safe=safe)}", f"WARC-Refers-To-Date: {DATE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes

    @classmethod
    def parse(cls, member: bytes) -> Record:
        raw = zlib.decompress(member, 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(headers["Content-Length"])]
        if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        return cls(headers, block.partition(b"\r\n\r\n")[2])

    def page(self, header: str) -> str:
        return self.headers[header].removeprefix("<urn:page:").removesuffix(">")


CAPTURE = "key string, page_id string, kind string, digest string, path string, offset long, length long"
_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``out``.

    Returns a row per capture: its key and its place. Of equal payloads of at least
    ``least_bytes`` the rows with the smallest page_id are responses (all of them, should
    that id repeat), the others revisits; without any page_id all are responses. A null
    html is an empty payload.
    """
    store, at = file_system(out)
    store.create_dir(at, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("sha"))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    firsts = staged(firsts, "first-copies")
    again = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull()) & (F.length("payload") >= least_bytes)
    # Copies of one payload are not dealt to one task.
    rows = left_join_hot(rows, firsts, "sha", pages.count(), F.xxhash64("page_id", "url")).withColumn("again", F.coalesce(again, F.lit(False)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    rows = rows.select(text("page_id"), "url", "sha", F.length("payload").alias("size"), F.when(~F.col("again"), F.col("payload")).alias("payload"), F.when(F.col("again"), text("first_id")).alias("first_id"), "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, place = f"{out}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            found = []
            for r in b.to_pylist():
                if f is None:
                    store, at = file_system(path)
                    f = store.open_output_stream(at, compression=None)
                kind = "response" if r["first_id"] is None else "revisit"
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                raw = record(kind, r["page_id"], r["url"], digest, r["payload"] or b"", r["size"], r["first_id"], r["first_url"])
                f.write(raw)
                found.append({"key": url_key(r["url"]), "page_id": r["page_id"], "kind": kind, "digest": digest, "path": path, "offset": place, "length": len(raw)})
                place += len(raw)
            yield pa.RecordBatch.from_pylist(found, _CAPTURE)
        if f is not None:
            f.close()

    arrow_batches(pages.sparkSession)
    return staged(rows.mapInArrow(write, CAPTURE), "captures")


_DIR = struct.Struct("<QQ4s")


def _index_block(lines: list[str]) -> bytes:
    return zlib.compress("\n".join(lines).encode(), 6)


def _tail(place: int, size: int) -> bytes:
    return _DIR.pack(place, size, b"ZDIR")


def write_index(captures: DataFrame, out: str, block_lines: int = BLOCK_LINES, file_captures: int = INDEX_CAPTURES) -> DataFrame:
    """Sort the captures by key into index files; return a row per file: its first and last key."""
    spark = captures.sparkSession
    n = max(1, -(-captures.count() // file_captures), min(spark.sparkContext.defaultParallelism, captures.count() // block_lines))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, place, blocks, lines, first, last = f"{out}/{uuid.uuid4().hex}.cdxz", None, 0, [], [], None, None
        for b in batches:
            for r in b.to_pylist():
                if f is None:
                    store, at = file_system(path)
                    f = store.open_output_stream(at, compression=None)
                    first = r["key"]
                if not lines:
                    blocks.append((r["key"], place))
                last = r["key"]
                lines.append(f"{r['key']} {DATE} " + json.dumps({k: r[k] for k in ("page_id", "kind", "digest", "path", "offset", "length")}))
                if len(lines) == block_lines:
                    place += f.write(raw := _index_block(lines)) or len(raw)
                    lines = []
        if lines:
            place += f.write(raw := _index_block(lines)) or len(raw)
        if f is not None:
            directory = _index_block([f"{k} {p}" for k, p in blocks])
            f.write(directory + _tail(place, len(directory)))
            f.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_key": first, "last_key": last, "n_blocks": len(blocks)}])

    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return staged(ordered.mapInArrow(write, "path string, first_key string, last_key string, n_blocks long"), "capture-index")


class IndexFile:
    """An index file: its sparse directory is read once, a block only when it is asked for."""

    def __init__(self, path: str):
        self.store, self.at = file_system(path)
        with self.store.open_input_file(self.at) as f:
            f.seek(f.size() - _DIR.size)
            place, size, magic = _DIR.unpack(f.read(_DIR.size))
            if magic != b"ZDIR":
                raise ValueError(f"{path} is no capture index")
            f.seek(place)
            entries = [x.rsplit(" ", 1) for x in zlib.decompress(f.read(size)).decode().split("\n")]
        self.keys = [k for k, _ in entries]
        self.starts = [int(p) for _, p in entries] + [place]

    def block(self, k: int) -> Iterator[tuple[str, dict]]:
        with self.store.open_input_file(self.at) as f:
            f.seek(self.starts[k])
            raw = zlib.decompress(f.read(self.starts[k + 1] - self.starts[k]))
        for line in raw.decode().split("\n"):
            key, _, body = line.split(" ", 2)
            yield key, json.loads(body)

    def blocks_of(self, key: str) -> range:
        """The blocks that may hold captures of a key. They may begin in the block before the first that starts with it."""
        return range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key))


def _captures(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, _CAPTURE)


def scan_index(files: DataFrame) -> DataFrame:
    """All captures, by blocks of the index."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n in zip(b.column("path").to_pylist(), b.column("n_blocks").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"path": [path] * n, "block": list(range(n))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, IndexFile] = {}
        for b in batches:
            for path, k in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                if path not in opened:
                    opened = {path: IndexFile(path)}
                yield _captures([{"key": key, **c} for key, c in opened[path].block(k)])

    wanted = files.select("path", "n_blocks").mapInArrow(blocks, "path string, block long")
    return wanted.repartitionByRange(files.sparkSession.sparkContext.defaultParallelism, "path", "block").mapInArrow(read, CAPTURE)


def look_up(files: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of each distinct key of the column ``url`` of ``urls``, by halving; other blocks of the index stay unread.

    The first keys of the index files go to every task: one short row for INDEX_CAPTURES captures.
    A key's blocks are dealt out to all tasks, so one with many captures is not one task's work.
    """
    spark = files.sparkSession
    top = sorted((r["first_key"], r["last_key"], r["path"]) for r in files.select("first_key", "last_key", "path").collect())
    held = spark.sparkContext.broadcast(top)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": [url_key(url) for url in b.column("url").to_pylist()]}, pa.schema([("key", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held.value
        firsts, opened = [t[0] for t in top], {}

        def places(key: str) -> Iterator[tuple[str, int, str]]:
            k = bisect.bisect_right(firsts, key) - 1
            while k >= 0 and top[k][1] >= key:
                path = top[k][2]
                if path not in opened:
                    if len(opened) >= 8:
                        opened.clear()
                    opened[path] = IndexFile(path)
                yield from ((path, n, key) for n in opened[path].blocks_of(key))
                if top[k][0] < key:
                    break
                k -= 1

        every = (x for b in batches for key in b.column("key").to_pylist() for x in places(key))
        while found := list(itertools.islice(every, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["path", "block", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, lines, found = None, None, {}, []
        for b in batches:
            for path, k, key in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("key").to_pylist(), strict=True):
                if at != (path, k):
                    if at is None or at[0] != path:
                        file = IndexFile(path)
                    at, lines = (path, k), {}
                    for own, c in file.block(k):
                        lines.setdefault(own, []).append({"key": own, **c})
                found += lines.get(key, ())
                if len(found) >= BATCH_ROWS:
                    yield _captures(found)
                    found = []
        yield _captures(found)

    wanted = urls.select("url").mapInArrow(keys, "key string").distinct().mapInArrow(find, "path string, block long, key string")
    dealt = wanted.repartition(4 * spark.sparkContext.defaultParallelism, "path", "block").sortWithinPartitions("path", "block")
    return dealt.mapInArrow(read, CAPTURE)


RECORD = "page_id string, kind string, payload_bytes long, payload_digest string, refers_to string, refers_url string"


def read_records(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at the captures' places, read in ranges of neighbours.

    Size and digest are those of the payload that was read; a revisit has none, its are null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            places = list(zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
            out, k = [], 0
            while k < len(places):
                start, end = places[k][1], places[k][1] + places[k][2]
                m = k + 1
                while m < len(places) and places[m][0] == places[k][0] and places[m][1] == end and end - start < READ_BYTES:
                    end += places[m][2]
                    m += 1
                if places[k][0] != path:
                    if f is not None:
                        f.close()
                    path = places[k][0]
                    store, at = file_system(path)
                    f = store.open_input_file(at)
                f.seek(start)
                raw = f.read(end - start)
                for _, offset, length in places[k:m]:
                    r = Record.parse(raw[offset - start : offset - start + length])
                    kind, own = r.headers["WARC-Type"], {"payload_bytes": None, "payload_digest": None, "refers_to": None, "refers_url": None}
                    if kind == "response":
                        own |= {"payload_bytes": len(r.payload), "payload_digest": base32_sha1(r.payload)}
                        if "sha1:" + own["payload_digest"] != r.headers["WARC-Payload-Digest"]:
                            raise ValueError(f"{path}: a payload is damaged")
                    else:
                        own |= {"payload_digest": r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": r.page("WARC-Refers-To"), "refers_url": r.headers["WARC-Refers-To-Target-URI"]}
                    out.append({"page_id": r.page("WARC-Record-ID"), "kind": kind} | own | ({"payload": r.payload} if payloads else {}))
                k = m
            names = [("page_id", pa.string()), ("kind", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("refers_url", pa.string())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(names + [("payload", pa.binary())] * payloads))
        if f is not None:
            f.close()

    n = captures.sparkSession.sparkContext.defaultParallelism
    places = captures.select("path", "offset", "length").repartitionByRange(4 * n, "path", "offset").sortWithinPartitions("path", "offset")
    return places.mapInArrow(read, RECORD + ", payload binary" * payloads)


def round_trip(pages: DataFrame, out: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and read every record back through the index.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to. What a
    revisit says of its payload is taken from the response that it refers to, which is
    looked up by its URL. Repeated rows are written and returned each.
    """
    spark = pages.sparkSession
    out = out or new_dir(spark, "warc")
    files = write_index(write_archives(pages, out, least_bytes), out)
    records = staged(read_records(scan_index(files)), "records")
    revisits = records.where("kind = 'revisit'")
    targets = look_up(files, revisits.select(F.col("refers_url").alias("url")))
    wanted = revisits.select(F.col("refers_to").alias("page_id"), F.col("payload_digest").alias("digest")).distinct()
    targets = targets.where("kind = 'response'").join(wanted, ["page_id", "digest"], "left_semi")
    first = read_records(targets).select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).dropDuplicates(["refers_to", "payload_digest"])
    pair = F.concat_ws(" ", "refers_to", "payload_digest").alias("pair")
    revisits = revisits.select("*", pair)
    often = revisits.groupBy("pair").agg(F.count("*").alias("n"))
    first = first.select(pair, "size").join(often, "pair")
    resolved = left_join_hot(revisits, first, "pair", records.count(), F.xxhash64("page_id")).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "kind", "refers_to")
    whole = records.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").unionByName(resolved)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind).alias(c)
    return whole.select(number("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to"))
