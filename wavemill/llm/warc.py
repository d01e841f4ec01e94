"""WARC archives with a two-level capture index.

Records are written as gzip members, one per page, and located through an index
of reversed-host URL keys: sorted lines in compressed blocks, and a sparse
directory of the blocks' first keys. A lookup searches the directory, then one
block, then reads the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import broadcast_if_small, materialize, utf8, work_dir

#: Equal payloads shorter than this are stored again rather than referred to.
MIN_REVISIT = 1000
_ENTRY = "key string, page_id long, file string, offset long, length long, bytes long"
_ENTRY_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.int64())])
_FOUND = "page_id long, file string, offset long, length long, bytes long"


def surt(url: str | None) -> str:
    """Reversed-host form of a URL without scheme and fragment: ``com,example,www)/path?query``."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of one capture: the URL key, then the page id as fixed-width text (null first)."""
    return f"{surt(url)} " + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


#: Capture date of records whose pages carry none; the table has no date, and a fixed one keeps archives repeatable.
CAPTURE_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(kind: str, name: str, fields: list[str], body: bytes, date: str) -> bytes:
    """One record as a gzip member; its id follows from the file and the place in it, so it is unique."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", *fields, f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def info_record(name: str, date: str = CAPTURE_DATE) -> bytes:
    """The record that opens an archive."""
    return _member("warcinfo", name, [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: wavemill\r\nformat: WARC File Format 1.1\r\n", date)


def _uri(url: str | None) -> str:
    return quote(url or "urn:page:none", safe="%/:=&?~#+!$,;'@()*[]")


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None, date: str = CAPTURE_DATE) -> bytes:
    """One page's record (``name``: file and place), an HTTP response; with ``refers_to`` a revisit without payload.

    The digest is written in base 32, as archives have it. Page ids are fields
    of their own, as they need not be unique.
    """
    fields = [
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _member("response", name, fields, http + payload, date)
    again = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    return _member("revisit", name, [*fields, *again], http, date)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record: what follows the HTTP head, or the whole block if it has none."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k: v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["Content-Type"].startswith("application/http") else block


def _open(uri: str):
    """The file system of a folder any executor can reach, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def with_record_types(pages: DataFrame, *, min_revisit: int = MIN_REVISIT, small_rows: int = 200_000) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to, refers_url): null ``refers_to`` means response.

    Payload groups are pre-aggregated and only those that occur repeatedly are
    joined back; they are broadcast if counted to be few.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(utf8("html"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    groups = materialize(
        rows.where(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("m"))
        .where("n > 1 and m.page_id is not null")
        .select("digest", F.col("m.page_id").alias("response"), F.col("m.url").alias("refers_url"))
    )
    joined = rows.join(broadcast_if_small(groups, small_rows), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response")), F.lit(None)).otherwise(F.col("response")).alias("refers_to"), "refers_url")


def write_archives(pages: DataFrame, folder: str, *, min_revisit: int = MIN_REVISIT, max_bytes: int = 256 << 20, date: str = CAPTURE_DATE) -> DataFrame:
    """Write one record per page under ``folder`` and return the written table of index entries.

    Every task attempt writes files of its own name, and only the entries of
    attempts that Spark commits reach the table, so a lost executor leaves at
    most files that nothing refers to. Null html is an empty payload. Repeated
    rows are repeated records; of equal rows with the largest page id each is a
    response.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):  # one row at a time: payloads are not all copied to Python at once
                    r = {c: batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")}
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, first = system.open_output_stream(f"{path}/{name}", compression=None), info_record(name, date)
                        out.write(first)
                        at = len(first)
                    member = record(f"{name}/{at}", r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers_url"], date)
                    out.write(member)
                    rows.append({"key": capture_key(r["url"], r["page_id"]), "page_id": r["page_id"], "file": name, "offset": at, "length": len(member), "bytes": len(r["payload"])})
                    at += len(member)
                    if at >= max_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)
        finally:
            if out is not None:
                out.close()

    return materialize(with_record_types(pages, min_revisit=min_revisit).mapInArrow(write, _ENTRY))


def build_index(entries: DataFrame, *, block_lines: int = 1000, part_rows: int = 100_000) -> DataFrame:
    """Blocks (part, block, first_key, data): sorted index lines, compressed, ``block_lines`` to a block.

    Entries are range-partitioned by key. The key ends in the page id, so a host
    or URL that holds much of the table is still split over parts.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def flush(lines: list[dict]) -> pa.RecordBatch:
            text = "\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"], r["bytes"]]) for r in lines)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "first_key": [lines[0]["key"]], "data": [zlib.compress(text.encode())]})

        for batch in batches:
            held.extend(batch.to_pylist())
            while len(held) >= block_lines:
                yield flush(held[:block_lines])
                held, number = held[block_lines:], number + 1
        if held:
            yield flush(held)

    parts = max(1, -(-entries.count() // part_rows))
    ordered = entries.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return materialize(ordered.mapInArrow(blocks, "part int, block int, first_key string, data binary"))


def find_captures(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries (page_id, file, offset, length, bytes of payload) of the distinct keys in column ``key``.

    The top directory has one row per index part. Keys are sent to their part,
    whose blocks and block directory meet them there.
    """
    tops = sorted((r["k"], r["part"]) for r in blocks.groupBy("part").agg(F.min("first_key").alias("k")).collect())  # one row per index part
    firsts, parts = [k for k, _ in tops], [p for _, p in tops]

    @F.pandas_udf(T.IntegerType())
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: parts[max(0, bisect.bisect_right(firsts, k) - 1)])

    def search(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("block")
        directory, data = held["first_key"].tolist(), held["data"].tolist()
        found: list[tuple] = []
        at, lines, keys_of = -1, [], []
        for key in sorted(wanted["key"]):
            k = max(0, bisect.bisect_left(directory, key) - 1)  # equal keys may begin in the block before
            while k < len(directory) and directory[k] <= key:
                if k != at:
                    lines = [json.loads(x) for x in zlib.decompress(data[k]).decode().split("\n")]
                    keys_of, at = [x[0] for x in lines], k
                i = bisect.bisect_left(keys_of, key)
                while i < len(lines) and keys_of[i] == key:
                    found.append(tuple(lines[i][1:]))
                    i += 1
                k += 1
        out = pd.DataFrame(found, columns=["page_id", "file", "offset", "length", "bytes"])
        return out.astype({"page_id": "Int64", "offset": "int64", "length": "int64", "bytes": "int64"})

    if not tops:
        return keys.sparkSession.createDataFrame([], _FOUND)
    placed = keys.distinct().withColumn("part", part_of("key"))
    return placed.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(search, _FOUND)


def read_captures(found: DataFrame, folder: str, *, part_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) by range reads.

    A response's length and digest are those of the payload read back; a
    revisit's are those its record states of the full payload. Entries are
    written, and dealt by file and place into as many tasks as their records
    have ``part_bytes`` of bytes, or as many as a shuffle has.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows, size = [], 0
                for r in batch.to_pylist():
                    if r["file"] != name:
                        if source is not None:
                            source.close()
                        name, source = r["file"], system.open_input_file(f"{path}/{r['file']}")
                    source.seek(r["offset"])
                    fields, body = parse(gzip.decompress(source.read(r["length"])))
                    full = fields["WARC-Type"] == "response"
                    rows.append({
                        "page_id": number(fields["X-Page-ID"]),
                        "payload_bytes": len(body) if full else int(fields["X-Payload-Length"]),
                        "payload_digest": hashlib.sha1(body).hexdigest() if full else base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
                        "record_type": fields["WARC-Type"],
                        "refers_to": number(fields.get("X-Refers-To-Page")),
                        "payload": body if full else None,
                    })
                    size += len(body)
                    if size >= part_bytes:  # payloads are handed on before they fill the worker
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if source is not None:
                source.close()

    found = materialize(found)
    total = found.agg(F.coalesce(F.sum(F.col("length") + F.col("bytes")), F.lit(0))).first()[0]
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // part_bytes))
    ordered = found.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, *, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages, index the archives, look every page up and read it back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Null urls and ids are indexed like others; null html is an empty
    payload; html of any length is one record, held by its task alone; repeated
    rows are records of their own, and each is read once; of equal payloads with
    the largest id every row is a response; an empty table gives an empty
    result; further columns are not read.
    """
    folder = folder or work_dir(pages.sparkSession)
    entries = write_archives(pages, folder, min_revisit=min_revisit)
    index = build_index(entries)

    @F.pandas_udf(T.StringType())
    def key(url: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if i is None else int(i)) for u, i in zip(url, page_id)], dtype=object)

    # ids travel as text: pandas would turn nullable longs into floats
    wanted = pages.select(key(F.col("url").cast("string"), F.col("page_id").cast("long").cast("string")).alias("key"))
    return read_captures(find_captures(index, wanted), folder).drop("payload")
