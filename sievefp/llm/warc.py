"""WARC archives through a chunked record table.

Writing: a record is written header first, then its payload in slices, so that no second
copy of a payload is made; each record is a gzip member of its own.  A task writes one
archive into a shared folder and reports segments (path, offset, length) that start at
record borders.  Reading: a segment is decompressed as a stream and each payload comes out
as rows (record_id, chunk_no, chunk, ...) that carry the digest and length of the payload so
far; no more than one chunk of it is held, however long the payload is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefp.llm.common import new_path, shuffles, stored

CHUNK = 1 << 18
SEGMENT = 1 << 23
_DATE = "2024-01-01T00:00:00Z"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder's address."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def mark_revisits(pages: DataFrame, id: str = "page_id", payload: str = "html", least: int = 100) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is the
    response and the others revisit it; smaller payloads are all responses.  A null payload
    is empty.  Rows that repeat the smallest id are all responses; a null id revisits unless
    all its equals have null ids too.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    known = pages.withColumns({"payload_digest": F.sha2(body, 256), "payload_bytes": F.octet_length(body).cast("long")})
    first = stored(
        known.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min(id).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"),
        "warc-copies",
    )
    both = known.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col(id).eqNullSafe(F.col("_first"))
    return both.withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))}
    ).drop("_digest", "_first")


def _urn(value: str | None) -> str:
    return "urn:no-page" if value is None else f"urn:page:{quote(value, safe='')}"


def _page(value: str) -> str | None:
    """The page id in a record's name; null for none."""
    name = value.strip("<>").partition("#")[0]
    return unquote(name[9:]) if name.startswith("urn:page:") else None


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


class _Archive:
    """An archive that is being written: gzip members one after another."""

    def __init__(self, folder: str):
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.at = self.many = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def record(self, page, url, kind, first, digest: str, payload: memoryview) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        stored_payload = payload if kind == "response" else payload[:0]
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page)}#{self.name[:32]}-{self.many}>", f"WARC-Date: {_DATE}"]
        if url is not None:
            head.append(f"WARC-Target-URI: {_line(url)}")
        head.append(f"WARC-Payload-Digest: sha256:{digest}")
        if kind == "revisit":
            head += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: <{_urn(first)}>"]
        head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(stored_payload)}"]
        self.many += 1  # rows that repeat an id are records of their own names
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(member.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http))
        for i in range(0, len(stored_payload), CHUNK):
            self._put(member.compress(stored_payload[i : i + CHUNK]))
        self._put(member.compress(b"\r\n\r\n") + member.flush())

    def close(self) -> None:
        self.out.close()


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One record for each row of mark_revisits' result; (path, offset, length, records) of
    the segments written.  An archive that a lost or repeated task left is not listed."""
    wanted = pages.select(F.col(id).cast("string"), url, "record_type", F.col("refers_to").cast("string"), "payload_digest", payload)

    def write(batches):
        archive, segments, start, records = None, [], 0, 0
        for batch in batches:
            ids, urls, kinds, firsts, digests = (batch.column(i).to_pylist() for i in range(5))
            for i, body in enumerate(batch.column(5)):
                archive = archive or _Archive(folder)
                buffer = body.as_buffer() if body.is_valid else None
                archive.record(ids[i], urls[i], kinds[i], firsts[i], digests[i], memoryview(buffer) if buffer is not None else memoryview(b""))
                records += 1
                if archive.at - start >= SEGMENT:
                    segments.append((archive.name, start, archive.at - start, records))
                    start, records = archive.at, 0
        if archive:
            if records:
                segments.append((archive.name, start, archive.at - start, records))
            archive.close()
            columns = list(zip(*segments))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n in columns[0]]), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["path", "offset", "length", "records"],
            )

    return stored(wanted.mapInArrow(write, "path string, offset long, length long, records long"), "warc-segments")


class _Stream:
    """The decompressed bytes of a segment's gzip members, read a little at a time."""

    def __init__(self, source, length: int):
        self.source, self.left, self.held, self.member = source, length, b"", zlib.decompressobj(31)

    def _more(self) -> bytes:
        while True:
            if self.member.eof:
                rest, self.member = self.member.unused_data, zlib.decompressobj(31)
            else:
                rest = self.member.unconsumed_tail
            if not rest:
                if not self.left:
                    return b""
                rest = self.source.read(min(self.left, 1 << 16))
                if not rest:
                    raise EOFError("an archive ends within a segment")
                self.left -= len(rest)
            if data := self.member.decompress(rest, CHUNK):
                return data

    def some(self, most: int) -> bytes:
        """1 to most bytes; none at the end."""
        data = self.held or self._more()
        self.held = data[most:]
        return data[:most]

    def line(self) -> bytes | None:
        """The next line without its CR LF; None at the end."""
        data = self.held
        while (i := data.find(b"\n")) < 0:
            more = self._more()
            if not more:
                if data:
                    raise EOFError("a record ends within its header")
                return None
            data += more
        self.held = data[i + 1 :]
        return data[:i].rstrip(b"\r")

    def fields(self) -> dict[str, str] | None:
        out = {}
        while (line := self.line()) is not None:
            if line:
                name, _, value = line.partition(b":")
                out[name.decode().lower()] = value.strip().decode()
            elif out:
                return out
        return None


def records(stream: _Stream):
    """(header, HTTP header, iterator of payload chunks) of each record; take the chunks first."""
    while (head := stream.fields()) is not None:
        left = int(head["content-length"])
        http_lines, http = 0, {}
        while (line := stream.line()) is not None:
            left -= len(line) + 2
            http_lines += 1
            if not line:
                break
            name, _, value = line.partition(b":")
            http[name.decode().lower()] = value.strip().decode()

        def chunks(left=left):
            while left:
                piece = stream.some(min(left, CHUNK))
                if not piece:
                    raise EOFError("a record ends within its payload")
                left -= len(piece)
                yield piece

        yield head, http, chunks()


_CHUNK_ROW = "record_id string, record_type string, refers_to string, url string, header_digest string, header_bytes long, chunk_no int, chunk binary, last boolean, bytes_so_far long, sha256_so_far string"


def read_chunks(spark: SparkSession, segments: DataFrame, chunks: bool = True) -> DataFrame:
    """The chunked record table of the segments: a row for each chunk of each payload.

    A record without payload has one row with an empty chunk.  bytes_so_far and
    sha256_so_far are of the payload up to and with the row's chunk; the row with ``last``
    has those of the whole.  With chunks=False only last rows come, with null chunks.
    """
    names = [c.split()[0] for c in _CHUNK_ROW.split(", ")]
    schema = pa.schema(
        [(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _CHUNK_ROW.split(", "))]
    )

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                files, inner = filesystem(path)
                with files.open_input_file(inner) as source:
                    source.seek(offset)
                    for head, http, pieces in records(_Stream(source, length)):
                        digest, size, n, before = hashlib.sha256(), 0, 0, b""
                        known = [
                            _page(head["warc-record-id"]), head["warc-type"], _page(head.get("warc-refers-to", "")), head.get("warc-target-uri"),
                            head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]),
                        ]
                        for piece in pieces:
                            if n and chunks:
                                rows.append([*known, n - 1, before, False, size, digest.hexdigest()])
                                held += len(before)
                            digest.update(piece)
                            size, n, before = size + len(piece), n + 1, piece
                            if held > 1 << 24:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                                rows, held = [], 0
                        rows.append([*known, max(n - 1, 0), before if chunks else None, True, size, digest.hexdigest()])
                        held += 300 + len(before) * chunks
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)

    return segments.select("path", "offset", "length").repartition(shuffles(spark)).mapInArrow(read, _CHUNK_ROW)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes every page to WARC archives and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    The result comes from the chunk table: length and digest of a response are those that its
    last chunk row carries, and must be its header's.  A revisit has no payload; what its
    header says must be what the response it refers to was read with.  Else the job fails.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    segments = write_archives(mark_revisits(pages), new_path(spark, "warc"))
    rows = read_chunks(spark, segments).filter("last").drop("chunk")
    rows = stored(rows, "warc-records")
    response = F.col("record_type") == "response"
    sound = (F.col("sha256_so_far") == F.col("header_digest")) & (F.col("bytes_so_far") == F.col("header_bytes"))
    fail = F.raise_error(F.lit("a payload differs from its header"))
    responses = rows.filter(response).withColumn("payload_digest", F.when(~sound, fail.cast("string")).otherwise(F.col("sha256_so_far")))
    revisited = responses.join(rows.filter(~response).select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    met = revisited.select(F.col("record_id").alias("refers_to"), F.col("sha256_so_far").alias("digest"), F.col("bytes_so_far").alias("bytes")).distinct()
    again = rows.filter(~response).join(met, (rows["refers_to"] == met["refers_to"]) & (F.col("header_digest") == F.col("digest")) & (F.col("header_bytes") == F.col("bytes")), "left")
    again = again.withColumn("payload_digest", F.when(F.col("digest").isNull(), F.raise_error(F.lit("a revisit differs from its response")).cast("string")).otherwise(F.col("digest")))
    shown = lambda df, size: df.select(F.col("record_id").cast(kind).alias("page_id"), F.col(size).alias("payload_bytes"), "payload_digest", "record_type", rows["refers_to"].cast(kind).alias("refers_to"))
    return shown(responses, "bytes_so_far").unionByName(shown(again, "bytes"))


#: DuckDB SQL of archive_digests over pages.
ORACLE = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p where n >= 100 group by h)
select page_id, n as payload_bytes, p.h as payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f on p.h = f.h and p.n >= 100
"""
