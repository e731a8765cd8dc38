"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, field, lean, packed, partitions, table, unpacked

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:millrace:page:"
PIECE = 1 << 18


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_head(page_id, url, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """The WARC header and the HTTP header of a record; a revisit ends with the latter."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if kind == 'revisit' else size)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def mark_revisits(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """`pages` with payload, payload_bytes, payload_digest, record_type and refers_to (which replace columns
    so named). Only digests that occur more than once are joined back, a small table; payloads move only
    if that table is too large to broadcast, and then the skew join splits a digest that many pages share."""
    made = ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole, given = packed(pages, made)
    raw, page = F.coalesce(F.col(field(pages, html_col)), F.lit("")).cast("binary"), F.col(field(pages, id_col))
    rows = whole.select("row", raw.alias("payload"), F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha2(raw, 256).alias("payload_digest"))
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min(page).alias("_first")).where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first")
    rows = rows.join(same, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~page.eqNullSafe(F.col("_first"))
    return rows.select(*unpacked(pages, given), "payload", "payload_bytes", "payload_digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Writes the rows of mark_revisits as WARC files that are one gzip stream each, and returns (archive,
    records). A task writes its rows as they come and begins another file after `archive_bytes`; names are
    unique to the attempt, and only the files that a finished attempt returned count."""

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = gz = None
        written = n = 0
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.write(gz.flush())
                out.close()
                done.append((name, n))
                out = None

        for b in batches:
            cols = [b.column(c) for c in ("page", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for k in range(b.num_rows):
                page, url, payload, digest, kind, first = (c[k].as_py() for c in cols)
                if out is None:
                    name, gz, written, n = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                body = record_head(page, url, len(payload), digest, kind, first, date) + (b"" if kind == "revisit" else payload) + b"\r\n\r\n"
                out.write(gz.compress(body))
                written, n = written + len(body), n + 1
                if written >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["archive", "records"]), preserve_index=False)

    lean(records.sparkSession)
    return records.select(column(id_col).alias("page"), column(url_col).alias("url"), "payload", "payload_digest", "record_type", "refers_to").mapInArrow(run, "archive string, records long")


class _Stream:
    """Inflates a file once from front to back, through all its members, holding one piece."""

    def __init__(self, source):
        self.source, self.gz, self.buffer, self.at, self.over = source, zlib.decompressobj(31), b"", 0, False

    def more(self) -> bool:
        while not self.over:
            rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            raw = rest or self.source.read(PIECE)
            if not raw:
                self.over = True
                break
            if got := self.gz.decompress(raw, 4 * PIECE):
                self.buffer, self.at = self.buffer[self.at :] + got, 0
                return True
        return False

    def head(self) -> bytes:
        """The next record's header, with its empty line; empty at the end."""
        while len(self.buffer) - self.at < 2 or self.buffer.startswith(b"\r\n", self.at):
            if len(self.buffer) - self.at >= 2:
                self.at += 2
            elif not self.more():
                return b""
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                raise ValueError("a record's header is cut off")
        head, self.at = self.buffer[self.at : end + 4], end + 4
        return head

    def body(self, size: int):
        while size:
            if len(self.buffer) == self.at and not self.more():
                raise ValueError("a record is cut off")
            part = self.buffer[self.at : self.at + size]
            self.at, size = self.at + len(part), size - len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites each archive of `source` (whatever its members) so that every record is its own gzip member,
    with a sidecar <archive>.idx of one JSON line per record (offset, length, id, type), and returns
    (archive, records). An archive is inflated once, as a stream; no record is held whole. Files appear
    under names unique to the attempt, so a task that runs again disturbs nothing."""

    def run(batches):
        import pyarrow as pa

        store, base = _open(source)
        sink, into = _open(target)
        sink.create_dir(into, recursive=True)
        for b in batches:
            for name in b.column("archive").to_pylist():
                new, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, sink.open_output_stream(f"{into}/{new}", compression=None) as out, sink.open_output_stream(f"{into}/{new}.idx", compression=None) as index:
                    stream = _Stream(raw)
                    while head := stream.head():
                        fields, gz, start = _fields(head), zlib.compressobj(level, zlib.DEFLATED, 31), at
                        parts = (head,), stream.body(int(fields["content-length"])), (b"\r\n\r\n",)
                        for part in (x for group in parts for x in group):
                            if packed := gz.compress(part):
                                out.write(packed)
                                at += len(packed)
                        out.write(tail := gz.flush())
                        at, n = at + len(tail), n + 1
                        index.write((json.dumps({"offset": start, "length": at - start, "id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n").encode())
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], names=["archive", "records"])

    lean(archives.sparkSession)
    return archives.mapInArrow(run, "archive string, records long")


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Reads normalised archives back, record by record at the offsets of the sidecar index: page_id, url,
    record_type, payload (null for revisits, or if not `with_payload`), payload_bytes and payload_digest
    of the full payload, refers_to. A payload that doesn't fit its digest raises."""

    def page(x):
        v = x.strip("<>").removeprefix(URN) if x else "null"
        return None if v == "null" else int(v)

    def run(batches):
        import pyarrow as pa

        store, base = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}") as f, store.open_input_stream(f"{base}/{name}.idx", compression=None) as index:
                    for line in index.read().decode().splitlines():
                        at = json.loads(line)
                        f.seek(at["offset"])
                        record = zlib.decompress(f.read(at["length"]), 31)
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = _fields(head)
                        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if kind != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {at['offset']}: the payload doesn't fit its digest")
                        keep = with_payload and kind != "revisit"
                        rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, payload if keep else None, size, digest, page(fields.get("warc-refers-to"))))
                        held += len(payload) if keep else 100
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    lean(archives.sparkSession)
    return archives.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes one WARC record for each row of `pages` (page_id long, url, html) under `folder` and returns the
    table (archive, records) of the normalised archives there, for read_archives.

    Of records with equal payloads of at least `min_bytes`, the one with the smallest page_id is a response
    and the others revisit it; smaller ones are all responses. Null html is an empty payload; a null url has
    no target; a null page_id is read back as null and never revisited, unless all equal ones are null, when
    all are responses. Repeated rows are records of their own; rows that share the smallest page_id are all
    responses. Urls are percent-encoded where the header needs it. An empty table gives no archive.

    Files are written first as the tasks' rows come, one gzip stream each, then normalised; the streams are
    deleted once every normalised file is listed. `folder` must be one that executors share.
    """
    spark = pages.sparkSession
    work = Scratch(spark, "warc")
    mono = work.write(write_monolithic(mark_revisits(pages, min_bytes), work.path("mono"), archive_bytes), "written")
    # One task for a few archives: files are large, their list is small.
    spread = mono.repartition(partitions(spark), "archive")
    normalise(spread, work.path("mono"), f"{folder}/warc").write.mode("overwrite").parquet(f"{folder}/archives")
    work.drop()
    return spark.read.schema("archive string, records long").parquet(f"{folder}/archives").repartition(partitions(spark), "archive")


def op10_warc(spark, sf_dir):
    folder = Scratch(spark, "op10").root
    archives = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives, f"{folder}/warc", with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
SQL = {
    "op10_warc": """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
}
