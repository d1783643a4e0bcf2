"""WARC archives as a chunked record table: payloads travel as numbered chunks with running digests.

Reading and writing never hold a whole compressed record: a payload is compressed chunk by chunk, and read
back as rows (record, chunk number, bytes) whose digest covers everything up to that chunk. The writer does
take a record's payload as one string, and its digest and the digest join work on whole payloads.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.llm.shared import materialise, open_store, shared_folder

CHUNK = 1 << 18
ARCHIVE_BYTES = 1 << 30
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_ROWS = (
    "page_id long, url string, record_type string, refers_to long, chunk int, is_last boolean, "
    "data binary, payload_bytes long, payload_digest string"
)


def record_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to): which page a repeated payload refers to.

    Payloads are compared by SHA-256 and length. Of those of at least 100 bytes that are equal, the page
    with the smallest id is stored; the groups are counted per digest before anything is joined.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    sized = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    repeated = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = repeated.where("copies > 1").select("digest", "first")
    joined = rows.join(repeated, "digest", "left")
    again = (F.octet_length("html") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _headers(page_id, url, refers_to, digest: str, size: int, date: str) -> tuple[bytes, bytes]:
    """The record header and the HTTP header; a revisit's block is the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def payload_chunks(text: str, chunk: int = CHUNK):
    """UTF-8 pieces of at most ``chunk`` bytes, at least one, encoded a slice at a time."""
    step = max(chunk // 4, 1)
    yield text[:step].encode("utf-8")
    for at in range(step, len(text), step):
        yield text[at : at + step].encode("utf-8")


def _integer(value):
    return None if pd.isna(value) else int(value)


def _write_archives(folder: str, date: str, chunk: int, archive_bytes: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done, out, name, written, records = [], None, "", 0, 0

        def close():
            out.close()
            store.move(f"{root}/.{attempt}-{name}", f"{root}/{name}")  # a second attempt writes the same bytes
            done.append((name, records, written))

        for batch in batches:
            for page_id, url, html, digest, size, refers_to in zip(
                batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["size"], batch["refers_to"]
            ):
                if out is None or written >= archive_bytes:
                    if out is not None:
                        close()
                    name, written, records = f"pages-{part:06d}-{len(done):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/.{attempt}-{name}", compression=None)
                refers_to = _integer(refers_to)
                url = None if url is None or pd.isna(url) else url
                head, http = _headers(_integer(page_id), url, refers_to, digest, int(size), date)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)  # a gzip member for each record
                written += out.write(packer.compress(head + http))
                if refers_to is None:
                    for piece in payload_chunks(html, chunk):
                        written += out.write(packer.compress(piece))
                written += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                records += 1
        if out is not None:
            close()
        if done:
            files, counts, sizes = zip(*done)
            yield pd.DataFrame({"file": files, "n_records": counts, "n_bytes": sizes})

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    date: str = "2024-01-01T00:00:00Z",
    chunk: int = CHUNK,
    archive_bytes: int = ARCHIVE_BYTES,
    **columns: str,
) -> tuple[str, DataFrame]:
    """Write a WARC 1.1 record per page, a gzip member each; returns the folder and its list of files.

    A null payload is empty, a null URL is left out, white space and control characters in a URL are
    percent-encoded. Repeated page ids give a record each. An empty table writes no file. Other columns
    are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = record_roles(pages, **columns).withColumn("size", F.octet_length("html").cast("long"))
    files = rows.mapInPandas(_write_archives(folder, date, chunk, archive_bytes), "file string, n_records long, n_bytes long")
    return folder, materialise(files, "archives")


class _Records:
    """Records of a compressed archive, read through a window of a few chunks."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk = source, chunk
        self.raw, self.plain, self.gunzip = b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Add some decompressed bytes to the window; False at the end of the file."""
        while True:
            if self.gunzip.eof:
                self.raw, self.gunzip = self.gunzip.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.chunk)
                if not self.raw:
                    return False
            got = self.gunzip.decompress(self.raw, self.chunk)
            self.raw = b"" if self.gunzip.eof else self.gunzip.unconsumed_tail
            if got:
                self.plain += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise ValueError("the archive is cut")
        out, self.plain = self.plain[:n], self.plain[n:]
        return out

    def head(self) -> bytes | None:
        """Up to and with the next blank line; None at the end."""
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.plain:
                    raise ValueError("the archive is cut")
                return None
        return self.take(at + 4)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_records(source, chunk: int):
    """Chunk rows of an archive; a revisit is one row without data whose sizes come from its headers."""
    records = _Records(source, chunk)
    while (head := records.head()) is not None:
        fields = _fields(head)
        http = records.head()
        left = int(fields["content-length"]) - len(http)
        row = (_urn(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _urn(fields.get("warc-refers-to")))
        declared = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "revisit":
            yield *row, 0, True, b"", int(_fields(http)["content-length"]), declared
        else:
            running, size, number = hashlib.sha256(), 0, 0
            while True:
                data = records.take(min(left, chunk))
                left -= len(data)
                running.update(data)
                size += len(data)
                digest = running.hexdigest()
                if left == 0 and digest != declared:
                    raise ValueError("a payload does not match its digest")
                yield *row, number, left == 0, data, size, digest
                number += 1
                if left == 0:
                    break
        if records.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _read_archives(folder: str, chunk: int, keep_data: bool, batch_bytes: int = 1 << 23):
    names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            for file in batch["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for row in read_records(source, chunk):
                        held += len(row[6])
                        rows.append(row if keep_data else (*row[:6], None, *row[7:]))
                        if held >= batch_bytes or len(rows) >= 10_000:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return run


def read_archives(folder: str, files: DataFrame, chunk: int = CHUNK, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives.

    One row per chunk: page_id, url, record_type, refers_to, chunk, is_last, data, payload_bytes and
    payload_digest, both over all chunks so far. The row with ``is_last`` carries those of the whole
    payload, checked against the record's header. ``keep_data=False`` leaves the bytes out.
    """
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = files.select("file").repartition(spread, "file")
    return listed.mapInPandas(_read_archives(folder, chunk, keep_data), CHUNK_ROWS)
