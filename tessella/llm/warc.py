"""WARC archives: a writer, and a sequential reader that decompresses member by member and verifies every digest."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import filesystem, saved, scratch, write_whole

#: Bytes that the reader asks for at once, and bytes that it inflates at once: its memory beside one record's.
CHUNK, INFLATE = 1 << 18, 1 << 18
DATE = "2026-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that isn't framed as its headers say, or whose digest differs."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else int(page_id)}>"


def page_of(rid: str | None):
    number = (rid or "<urn:x-page:null>").rpartition(":")[2].rstrip(">")
    return None if number == "null" else int(number)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member. A response holds the HTTP headers and the payload; a revisit the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "") or record_id(page_id)[1:-1]
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to)}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator["_Member"]:
    """The gzip members of a stream, each to be read to its end before the next."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        m = _Member(stream, rest)
        yield m
        rest = m.finish()


class _Member:
    """Incremental decompression of one gzip member: at most INFLATE bytes beyond what is asked for are held."""

    def __init__(self, stream, first: bytes):
        self.stream, self.raw, self.z, self.out = stream, first, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw
        if not self.z.unconsumed_tail:
            self.raw = b""
        if not data:
            data = self.stream.read(CHUNK)
            if not data:
                raise WarcError("the archive ends within a member")
        try:
            self.out += self.z.decompress(data, INFLATE)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        return True

    def line(self) -> bytes:
        seen = 0
        while (end := self.out.find(b"\r\n", max(0, seen - 1))) < 0:
            seen = len(self.out)
            if not self._more():
                raise WarcError("a header line without an end")
        text = bytes(self.out[:end])
        del self.out[: end + 2]
        return text

    def read(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise WarcError(f"{n} bytes are announced, {len(self.out)} there")
        data = bytes(self.out[:n])
        del self.out[:n]
        return data

    def finish(self) -> bytes:
        """What follows this member in the bytes that were read. Nothing may be left of the member."""
        while self._more():
            pass
        if self.out:
            raise WarcError(f"{len(self.out)} bytes after the record in its member")
        return self.z.unused_data


def _headers(m: _Member) -> dict[str, str]:
    found = {}
    while line := m.line():
        k, _, v = line.decode("utf-8", "replace").partition(":")
        found[k.strip().lower()] = v.strip()
    return found


def read_records(stream) -> Iterator[dict]:
    """headers, block and payload of each record, in order: framed by Content-Length, digests verified, else WarcError."""
    for m in members(stream):
        if not m.line().startswith(b"WARC/"):
            raise WarcError("a member that doesn't start with WARC/")
        head = _headers(m)
        block = m.read(int(head["content-length"]))
        if m.read(4) != b"\r\n\r\n":
            raise WarcError("no empty lines after the block")
        if (said := head.get("warc-block-digest", "").rpartition(":")[2]) and said != sha1_base32(block):
            raise WarcError(f"block digest of {head.get('warc-record-id')}")
        http, _, payload = block.partition(b"\r\n\r\n")
        lines = http.split(b"\r\n")[1:]
        http_head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        kind = head["warc-type"]
        said = head.get("warc-payload-digest", "").rpartition(":")[2]
        if kind != "revisit" and (said != sha1_base32(payload) or int(http_head["content-length"]) != len(payload)):
            raise WarcError(f"payload of {head.get('warc-record-id')}")
        yield {"headers": head, "http": http_head, "payload": None if kind == "revisit" else payload, "payload_digest": said}


def assigned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to: refers_to is set where the page's record is a revisit.

    Of rows whose payloads of at least min_bytes are equal, those with the smallest page_id (a null id after all others)
    are responses. A null html is an empty payload. Only digests that occur twice are joined; their aggregate is
    partial before its shuffle, so one payload may be that of a third of all rows.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    key = F.unhex(F.sha1("payload"))
    slim = pages.select("page_id", payload.alias("payload")).where(F.length("payload") >= min_bytes).select("page_id", key.alias("key"))
    twice = slim.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = saved(twice.select("key", "first"), "warc-equal")
    rows = rows.withColumn("key", key)
    rows = rows.join(twice, "key", "left")
    again = F.col("first").isNotNull() & (F.length("payload") >= min_bytes) & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return rows.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, record_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) as folder/part-*.warc.gz; returns the files' table (path, records).

    A task writes its rows in files of about record_bytes before compression. A file gets its name, which follows from
    the task's partition, when it is whole; a task that is lost runs again and writes the same names.
    """

    def write(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, held, n, size = 0, [], 0, 0

        def flush():
            nonlocal number, held, n, size
            path = f"{folder}/part-{part:06d}-{number:05d}.warc.gz"
            write_whole(path, held)
            out = pd.DataFrame({"path": [path], "records": [n]})
            number, held, n, size = number + 1, [], 0, 0
            return out

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                held.append(record(page_id, url, payload, sha1_base32(payload), refers, refers is not None))
                n, size = n + 1, size + len(payload)
                if size >= record_bytes:
                    yield flush()
        if n:
            yield flush()

    import pyarrow as pa

    def arrow(batches):
        for df in write(batches):
            yield pa.RecordBatch.from_pandas(df, preserve_index=False)

    return saved(assigned(pages, min_bytes).mapInArrow(arrow, "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record of the archives in `files` (path): headers read back, payloads verified. One archive is one task's work."""
    spark = files.sparkSession
    n = max(1, files.count())

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = pa.schema([(x, pa.string()) for x in names[:5]] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = filesystem(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for r in read_records(stream):
                        h = r["headers"]
                        rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), r["payload_digest"], int(r["http"]["content-length"]), r["payload"]))
                        held += len(r["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    read = read_archives(files)
    page = lambda c: F.regexp_extract(c, r":(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first, count(*) OVER (PARTITION BY html) AS n FROM p),
bits AS (SELECT *, list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (('0x' || substr(hex || '0', 1 + i // 4, 2))::INTEGER >> (3 - i % 4)) % 32, 1)) AS letters FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
