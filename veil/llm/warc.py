"""WARC archives: a monolithic gzip stream is inflated once, every record becomes a gzip member of its own, and a side-car index keeps its place.

Tasks write archives straight to a shared folder under names of their own attempt; only names in the index that Spark stores count, so an
attempt that was lost leaves nothing but an unread file. One archive is one unit of work, of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm.common import new_folder, query, stored, table

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
INDEX = "archive string, page_id long, record_id string, payload_bytes long, payload_digest string"
PLACES = "archive string, offset long, length long, page_id long, record_type string, refers_to long"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, object], payload: bytes) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode()]
    head += [f"{name}: {value}".encode() for name, value in fields.items() if value is not None]
    return CRLF.join([*head, f"Content-Length: {len(payload)}".encode(), b"", payload, b"", b""])


def member(data: bytes) -> bytes:
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


class Records:
    """Records of one gzip stream (one member or many), inflated once from the start in pieces."""

    def __init__(self, file):
        self.file, self.inflate, self.held, self.waiting = file, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            self.inflate, self.waiting = zlib.decompressobj(31), rest
        if not self.waiting:
            self.waiting = self.file.read(CHUNK)
        if not self.waiting:
            return False
        self.held += self.inflate.decompress(self.waiting, CHUNK)
        self.waiting = self.inflate.unconsumed_tail
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (stop := self.held.find(CRLF + CRLF)) < 0:
                if not self._more():
                    return
            lines = bytes(self.held[:stop]).decode().split("\r\n")[1:]
            fields = dict(line.split(": ", 1) for line in lines)
            start, size = stop + 4, int(fields["Content-Length"])
            while len(self.held) < start + size + 4:
                if not self._more():
                    raise EOFError("a record ends early")
            payload = bytes(self.held[start:start + size])
            del self.held[:start + size + 4]
            yield fields, payload


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, whatever its scheme."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the pages as one gzip stream each, all records responses; returns the stored index (archive, page_id, ...).

    An archive is closed beyond ``archive_bytes`` bytes of records. The payload is the html in UTF-8, empty for null. A null page_id is kept.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        name, stream, deflate, size = "", None, None, 0
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url"), batch.column("html")):
                if stream is None:
                    name, size, deflate = f"raw-{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html.as_py() or "").encode()
                row = (name, page, f"<urn:uuid:{uuid.uuid4()}>", len(payload), digest(payload))
                fields = {"WARC-Record-ID": row[2], "WARC-Target-URI": "".join((url.as_py() or "").split()) or None, "Page-ID": page,
                          "Payload-Length": row[3], "WARC-Payload-Digest": f"sha1:{row[4]}"}
                data = record("response", fields, payload)
                stream.write(deflate.compress(data))
                size += len(data)
                rows.append(row)
                if size >= archive_bytes:
                    stream.write(deflate.flush())
                    stream.close()
                    stream = None
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "page_id", "record_id", "payload_bytes", "payload_digest"])
        if stream is not None:
            stream.write(deflate.flush())
            stream.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def decided(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The index with record_type and refers_to: of equal payloads of ``least_bytes`` bytes or more, the smallest page_id is the response.

    Ties of page_id go to the smallest record_id; a null page_id comes last.
    """
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record_id"))
    key = ["payload_digest", "payload_bytes"]
    first = index.where(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.min(order).alias("head"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select(*key, F.col("head")["record_id"].alias("head_record"), F.col("head")["page_id"].alias("head_page"))
    joined = index.join(first, key, "left")
    again = F.col("head_record").isNotNull() & (F.col("head_record") != F.col("record_id"))
    return joined.select("archive", "record_id", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("head_page")).alias("refers_to"), F.when(again, F.col("head_record")).alias("refers_record"))


def normalised(decisions: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive with one gzip member per record, revisits without payload, and a side-car index file next to it.

    Returns the stored index of the new archives: (archive, offset, length, page_id, record_type, refers_to).
    """
    def rewrite(group: pd.DataFrame) -> pd.DataFrame:
        fs, path = open_folder(folder)
        name = group["archive"].iloc[0]
        out_name, at, rows = f"member-{uuid.uuid4().hex}.warc.gz", 0, []
        verdict = {r.record_id: r for r in group.itertuples(index=False)}
        with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, fs.open_output_stream(f"{path}/{out_name}", compression=None) as out:
            for fields, payload in Records(raw):
                found = verdict[fields["WARC-Record-ID"]]
                del fields["WARC-Type"], fields["Content-Length"]
                page = int(fields["Page-ID"]) if "Page-ID" in fields else None
                refers = None
                if found.record_type == "revisit":
                    refers = None if pd.isna(found.refers_to) else int(found.refers_to)
                    fields |= {"WARC-Refers-To": found.refers_record, "Refers-To-Page": refers, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    payload = b""
                data = member(record(found.record_type, fields, payload))
                out.write(data)
                rows.append((out_name, at, len(data), page, found.record_type, refers))
                at += len(data)
        with fs.open_output_stream(f"{path}/{out_name}.idx", compression=None) as side:
            for r in rows:
                side.write(f"{r[1]}\t{r[2]}\t{'' if r[3] is None else r[3]}\t{r[4]}\n".encode())
        done = pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "record_type", "refers_to"])
        return done.astype({"page_id": "Int64", "refers_to": "Int64"})

    exact = decisions.withColumn("refers_to", F.col("refers_to").cast("string"))  # a long with nulls would become a double
    return stored(exact.groupBy("archive").applyInPandas(rewrite, PLACES), "warc-places")


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each fetched by its offset and inflated alone.

    A response whose payload does not match its digest or length fails the job.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["archive"] != name:
                    name, file = r["archive"], fs.open_input_file(f"{path}/{r['archive']}")
                data = zlib.decompress(file.read_at(r["length"], r["offset"]), 31)
                head, payload = data.split(CRLF + CRLF, 1)
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                payload = payload[:int(fields["Content-Length"])]
                kind, size, sha = fields["WARC-Type"], int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest(payload) != sha):
                    raise ValueError(f"{name} at {r['offset']}: payload does not match its digest")
                rows.append((fields.get("Page-ID"), size, sha, kind, fields.get("Refers-To-Page")))
            columns = list(zip(*rows)) if rows else [[]] * 5
            as_int = [[None if v is None else int(v) for v in c] if i in (0, 4) else c for i, c in enumerate(columns)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(as_int, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return places.select("archive", "offset", "length").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
n AS (SELECT *, unnest(generate_series(0, 31)) AS k FROM d),
c AS (SELECT page_id, payload_bytes, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (('0x' || substr(hex, 1 + k * 5 // 4, 2))::INT >> (3 - (k * 5) % 4)) & 31 AS INT), 1), '' ORDER BY k) AS payload_digest
      FROM n GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = h THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = h THEN NULL ELSE h END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS h FROM c)
"""


@query("op2_warc", _SQL)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives, normalised, and read back through the index."""
    place = new_folder(spark, "warc")
    index = write_monolithic(table(spark, folder, "pages"), place)
    return read_back(normalised(decided(index), place), place)
