"""WARC archives with an index first: write records, index them, read selected byte ranges back.

Every record is a gzip member of its own.  Writing yields an index row per record (file, offset, length, url, digest),
stored as a table; reading sorts the selected index rows by file and offset and joins neighbouring ranges into one read.

Cases: a null payload is empty; a null url is left out of the record; equal payloads are found by SHA-256 and length; the
smallest page_id of a group is the response and rows that share that page_id are responses too; rows without a page_id
revisit a response where the group has one, and are responses otherwise; an empty table gives no archive and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import filesystem, new_path, partitions, written

INDEX = "file string, offset long, length long, url string, digest string, record_type string, payload_bytes long, page_id long"
#: Bytes between two wanted ranges that are read along rather than skipped, and the most that one read may hold.
GAP, MOST = 64 << 10, 8 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and the block of a gzipped record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers["content-length"])]


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html); returns the stored index.

    Which page answers for a payload is settled on ids and digests alone; payloads move only to meet that small table, and
    not even then where Spark finds it small enough to send round.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html")).withColumn("same", F.sha2("html", 256))
    small = written(keyed.select("page_id", "same", F.octet_length("html").alias("n")), "payloads")
    shared = small.groupBy("same", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
    refers = small.join(shared, ["same", "n"]).where("page_id is null or page_id <> first")
    refers = refers.select(F.coalesce("page_id", F.lit(-1)).alias("own"), F.col("page_id").isNull().alias("nameless"), "same", "first").distinct()
    out = keyed.join(refers, (F.coalesce(keyed["page_id"], F.lit(-1)) == refers["own"]) & (keyed["page_id"].isNull() == refers["nameless"]) & (keyed["same"] == refers["same"]), "left")
    out = out.select(keyed["page_id"], "url", "html", F.col("first").alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if stream is None:
                        name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                        fs, path = filesystem(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        stream = fs.open_output_stream(path, compression=None)
                        info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        stream.write(info)
                        at = len(info)
                    data = html.encode("utf-8", "surrogatepass")
                    digest, kind = sha1_base32(data), "response" if refers_to is None else "revisit"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                    target = None if url is None else _CONTROL.sub(lambda m: quote(m[0]), url)
                    headers = [
                        ("WARC-Record-ID", _page_uri(page_id)),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", target),
                        ("WARC-Payload-Digest", f"sha1:{digest}"),
                        ("WARC-Refers-To", None if refers_to is None else _page_uri(refers_to)),
                        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("Content-Type", "application/http; msgtype=response"),
                    ]
                    member = record(kind, headers, head + data if refers_to is None else head)
                    stream.write(member)
                    rows.append((name, at, len(member), target, digest, kind, len(data), page_id))
                    at += len(member)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if stream is not None:
                stream.close()

    return written(out.mapInArrow(put, INDEX), "cdx")


def read_records(index: DataFrame) -> DataFrame:
    """The records of the selected ``index`` rows, read from the archives.

    Columns: page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to.
    """

    def ranges(rows: list[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
        held: list[tuple] = []
        for row in rows:
            if held and (row[0] != held[0][0] or row[1] > held[-1][1] + held[-1][2] + GAP or row[1] + row[2] - held[0][1] > MOST):
                yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held
                held = []
            held.append(row)
        if held:
            yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, ""
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for file, begin, end, wanted in ranges(rows):
                if file != name:
                    fs, path = filesystem(file)
                    opened, name = fs.open_input_file(path), file
                data = opened.read_at(end - begin, begin)
                out = []
                for _, offset, length in wanted:
                    headers, block = parse(data[offset - begin : offset - begin + length])
                    head, _, body = block.partition(b"\r\n\r\n")
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind, size = headers["warc-type"], int(re.search(rb"Content-Length: (\d+)", head)[1])
                    if kind == "response" and (sha1_base32(body) != stated or len(body) != size):
                        raise ValueError(f"record at {offset} of {file} is damaged")
                    out.append((_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, body if kind == "response" else None, size, stated, _page_of(headers.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    spark = index.sparkSession
    dealt = index.select("file", "offset", "length").repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(get, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
