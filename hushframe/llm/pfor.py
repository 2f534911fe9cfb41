"""Token ids in patched frame-of-reference files.

A file holds blocks of 1024 ids (the last may hold fewer).  A block stores its minimum, packs what is left above it at a
width that a stated share of the block fits in, and keeps the rest in an exception list (place, high part).  The footer
holds the ids of each document and the start of each block, so any block or document can be read by itself.

Cases: null text is empty; an empty document is just its end id; null ``doc_id`` sorts first; equal ``doc_id`` values
are ordered by text; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import filesystem, new_path, partitions, range_bucket, range_edges, written
from .tokens import encoder, runs

BLOCK = 1024
MAGIC = b"HPFOR1\0\0"
#: The share of a block's values that the packed width must hold.
PERCENTILE = 0.9
#: Ids from which a file ends with the document at hand and the next one begins.
ROLL = 1 << 27
#: Stands for a null document id in a file.
NO_ID = -(1 << 63)
_HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 values below 2**width as rows of 16 * width 64-bit words: 64 values share ``width`` words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).reshape(len(values), 16 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_pack`."""
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(bit)
        if bit + width > 64:
            v |= lanes[word + 1] << np.uint64(64 - bit)
        out[i] = v & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


#: Blocks that are packed or unpacked together, so that they stay in the processor's cache.
TOGETHER = 256


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ``ids`` (unsigned 32-bit), each as bytes; only the last may be short."""
    return [x for a in range(0, len(ids), TOGETHER * BLOCK) for x in _encode(ids[a : a + TOGETHER * BLOCK], percentile)]


def _encode(ids: np.ndarray, percentile: float) -> list[bytes]:
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    counts = np.full(n, BLOCK)
    counts[-1] = len(ids) - (n - 1) * BLOCK
    least = full.min(axis=1)
    rest = full - least[:, None]
    k = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    bound = np.partition(rest, k, axis=1)[:, k]
    widths = np.array([int(x).bit_length() for x in bound])
    out: list[bytes] = [b""] * n
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        own = rest[rows]
        high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        packed = _pack(own & np.uint32((1 << int(width)) - 1), int(width)) if width else None
        where, place = np.nonzero(high)
        high = high[where, place].astype("<u4")
        place = place.astype("<u2")
        ends = np.searchsorted(where, np.arange(len(rows) + 1))
        heads = np.zeros(len(rows), _HEAD)
        heads["least"], heads["n"], heads["width"], heads["exceptions"] = least[rows], counts[rows], width, np.diff(ends)
        for k, r in enumerate(rows.tolist()):
            a, b = ends[k], ends[k + 1]
            out[r] = b"".join((heads[k].tobytes(), packed[k].tobytes() if width else b"", place[a:b].tobytes(), high[a:b].tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the consecutive blocks that begin at ``starts`` in ``data``."""
    parts = [_decode(data, starts[a : a + TOGETHER]) for a in range(0, len(starts), TOGETHER)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    values = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(heads["width"]):
        rows = np.flatnonzero(heads["width"] == width)
        if width:
            words = np.stack([np.frombuffer(data, "<u8", 16 * int(width), int(starts[r]) + _HEAD.itemsize) for r in rows])
            values[rows] = _unpack(words, int(width))
    for r in np.flatnonzero(heads["exceptions"]).tolist():
        width, n = int(heads["width"][r]), int(heads["exceptions"][r])
        at = int(starts[r]) + _HEAD.itemsize + 128 * width
        values[r, np.frombuffer(data, "<u2", n, at)] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width)
    values += heads["least"][:, None]
    if int(heads["n"].min()) == BLOCK:
        return values.reshape(-1)
    return values[np.arange(BLOCK)[None, :] < heads["n"][:, None]]


class Writer:
    """One file: ids come document by document, blocks go out as they fill."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.starts: list[int] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint32)

    def _put(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids)
        for block in blocks:
            self.starts.append(self.at)
            self.at += len(block)
        self.out.write(b"".join(blocks))

    def add(self, docs: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(docs)
        self.lengths.append(lengths)
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        self._put(self.rest)
        docs, lengths = (np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8") for x in (self.docs, self.lengths))
        body = docs.tobytes() + lengths.tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(body + struct.pack("<QQQQ", self.at, len(docs), len(self.starts), self.ids) + MAGIC)
        self.out.close()


class Reader:
    """A file written by :class:`Writer`; only the footer and the blocks asked for are read."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token file")
        self.end, n_docs, n_blocks, self.ids = struct.unpack("<QQQQ", tail[:32])
        body = self.file.read_at(size - 40 - self.end, self.end)
        self.docs = np.frombuffer(body, "<i8", n_docs)
        self.lengths = np.frombuffer(body, "<i8", n_docs, 8 * n_docs)
        self.starts = np.frombuffer(body, "<u8", n_blocks, 16 * n_docs)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids at places ``first`` to ``last - 1`` of the file."""
        a, b = first // BLOCK, -(-last // BLOCK)
        if a >= b:
            return np.zeros(0, np.uint32)
        begin = int(self.starts[a])
        stop = int(self.starts[b]) if b < len(self.starts) else self.end
        ids = decode_blocks(self.file.read_at(stop - begin, begin), self.starts[a:b].astype(np.int64) - begin)
        return ids[first - a * BLOCK : last - a * BLOCK]

    def documents(self, most: int = 4 * 1024 * BLOCK) -> Iterator[tuple[int, int, int, int]]:
        """(document, its start in the file, its ids, their crc32), in order; at most ``most`` ids are held at once."""
        ends = np.cumsum(self.lengths)
        crc, place, doc = 0, 0, 0
        while doc < len(self.docs):
            upto = min(place + most, self.ids)
            data = memoryview(self.read(place, upto).astype("<u4").tobytes())
            base = place
            while doc < len(self.docs) and (ends[doc] <= upto):
                crc = zlib.crc32(data[4 * (place - base) : 4 * (int(ends[doc]) - base)], crc)
                yield doc, int(ends[doc] - self.lengths[doc]), int(self.lengths[doc]), crc
                place, crc, doc = int(ends[doc]), 0, doc + 1
            if place < upto:
                crc = zlib.crc32(data[4 * (place - base) :], crc)
                place = upto


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write its ids in ascending ``doc_id`` order; returns the manifest.

    One range of ``doc_id`` makes one file, or several of ``ROLL`` ids.  A task writes under a name of its own and only names in the stored manifest
    count, so a retried or doubled task leaves at most an unlisted file.  Manifest: bucket, part, file, n_docs, n_ids, base
    (ids in all files before it).
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    edges = range_edges(docs, "doc_id", partitions(spark))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, name, bucket, part, n_docs = encoder(tokenizer, True), None, "", 0, -1, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [out.ids]})

        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
            for a, b in runs(texts):
                if out is None:
                    bucket, part, n_docs = batch.column("bucket")[0].as_py(), part + 1, 0
                    name = f"{folder}/ids-{bucket:06d}-{part:04d}-{uuid.uuid4().hex}.pfor"
                    out = Writer(name)
                got, lengths = encode(texts[a:b], end_id)
                out.add(ids[a:b], got, lengths)
                n_docs += b - a
                if out.ids >= ROLL:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    dealt = docs.select("doc_id", "text", range_bucket(F.col("doc_id"), edges).alias("bucket"))
    dealt = dealt.repartitionById(len(edges) + 1, "bucket").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = written(dealt.mapInArrow(put, "bucket int, part int, file string, n_docs long, n_ids long"), "manifest")
    # one row a file: the running sum is over the file list, not over rows
    base = F.sum("n_ids").over(Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("base", F.coalesce(base, F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document from the files of a manifest: doc_id, start, n_tokens, ids_crc32."""

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], names)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                reader, rows = Reader(entry["file"]), []
                for doc, start, n, crc in reader.documents():
                    value = int(reader.docs[doc])
                    rows.append((None if value == NO_ID else value, entry["base"] + start, n, crc))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    dealt = manifest.repartition(partitions(manifest.sparkSession), "bucket", "part")
    return dealt.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(manifest: DataFrame) -> DataFrame:
    """The manifest with its running sums, kept as a table beside the files."""
    return written(manifest, "token-index")
