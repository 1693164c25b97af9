"""Token ids in files of bit or byte planes.

A file image holds whole documents in order: blocks of ``BLOCK`` ids, each transposed into planes that are compressed
one by one with zstandard, an index of the blocks, and an index of the documents. All numbers are little-endian.

    magic "TPPLANE1", then uint32: version, bits of a plane (1 or 8), ids of a block, planes, blocks, documents
    blocks: the compressed planes, lowest first
    block index: uint32 compressed length of each plane of each block, uint64 place of each block in the image
    document index: int64 id (with a null mask of bytes) and uint32 number of ids of each document

Images are rows of a Parquet table, so that Spark's committer writes them wherever the shared folder is; ``save_image``
and ``open_image`` keep one as a plain file. Images have about ``IMAGE_IDS`` ids (a longer document has its own).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import SLICE_BYTES, slices, stored
from tallyproof.llm.tokens import default_path, encoder, ended

MAGIC = b"TPPLANE1"
BLOCK = 1 << 16
IMAGE_IDS = 1 << 21


def to_planes(ids: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """Planes of a block, lowest first: plane p holds bit (or byte) p of every id."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(planes)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, p], bitorder="little").tobytes() for p in range(planes)]


def from_planes(planes: list[bytes], count: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.zeros((count, 4), dtype=np.uint8)
        for p, x in enumerate(planes):
            raw[:, p] = np.frombuffer(x, dtype=np.uint8)
        return raw.view("<u4").reshape(-1)
    each = np.zeros((count, 32), dtype=np.uint8)
    for p, x in enumerate(planes):
        each[:, p] = np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=count, bitorder="little")
    return np.packbits(each, axis=1, bitorder="little").view("<u4").reshape(-1)


def pack_image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, *, bits: int = 8, block: int = BLOCK, level: int = 3) -> bytes:
    """The image of documents with ``counts`` ids each, laid end to end in ``ids``."""
    press = zstandard.ZstdCompressor(level=level)
    top = int(ids.max(initial=0)).bit_length()
    planes = max(1, -(-top // bits))
    parts, lengths, places = [], [], []
    place = len(MAGIC) + 24
    for a in range(0, len(ids), block):
        places.append(place)
        for plane in to_planes(ids[a: a + block], planes, bits):
            parts.append(press.compress(plane))
            lengths.append(len(parts[-1]))
            place += lengths[-1]
    head = np.array([1, bits, block, planes, len(places), len(counts)], dtype="<u4").tobytes()
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    docs = np.array([x or 0 for x in doc_ids], dtype="<i8")
    return b"".join([MAGIC, head, *parts, np.array(lengths, dtype="<u4").tobytes(), np.array(places, dtype="<u8").tobytes(),
                     docs.tobytes(), null.tobytes(), np.asarray(counts).astype("<u4").tobytes()])


class Image:
    """Reads an image; ``blocks(a, b)`` decodes only the blocks that ids a to b lie in."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of id planes")
        self.view, at = view, len(MAGIC)
        _, self.bits, self.block, self.planes, blocks, docs = np.frombuffer(view[at: at + 24], dtype="<u4").tolist()
        end = len(view)
        self.counts = np.frombuffer(view[end - 4 * docs: end], dtype="<u4").astype(np.int64)
        end -= 4 * docs
        null = np.frombuffer(view[end - docs: end], dtype=np.uint8)
        end -= docs
        ids = np.frombuffer(view[end - 8 * docs: end], dtype="<i8")
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        end -= 8 * docs
        self.places = np.frombuffer(view[end - 8 * blocks: end], dtype="<u8").astype(np.int64)
        end -= 8 * blocks
        size = 4 * blocks * self.planes
        self.lengths = np.frombuffer(view[end - size: end], dtype="<u4").reshape(blocks, self.planes).astype(np.int64)
        self.n_ids = int(self.counts.sum())

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last (not included) of the image."""
        last = self.n_ids if last is None else last
        if first >= last:
            return np.zeros(0, dtype="<u4")
        unpress, out, low = zstandard.ZstdDecompressor(), [], first // self.block
        for k in range(low, -(-last // self.block)):
            count, place, planes = min(self.block, self.n_ids - k * self.block), int(self.places[k]), []
            for n in self.lengths[k].tolist():
                planes.append(unpress.decompress(self.view[place: place + n]))
                place += n
            out.append(from_planes(planes, count, self.bits))
        return np.concatenate(out)[first - low * self.block: last - low * self.block]


def save_image(path: str | Path, image: bytes) -> None:
    Path(path).write_bytes(image)


def open_image(path: str | Path) -> Image:
    """An image in a plain file, memory-mapped."""
    return Image(memoryview(np.memmap(path, dtype=np.uint8, mode="r")))


SCHEMA = "part int, seq int, n_docs long, n_ids long, image binary"


def write_id_files(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, bits: int = 8) -> DataFrame:
    """Encode all texts, in ascending order of id, into file images; the stored table of images is returned.

    Texts are dealt out by ranges of ids before they are encoded, so each task writes one run of the order. Null texts
    are empty (only the end id); null ids come first; rows that share an id keep their own entries, in order of text.
    An empty table gives no images. Rows (part, seq, n_docs, n_ids, image) in ascending (part, seq) are the whole order.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        names, counts, held, size = [], [], [], 0

        def image() -> pa.RecordBatch:
            data = pack_image(names, np.concatenate(counts), np.concatenate(held), bits=bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()),
                                               pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "image"])

        for batch in batches:
            for piece in slices(batch, "text", 2 * SLICE_BYTES):
                ids, bounds = ended(*encoder(path).encode(piece.column(1)), end_id)
                names += piece.column(0).to_pylist()
                counts.append(np.diff(bounds))
                held.append(ids)
                size += len(ids)
                if size >= IMAGE_IDS:
                    yield image()
                    seq += 1
                    names, counts, held, size = [], [], [], 0
        if names:
            yield image()

    return stored(rows.select("id", "text").mapInArrow(encode, SCHEMA), "id_files")


def image_starts(images: DataFrame) -> DataFrame:
    """(part, seq, first): the number of ids before each image. Two levels: within parts, then one row per part."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return images.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(before, "part").select(
        "part", "seq", (F.col("before") + F.col("within")).alias("first"))


def read_id_files(images: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document of the images, with the number of ids before it; ids is a list of integers."""
    def decode(image: Image, first: int) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum(image.counts)])
        return pa.RecordBatch.from_arrays([
            pa.array(image.doc_ids, pa.int64()), pa.array(first + bounds[:-1]),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(image.ids().astype(np.int64))),
        ], names=["doc_id", "start", "ids"])

    return _read(images, decode, "doc_id long, start long, ids array<long>")


def document_digests(images: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the images; the checksum is over little-endian 32-bit ids."""
    def decode(image: Image, first: int) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum(image.counts)])
        raw = memoryview(image.ids().astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(image.doc_ids, pa.int64()), pa.array(first + bounds[:-1]), pa.array(image.counts),
                                           pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(images, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(images: DataFrame, decode, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield decode(Image(batch.column(0)[i].as_buffer()), batch.column(1)[i].as_py())

    return images.join(image_starts(images), ["part", "seq"]).select("image", "first").mapInArrow(each, schema)
