"""Token ids on disk: fixed-width bit packing in blocks, read back by vectorised unpacking or by random access.

A store is a folder of Parquet files. Each row is a block: whole documents in rising order of id, until `BLOCK_IDS` ids
are reached, as the columns part, block, first (ids of the part before it), width (bits an id), low and high (the block's
smallest and largest doc_id, by which Parquet leaves out blocks unread), doc_ids, offsets (where each document begins in
the block, and the end) and payload (ids packed little-endian, least bit first). A block is
readable on its own: id k is the bits k * width to (k + 1) * width. Parts follow one another in rising doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import durable, prepare
from lumenfare.llm.encoding import encoder

BLOCK_IDS = 1 << 16
#: Bytes of text that a part of the store holds, about.
PART_BYTES = 1 << 24
#: Places of so many parts are broadcast, a few MB; of more, joined by shuffle.
BROADCAST_PARTS = 200_000
_BLOCKS = "part int, block int, first long, width int, low bigint, high bigint, doc_ids array<bigint>, offsets array<bigint>, payload binary"
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
_PLACE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def width_of(vocabulary: int) -> int:
    """Bits that the largest id of the vocabulary takes, 1 at least."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids (below 2**width) in width bits each; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """The ids first to first + count, without touching the bytes of others."""
    low, high = first * width // 8, -(-(first + count) * width // 8)
    part = np.frombuffer(payload, np.uint8)[low:high]
    if width in (8, 16, 32):
        return part.view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(part, bitorder="little")[first * width - low * 8 :][: count * width].reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes each row's ids and end_id in rising doc_id order (null first; ties by text) to a new store at path.

    The texts are dealt by ranges of doc_id, once, and each part is encoded and packed as it streams by, so a worker
    holds one block and one document. Null texts are empty; other columns are ignored; no rows make an empty store.
    """
    prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer, False), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        width = width_of(max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        ids, held, size, first, block = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0] + [len(x) // 4 for x in ids])
            payload = pack_bits(np.frombuffer(b"".join(ids), "<u4"), width)
            known = [x for x in held if x is not None]
            values = (part, block, first, width, min(known, default=None), max(known, default=None), held, offsets, payload)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCK)], schema=_BLOCK)

        for batch in frames:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                held.append(doc_id)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= BLOCK_IDS:
                    yield row()
                    ids, held, first, block, size = [], [], first + size, block + 1, 0
        if ids:
            yield row()

    dealt = texts.repartitionByRange(max(1, -(-size // PART_BYTES)), F.asc_nulls_first("doc_id"), F.substring("text", 1, 16)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    dealt.mapInArrow(emit, _BLOCKS).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the store; start: ids of all documents before it.

    One row per part is summed up in one task, to place the parts; blocks are unpacked where they are read.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    ends = durable(blocks.groupBy("part").agg(F.max(F.col("first") + F.element_at("offsets", -1)).alias("ids")))
    base = ends.select("part", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for begin, width, doc_ids, offsets, payload in zip(*batch.columns):
                at = offsets.values.to_numpy()
                raw = memoryview(unpack_bits(payload.as_py(), width.as_py(), 0, int(at[-1])).astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begin.as_py() + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=_PLACE)

    side = F.broadcast(base) if ends.count() <= BROADCAST_PARTS else base
    placed = blocks.join(side, "part").select((F.col("base") + F.col("first")).alias("begin"), "width", "doc_ids", "offsets", "payload")
    return placed.mapInArrow(emit, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Spans of ids that one read asks Parquet for; the gaps between more than so many ids are closed, the widest last.
MOST_SPANS = 64


def _spans(ids: list[int]) -> list[tuple[int, int]]:
    """At most MOST_SPANS ranges that hold the ids, parted at the widest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: MOST_SPANS - 1]
    edge = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(edge, edge[1:])] if ids else []


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for, unpacked from their blocks alone; ids not in the store are left out.

    Blocks whose bounds hold none of the ids are left out by the scan itself.
    """
    want = set(doc_ids)
    holds = F.lit(False)
    for low, high in _spans(sorted(want)):
        holds = holds | ((F.col("low") <= high) & (F.col("high") >= low))
    blocks = spark.read.schema(_BLOCKS).parquet(path).where(holds)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for width, ids, offsets, payload in zip(pdf.width, pdf.doc_ids, pdf.offsets, pdf.payload):
                hits = [k for k, x in enumerate(ids) if x in want]
                yield pd.DataFrame({"doc_id": [int(ids[k]) for k in hits], "ids": [unpack_bits(payload, width, int(offsets[k]), int(offsets[k + 1] - offsets[k])).astype(int) for k in hits]})

    return blocks.select("width", "doc_ids", "offsets", "payload").mapInPandas(emit, "doc_id long, ids array<int>")
