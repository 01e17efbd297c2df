"""Simple-8b word-aligned coding of token ids, and a file format of coded documents.

A 64-bit word has a 4-bit selector and 60 bits for the ids that fit: 60 of one bit, 30 of two, and so on to one of 60.
Selector 0 is an escape: its word holds the place of a larger value in a list beside the words. Ids are coded in blocks;
the offset of each block in the words is kept, so that all blocks are decoded at once with array operations.

Files are Parquet tables of chunks. A chunk has consecutive documents, their lengths, and the blocks with their ids;
shards are the tasks that wrote them, in the order of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrim.functions.tokenizers import Pieces
from veritrim.llm.common import arrow_map, texts_of
from veritrim.session import shared_folder

#: ids per word and bits per id of selectors 1 to 14 (fixed values of the coding).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096
CHUNK_IDS = 1 << 18
CHUNK_SCHEMA = (
    "shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, words binary, offsets binary, large binary"
)


#: Bits of each value of 16 bits.
_SMALL = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value; 1 for 0."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values]
    if not len(values) or values.max() < 1 << 52:  # exact as doubles
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1)
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.maximum(np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]), 1)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, values of more than 60 bits). Any unsigned 64-bit values; none give none."""
    values = np.asarray(values, np.uint64)
    n, rows = len(values), -(-len(values) // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    most = int(COUNTS.max())
    grid = np.zeros((rows, block + most), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = values
    grid[:, :block] = flat.reshape(rows, block)
    bits = bit_lengths(grid.ravel()).reshape(grid.shape)
    large = values[bits[:, :block].ravel()[:n] > 60]
    # The selector at each place: the first, so the widest, whose ids all fit. A word may run over the end of its block.
    # ``widest`` has the most bits of the next ids at each place, of as many ids as the selector at hand takes.
    chosen = np.zeros((rows, block), np.int8)
    widest, reach = bits.astype(np.uint8), 1
    for selector in range(len(COUNTS) - 1, 0, -1):
        count = int(COUNTS[selector])
        while reach < count:
            step = min(reach, count - reach)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        np.copyto(chosen, np.int8(selector), where=widest[:, :block] <= BITS[selector])
    ends = np.arange(1, rows + 1) * block
    ends[-1] = n
    # All blocks advance together, one word a step.
    takes = COUNTS[chosen.ravel()]
    at, steps = np.arange(rows) * block, []
    while len(at):
        steps.append(at)
        at = at + takes[at]
        going = at < ends
        if not going.all():
            at, ends = at[going], ends[going]
    place = np.sort(np.concatenate(steps))
    row, selector = place // block, chosen.ravel()[place]
    words = selector.astype(np.uint64) << np.uint64(60)
    ids, place = grid.ravel(), place + row * most
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        width, first, packed = np.uint64(BITS[s]), place[mine], words[mine]
        for k in range(int(COUNTS[s])):
            packed |= ids[first + k] << (np.uint64(k) * width)
        words[mine] = packed
    return words, np.searchsorted(row, np.arange(rows)), large


def decode(words: np.ndarray, offsets: np.ndarray, large: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values that ``encode`` got, as unsigned 64-bit integers."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector].copy()
    ends = np.append(offsets[1:], len(words))
    sizes = np.full(len(offsets), block)
    sizes[-1] = n - (len(offsets) - 1) * block
    held = np.add.reduceat(counts, offsets)
    counts[ends - 1] -= held - sizes  # the last word of a block may be partly filled
    start = np.cumsum(counts) - counts
    within = (np.arange(n) - np.repeat(start, counts)).astype(np.uint64)
    width = np.repeat(BITS[selector].astype(np.uint64), counts)
    out = (np.repeat(words, counts) >> (within * width)) & ((np.uint64(1) << width) - np.uint64(1))
    escaped = np.repeat(selector == 0, counts)
    if escaped.any():
        out[escaped] = large[out[escaped].astype(np.int64)]
    return out


#: What this worker process knows, by tokenizer file; its later tasks go on with it.
_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES.clear()
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def slices(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows in order, as many at a time as have ``size`` bytes of text, or one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text; other columns are ignored) in the order of (doc_id, text), NULL ids first.

    NULL and empty texts have the end id only; repeated rows are coded each. A long document makes a long chunk.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, chunk = pieces_of(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(ids).astype(np.uint64)
            words, offsets, large = encode(values)
            blobs = [words.astype("<u8"), offsets.astype("<i8"), large.astype("<u8")]
            row = [[shard], [chunk], [len(values)], [doc_ids], [[len(x) for x in ids]], *([b.tobytes()] for b in blobs)]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
            )

        for batch in batches:
            for part in slices(batch):
                texts = [t.decode("utf-8") for t in texts_of(part.column("text"))]
                for doc_id, found in zip(part.column("doc_id").to_pylist(), pieces.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(np.append(found, np.uint32(end_id)))
                    total += len(found) + 1
                    if total >= CHUNK_IDS:
                        yield flush()
                        doc_ids, ids, total, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_map(ordered, task, CHUNK_SCHEMA)


def write_documents(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> str:
    """Writes the chunk files and returns their folder (a new one in the shared folder unless named)."""
    path = path or shared_folder(docs.sparkSession, "token-ids")
    encode_documents(docs, tokenizer_path, end_id).write.mode("overwrite").parquet(path)
    return path


def chunks_with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with ``start``: the ids before each. Only sums per shard go through one task."""
    chunks = spark.read.parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("shard", "chunk", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("chunk_start"))
    starts = starts.join(shards, "shard").select("shard", "chunk", (F.col("shard_start") + F.col("chunk_start")).alias("start"))
    return chunks.join(starts, ["shard", "chunk"])


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless switched off, the ids, decoded from the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a chunk at a time
                row = batch.slice(k, 1).to_pylist()[0]
                blobs = [np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("offsets", "<i8"), ("large", "<u8"))]
                ids = decode(*blobs, row["n_ids"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                parts = np.split(ids, ends[:-1])
                starts = row["start"] + ends - [len(p) for p in parts]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return arrow_map(chunks_with_starts(spark, path), task, schema)
