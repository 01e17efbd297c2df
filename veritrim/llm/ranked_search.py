"""Ranked lexical search by bit-sliced Bloom signatures.

Documents of like size lie side by side in blocks. A block holds one bitmap over its documents for each bit of their
Bloom signatures, and the texts. A term is entered once for each level of its frequency that it reaches, so that the
bitmaps of a query's terms overestimate how often each document holds them. Weighted sums of these bitmaps bound the scores from
above; a document is scored exactly, from its text, unless its bound is below a score that enough documents are known to reach.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrim.llm.common import ASCII_LOWER, ASCII_UPPER, arrow_map, rows_at_a_time, texts_of, written

#: Documents of a block at most, and the bytes of text at which it closes: what a task holds, not what it takes.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of text in all open blocks of a task at which the largest closes, and documents that a task gets at a time.
OPEN_BYTES, READ_DOCS = 16 << 20, 256
#: The index is stored a few blocks to a row group, so that neither its writer nor its readers hold a whole file.
STORED = {"parquet.block.size": BLOCK_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Frequencies from which on a level holds a term, bits set for each level, and bits of a signature for each entry.
LEVELS = (1, 2, 3, 5, 9, 17)
PROBES, BITS = 2, 12
#: Items searched at a time: the driver holds so many, and each block is compared with so many at once.
ITEMS = 500
#: One block in so many gives the first lower bounds of the scores that matter.
PILOT = 8
INDEX = "pilot int, width long, documents int, terms long, doc_ids array<long>, lengths array<long>, slices binary, texts array<binary>"
HITS = "item int, doc_id long, score long"

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TERMS = bytes.maketrans(ASCII_UPPER.encode() + _SEPARATORS, ASCII_LOWER.encode() + b" " * len(_SEPARATORS))
_NAMES = 1 << 16


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats: runs of letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(_TERMS).split()


def places(names: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The bits of entries, one row a probe."""
    with np.errstate(over="ignore"):
        mixed = (names + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(level).astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        step = (mixed >> np.uint64(33)) | np.uint64(1)
        return np.stack([(mixed + np.uint64(i) * step) % np.uint64(width) for i in range(PROBES)]).astype(np.int64)


def _entries(counts: Counter, names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term, level) of all entries of a document."""
    if len(names) > _NAMES:
        names.clear()
    for term in counts:
        if term not in names:
            names[term] = xxhash.xxh64_intdigest(term)
    hashed = np.fromiter((names[t] for t in counts), np.uint64, len(counts))
    found = np.fromiter(counts.values(), np.int64, len(counts))
    reached = [found >= least for least in LEVELS]
    return np.concatenate([hashed[r] for r in reached]), np.repeat(np.arange(len(LEVELS), dtype=np.uint8), [r.sum() for r in reached])


def _block(docs: list[tuple]) -> dict:
    width = BITS * max(len(names) for *_, names, _ in docs)
    bits = np.zeros((width, -(-len(docs) // 8) * 8), np.bool_)
    for i, (*_, names, level) in enumerate(docs):
        bits[places(names, level, width), i] = True
    first = xxhash.xxh64_intdigest(docs[0][1])
    return {
        "pilot": first % PILOT, "width": width, "documents": len(docs), "terms": sum(d[2] for d in docs), "doc_ids": [d[0] for d in docs],
        "lengths": [d[2] for d in docs], "slices": np.packbits(bits, axis=1).tobytes(), "texts": [d[1] for d in docs],
    }


def _blocks(docs: Iterator[tuple], block_docs: int, open_bytes: int = OPEN_BYTES) -> Iterator[dict]:
    """Blocks of (doc_id, text) with terms; open are one for each doubling of the number of entries, with ``open_bytes`` of text in all."""
    opened: dict[int, list[tuple]] = {}
    held: Counter = Counter()
    names: dict[bytes, int] = {}

    def closed(kind: int) -> dict:
        del held[kind]
        return _block(opened.pop(kind))

    for doc_id, text in docs:
        terms = terms_of(text)
        if not terms:
            continue
        entries = _entries(Counter(terms), names)
        kind = len(entries[0]).bit_length()
        opened.setdefault(kind, []).append((doc_id, text, len(terms), *entries))
        held[kind] += len(text)
        if len(opened[kind]) >= block_docs or held[kind] >= BLOCK_BYTES:
            yield closed(kind)
        elif held.total() >= open_bytes:
            yield closed(max(held, key=held.get))
    for kind in sorted(opened):
        yield closed(kind)


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of the signatures and texts of ``docs`` (doc_id long, text), as a table in the shared folder.

    Documents without terms, NULL texts among them, are left out: they match nothing. Repeated rows and NULL ids are documents
    of their own. Other columns are ignored. A task keeps one open block for each doubling of the number of entries, ``OPEN_BYTES`` of text
    in all; a very long text is a block alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("pilot", pa.int32()), ("width", pa.int64()), ("documents", pa.int32()), ("terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
             ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()), ("texts", pa.list_(pa.binary()))]
        )
        rows = (row for b in batches for row in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True))
        for block in _blocks(rows, block_docs):
            yield pa.RecordBatch.from_pylist([block], schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with rows_at_a_time(docs.sparkSession, READ_DOCS):
        return written(arrow_map(own, task, INDEX), "search-index", **STORED)


def _frequencies(index: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the terms stands: summed by task, then by term; the driver gets a row for each term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for texts in batch.column("texts"):
                for text in texts.as_py():
                    found.update(vocabulary.intersection(terms_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    counted = arrow_map(index.select("texts"), task, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class _Query:
    """What a task needs of a batch of items: their terms, the weights of these, and which item has which."""

    def __init__(self, items: list[bytes], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.n_items = n_docs, n_terms, len(items)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        self.terms = sorted(t for t, w in weight.items() if w > 0)
        number = {t: i for i, t in enumerate(self.terms)}
        self.weights = np.array([weight[t] for t in self.terms], np.int64)
        self.names = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], np.uint64)
        pairs = [(number[t], i) for i, text in enumerate(items) for t in set(terms_of(text)) if t in number]
        self.by_item = np.zeros((len(items), len(self.terms)), np.float32)
        self.items_of: list[list[int]] = [[] for _ in self.terms]
        for t, i in pairs:
            self.by_item[i, t] = weight[self.terms[t]]
            self.items_of[t].append(i)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents with n terms."""
        return 50 + (50 * n * self.n_docs) // self.n_terms

    def bounds(self, width: int, n: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores, items by documents."""
        rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
        held, level = None, np.zeros((len(self.terms), rows.shape[1] * 8), np.uint8)
        for at in range(len(LEVELS)):
            now = np.bitwise_and.reduce(rows[places(self.names, at, width)], axis=0)
            held = now if held is None else held & now  # a frequency reaches all levels below its own
            level += np.unpackbits(held, axis=1)
        level = level[:, : len(n)]
        some = level.any(axis=1)
        most = np.array([0, *(least - 1 for least in LEVELS[1:]), np.iinfo(np.int32).max], np.float64)
        most = np.minimum(most[:, None], n[None, :])
        part = np.where(most > 0, 1e9 * most / (1000 * most + 20 * self.lengths(n)), 0).astype(np.float32)
        total = self.by_item[:, some] @ part[level[some], np.arange(len(n))]
        return np.where(total > 0, total * np.float32(1.0001) + np.float32(1), 0)  # more than single precision rounds

    def scores(self, text: bytes, number: dict[bytes, int]) -> np.ndarray:
        """Exact scores of a document for all items, as whole numbers."""
        words = terms_of(text)
        m = 50 + (50 * len(words) * self.n_docs) // self.n_terms
        total = np.zeros(self.n_items, np.int64)
        for term, tf in Counter(w for w in words if w in number).items():
            at = number[term]
            total[self.items_of[at]] += int(self.weights[at]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        return total


def _hits(index: DataFrame, query: _Query, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): a task's ``k`` best documents of each item, those below ``least`` (item by item) left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(query.terms)}
        best: list[list] = [[] for _ in least]
        bar = least.copy()
        for batch in batches:
            for row in range(batch.num_rows):
                width, ids, lengths, slices, texts = (batch.column(c)[row] for c in ("width", "doc_ids", "lengths", "slices", "texts"))
                bounds = query.bounds(width.as_py(), np.array(lengths.as_py(), np.int64), slices.as_buffer())
                for at in np.flatnonzero((bounds >= bar[:, None]).any(axis=0)):
                    wanted = np.flatnonzero(bounds[:, at] >= bar)
                    if not len(wanted):
                        continue
                    scores = query.scores(texts[int(at)].as_py(), number)
                    doc_id = ids[int(at)].as_py()
                    # The worst of a heap comes first: the lowest score, then the greatest id; NULL counts as the least.
                    for item in wanted[scores[wanted] >= np.maximum(bar[wanted], 1)]:
                        entry = (int(scores[item]), doc_id is None, -(doc_id or 0))
                        if len(best[item]) < k:
                            heapq.heappush(best[item], entry)
                        else:
                            heapq.heappushpop(best[item], entry)
                        if len(best[item]) == k:
                            bar[item] = max(bar[item], best[item][0][0])
        rows = [(i, None if null else -minus, score) for i, held in enumerate(best) for score, null, minus in held]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"]
        )

    return arrow_map(index.select("width", "doc_ids", "lengths", "slices", "texts"), task, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of each item with the highest scores above 0; fewer if there are no more.

    Equal scores go by ascending doc_id, NULL first. Rows of ``items`` (item_id, text) are items of their own, repeated ones
    too; NULL or termless texts find nothing, nor does an empty index. ``items`` comes to the driver ``ITEMS`` rows at a time, which are
    compared with all blocks at once; the lower bounds that a part of the blocks gives only spare work.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not total["n"]:
        return found
    for batch in batched(items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator(), ITEMS):
        texts = [(r["text"] or "").encode() for r in batch]
        vocabulary = {t for text in texts for t in terms_of(text)}
        if not vocabulary:
            continue
        with rows_at_a_time(spark, 1):  # a row is a block
            query = _Query(texts, _frequencies(index, vocabulary), total["n"], total["l"])
            pilot = _ranked(_hits(index.filter("pilot = 0"), query, np.ones(len(texts), np.int64), k), k)
            least = np.ones(len(texts), np.int64)
            for r in pilot.filter(F.col("rank") == k).select("item", "score").collect():
                least[r["item"]] = r["score"]
            ranked = written(_ranked(_hits(index, query, least, k), k), "search-hits")
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], f"item int, item_id {kind}"))
        found = found.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found
