"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: neighbouring symbols get labels from the lowest bit in which they
differ, again and again until six labels are left, and phrases begin at local extremes of the labels. A phrase's
name is a hash of its symbols; the names are the symbols of the next level. Cuts depend on a few symbols around them, so
equal substrings have equal phrases inside, at whatever offset they stand.

A fingerprint keeps, for each level, the smallest phrase names; likeness estimates from them the share of phrases that two
texts have in common. Many texts are parsed at once with array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import arrow_map

#: Levels whose names a fingerprint holds, and most names of each.
LEVELS = (2, 3, 4, 5)
KEPT = 24
GROUP_CHARS = 300_000

_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coin_table() -> np.ndarray:
    """Label of a small label (below 128) after another: twice the lowest bit in which they differ, plus its value."""
    before, now = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = (before ^ now) & -(before ^ now)
    bit = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return (2 * bit + ((now >> bit) & 1)).astype(np.uint8).ravel()


_COINS = _coin_table()


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, different between neighbours, of symbols that differ from theirs; ``first`` are starts of texts."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = symbols ^ before
    low = differ & (~differ + np.uint64(1))
    bit = np.bitwise_count(low - np.uint64(1))
    labels = (bit << np.uint8(1)) | ((symbols & low) > 0)
    for _ in range(3):  # 128 labels become 14, 8 and 6
        pair = np.empty(len(labels), np.int32)
        pair[1:] = labels[:-1]
        pair[first] = labels[first] ^ 1
        pair <<= 7
        pair |= labels
        labels = _COINS[pair]
    return labels


def next_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase names, first phrase of each text); ``first`` is where texts start, none of them empty."""
    start = np.ones(len(symbols), bool)
    start[1:] = symbols[1:] != symbols[:-1]
    start[first] = True
    if not start.all():  # a run of one symbol is a symbol of its own
        at = np.flatnonzero(start)
        runs = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        single = symbols[at]
        symbols = np.where(runs > 1, _mixed(single + runs * _MULTIPLIERS[63]), single)
        first = np.searchsorted(at, first)
    labels = _labels(symbols, first)
    up = np.zeros(len(labels), bool)
    up[1:] = labels[1:] > labels[:-1]
    inner = np.ones(len(labels), bool)
    inner[first] = False
    inner[first[1:] - 1] = False
    inner[-1] = False
    falls = np.zeros(len(labels), bool)
    falls[:-1] = ~up[1:]
    highest = up & falls & inner
    lowest = ~up & ~falls & inner
    near = np.zeros(len(labels), bool)
    near[1:] |= highest[:-1]
    near[:-1] |= highest[1:]
    begin = highest | (lowest & ~near)
    begin[first] = True
    at = np.flatnonzero(begin)
    within = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
    names = np.add.reduceat(symbols * _MULTIPLIERS[np.minimum(within, 62)], at)
    return _mixed(names), np.searchsorted(at, first)


def fingerprints(texts: list[str]) -> list[tuple[tuple[int, ...], ...]]:
    """For each text and level of ``LEVELS`` the smallest distinct names (32 bits), ascending. Empty texts have none."""
    out: list = [((),) * len(LEVELS)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(texts[i]) for i in some])
    first = np.cumsum(sizes) - sizes
    symbols = _mixed(symbols + _MULTIPLIERS[0])
    held: list[list[tuple[int, ...]]] = [[] for _ in some]
    for level in range(1, max(LEVELS) + 1):
        symbols, first = next_level(symbols, first)
        if level not in LEVELS:
            continue
        sizes = np.diff(np.append(first, len(symbols)))
        # (text, name) in one word, sorted; then the first distinct ones of each text.
        keys = np.sort((np.repeat(np.arange(len(some)), sizes).astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32)))
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        begins = np.searchsorted(keys, np.arange(len(some) + 1).astype(np.uint64) << np.uint64(32))
        names = (keys & np.uint64(0xFFFFFFFF)).tolist()
        for k, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            held[k].append(tuple(names[lo : min(hi, lo + KEPT)]))
    for i, levels in zip(some, held, strict=True):
        out[i] = tuple(levels)
    return out


def written_out(levels: tuple[tuple[int, ...], ...]) -> str:
    """Hexadecimal, eight digits a name, levels apart by full stops; an empty text has the empty fingerprint."""
    return ".".join(np.array(names, ">u4").tobytes().hex() for names in levels) if any(levels) else ""


def likeness(a: tuple[tuple[int, ...], ...], b: tuple[tuple[int, ...], ...]) -> float:
    """Share of the smallest names of both that both have, over all levels; 1 for two empty fingerprints, 0 for one."""
    shared = seen = 0
    for x, y in zip(a, b, strict=True):
        if x == y:
            shared, seen = shared + len(x), seen + len(x)
            continue
        mine, other = set(x), set(y)
        both = sorted(mine | other)[:KEPT]
        seen += len(both)
        shared += len(mine.intersection(other, both))
    return shared / seen if seen else 1.0


def beside_the_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, guest, doc_id, text) in order within each task: a part's documents by doc_id, then the one that follows.

    The parts are ranges of doc_id; the first document of each is also a guest of the part before (of the last
    part, for the first), so every document meets the next one without a global order in one task. Bounds and
    heads of the parts, a few numbers each, reach the driver.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    )
    bounds = sorted(set(rows.approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    limits = F.array(*(F.lit(int(b)) for b in bounds)).cast("array<bigint>")
    rows = rows.withColumn("part", F.size(F.filter(limits, lambda b: b <= F.col("place"))))
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.min("place").alias("head")).collect())
    hosts = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    here = F.struct("part", F.lit(0).alias("guest"))
    entries = F.array(here)
    if hosts:
        table = F.create_map(*(F.lit(x) for pair in hosts.items() for x in pair))
        there = F.struct(F.element_at(table, F.col("place")).alias("part"), F.lit(1).alias("guest"))
        entries = F.when(F.col("place").isin(list(hosts)), F.array(here, there)).otherwise(entries)
    return (
        rows.select(F.explode(entries).alias("at"), "doc_id", "place", "text")
        .select("at.part", "at.guest", "doc_id", "place", "text")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "guest", "place", F.xxhash64("text"))
    )


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``
    (doc_id, text; other columns are ignored). Next is by ascending doc_id (NULL first, repeated ids by a hash of the
    text), after the last comes the first; a single document follows itself. NULL texts are empty.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[object, str, str]] = []
        chars, names = 0, [c.split()[0] for c in schema.split(", ")]

        def out(like: pa.DataType) -> pa.RecordBatch:
            edited = []
            for _, text, following in pairs:
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + following[:cut])
            texts = [p[1] for p in pairs] + edited
            follow = []  # where the next document's fingerprint is
            for i, (_, _, following) in enumerate(pairs):
                if i + 1 < len(pairs) and pairs[i + 1][1] is following:
                    follow.append(i + 1)
                else:
                    follow.append(len(texts))
                    texts.append(following)
            prints = fingerprints(texts)
            n = len(pairs)
            own, changed = prints[:n], prints[n : 2 * n]
            columns = [
                pa.array([p[0] for p in pairs], like),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(map(written_out, own), pa.string()),
                pa.array(map(written_out, changed), pa.string()),
                pa.array(map(likeness, own, changed), pa.float64()),
                pa.array([likeness(a, prints[f]) for a, f in zip(own, follow, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        part, held, like = None, None, None
        for batch in batches:
            like = batch.schema.field("doc_id").type
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                for p, guest, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                    if p != part:
                        part, held = p, None
                    if held is not None:
                        pairs.append((*held, text))
                        chars += 2 * len(held[1])
                    held = None if guest else (doc_id, text)
                    if chars >= GROUP_CHARS:
                        yield out(like)
                        pairs, chars = [], 0
        if pairs:
            yield out(like)

    return arrow_map(beside_the_next(docs, parts), task, schema)
