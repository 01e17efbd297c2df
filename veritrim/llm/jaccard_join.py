"""Jaccard self-join of documents on word shingles, exact, and its connected components.

Documents with equal sets are one node. Two nodes can only link if they share one of the first shingles of both in a
common order (the prefix of each that is longer than what may differ). The order is by hash, with shingles that many texts
share last, so that passages found everywhere seldom are what brings texts together.

Nodes that share a prefix shingle form a run, sorted and banded by set size; in a band each is paired with the first (a
star). Pairs are checked by bitmap signatures, whose bit counts bound the overlap from above, then by intersection of
the sorted shingles. Runs that still hold several components are joined in tiles of the sizes that may link, across components
only, and by signatures before any pair leaves the tile: first the likeliest pair of each node, and at the end all that are left.
So a group of many copies costs as many pairs as it has members, and no link between different components is lost.

Any choice of the shingles that come last gives the same result; it only decides how many pairs are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import LOWER_BYTES, arrow_map, largest, sized, texts_of, written

WIDTH = 5
#: Similarity as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: A shingle that so many texts of one batch share counts as common; at most so many common ones are told to the tasks.
COMMON_IN_BATCH, MOST_COMMON = 3, 500_000
#: Rows of one common shingle that go to one task.
SALT_ROWS = 2000

_RNG = np.random.default_rng(17)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; texts without words have none."""
    data = np.frombuffer(b" ".join(t.translate(LOWER_BYTES) for t in texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    letter = ~_SPACE[data]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    lengths = last - first
    inside = np.flatnonzero(letter)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = mixed(np.arange(int(lengths.max()), dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    begins = np.cumsum(lengths) - lengths
    words = mixed(np.add.reduceat(_BYTES[data[inside]] * weight[place], begins) + lengths.astype(np.uint64))
    bounds = np.searchsorted(first, ends)  # words up to the end of each text
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _PLACES[j]
    rolled = mixed(rolled)
    out, lo = [], 0
    for hi in bounds.tolist():
        n = hi - lo
        if n >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif n:
            short = (words[lo:hi] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACES[width + n]
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
        lo = hi
    return out


def node_of(shingles: np.ndarray) -> int:
    """A name of the set, the same in any order; the empty set has 0."""
    if not len(shingles):
        return 0
    total = mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + _PLACES[:1] * np.uint64(len(shingles)))[0].astype(np.int64)) or 1


def signature(shingles: np.ndarray) -> bytes:
    """One bit for each hash value modulo the bits, on if an odd number of shingles fall there.

    There are at least as many bits as shingles (a power of two, 64 or more). Bits in which two signatures differ
    are no more than the shingles in which the sets differ; halves of a longer one can be folded onto each other.
    """
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No two sets of these sizes and signatures share more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def links(overlap: int, n_a: int, n_b: int) -> bool:
    return WHOLE * overlap >= PART * (n_a + n_b - overlap)


def _batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _record(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names.split())


def repeated(sets: list[np.ndarray], parts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, its sets) of those that ``COMMON_IN_BATCH`` or more of the sorted sets have, in order.

    One part of the range of the hashes is counted after another, so that no second copy of all sets is held.
    """
    bounds = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    out = []
    for k in range(parts if sets else 0):
        every = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
        every.sort()
        again = every[COMMON_IN_BATCH - 1 :]
        found = np.unique(again[again == every[: len(again)]])  # sorted, so many equals reach from one to the other
        out.append((found, np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left")))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(empty, *out, strict=True))


def describe(docs: DataFrame) -> DataFrame:
    """Rows of each text (kind 0: doc_id, text_hash, node, n, signature) and of common shingles (kind 1: node is the
    shingle, n its texts in a batch)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "kind doc_id text_hash node n signature"
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            like = batch.schema.field("doc_id").type
            for rows in _batches(batch):
                sets = shingle_sets(texts_of(rows.column("text")))
                nodes = [node_of(s) for s in sets]
                columns = [
                    pa.array([0] * len(sets), pa.int32()),
                    rows.column("doc_id"),
                    rows.column("text_hash"),
                    pa.array(nodes, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary()),
                ]
                yield _record(columns, names)
                held.update(zip(nodes, sets, strict=True))
            found, counts = repeated(list(held.values()))
            held.clear()
            nothing = [pa.nulls(len(found), t) for t in (like, pa.int64(), pa.binary())]
            yield _record(
                [pa.array([1] * len(found), pa.int32()), nothing[0], nothing[1], _signed(found), pa.array(counts, pa.int64()), nothing[2]],
                names,
            )

    return arrow_map(docs, task, f"kind int, doc_id {id_type}, text_hash long, node long, n long, signature binary")


def prefixes(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, set of each): those of each set that come first, the sorted ``common`` ones last, by which a link must show."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    wanted = sizes - -(-PART * sizes // WHOLE) + 1
    place = np.searchsorted(common, every)
    last = common[np.minimum(place, len(common) - 1)] == every if len(common) else np.zeros(len(every), bool)
    begin = np.cumsum(sizes) - sizes
    rare_before = np.cumsum(~last) - ~last
    base = np.append(rare_before, (~last).sum())
    rare_rank = rare_before - base[begin][owner]
    common_rank = np.arange(len(every)) - begin[owner] - rare_rank
    rare = base[begin + sizes] - base[begin]
    rank = np.where(last, rare[owner] + common_rank, rare_rank)
    chosen = rank < wanted[owner]
    return every[chosen], owner[chosen]


def prefix_rows(docs: DataFrame, common: np.ndarray, texts: np.ndarray) -> DataFrame:
    """token, salt, n, node, parts: the prefix of each text. Common tokens are salted by how many texts have them, into so
    many parts; others have one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch):
                sets = shingle_sets(texts_of(rows.column("text")))
                tokens, owner = prefixes(sets, common)
                node = np.array([node_of(s) for s in sets], np.int64)[owner]
                size = np.array([len(s) for s in sets], np.int64)[owner]
                salt, parts = np.zeros(len(tokens), np.int64), np.ones(len(tokens), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    parts = np.where(common[at] == tokens, -(-texts[at] // SALT_ROWS), 1)
                    salt = (node.view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts
                columns = [pa.array(salt, pa.int32()), *(pa.array(c, pa.int64()) for c in (size, node, parts))]
                yield _record([_signed(tokens), *columns], "token salt n node parts")

    return arrow_map(docs, task, "token long, salt int, n long, node long, parts long")


def band_of(n: np.ndarray) -> np.ndarray:
    """Size bands by a factor of 5 / 4."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(WHOLE / PART) + 1e-9).astype(np.int64)


def runs(prefix: DataFrame) -> DataFrame:
    """token, salt, n, node, band, lead_n, lead: nodes of tokens that several nodes have, with the first of their band.
    A token of several salts keeps all its nodes, since what is alone in its salt has others elsewhere.

    The shuffle brings a token's rows together and sorts them; they stream through the task.
    """
    names = "token salt n node band lead_n lead"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((5, 0), np.int64)  # the last row so far, whose run may go on
        lead: tuple[int, ...] | None = None  # (token, salt, band, n, node) of its band
        told = False  # whether the last row's run had others

        def out(rows: np.ndarray, end: bool) -> pa.RecordBatch | None:
            nonlocal rest, lead, told
            token, salt, n, node, parts = rows
            new = np.ones(len(token), bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            token, salt, n, node, parts = rows[:, new]
            if not len(token):
                return None
            change = np.ones(len(token), bool)
            change[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            run = np.cumsum(change) - 1
            several = (np.bincount(run) > 1)[run]
            band = band_of(n)
            start = change.copy()
            start[1:] |= band[1:] != band[:-1]
            first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
            lead_n, lead_node = n[first], node[first]
            if lead is not None and lead[:3] == (token[0], salt[0], band[0]):
                same = first == 0
                lead_n, lead_node = np.where(same, lead[3], lead_n), np.where(same, lead[4], lead_node)
            several[run == 0] |= told
            keep = several | (parts > 1)
            if not end:  # the last row is told with what follows it
                keep[-1] = False
            more = told if run[-1] == 0 else False
            told = bool(more or (run == run[-1]).sum() > 1)
            lead = (token[-1], salt[-1], band[-1], lead_n[-1], lead_node[-1])
            rest = np.stack([token[-1:], salt[-1:], n[-1:], node[-1:], parts[-1:]])
            columns = (token, salt, n, node, band, lead_n, lead_node)
            return _record([pa.array(c[keep], pa.int64()) for c in columns], names)

        for batch in batches:
            part = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("token", "salt", "n", "node", "parts")])
            made = out(np.concatenate([rest, part], axis=1), end=False)
            if made is not None and made.num_rows:
                yield made
        if rest.shape[1]:
            made = out(rest, end=True)
            if made is not None and made.num_rows:
                yield made

    ordered = prefix.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    return arrow_map(ordered, task, ", ".join(f"{c} long" for c in names.split()))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. ``nodes``: node, n, signature, doc_id and text_hash of one text each."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sign_a", "sign_b", "n_a", "n_b")]
            ok = [links(min(overlap_bound(*r), r[2], r[3]), r[2], r[3]) for r in zip(*columns, strict=True)]
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch):
                sets = shingle_sets(texts_of(rows.column("text")))
                yield _record([rows.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], "node shingles")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch):
                columns = [rows.column(c).to_pylist() for c in ("shingles_a", "shingles_b")]
                ok = []
                for x, y in zip(*columns, strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    ok.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda df, s, *c: df.select(F.col("node").alias(s), *(F.col(x).alias(f"{y}_{s}") for x, y in c))
    signs = [side(nodes, s, ("n", "n"), ("signature", "sign")) for s in "ab"]
    possible = pairs.join(signs[0], "a").join(signs[1], "b")
    possible = possible.filter((F.col("n_a") * WHOLE >= F.col("n_b") * PART) & (F.col("n_b") * WHOLE >= F.col("n_a") * PART))
    close = written(arrow_map(possible, bound, "a long, b long, n_a long, n_b long"), "jaccard-close")
    needed = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = nodes.join(needed, "node", "left_semi").select("node", F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    texts = sized(written(texts, "jaccard-needed"))
    same = docs["doc_id"].eqNullSafe(texts["_doc_id"]) & (docs["text_hash"] == texts["_text_hash"])
    found = arrow_map(docs.join(texts, same).select("node", "text"), shingles, "node long, shingles binary")
    sets = written(found.dropDuplicates(["node"]), "jaccard-sets")
    both = close.select("a", "b").join(side(sets, "b", ("shingles", "shingles")), "b").join(side(sets, "a", ("shingles", "shingles")), "a")
    return written(arrow_map(both, exact, "a long, b long"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) of every node with an edge (a, b), by alternating stars.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest. Rounds grow with the
    logarithm of the longest path; only counts and sums reach the driver.
    """
    edges = edges.select(*_ordered(F.col("a"), F.col("b"))).filter("a < b").distinct()
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        edges = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        edges = written(edges, "jaccard-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def most_overlap(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The bound of the overlap of each pair by its signatures; array operations over pairs of like lengths."""
    out = np.zeros(len(a), np.int64)
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for wide in np.unique(widths, axis=0):
        mine = np.flatnonzero((widths == wide).all(axis=1))
        x, y = (np.frombuffer(b"".join(side[k] for k in mine), np.uint64).reshape(len(mine), -1) for side in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
        out[mine] = (n_a[mine] + n_b[mine] - differ) // 2
    return out


def across(rows: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of nodes of one token (token, n, node, root, signature) that may link by size and signature, and whose
    roots differ: all of them, or with ``best`` for each node the likeliest of those before it, so that there are no more
    pairs than rows.

    Rows of a token come sorted by size; a task holds those whose size may link with the next, and joins tile after
    tile with them. Only pairs that pass the bound of their signatures leave it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = np.zeros((4, 0), np.int64), np.zeros(0, object)
        for batch in batches:
            whole = np.stack([np.asarray(batch.column(c)) for c in ("token", "n", "node", "root")])
            signs = np.array([*batch.column("signature").to_pylist(), None], object)[:-1]
            for start in range(0, whole.shape[1], 256):
                tile = whole[:, start : start + 256]
                reach = (window[0] == tile[0, 0]) & (window[1] * WHOLE >= tile[1, 0] * PART)
                window = np.concatenate([window[:, reach], tile], axis=1)
                held = np.concatenate([held[reach], signs[start : start + 256]])
                old = window.shape[1] - tile.shape[1]
                likeliest, partner = np.zeros(tile.shape[1]), np.zeros(tile.shape[1], np.int64)
                for lo in range(0, window.shape[1], 256):
                    side = window[:, lo : lo + 256]
                    fits = (side[0][:, None] == tile[0]) & (side[3][:, None] != tile[3]) & (side[1][:, None] * WHOLE >= tile[1] * PART)
                    fits &= np.arange(lo, lo + side.shape[1])[:, None] < old + np.arange(tile.shape[1])
                    i, j = np.nonzero(fits)
                    for k in range(0, len(i), 8192):
                        x, y = i[k : k + 8192], j[k : k + 8192]
                        n_x, n_y = side[1][x], tile[1][y]
                        overlap = most_overlap(list(held[lo + x]), list(held[old + y]), n_x, n_y)
                        near = links(overlap, n_x, n_y)
                        x, y, share = x[near], y[near], (overlap / (n_x + n_y - overlap))[near]
                        if best:
                            order = np.argsort(share, kind="stable")  # the last written is the likeliest
                            x, y, share = x[order], y[order], share[order]
                            more = share > likeliest[y]
                            likeliest[y[more]], partner[y[more]] = share[more], side[2][x[more]]
                        elif len(x):
                            yield _record([pa.array(side[2][x], pa.int64()), pa.array(tile[2][y], pa.int64())], "a b")
                found = likeliest > 0
                if found.any():
                    yield _record([pa.array(partner[found], pa.int64()), pa.array(tile[2][found], pa.int64())], "a b")
                last = window[0] == tile[0, -1]
                window, held = window[:, last], held[last]

    ordered = rows.select("token", "n", "node", "root", "signature").repartition("token").sortWithinPartitions("token", "n", "node")
    pairs = arrow_map(ordered, task, "a long, b long")
    return pairs.select(*_ordered(F.col("a"), F.col("b"))).distinct()


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (shingles), root (the same for all rows of a component) of each row of ``docs``; written."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    described = written(describe(docs), "jaccard-described")
    rows = described.filter("kind = 0").drop("kind")
    common = written(described.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")), "jaccard-common")
    told = largest(common, "n", MOST_COMMON).toArrow()  # bounded by a parameter
    shingle, texts = (np.asarray(told.column(c)).astype(np.int64) for c in ("node", "n"))
    order = np.argsort(shingle.view(np.uint64))
    shingle, texts = shingle[order].view(np.uint64), texts[order]

    one = F.min_by(F.struct("doc_id", "text_hash"), F.struct("doc_id", "text_hash")).alias("one")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), one)
    nodes = written(nodes.select("node", "n", "signature", "one.doc_id", "one.text_hash"), "jaccard-nodes")

    shared = written(runs(prefix_rows(docs, shingle, texts)), "jaccard-runs")
    leads = shared.select("token", "band", "lead_n", "lead").distinct()
    heads = leads.groupBy("token", "band").agg(F.min(F.struct("lead_n", "lead")).alias("head"))  # over all salts
    stars = shared.select(*_ordered(F.col("lead"), F.col("node"))).unionByName(
        leads.join(heads, ["token", "band"]).select(*_ordered(F.col("lead"), F.col("head.lead")))
    )
    seen = written(stars.filter("a < b").distinct(), "jaccard-pairs")
    roots = written(components(verified(seen, nodes, docs)), "jaccard-roots")
    # What is left of different components: twice the likeliest pair of each node, which joins most of them, then all pairs.
    for best in (True, True, False):
        placed = shared.select("token", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        told = nodes.select("node", "signature").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = shared.select("token", "n", "node").join(several.select("token"), "token", "left_semi").join(told, "node")
        new = written(across(left, best).join(seen, ["a", "b"], "left_anti"), "jaccard-pairs")
        ends = roots.filter("node > root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = written(components(ends.unionByName(verified(new, nodes, docs))), "jaccard-roots")
        seen = seen.unionByName(new)
    final = roots
    named = rows.join(final, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root"))
    return written(named, "jaccard-named")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest doc_id that links lead to, the row's own included. Equal sets always link.
    NULL, empty and blank texts have no shingles and link with nothing, not even each other. Repeated rows are rows
    of their own. A NULL doc_id never names a component of others; alone it has none. Sets are told apart by 64-bit hashes.
    """
    named = linked_rows(docs)
    smallest = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(smallest, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest (doc_id, text hash) stays.

    Of repeated rows one stays. Texts without words all stay. Rows keep their columns and values.
    """
    rows = linked_rows(docs).filter("n > 0")
    name = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")  # NULL ids last
    first = rows.groupBy("root").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    others = rows.join(first, "root").select("doc_id", "text_hash", (name == F.col("first")).alias("stays"))
    others = others.groupBy("doc_id", "text_hash").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    listed = others.filter("not stays or rows > 1").toDF("_listed_id", "_listed_hash", "_listed_stays", "_listed_rows")
    listed = sized(written(listed, "jaccard-listed"))
    hash_ = F.xxhash64(docs["text"].cast("string"))
    same = docs["doc_id"].eqNullSafe(listed["_listed_id"]) & (hash_ == listed["_listed_hash"])
    alone = docs.join(listed, same, "left_anti")
    repeated = docs.join(listed.filter("_listed_stays"), same).dropDuplicates(["_listed_id", "_listed_hash"])
    return alone.unionByName(repeated.select(*[docs[c] for c in docs.columns]))
