"""The trie of conversation prefixes, by ROLLUP over columns of turn ids.

A conversation is laid out in blocks of a fixed number of columns, one turn id in each; a longer one goes on in further
rows, keyed by the node at which the block before ended. ``GROUP BY block, key, ROLLUP (t1, ..., tn)`` then
aggregates every prefix of every conversation at once, and ``grouping_id`` tells how long a prefix a group is. Sums over
subtrees are the same rollup over the nodes, to which each full block adds what its further blocks hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrim.llm.common import arrow_map, written
from veritrim.operators.skew import lookup_join

#: Turns of a block.
COLUMNS = 8
ROOT = hashlib.md5(b"").hexdigest()
BATCH = 4096


def crc32_of(conv_id: Column) -> Column:
    """Unsigned crc32 of the id in decimal."""
    return F.crc32(conv_id.cast("string").cast("binary"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_id, of rows (conv_id, turn, role, text).

    Rows go by (turn, role, text), NULL turns first; ties and repeated rows are turns of their own. NULL roles and texts are
    empty. Rows without a conv_id belong to no conversation and are left out. The id names role and text by a hash of 128 bits and holds
    the text's code points.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turn_id = F.concat(named, F.lit(":"), F.length(F.col("text")).cast("string"), F.lit(";"))
    return rows.withColumn("place", F.row_number().over(order)).select("conv_id", "place", turn_id.alias("turn_id"))


def with_shared_heads(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations rebuilt so that they share beginnings: conv_id, place, turn_id, and one row of place 0 for each conversation.

    The first h turns of conversation ``c - c % group`` come before what follows the first h turns of conversation c, with h the crc32
    of c modulo ``heads``.
    """
    h = (crc32_of(F.col("conv_id")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    first = turns.filter((F.col("place") < heads) & (F.col("conv_id") % group == 0))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "turn_id"))).alias("first"))
    every = turns.select("conv_id").distinct().select("conv_id", base.alias("base")).join(first, "base", "left")
    shared = every.select("conv_id", F.explode(F.filter("first", lambda x: x["place"] <= h)).alias("x")).select("conv_id", "x.place", "x.turn_id")
    # Own turns follow whatever number of shared ones there is.
    own = turns.filter(F.col("place") > h).select("conv_id", (F.col("place") + heads).alias("place"), "turn_id")
    start = every.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("turn_id"))
    return shared.unionByName(own).unionByName(start)


def blocks(turns: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """conv_id, block, key, up, last, t1, ..., tn: each conversation's turns in rows of ``columns``.

    ``turns`` has conv_id, place, turn_id; a row without a turn_id makes a conversation known that may have no turns. ``key`` names the
    node before the block, ``up`` that of the block before; ``last`` marks a conversation's last row, which only a conversation without
    turns has empty. The turns of a conversation, sorted by the shuffle, stream through one task.
    """
    names = [f"t{i + 1}" for i in range(columns)]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.string()] * columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, block, key, up, held = None, 0, ROOT, None, []

        def put(last: bool) -> None:
            rows.append((conv, block, key, up, last, *held, *[None] * (columns - len(held))))

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "block", "key", "up", "last", *names])

        for batch in batches:
            for conv_id, turn_id in zip(batch.column("conv_id").to_pylist(), batch.column("turn_id").to_pylist(), strict=True):
                if conv_id != conv:
                    if conv is not None:
                        put(True)
                    conv, block, key, up, held = conv_id, 0, ROOT, None, []
                if turn_id is None:
                    continue
                if len(held) == columns:
                    put(False)
                    block, up, key, held = block + 1, key, node_name(key, held), []
                held.append(turn_id)
                if len(rows) >= BATCH:
                    yield out()
        if conv is not None:
            put(True)
        if rows:
            yield out()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = "conv_id long, block int, key string, up string, last boolean, " + ", ".join(f"{n} string" for n in names)
    return arrow_map(ordered.select("conv_id", "turn_id"), task, schema)


def node_name(key: str, turn_ids: list[str]) -> str:
    return hashlib.md5((key + "".join(turn_ids)).encode()).hexdigest() if turn_ids else key


def _name(columns: int, less: int = 0) -> Column:
    """As ``node_name``, of the first ``depth - less`` turns of a row (``width`` is how many it has)."""
    held = F.slice(F.array(*[f"t{i + 1}" for i in range(columns)]), 1, F.col("width") - less)
    return F.when(F.col("width") > less, F.md5(F.concat(F.col("key"), F.array_join(held, "")).cast("binary"))).otherwise(F.col("key"))


def _rollup(rows: DataFrame, columns: int, values: str) -> DataFrame:
    """``values`` for each group of ``rows`` by block, key and some first turns; ``width`` is their number."""
    turns = [f"t{i + 1}" for i in range(columns)]
    filled = " + ".join(f"int({t} IS NOT NULL)" for t in turns)
    found = rows.sparkSession.sql(
        f"SELECT block, key, {', '.join(turns)}, {columns} - bit_count(grouping_id()) AS width, {values} FROM {{rows}} "
        f"GROUP BY block, key, ROLLUP ({', '.join(turns)})",
        rows=rows,
    )
    # A row that ends before a column has no prefix of that length; further blocks begin below the node they are keyed by.
    return found.filter(F.expr(f"{filled} = width") & ((F.col("width") > 0) | (F.col("block") == 0)))


def nodes(laid: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """Every node once: name, parent, depth, conv_id, n_convs, chars, and its place in its block."""
    last = F.element_at(F.array(*[f"t{i + 1}" for i in range(columns)]), F.col("width").cast("int"))
    chars = F.when(F.col("width") > 0, F.regexp_extract(last, r":(\d+);", 1).cast("long")).otherwise(F.lit(0).cast("long"))
    found = _rollup(laid, columns, "min(conv_id) AS conv_id, count(1) AS n_convs").withColumn("width", F.col("width").cast("int"))
    return found.select(
        "*",
        _name(columns).alias("name"),
        F.when(F.col("width") > 0, _name(columns, 1)).alias("parent"),
        (F.col("block") * columns + F.col("width")).cast("long").alias("depth"),
        F.when(F.col("width") > 0, chars).otherwise(0).alias("chars"),
    )


def _below(own: DataFrame, rounds: int) -> DataFrame:
    """key, leaves, saved: of each block with all blocks below it, from rows (key, up, leaves, saved).

    Each round, a block adds its sums to those of the block it points to and then points where that one does, which
    covers twice as many blocks as the round before.
    """
    for k in range(rounds):
        given = own.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        grown = own.join(given, "key", "left").select(
            "key",
            "up",
            (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
        )
        further = own.select(F.col("key").alias("up"), F.col("up").alias("next"))
        jumped = lookup_join(grown, further, "up", ["next"]).select("key", F.col("next").alias("up"), "leaves", "saved")
        own = written(jumped, f"trie-below-{k}")
    return own.select("key", "leaves", "saved")


def _ends(laid: DataFrame, columns: int) -> DataFrame:
    """name, ends_sha256 of the conversations that end at each node; their ids stream sorted through the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, rows = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.string())], names=["name", "ends_sha256"])

        for batch in batches:
            for at, conv_id in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if at != name:
                    if name is not None:
                        rows.append((name, digest.hexdigest()))
                    name, digest = at, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            if len(rows) >= BATCH:
                yield out()
                rows = []
        if name is not None:
            rows.append((name, digest.hexdigest()))
            yield out()

    filled = sum((F.col(f"t{i + 1}").isNotNull().cast("int") for i in range(columns)), F.lit(0))
    ends = laid.filter("last").withColumn("width", filled).select(_name(columns).alias("name"), "conv_id")
    return arrow_map(ends.repartition("name").sortWithinPartitions("name", "conv_id"), task, "name string, ends_sha256 string")


def trie(turns: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    ``turns`` has conv_id, place and turn_id, as ``ordered_turns`` gives them; other columns are ignored. A node is a distinct sequence of
    turns with which conversations begin, from the root on, which has none. conv_id is the smallest of these conversations, n_leaves
    the childless nodes in the subtree, saved_tokens the code points that one copy of each shared turn saves there,
    ends_sha256 the digest of the ids of the conversations that end at the node. An empty table has no nodes.
    """
    laid = written(blocks(turns, columns), "trie-blocks")
    found = written(nodes(laid, columns), "trie-nodes")
    children = found.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = written(
        found.join(children, "name", "left").select(
            *found.columns,
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        "trie-valued",
    )
    deepest = laid.agg(F.max("block")).first()[0] or 0
    turn_names = [f"t{i + 1}" for i in range(columns)]
    place = ["block", "key", *turn_names]
    values = valued.select(*place, "leaves", "saved")
    if deepest:
        ups = laid.filter("block > 0").groupBy("key").agg(F.min(F.when(F.col("block") > 1, F.col("up"))).alias("up"))
        sums = valued.filter("block > 0").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = _below(sums.join(ups, "key"), deepest.bit_length())
        values = values.unionByName(
            valued.select(*place, "name").join(below.withColumnRenamed("key", "name"), "name").select(*place, "leaves", "saved")
        )
    filled = sum((F.col(t).isNotNull().cast("int") for t in turn_names), F.lit(0))
    sums = _rollup(values, columns, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens").withColumn("width", filled)
    sums = sums.select(_name(columns).alias("name"), "n_leaves", "saved_tokens")
    parents = found.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = lookup_join(valued.select("name", "parent", "depth", "conv_id", "n_convs", "n_children"), parents, "parent", ["parent_conv_id"])
    return (
        full.join(sums, "name")
        .join(_ends(laid, columns), "name", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
