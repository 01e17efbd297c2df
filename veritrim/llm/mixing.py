"""Mixing sources to target weights by pivotal dependent rounding.

A document's fractional copies become whole ones in pairs: mass moves between two documents, at random and fair in
expectation, until one of them is whole; the other goes on. A node of the reduction tree does this for some
documents of one source and hands on at most one unfinished document; nodes of the next level take those. So a
source's words stay as they were but for the last unfinished document, and no node gets more than a
bounded number of rows, however large its source is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrim.llm.common import written

#: Documents that a node of the tree takes on average.
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, n (documents with words), source_size, target, from rows of (source, size).

    Sources by code point, NULL last, have the weights in turn. ``share`` of all words is dealt out by
    weight; what is above ``cap`` times a source's size goes to the others until none is above: target =
    min(cap * size, level * weight), where the level is the largest of those at which the sources that fill up
    first are full. One row per source goes through one task; documents do not.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "rank")
    everything = Window.partitionBy()
    rank = F.col("rank")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    full = F.sum(F.col("cap")).over(by_fill) - F.col("cap")
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(cap))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) * float(share) - full) / left)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "source_size", "n", "target")
    )


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)


def _node(units: Column) -> Column:
    """One node: an array of units in, an array of units of which at most one is unfinished out.

    A unit is (key, nth, doc_id, size, mass) with 0 < mass < size before; it is finished when its mass is 0 or its size.
    """

    def put(unit: Column, mass: Column) -> Column:
        return unit.withField("mass", mass)

    def step(state: Column, unit: Column) -> Column:
        held = state["held"]
        a, b = held["mass"], unit["mass"]
        room_a, room_b = held["size"] - a, unit["size"] - b
        down, up = F.least(a, room_b), F.least(room_a, b)  # what the held unit can give, and take
        gives = _uniform(held["key"], held["nth"], unit["key"], unit["nth"]) * (down + up) < up
        new_a = F.when(gives, F.when(a <= room_b, 0.0).otherwise(a - room_b)).otherwise(
            F.when(room_a <= b, held["size"].cast("double")).otherwise(a + b)
        )
        new_b = F.when(gives, F.when(a <= room_b, a + b).otherwise(unit["size"].cast("double"))).otherwise(
            F.when(room_a <= b, b - room_a).otherwise(0.0)
        )
        first, second = put(held, new_a), put(unit, new_b)
        first_done = (new_a <= 0) | (new_a >= held["size"])
        return F.when(
            held.isNull(), F.struct(unit.alias("held"), state["done"].alias("done"))
        ).otherwise(
            F.struct(
                F.when(first_done, second).otherwise(first).alias("held"),
                F.concat(state["done"], F.array(F.when(first_done, first).otherwise(second))).alias("done"),
            )
        )

    empty = F.slice(units, 1, 0)
    start = F.struct(F.when(F.size(units) < 0, units[0]).alias("held"), empty.alias("done"))
    return F.aggregate(units, start, step, lambda s: F.concat(s["done"], F.array(s["held"])))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, fan_in: int = FAN_IN
) -> DataFrame:
    """Copies of each document: doc_id, nth, source, size, source_size, target, copies, taken.

    ``docs`` has doc_id, text, source; other columns are ignored. ``nth`` numbers rows of the same doc_id by source and
    size, so that repeated rows are rounded apart. A document gets floor(f) or floor(f) + 1 copies, with f the target
    over the size of its source; a source misses its target by less than one document: the last unfinished one is
    rounded to the nearer side. Choices depend on ids alone, so reruns agree. NULL texts and texts
    without words have size 0 and no copies taken beyond floor(f); an empty table gives an empty one.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    numbered = Window.partitionBy("key").orderBy("source", "size")
    sizes = written(
        docs.select(key.alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size")).withColumn(
            "nth", F.row_number().over(numbered)
        ),
        "mixing-sizes",
    )
    sources = written(source_targets(sizes, weights, share, cap), "mixing-sources")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(each)
    named = sources.select(F.col("source").alias("_source"), "source_size", "n", "target")
    known = lambda df: df.join(named, df["source"].eqNullSafe(named["_source"])).drop("_source")
    planned = known(sizes).withColumn("mass", (each - whole) * F.col("size"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    unit = F.struct("key", "nth", "doc_id", "size", "mass")
    finished = [planned.filter(~open_).select("doc_id", "nth", "source", "size", F.lit(0).alias("extra"))]

    most = sources.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # one number
    pending, level, nodes = planned.filter(open_).select("source", unit.alias("unit"), "n"), 0, F.col("n")
    while most > 1 or level == 0:
        most, level = math.ceil(most / fan_in), level + 1
        nodes = F.ceil(nodes / float(fan_in))
        placed = F.pmod(F.xxhash64("unit.key", "unit.nth", F.lit(level)), F.greatest(nodes, F.lit(1)))
        grouped = (
            pending.withColumn("node", placed)
            .groupBy("source", "node")
            .agg(F.collect_list("unit").alias("units"), F.first("n").alias("n"))
            .withColumn("units", F.array_sort("units"))
        )
        result = written(grouped.select("source", "n", F.explode(_node(F.col("units"))).alias("unit")), f"mixing-level{level}")
        done = (F.col("unit.mass") <= 0) | (F.col("unit.mass") >= F.col("unit.size"))
        extra = F.when(F.col("unit.mass") * 2 >= F.col("unit.size"), 1).otherwise(0)
        rows = lambda df: df.select("unit.doc_id", "unit.nth", "source", "unit.size", extra.alias("extra"))
        last = most <= 1
        finished.append(rows(result if last else result.filter(done)))
        pending = result.filter(~done).select("source", "unit", "n")
        if last:
            break

    chosen = finished[0]
    for part in finished[1:]:
        chosen = chosen.unionByName(part)
    return known(chosen).select(
        "doc_id",
        "nth",
        "source",
        "size",
        "source_size",
        "target",
        (whole + F.col("extra")).cast("long").alias("copies"),
        ((whole + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
    )


def repeat_by_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Each row of ``docs`` as many times as ``copies`` (of ``mix``) says; rows with no copy go.

    Rows and copies of a doc_id meet in one shuffle; those of the same source and size are paired in any order.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key")
    row = F.struct(*docs.columns)
    rows = docs.select(name, F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), row.alias("_row"))
    told = copies.select(name, F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    both = rows.unionByName(told, allowMissingColumns=True).repartition("_key")
    alike = Window.partitionBy("_key", "_source", "_size", F.col("_row").isNull()).orderBy("_copies")
    paired = Window.partitionBy("_key", "_source", "_size", "_nth")
    both = both.withColumn("_nth", F.row_number().over(alike)).withColumn("_copies", F.max("_copies").over(paired))
    wanted = both.filter("_row is not null and _copies > 0")
    return wanted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
