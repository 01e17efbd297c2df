"""An index of the cells a log holds, so that a batch looks up its own keys and not the log.

Each commit of the log adds a segment: its cells, dealt by a hash of the sample's key into buckets, one row for each with a Bloom
filter of the hashes. Segments are merged so that each is several times as large as the next, which leaves few of
them, and the number of buckets follows their size. A batch reads the filters of its own buckets and the cells of those
that may hold one of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.schemas import CELL_KEY
from veritrim.session import ship_package

SAMPLE_KEY = ("id", "dataset")
CELL = "struct<id: string, dataset: string, model_name: string, requested_mode: int>"
FOLDER = "_keys"
SEGMENT = f"cells array<{CELL}>, bits binary, segment string, bucket int"
#: Cells of a bucket, about; bits and probes of the filter for each key; how much larger a segment is than the next.
BUCKET_CELLS, KEY_BITS, PROBES, FAN_OUT = 20_000, 12, 4, 4


def key_hash() -> Column:
    return F.xxhash64(*SAMPLE_KEY)


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    mixed = hashes.astype(np.uint64)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return ((mixed[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, 1 << int(len(hashes) * KEY_BITS).bit_length()), np.bool_)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the hashes may be among those the filter was made of."""
    packed = np.frombuffer(filter_, np.uint8)
    at = _places(hashes, len(packed) * 8)
    return bool((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0).any())


def buckets_for(cells: int) -> int:
    return 1 << max(0, (cells // BUCKET_CELLS).bit_length())


def write_segment(cells: DataFrame, path: str, segment: str, at_most: int) -> dict[str, Any]:
    """Write distinct cells, ``at_most`` of them, as a segment; returns its entry: segment, buckets, cells."""
    spark = cells.sparkSession
    ship_package(spark)
    buckets = buckets_for(at_most)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bloom(np.asarray(h, np.int64)) for h in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("cells"), pa.array(made, pa.binary())], names=["bucket", "cells", "bits"])

    hashed = cells.select(F.struct(*CELL_KEY).cast(CELL).alias("cell"), key_hash().alias("h"))
    rows = (
        hashed.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.collect_set("cell").alias("cells"), F.collect_set("h").alias("hashes"))
        .mapInArrow(task, f"bucket int, cells array<{CELL}>, bits binary")
    )
    rows.write.partitionBy("bucket").parquet(f"{path}/{FOLDER}/segment={segment}")
    return {"segment": segment, "buckets": buckets, "cells": at_most}


def _read(spark: SparkSession, path: str, segments: Sequence[dict[str, Any]]) -> DataFrame:
    at = [f"{path}/{FOLDER}/segment={s['segment']}" for s in segments]
    return spark.read.schema(SEGMENT).option("basePath", f"{path}/{FOLDER}").parquet(*at)


def cells_in(spark: SparkSession, path: str, segments: Sequence[dict[str, Any]]) -> DataFrame:
    return _read(spark, path, segments).select(F.inline("cells"))


def to_merge(segments: Sequence[dict[str, Any]], added: int) -> int:
    """How many of the last segments a new one of ``added`` cells is merged with."""
    taken, size = 0, added
    for segment in reversed(segments):
        if segment["cells"] >= FAN_OUT * size:
            break
        taken, size = taken + 1, size + segment["cells"]
    return taken


def extended(spark: SparkSession, path: str, segments: list[dict[str, Any]], cells: DataFrame, segment: str) -> list[dict[str, Any]]:
    """The segments with ``cells`` as a new one, into which the last ones may be merged."""
    added = cells.count()
    taken = to_merge(segments, added)
    kept, merged = segments[: len(segments) - taken], segments[len(segments) - taken :]
    if merged:
        cells = cells.select(*CELL_KEY).unionByName(cells_in(spark, path, merged))
    return [*kept, write_segment(cells, path, segment, added + sum(s["cells"] for s in merged))]


def known_cells(spark: SparkSession, path: str, segments: Sequence[dict[str, Any]], keys: DataFrame) -> DataFrame:
    """Cells of the index in the buckets that may hold one of ``keys`` (id, dataset): all cells of these keys, and others.

    Filters are read for the buckets of the keys alone; the driver sees the numbers of the buckets.
    """
    ship_package(spark)
    at = F.inline(F.array(*[F.struct(F.lit(s["segment"]).alias("segment"), F.lit(s["buckets"]).alias("buckets")) for s in segments]))
    asked = (
        keys.select(key_hash().alias("h"), at)
        .groupBy("segment", F.pmod("h", F.col("buckets")).cast("int").alias("bucket"))
        .agg(F.collect_set("h").alias("asked"))
    )
    asked = asked.localCheckpoint() if False else asked

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch.column("bits").to_pylist(), batch.column("asked").to_pylist(), strict=True)
            found = [may_hold(bits, np.asarray(h, np.int64)) for bits, h in held]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("bucket")], names=["segment", "bucket"]).filter(pa.array(found, pa.bool_()))

    filters = _read(spark, path, segments).select("segment", "bucket", "bits")
    # With as many keys as buckets every filter is asked for anyway.
    probed = filters.join(F.broadcast(asked), ["segment", "bucket"]).select("segment", "bucket", "bits", "asked")
    found = probed.mapInArrow(task, "segment string, bucket int").collect()
    by_segment: dict[str, list[int]] = {}
    for row in found:
        by_segment.setdefault(row["segment"], []).append(row["bucket"])
    wanted = F.lit(False)
    for segment, buckets in by_segment.items():
        wanted |= (F.col("segment") == segment) & F.col("bucket").isin(buckets)
    return _read(spark, path, segments).filter(wanted).select(F.inline("cells"))
