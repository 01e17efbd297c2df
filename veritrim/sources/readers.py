"""Samples, raw datasets and the results log as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrim.functions.casts import lenient_float, lenient_int, timestamp
from veritrim.functions.text import strip
from veritrim.operators import key_index
from veritrim.operators.dedup import FILE_ORDER
from veritrim.operators.grid import logged_cells
from veritrim.schemas import METRICS, RESULT, RESULT_LOG, SAMPLE
from veritrim.sources import commits

CORRUPT = "_corrupt_record"
ORDER = "struct<version: bigint, file: string, row: bigint>"


def parsed_json(line: Column, schema: T.StructType) -> Column:
    """Struct of the schema and ``_corrupt_record``, which holds a line that is not one JSON object and nothing else."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    parsed = F.from_json(line, with_corrupt, options)
    # The parser stops after the first value; in brackets, text after the object is an error of the array.
    whole = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>", options)
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], line.alias(CORRUPT))
    return F.when(F.size(whole) == 1, parsed).otherwise(nothing)


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = SAMPLE) -> DataFrame:
    """One JSON object per line from one or several files, blank lines skipped.

    Adds ``source_file`` and ``_corrupt_record``. Lines are read as text and parsed as a column, so that the
    rejects alone can be queried, which the JSON source does not allow.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    filled = lines.filter(strip(F.col("value")) != "")
    return filled.select(
        parsed_json(F.col("value"), schema).alias("_p"), F.col("_metadata.file_path").alias("source_file")
    ).select("_p.*", "source_file")


def good_rows(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not valid JSON objects, with the file they come from."""
    return lines.filter(F.col(CORRUPT).isNotNull()).select("source_file", F.col(CORRUPT).alias("line"))


def read_raw(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Raw dataset rows with ``_order``, which sorts them as they stand in the files."""
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    rows = spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))
    return rows.select("*", place.alias("_order"))


def file_place(rows_of_files: bool = True) -> Column:
    """Place of a row in what was read: file by file in order of their paths, within a file as its rows stand there.

    Parquet files number their rows. Of other files, each has to be read by one task, as a CSV file of records over several
    lines is, whose rows are then numbered as they pass.
    """
    row = F.col("_metadata.row_index") if rows_of_files else F.monotonically_increasing_id()
    return F.struct(F.lit(0).cast("long").alias("version"), F.col("_metadata.file_path").alias("file"), row.alias("row"))


def read_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A Parquet table with ``FILE_ORDER``."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return rows.select("*", file_place().alias(FILE_ORDER))


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_results_csv(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """The log as text columns; every column of the result schema is present, absent ones as NULL. ``with_order`` adds ``FILE_ORDER``.

    Predictions may hold line breaks and doubled quotes, so records may span lines and a file
    cannot be split: CSV is for exchange, the Parquet log for large data. A missing or empty file gives no rows.
    """
    nothing = no_rows(spark, T.StructType([T.StructField(n, T.StringType()) for n in RESULT.names]))
    if with_order:
        nothing = nothing.withColumn(FILE_ORDER, F.lit(None).cast(ORDER))
    try:
        text = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    except AnalysisException as err:
        if commits.missing_path(err):
            return nothing
        raise
    absent = [F.lit(None).cast("string").alias(n) for n in RESULT.names if n not in text.columns]
    present = [n for n in RESULT.names if n in text.columns]
    place = [file_place(rows_of_files=False).alias(FILE_ORDER)] if with_order else []
    return text.select(*present, *absent, *place).select(*RESULT.names, *[FILE_ORDER for _ in place]) if present else nothing


def typed_results(text: DataFrame, strict: bool = False) -> DataFrame:
    """Text columns to the result schema.

    Lenient: bad numbers become 0 and missing text its default. Strict: a bad number fails the job.
    """
    place = [c for c in text.columns if c == FILE_ORDER]
    if strict:
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT.fields]
        return text.select(*typed, *place)
    defaults = {"dataset": "unknown"}
    numbers = {c: lenient_int(F.col(c)) for c in ("compressed", "orig_tokens", "compressed_tokens")}
    numbers |= {c: lenient_float(F.col(c)) for c in METRICS}
    columns = [
        (
            timestamp(F.col(name))
            if name == "timestamp"
            else numbers.get(name, F.coalesce(F.col(name), F.lit(defaults.get(name, ""))))
        ).alias(name)
        for name in RESULT.names
    ]
    return text.select(*columns, *place)


def load_results(spark: SparkSession, path: str, strict: bool = False, with_order: bool = False) -> DataFrame:
    """A results log in CSV, typed; ``with_order`` adds ``FILE_ORDER``."""
    return typed_results(read_results_csv(spark, path, with_order), strict)


def read_log(spark: SparkSession, path: str, state: dict[str, Any] | None = None, with_order: bool = False) -> DataFrame:
    """The Parquet results log as its newest manifest has it, or as it was in ``state``; no rows when it does not exist yet.

    Files that no manifest names, such as those of a writer that was killed, are not read. A folder without manifests is
    read as it is. ``with_order`` adds ``FILE_ORDER``: commits in the order in which they were published, then
    files and their rows.
    """
    path = path.rstrip("/")
    state = commits.state(spark, path) if state is None else state
    place = [file_place().alias(FILE_ORDER)] if with_order else []
    if state["version"]:
        log = commits.read_files(spark, path, commits.files_of(state), RESULT_LOG, place)
        return _by_commit(log, state) if with_order else log
    try:
        return spark.read.schema(RESULT_LOG).parquet(path).select(*RESULT_LOG.names, *place)
    except AnalysisException as err:
        if commits.missing_path(err):
            nothing = no_rows(spark, RESULT_LOG)
            return nothing.withColumn(FILE_ORDER, F.lit(None).cast(ORDER)) if with_order else nothing
        raise


def _by_commit(log: DataFrame, state: dict[str, Any]) -> DataFrame:
    """``FILE_ORDER`` with the number of the commit that a row's file belongs to."""
    spark = log.sparkSession
    numbers = [
        (part.split("=")[1], i)
        for i, entry in enumerate(state["entries"], 1)
        for part in {p for f in entry["files"] for p in f["file"].split("/") if p.startswith("commit=")}
    ]
    known = spark.createDataFrame(numbers, "_commit string, _version long")
    commit = F.regexp_extract(F.col(FILE_ORDER)["file"], r"/commit=([^/]+)/", 1)
    version = F.coalesce("_version", F.lit(0).cast("long"))
    joined = log.withColumn("_commit", commit).join(F.broadcast(known), "_commit", "left")
    return joined.withColumn(FILE_ORDER, F.col(FILE_ORDER).withField("version", version)).drop("_commit", "_version")


def logged_cells_of(spark: SparkSession, path: str, keys: DataFrame, state: dict[str, Any] | None = None) -> DataFrame:
    """Cells the log holds of ``keys`` (id, dataset), and some others: by the log's index, else from the whole log."""
    path = path.rstrip("/")
    state = commits.state(spark, path) if state is None else state
    if state["version"] and state["table"].get("index"):
        return key_index.known_cells(spark, path, state["table"]["index"], keys)
    return logged_cells(read_log(spark, path, state))
