"""Models as a batch stage: the caller supplies the model, Spark supplies the batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veritrim.schemas import OOM_MARKERS, Settings

# The model this worker process holds: (loader, model name) and the predictor, or the error of loading it. Later tasks
# of the process find it there.
_HELD: dict[tuple[str, Any], Any] = {}

# A predictor maps a list of inputs to a list of outputs; an output may be an exception, for that row only.
Predictor = Callable[[list[Any]], Sequence[Any]]
Loader = Callable[[Any], Predictor]


@dataclass(frozen=True)
class Packing:
    """How the inputs of a task become the calls of its model.

    Inputs of like length go together, and a call is closed when its inputs, padded to the longest, would take more than
    ``tokens``; an input longer than that goes alone. ``count`` gives an input's length. With ``once``, equal inputs
    of a model are answered by one: for models that always answer the same.
    """

    tokens: int
    count: Callable[[Any], int] = lambda text: len(str(text).split())
    once: bool = True


def packs(lengths: Sequence[int], tokens: int) -> list[list[int]]:
    """Positions of the inputs of each call, the longest inputs first."""
    made: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if not made or longest * (len(made[-1]) + 1) > tokens:
            made.append([])
            longest = max(1, lengths[i])
        made[-1].append(i)
    return made


ERROR = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("unavailable", T.BooleanType()),
    ]
)


def _failure(err: BaseException, unavailable: bool = False) -> dict[str, Any]:
    return {"type": type(err).__name__, "message": str(err), "unavailable": unavailable}


def _attempt(predict: Predictor, inputs: list[Any]) -> list[Any]:
    """One output for each input; a batch that fails, or has another number of outputs, is halved and tried again."""
    if not inputs:
        return []
    try:
        outputs = list(predict(inputs))
        if len(outputs) == len(inputs):
            return outputs
        raise ValueError(f"{len(outputs)} outputs for {len(inputs)} inputs")
    except Exception as err:
        if len(inputs) == 1:
            return [err]
        middle = len(inputs) // 2
        return _attempt(predict, inputs[:middle]) + _attempt(predict, inputs[middle:])


def _is_out_of_memory(result: Any) -> bool:
    text = str(result).lower()
    return isinstance(result, RuntimeError) and any(marker in text for marker in OOM_MARKERS)


def _predict_with_retry(
    predict: Predictor, inputs: list[Any], shorten: Callable[[Any], Any] | None
) -> tuple[list[Any], list[Any]]:
    """Results and the inputs they were made from; rows that ran out of memory get one shortened retry."""
    results, used = _attempt(predict, inputs), list(inputs)
    if shorten is None:
        return results, used
    retries = {
        i: short
        for i, (result, item) in enumerate(zip(results, inputs, strict=True))
        if _is_out_of_memory(result) and (short := shorten(item)) != item
    }
    for i, result in zip(retries, _attempt(predict, list(retries.values())), strict=True):
        results[i], used[i] = result, retries[i]
    return results, used


def _predict_packed(
    predict: Predictor, inputs: list[Any], shorten: Callable[[Any], Any] | None, packing: Packing | None, known: dict[Any, tuple[Any, Any]]
) -> tuple[list[Any], list[Any]]:
    """As ``_predict_with_retry``, in calls of bounded size. ``known`` holds what equal inputs were answered last."""
    if packing is None:
        return _predict_with_retry(predict, inputs, shorten)
    place: dict[Any, list[int]] = {}
    for i, item in enumerate(inputs):
        place.setdefault(item if packing.once else i, []).append(i)
    todo = [where[0] for item, where in place.items() if item not in known]
    answered: dict[int, tuple[Any, Any]] = {}
    for group in packs([packing.count(inputs[i]) for i in todo], packing.tokens):
        chosen = [todo[g] for g in group]
        answered |= dict(zip(chosen, zip(*_predict_with_retry(predict, [inputs[i] for i in chosen], shorten), strict=True), strict=True))
    found: list[Any] = [None] * len(inputs)
    for item, where in place.items():
        result = known[item] if item in known else answered[where[0]]
        for i in where:
            found[i] = result
    if packing.once:
        # Equal inputs of a task stand together: only the last ones may go on in its next rows.
        known.clear()
        known.update({inputs[-1]: found[-1]} if inputs else {})
    return [r for r, _ in found], [u for _, u in found]


def score_batches(
    df: DataFrame,
    load: Loader,
    inputs: str | Sequence[str],
    output: str,
    output_type: T.DataType,
    model_col: str | None = None,
    shorten: Callable[[Any], Any] | None = None,
    tasks: int | None = None,
    packing: Packing | None = None,
) -> DataFrame:
    """Adds ``output`` and ``error`` columns computed by a loaded model.

    ``load(model_name)`` runs on the executors. A worker process holds one model at a time and keeps it for its later
    tasks. With ``model_col``, rows are dealt to ``tasks`` ranges of model and input (two for each core of
    the session unless given), so that all but a few tasks see a single model, and models are loaded fewer than
    ``tasks`` + models times, however many rows there are. A load that failed is tried again by the next task.
    A failed row gets an error and no output. When a model cannot be loaded, its rows are marked
    ``unavailable``; they are not results, and a later run can take them up again. Rows that carry an error from an
    earlier stage pass through. With ``packing`` a model is called with so many padded tokens at a time, and, if it may, once
    for equal inputs; without it, with the rows of an Arrow batch. With ``shorten``, a retried input replaces the original one in its column.
    """
    names = [inputs] if isinstance(inputs, str) else list(inputs)
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast(ERROR))
    if model_col is not None:
        tasks = tasks or 2 * df.sparkSession.sparkContext.defaultParallelism
        df = df.withColumn("_deal", F.xxhash64(*names)).repartitionByRange(tasks, model_col, "_deal")
        df = df.sortWithinPartitions(model_col, "_deal").drop("_deal")
    schema = T.StructType(df.schema.fields + [T.StructField(output, output_type)])
    out_type, error_type = to_arrow_type(output_type), to_arrow_type(ERROR)
    loader = hashlib.sha256(CloudPickleSerializer().dumps(load)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # This function travels with copies of the globals it names; the module of the worker process keeps its own.
        from veritrim.operators.inference import _HELD as held

        failed: dict[Any, Exception] = {}
        answered: dict[Any, dict] = {}

        def predictor(model: Any) -> Any:
            if model in failed:
                return failed[model]
            if (loader, model) not in held:
                held.clear()
                try:
                    held[loader, model] = load(model)
                except Exception as err:
                    failed[model] = err
                    return err
            return held[loader, model]

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in names]
            items = columns[0] if len(columns) == 1 else list(zip(*columns))
            models = batch.column(model_col).to_pylist() if model_col else [None] * len(items)
            errors = batch.column("error").to_pylist()
            outputs: list[Any] = [None] * len(items)
            for model in dict.fromkeys(models):
                rows = [i for i, m in enumerate(models) if m == model and errors[i] is None]
                if not rows:
                    continue
                predict = predictor(model)
                if isinstance(predict, Exception):
                    for i in rows:
                        errors[i] = _failure(predict, unavailable=True)
                    continue
                last = answered.setdefault(model, {})
                results, used = _predict_packed(predict, [items[i] for i in rows], shorten, packing, last)
                for i, result, item in zip(rows, results, used, strict=True):
                    columns[0][i] = item if len(names) == 1 else columns[0][i]
                    if isinstance(result, Exception):
                        errors[i] = _failure(result)
                    else:
                        outputs[i] = result
            arrays = {name: batch.column(name) for name in batch.schema.names}
            if shorten is not None and len(names) == 1:
                arrays[names[0]] = pa.array(columns[0], type=batch.schema.field(names[0]).type)
            arrays["error"] = pa.array(errors, type=error_type)
            arrays[output] = pa.array(outputs, type=out_type)
            yield pa.RecordBatch.from_pydict(arrays)

    return df.mapInArrow(run, schema)
