"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its text is trainable.
Turns after the last assistant turn, which no example has as context, make a last example without a target.
Turns of a conversation are sorted by the shuffle and stream through the task, which holds the context so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import arrow_map

#: Marks of a turn (fixed values of the template).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
EXAMPLES = "conv_id long, example int, formatted string, target_start int, target_end int"
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    """No mark can be read in the result: every ``<|``, with any backslashes between, gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back."""
    turns = formatted.split(CLOSE)[:-1]
    return [
        (unescape_role(role), unescape(text)) for role, _, text in (t.removeprefix(OPEN).partition("\n") for t in turns)
    ]


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, target_start, target_end (code points; the target is NULL in the last, context-only one).

    Rows of a conversation go by (turn, role, text), NULLs first; ties in turn stay turns of their own.
    NULL roles and texts are empty; a NULL conv_id is a conversation. Other columns are ignored. Conversations
    without target turns have the context-only example; an empty table has none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, conv, context, number, pending = 0, (), [], 0, False

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            names = [c.split()[0] for c in EXAMPLES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv_id, role, text in zip(*columns, strict=True):
                if conv != (conv_id,):
                    if pending:
                        rows.append((*conv, number, "".join(context), None, None))
                    conv, context, number, pending = (conv_id,), [], 0, False
                head = f"{OPEN}{escape_role(role or '')}\n"
                body = escape(text or "")
                context.append(f"{head}{body}{CLOSE}")
                pending = role != target_role
                if not pending:
                    context = ["".join(context)]
                    end = len(context[0]) - len(CLOSE)
                    rows.append((conv_id, number, context[0], end - len(body), end))
                    number, size = number + 1, size + len(context[0])
                if size >= BATCH_CHARS:
                    yield out()
                    rows, size = [], 0
        if pending:
            rows.append((*conv, number, "".join(context), None, None))
        if rows:
            yield out()

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string"), F.col("text").cast("string")
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_map(ordered, task, EXAMPLES)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation of ``examples``, read back from the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. The longest example holds all turns; the targets come in the order of the examples."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, loss, loss_chars, chars, last = (), None, 0, 0, ""

        def row() -> pa.RecordBatch:
            turns = turns_in(last)
            hashed = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            values = [conv[0], len(turns), hashed, loss_chars, loss.hexdigest(), chars]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, text, start, end = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "target_start", "target_end"))
                if conv != (conv_id,):
                    if conv:
                        ready.append(row())
                    conv, loss, loss_chars, chars = (conv_id,), hashlib.sha256(), 0, 0
                if start is not None:
                    target = unescape(text[start:end])
                    loss.update(target.encode())
                    loss_chars += len(target)
                chars, last = chars + len(text), text
            if len(ready) >= 1000:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if conv:
            ready.append(row())
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]

    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return arrow_map(
        ordered,
        task,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
