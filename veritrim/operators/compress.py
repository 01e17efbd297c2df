"""Extractive prompt compression: keep the rarest tokens of a text, up to a budget.

Rarity in the corpus stands in for self-information (Selective Context, arXiv 2310.06201). Ranks are
by whole counts, then by position, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veritrim.functions.text import spaced, tokens
from veritrim.operators.skew import dealt_to_all, frequent_keys, lookup_join
from veritrim.session import written


# Longer tokens are not broadcast, however frequent.
MOST_TOKEN_BYTES = 1024
# Texts whose tokens a task ranks at once.
TEXTS_AT_ONCE = 256


def token_frequencies(texts: DataFrame, text_col: str, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """How often each token occurs in all the texts; counted map-side before the shuffle."""
    return (
        dealt_to_all(texts.select(text_col)).select(F.explode(split(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def compress_to_budget(
    texts: DataFrame,
    key: Sequence[str],
    text_col: str,
    budget: int,
    frequencies: DataFrame | None = None,
    most_frequent_tokens: int = 10_000,
    split: Callable[[Column], Column] = tokens,
    rebuild: Callable[[Column], Column] = spaced,
) -> DataFrame:
    """Columns ``key``, ``prompt``, ``orig_tokens``, ``compressed_tokens``; ``key`` must be unique.

    ``split`` turns a text into its tokens, words unless given or whatever a tokenizer makes of it, and ``rebuild`` turns those
    that are kept into a text. A text within the budget is returned unchanged. Rarity is measured in the texts themselves or,
    where given, by ``frequencies`` of a larger corpus; a token that is not among those is the rarest.

    Frequent tokens, at most ``most_frequent_tokens`` of them and of ``MOST_TOKEN_BYTES`` each, are told to all tasks. The
    others are rarer: only these meet their count in a salted shuffle join. Of the frequent tokens of a text only as many go on, within its row, as the
    budget has room for beside the others. A text's tokens come together once more and are cut to the budget there, in
    the same way for any budget.
    """
    freq = written(token_frequencies(texts, text_col, split), "frequencies") if frequencies is None else frequencies
    short = F.octet_length(F.col("token").cast("string")) <= MOST_TOKEN_BYTES
    frequent = frequent_keys(freq, "freq", most_frequent_tokens).filter(short)

    dealt = dealt_to_all(texts.select(*key, F.col(text_col).alias("prompt")))
    words = dealt.withColumn("_words", split(F.col("prompt")))
    counted = lookup_join(
        _candidates(words, key, budget, frequent), freq, "token", ["freq"], counts=freq.select("token", F.col("freq").alias("_rows"))
    )
    # A text's tokens are no more than its row had already. Its rows meet unsummed: hardly two lie in one task before.
    rare = F.struct(F.coalesce("freq", F.lit(0).cast("long")).cast("long").alias("freq"), "pos", "token")
    ranked = counted.repartition(*key).groupBy(*key).agg(
        F.collect_list(F.when(F.col("token").isNotNull(), rare)).alias("_rare"),
        F.flatten(F.collect_list("_head.known")).alias("_known"),
        F.max("_head.orig_tokens").alias("orig_tokens"),
        F.max("_head.whole").alias("_whole"),
    )
    first = F.slice(F.sort_array(F.concat("_rare", "_known")), 1, budget)
    kept = F.sort_array(F.transform(first, lambda t: F.struct(t["pos"], t["token"].alias("token"))))
    found = ranked.select(*key, "orig_tokens", "_whole", kept.alias("_kept"))
    return found.select(
        *key,
        F.when(F.col("orig_tokens") <= budget, F.col("_whole")).otherwise(rebuild(F.col("_kept.token"))).alias("prompt"),
        "orig_tokens",
        F.least("orig_tokens", F.lit(budget)).alias("compressed_tokens"),
    )


def _candidates(words: DataFrame, key: Sequence[str], budget: int, frequent: DataFrame) -> DataFrame:
    """What may be kept of each text: a row for the text, with the frequent tokens that may be kept, and one for each other token.

    ``words`` has ``key``, ``prompt`` and the tokens, ``_words``; ``frequent`` (token, freq) is told to all tasks. A text within the budget
    passes whole, without tokens. Column ``_head`` (orig_tokens, whole, known) is that of a text's own row, which has no token.
    """
    token = words.schema["_words"].dataType.elementType
    known_type = T.ArrayType(T.StructType([T.StructField("freq", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("token", token)]))
    head_type = T.StructType(
        [T.StructField("orig_tokens", T.IntegerType()), T.StructField("whole", words.schema["prompt"].dataType), T.StructField("known", known_type)]
    )
    own = [words.schema[name] for name in key]
    schema = T.StructType([*own, T.StructField("_head", head_type), T.StructField("pos", T.IntegerType()), T.StructField("token", token)])
    out = to_arrow_schema(schema)
    head, known_arrow, token_arrow = out.field("_head").type, to_arrow_schema(head_type).field("known").type, out.field("token").type
    told = sorted(((r["token"], r["freq"]) for r in frequent.select("token", "freq").collect()), key=lambda r: r[1])
    names, freqs = pa.array([r[0] for r in told], token_arrow), np.array([r[1] for r in told], np.int64)
    names_own, most_bytes, at_once = list(key), MOST_TOKEN_BYTES, TEXTS_AT_ONCE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                own_columns = [batch.column(n).cast(out.field(n).type) for n in names_own]
                lists = batch.column("_words")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                over = size > budget
                flat = pc.list_flatten(lists).cast(token_arrow)
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                place = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy()
                rare = np.flatnonzero((place < 0) & over[row])
                lower = rare
                if pa.types.is_string(token_arrow):
                    lower = rare[pc.binary_length(flat).to_numpy()[rare] <= most_bytes]
                room = np.maximum(budget - np.bincount(row[lower], minlength=len(size)), 0)
                known = np.flatnonzero((place >= 0) & over[row] & (room[row] > 0))
                known = known[np.lexsort((known, freqs[place[known]], row[known]))]
                first = np.searchsorted(row[known], np.arange(len(size)))
                known = known[np.arange(len(known)) - first[row[known]] < room[row[known]]]
                ends = np.append(0, np.cumsum(np.bincount(row[known], minlength=len(size)))).astype(np.int32)
                parts = [pa.array(freqs[place[known]]), pa.array(pos[known].astype(np.int32)), flat.take(pa.array(known))]
                lists_known = pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(known_arrow.value_type)), type=known_arrow
                )
                prompt = batch.column("prompt").take(pa.array(np.arange(len(size)), mask=over))
                heads = pa.StructArray.from_arrays(
                    [pa.array(size.astype(np.int32)), prompt.cast(head.field("whole").type), lists_known], fields=list(head)
                )
                nothing = [pa.nulls(len(size), pa.int32()), pa.nulls(len(size), token_arrow)]
                yield pa.RecordBatch.from_arrays([*own_columns, heads, *nothing], schema=out)
                of = pa.array(row[rare])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(of) for c in own_columns], pa.nulls(len(rare), head), pa.array(pos[rare].astype(np.int32)), flat.take(pa.array(rare))],
                    schema=out,
                )

    return words.select(*key, "prompt", "_words").mapInArrow(task, schema)
