"""Benchmark decontamination with a distributed positional index.

The test windows are looked up from their rarest term: training postings (document, position) of those terms are found
where the documents lie, the posting's offset in the window gives the place where the window would start, and the other
terms of the window must stand at their offsets. Only the hits are shuffled. Everything is a DataFrame operation: the
words of a document are exploded and probed in one pass, and never leave their task unless they match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import lower_ascii, sized, written

#: Between words: every ASCII character but 0-9 and a-z (A-Z are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A term that no text has: one stands after the last word of each document, so that each has a row among the hits.
END = "\x01"
#: The windows are broadcast up to so many; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; NULL has none. The first or last element may be empty."""
    return F.split(lower_ascii(text), SEPARATORS)


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """window (array of words) and items (distinct item_ids as strings, sorted by code point).

    Items of fewer words than ``size``, but not none, are one window. NULL texts have none; a NULL item_id is left out
    of ``items``, though its windows count as hits.
    """
    words = F.filter(words_of(F.col("text")), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    parts = F.when(F.size("words") >= size, F.transform(starts, lambda i: F.slice("words", i, size))).when(
        F.size("words") > 0, F.array("words")
    )
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
        .select("item_id", F.explode(parts).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def anchored(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with the term to look them up by: the rarest in the training texts, and its first offset."""
    terms = windows.select(F.explode("window").alias("term")).distinct()
    training = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(sized(written(terms, "terms"), MOST_BROADCAST), "term")
    postings = training.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    placed = windows.select("window", "items", F.posexplode("window").alias("offset", "term"))
    rarity = F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "term", "offset")
    found = placed.join(postings, "term", "left").groupBy("window").agg(
        F.first("items").alias("items"), F.min(rarity).alias("rarest")
    )
    # A window with a term that no document has cannot occur.
    return found.filter("rarest.postings > 0").select("window", "items", "rarest.term", "rarest.offset")


def phrase_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, text_hash, n_words, start, length, items: exact occurrences of windows, and a row without start per document."""
    windows = written(windows_of(benchmark, size), "windows")
    anchors = written(anchored(docs, windows), "anchors")
    end = F.array(F.lit(END))
    none = F.array().cast("array<string>")
    sentinel = docs.sparkSession.range(1).select(none.alias("window"), none.alias("items"), F.lit(END).alias("term"), F.lit(0).alias("offset"))
    index = sized(anchors.unionByName(sentinel), MOST_BROADCAST)
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words_of(F.col("text")), end).alias("words"))
    postings = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("position", "posted"))
    start = F.col("position") - F.col("offset")
    stands = (F.size("window") == 0) | (
        (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    )
    blank = F.when(F.col("words")[0] == "", 1).otherwise(0)
    last = F.size("words") - 1
    count = F.when(last > 0, last - blank - F.when((last > 1) & (F.col("words")[F.greatest(last - 1, F.lit(0))] == ""), 1).otherwise(0)).otherwise(0)
    return postings.join(index, (F.col("posted") == F.col("term")) & stands).select(
        "doc_id",
        "text_hash",
        F.when(F.size("window") == 0, count).cast("long").alias("n_words"),
        F.when(F.size("window") > 0, start).alias("start"),
        F.size("window").alias("length"),
        "items",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, n_hit, items (sorted), contaminated.

    Repeated rows have a row each, of the same content. NULL and empty texts have no words. ``n_hit`` counts words
    inside any occurrence of a window, overlapping ones once. An empty benchmark hits nothing.
    """
    hits = phrase_hits(docs, benchmark, size)
    each = hits.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.explode_outer(F.when(F.col("start").isNotNull(), F.sequence("start", F.col("start") + F.col("length") - 1))).alias("word"),
        "items",
    )
    # Distinct words first, so that a word inside many windows or copies is one row.
    words = each.groupBy("doc_id", "text_hash", "word").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    found = words.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").alias("copies"),
        F.count("word").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.select(
        "doc_id",
        "text_hash",
        "n_words",
        "n_hit",
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) without an occurrence of a window, unchanged."""
    found = contamination(docs, benchmark, size).filter("contaminated")
    leaks = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    leaks = sized(written(leaks, "leaks"))
    same = docs["doc_id"].eqNullSafe(leaks["_doc_id"]) & (F.xxhash64(docs["text"]) == leaks["_text_hash"])
    return docs.join(leaks, same, "left_anti")


def proximity_hits(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """query_id, doc_id, text_hash, position: both terms of a query (query_id, first, second) at most ``within`` words apart.

    ``position`` is the place of the first term. Queries are a bounded test set; the index is that of all documents.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    postings = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("position", "posted"))
    around = F.slice("words", F.greatest(F.col("position") - within, F.lit(0)) + 1, 2 * within + 1)
    return (
        postings.join(sized(queries, MOST_BROADCAST), (F.col("posted") == F.col("first")) & F.array_contains(around, F.col("second")))
        .select("query_id", "doc_id", "text_hash", "position")
    )
