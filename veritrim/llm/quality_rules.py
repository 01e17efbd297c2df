"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

The words of a text and its pairs of neighbouring words fall into a fixed number of hashed buckets. Two multinomials over the
buckets, one of trusted documents and one of the whole corpus, are counted over all documents. A document's ratio is the mean,
over its n-grams, of the logarithm of the trusted over the raw probability. The threshold is a score between trusted
and rejected labelled documents; every document is held against it the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import sized, written

#: Buckets of n-grams; a power of two up to 2 ** 32.
BUCKETS = 1 << 16
#: Weights are whole numbers of this part, so that a sum does not depend on its order.
UNITS = 1_000_000
#: One in so many labelled documents is left out of the counts and helps to choose the threshold instead.
HELD_OUT = 5
#: Steps of the score among which the threshold is chosen, for a score of 1.
STEPS = 100
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it uses it."""
    return F.transform(F.array(value), body)[0]


def _rest(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _first(values: Column, less: int) -> Column:
    return F.slice(values, 1, F.greatest(F.size(values) - less, F.lit(0)))


def pair_hashes(hashed: Column) -> Column:
    """Of each pair of neighbours, from the hashes of the words."""
    return F.zip_with(_first(hashed, 1), _rest(hashed, 1), lambda a, b: F.xxhash64(a, b))


def window_hashes(hashed: Column, pairs: Column) -> Column:
    """Of each window of three words."""
    return F.zip_with(_first(pairs, 1), _rest(hashed, 2), lambda a, b: F.xxhash64(a, b))


def repeat_words(windows: Column) -> Column:
    """Number of words that stand in a 3-word window found twice or more; windows are told apart by their hashes.

    Most texts have no hash twice. In others, the lowest bits of each hash give way to the place of its window; sorted, equals
    are neighbours. The places of those, sorted, cover up to three words each.
    """

    def pairs(packed: Column, mask: Column) -> Column:
        alike = F.zip_with(
            _first(packed, 1),
            _rest(packed, 1),
            lambda a, b: F.when(a.bitwiseXOR(b).bitwiseOR(mask) == mask, F.array(a.bitwiseAND(mask), b.bitwiseAND(mask))),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.zip_with(at, _rest(at, 1), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def found(mask: Column) -> Column:
        packed = F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
        return _let(_let(F.sort_array(packed), lambda x: pairs(x, mask)), covered)

    places = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(windows) + F.lit(1)))).cast("long") - 1
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, _let(places, found)).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_columns(text: Column, held: Column, windows: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, its words and window hashes. NULL is empty."""
    known = F.coalesce(text, F.lit(""))
    return [
        F.size(held).cast("long").alias("n_words"),
        F.length(F.array_join(held, "")).cast("long").alias("word_chars"),
        (F.length(known) - F.length(F.regexp_replace(known, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeat_words(windows).alias("n_repeat_words"),
    ]


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or more than ``most_repeated`` percent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, trusted, held_out: trusted has quality 1 and is not toxic, in all its rows; others have quality 0 in one.

    Further rows and NULL ids are left out. A NULL ``toxic`` counts as not toxic, a NULL quality says nothing. Held-out documents
    are chosen by crc32 of the id as text.
    """
    return (
        labels.select("doc_id", "quality", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .filter((F.col("quality") == 0) | (F.col("toxic") == 0))
        .select(
            "doc_id",
            (F.col("quality") != 0).alias("trusted"),
            (F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0).alias("held_out"),
        )
    )


def words(text: Column) -> Column:
    """The words of a text; none of NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashes(held: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(held, lambda w: F.xxhash64(w))


def weights(docs: DataFrame, marked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``weights``: by bucket, the log ratio of its trusted to its raw probability, in ``UNITS``.

    One is added to each count; held-out documents count as raw only. N-grams are summed by bucket before they are shuffled; without trusted n-grams
    every weight is zero.
    """
    own = docs.join(marked.filter("trusted and not held_out").select("doc_id", "trusted"), "doc_id", "left").select(
        F.col("trusted").isNotNull().alias("trusted"), hashes(words(F.col("text"))).alias("hashes")
    )
    grams = own.select("trusted", F.explode(F.concat("hashes", pair_hashes(F.col("hashes")))).alias("gram"))
    counts = grams.groupBy(F.col("gram").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.sum(F.col("trusted").cast("long")).alias("trusted")
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    total = every.agg(
        F.sum("raw").alias("n_raw"),
        F.sum("trusted").alias("n_trusted"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("counts"),
    )

    def log_share(count: Column, n: str) -> Column:
        return F.log((count + 1).cast("double")) - F.log((F.col(n) + buckets).cast("double"))

    def value(c: Column) -> Column:
        ratio = log_share(c["trusted"], "n_trusted") - log_share(c["raw"], "n_raw")
        return F.when(F.col("n_trusted") > 0, F.round(ratio * UNITS)).otherwise(0.0).cast("long")

    return total.select(F.transform("counts", value).alias("weights"))


def scored(docs: DataFrame, marked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base columns and ``llr``, the mean weight of a document's n-grams (0 without any).

    The weights, one number a bucket, go by the driver into the plan, as a text that Spark folds into one array.
    """
    held = weights(docs, marked, buckets).select(F.array_join(F.col("weights").cast("array<string>"), ",")).first()[0]
    weight = F.split(F.lit(held), ",").cast("array<bigint>")

    def total(grams: str) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda t, g: t + weight[g.bitwiseAND(F.lit(buckets - 1))])

    n = F.greatest(F.size("hashes") + F.size("pairs"), F.lit(1))
    return (
        docs.select("doc_id", "text", words(F.col("text")).alias("held"))
        .withColumn("hashes", hashes(F.col("held")))
        .withColumn("pairs", pair_hashes(F.col("hashes")))
        .withColumn("windows", window_hashes(F.col("hashes"), F.col("pairs")))
        .select(
            "doc_id",
            *base_columns(F.col("text"), F.col("held"), F.col("windows")),
            ((total("hashes") + total("pairs")) / n / UNITS).alias("llr"),
        )
    )


def threshold(labelled: DataFrame) -> float | None:
    """The score from which on a document is kept, from rows (llr, trusted).

    Of all steps, those with the greatest sum of the share of trusted documents kept and of rejected ones dropped; the
    middle one of the first run of them. Without rejected documents nothing is dropped (None). The driver sees a count by step.
    """
    step = F.floor(F.col("llr") * STEPS).alias("step")
    found = labelled.groupBy(step).agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")).collect()
    held = {r["step"]: (r["good"], r["bad"]) for r in found}
    n_good, n_bad = sum(g for g, _ in held.values()), sum(b for _, b in held.values())
    if not n_good or not n_bad:
        return None
    good, bad, gains = n_good, 0, {}
    for s in range(min(held), max(held) + 2):
        gains[s] = good * n_bad + bad * n_good
        g, b = held.get(s, (0, 0))
        good, bad = good - g, bad + b
    best = max(gains.values())
    first = min(s for s, v in gains.items() if v == best)
    last = first
    while gains.get(last + 1) == best:
        last += 1
    return ((first + last) // 2) / STEPS


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept: a row for each of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id, quality and toxic; other columns are ignored. NULL and empty texts have
    no words and fail. Repeated rows are judged each, and counted each; a document whose score is the threshold is kept. An
    empty ``docs`` gives no rows; without trusted or rejected held-out labels the base rules alone decide.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = sized(written(marks(labels), "quality-marks"))
    found = written(scored(docs, marked, buckets), "quality-scores")
    chosen = marked.filter("held_out").select("doc_id", "trusted")
    least = threshold(found.join(chosen, "doc_id").filter(~base_failed()).select("llr", "trusted"))
    kept = ~base_failed() & (F.col("llr") >= least if least is not None else F.lit(True))
    return found.select("*", base_failed().alias("base_failed"), kept.alias("kept"))
