"""Rules, ratio and threshold against a plain loop; NULLs, ties, repeated rows and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrim.llm import quality_rules as Q

SYMBOLS = set("#*$%&|<>")


def base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    at = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(at),
    ), words


def brute(spark, rows, labels, buckets):
    """As ``judge``; only the hash itself is Spark's."""
    texts = {w for _, t in rows for w in base(t)[1]}
    frame = spark.createDataFrame([(w,) for w in texts] or [("x",)], "w string")
    name = dict(frame.select("w", F.xxhash64("w")).collect())
    pairs = {p for _, t in rows for p in zip(base(t)[1], base(t)[1][1:], strict=False)}
    pair_frame = spark.createDataFrame([(a, b, name[a], name[b]) for a, b in pairs] or [("x", "x", 1, 1)], "a string, b string, x long, y long")
    pair_name = {(r[0], r[1]): r[2] for r in pair_frame.select("a", "b", F.xxhash64("x", "y")).collect()}

    def grams(text):
        words = base(text)[1]
        return [name[w] % buckets for w in words] + [pair_name[p] % buckets for p in zip(words, words[1:], strict=False)]

    by_doc = {}
    for d, q, t in labels:
        if d is not None and q is not None:
            by_doc.setdefault(d, []).append((q, t or 0))
    trusted = {d for d, v in by_doc.items() if min(q for q, _ in v) == 1 and max(t for _, t in v) == 0}
    rejected = {d for d, v in by_doc.items() if min(q for q, _ in v) == 0}
    held_out = {d for d in trusted | rejected if zlib.crc32(str(d).encode()) % 5 == 0}
    raw, own = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in trusted - held_out:
            own.update(grams(t))
    n, m = sum(raw.values()), sum(own.values())
    weight = [
        round(1e6 * (math.log(own[b] + 1) - math.log(m + buckets) - math.log(raw[b] + 1) + math.log(n + buckets))) if m else 0
        for b in range(buckets)
    ]
    out = []
    for d, t in rows:
        g = grams(t)
        values = base(t)[0]
        failed = values[0] < 50 or 100 * values[4] > 50 * values[0]
        out.append((d, *values, sum(weight[b] for b in g) / len(g) / 1e6 if g else 0.0, failed))
    good = [math.floor(100 * r[6]) for r in out if r[0] in trusted & held_out and not r[7]]
    bad = [math.floor(100 * r[6]) for r in out if r[0] in rejected & held_out and not r[7]]
    least = -math.inf
    if good and bad:
        steps = range(min(good + bad), max(good + bad) + 2)
        gain = [sum(g >= s for g in good) * len(bad) + sum(b < s for b in bad) * len(good) for s in steps]
        first = last = gain.index(max(gain))
        while last + 1 < len(gain) and gain[last + 1] == gain[first]:
            last += 1
        least = (steps[first] + steps[last]) // 2 / 100
    return [(*r, not r[7] and r[6] >= least) for r in out]


def made(seed=3, n=160):
    rng = random.Random(seed)
    plain = [a + b for a in "bcdfg" for b in "aeiou"]
    rows, labels = [], []
    for i in range(n):
        junk = i % 3 == 0
        words = [rng.choice(plain) for _ in range(rng.choice([0, 1, 2, 3, 30, 60, 90, 200]))]
        if junk:
            words = [w + rng.choice(["###", "$$", "|"]) for w in words]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        rows.append((i, text * (4 if i % 7 == 0 else 1)))
        if i % 2:
            labels.append((i, 0 if junk else 1, 1 if i % 11 == 0 else 0))
    edge = [(1000, None), (1001, ""), (1002, " \n\n"), (1003, "a a a a a"), (1004, "x\nx\nx"), (None, "p q r " * 40), (None, "p q r " * 40),
            (7, rows[7][1]), (1005, "é ü z 😀 " * 30), (1006, "w " * 70_000)]
    return rows + edge, labels + [(None, 0, 0), (1, None, None), (3, 1, None), (5, 0, 1), (5, 1, 0), (99999, 1, 0)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "k", True) for r in rows], "doc_id long, text string, held int, trusted string, kept boolean")
    return docs.repartition(5), spark.createDataFrame([(*r, 2) for r in labels], "doc_id long, quality int, toxic int, text int")


@pytest.mark.parametrize("buckets", [64, 1 << 12])
def test_equals_plain_loop(spark, buckets):
    rows, labels = made()
    got = Q.judge(*frames(spark, rows, labels), buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]

    def shown(out):
        return sorted(((*r[:6], f"{r[6]:.9f}".replace("-0.000000000", "0.000000000"), *r[7:]) for r in map(tuple, out)), key=str)

    want = brute(spark, rows, labels, buckets)
    assert shown(got.collect()) == shown(want)
    junk = [r[-1] for r in want if r[0] is not None and r[0] < 160 and r[0] % 3 == 0 and not r[-2]]
    clean = [r[-1] for r in want if r[0] is not None and r[0] < 160 and r[0] % 3 and not r[-2]]
    assert not any(junk) and sum(clean) >= 0.9 * len(clean)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(0, 0, 0)]])
def test_without_labels_the_rules_decide(spark, labels):
    rows, _ = made(n=20)
    assert all(r.kept != r.base_failed for r in Q.judge(*frames(spark, rows, labels)).collect())


def test_empty(spark):
    docs, labels = frames(spark, [], [])
    assert Q.judge(docs, labels).collect() == []


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.judge(docs, labels).filter("not base_failed").join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").collect()
    good, bad = ([r.kept for r in got if r.quality == q and r.toxic == 0] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    # Documents that no label covers, told by their look.
    plain = [r.kept for r in got if r.quality is None and not r.n_symbols and not r.n_repeat_words and r.text != r.text.upper() and "!!" not in r.text]
    assert len(plain) > 300 and sum(plain) >= 0.99 * len(plain)
