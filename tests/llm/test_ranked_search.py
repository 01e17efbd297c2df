"""Whole results against scoring every document; bounds never below scores; edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from veritrim.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, length = len(found), sum(x for *_, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in found:
            m = 50 + (50 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(n=400, seed=5):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfgÉß1" for b in "aeiou2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60, 150]))
        docs.append((i, rng.choice([" ", ", ", "\n", "_"]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
    docs += [(n + i, docs[7][1]) for i in range(70)]  # ties, more of them than are wanted
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (5000, None), (5001, ""), (5002, "--- !!"), (5003, "ba " * 60_000 + "be")]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(12)] + [(7, docs[7][1]), (7, docs[7][1]), (None, "ba BE"), (99, None), (98, "?"), (97, "unknownterm")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, item int, score string").repartition(3)
    return d, spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")


@pytest.mark.parametrize(("k", "block_docs"), [(50, 1024), (5, 16), (1, 3)])
def test_equals_scoring_everything(spark, k, block_docs):
    docs, items = made()
    d, q = frames(spark, docs, items)
    got = S.search(S.build_index(d, block_docs), q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_items_in_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "ITEMS", 4)
    docs, items = made(n=60)
    d, q = frames(spark, docs, items)
    assert sorted(map(tuple, S.search(S.build_index(d), q, 10).collect()), key=str) == brute(docs, items, 10)


def test_bounds_hold_and_exclude():
    docs, items = made()
    found = [(d, (t or "").encode()) for d, t in docs]
    query = S._Query(
        [(t or "").encode() for _, t in items],
        Counter(t for _, x in found for t in set(S.terms_of(x))),
        sum(bool(S.terms_of(x)) for _, x in found),
        sum(len(S.terms_of(x)) for _, x in found),
    )
    number = {t: i for i, t in enumerate(query.terms)}
    held = [(d, x, len(S.terms_of(x)), *S._entries(Counter(S.terms_of(x)), {})) for d, x in found if 10 < len(S.terms_of(x)) < 1000]
    block = S._block(held)
    bounds = query.bounds(block["width"], np.array(block["lengths"]), block["slices"])
    exact = np.stack([query.scores(x, number) for _, x, *_ in held], axis=1)
    assert (bounds >= exact).all()
    least = np.sort(exact, axis=1)[:, -5][:12, None]
    assert (bounds[:12] >= least).sum() < 0.25 * bounds[:12].size


def test_empty(spark):
    docs, items = made(n=20)
    d, q = frames(spark, docs, items)
    assert S.search(S.build_index(d.limit(0)), q).collect() == []
    assert S.search(S.build_index(d), q.limit(0)).collect() == []


def test_tasks_get_few_documents_and_one_block_at_a_time(spark, monkeypatch):
    docs, items = made()
    d, q = frames(spark, docs, items)
    inner = S.arrow_map

    def watched(df, function, schema):
        most = 256 if schema == S.INDEX else 1

        def task(batches):
            def seen():
                for batch in batches:
                    if batch.num_rows > most:
                        raise ValueError(f"{batch.num_rows} rows at once")
                    yield batch

            yield from function(seen())

        return inner(df, task, schema)

    monkeypatch.setattr(S, "arrow_map", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = S.search(S.build_index(d.coalesce(1), 16), q, 10)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 10)


def test_index_is_stored_in_small_row_groups(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.randbytes(500).hex() for _ in range(2600)) for _ in range(8)]  # 2.6 MB each
    index = S.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert sum(groups) == 4 and max(groups) <= 2


def test_open_blocks_are_bounded_together():
    rng = random.Random(3)
    docs = [(i, b" ".join(b"w%d" % rng.randrange(10**6) for _ in range(2 ** rng.randrange(1, 11)))) for i in range(600)]
    taken, given, out = 0, 0, []

    def rows():
        nonlocal taken
        for row in docs:
            assert taken - given < 40_000
            taken += len(row[1])
            yield row

    for block in S._blocks(rows(), 1024, 40_000):
        given += sum(map(len, block["texts"]))
        out += zip(block["doc_ids"], block["texts"], strict=True)
    assert sorted(out) == docs
