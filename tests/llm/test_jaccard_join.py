"""Links and components against all pairs; nulls, empty and repeated texts, clashing columns, small batches."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from veritrim.llm import jaccard_join as J


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "ÉTÉ", "été", "A.", "a."]
    passage = rng.choices(vocabulary, k=30)
    rows, next_id = [(None, "one two three four five six"), (900, None), (901, ""), (902, " \n\t"), (903, "lone"), (904, "LONE")], 0
    for size in (6, 20, 60, 150):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            for _ in range(rng.choice([1, 2, 9])):
                text = list(base)
                for _ in range(rng.randrange(max(2, size // 15))):
                    text[rng.randrange(size)] = rng.choice(vocabulary)
                if rng.random() < 0.4:
                    at = rng.randrange(size)
                    text[at:at] = passage
                rows.append((next_id, rng.choice([" ", "\n", "  "]).join(text)))
                next_id += 1
    for i in range(40):  # a chain: each links with the next, the ends do not
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))))
    rows += [rows[10], rows[10], (rows[12][0], "another text under the same id as one before it")]
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    clashing = "node int, token int, root int, rows int, text_hash int, stays int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], f"doc_id long, text string, {clashing}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in J.jaccard_components(df.repartition(5)).collect()]
        kept = J.one_of_each(df)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows)
    assert sorted(got, key=str) == want
    # One of each component, and the texts without words; the last row is a component of its own under an id that is taken.
    others = {c for _, n, c in brute(rows[:-1]) if n}
    assert sorted(ids, key=str) == sorted([*others, rows[-1][0], 900, 901, 902], key=str)


def test_nodes_alone_in_their_salts_link(spark, monkeypatch):
    monkeypatch.setattr(J, "SALT_ROWS", 1)
    monkeypatch.setattr(J, "COMMON_IN_BATCH", 2)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(150)]
    rows = [(i, " ".join([f"l{i}x{k}" for k in range(200)] + passage)) for i in range(60)]  # longer texts, of rarer prefixes
    for i in range(5):  # the passage with a word changed
        text = list(passage)
        text[rng.randrange(150)] = f"changed{i}"
        rows.append((100 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {c for d, _, c in want if d >= 100} == {100}
    assert sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).collect() == []


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 5000, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 5000, rng.integers(0, 300)).astype(np.uint64)]))
        if len(b):
            assert J.overlap_bound(J.signature(a), J.signature(b), len(a), len(b)) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("common", [0, 50, 2000])
def test_links_share_a_prefix_for_any_common_shingles(common):
    rng = np.random.default_rng(common)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    last = np.unique(rng.choice(pool, common)) if common else np.zeros(0, np.uint64)
    for _ in range(100):
        a = np.unique(rng.choice(pool, rng.integers(1, 200)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.choice(pool, rng.integers(0, 10))]))
        if len(b) and J.links(len(np.intersect1d(a, b)), len(a), len(b)):
            tokens, owner = J.prefixes([a, b], last)
            assert set(tokens[owner == 0]) & set(tokens[owner == 1])


def test_shared_shingles_are_counted_in_parts_of_their_range():
    import tracemalloc

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)
    pool[:4] = [0, 2**64 - 1, 2**60, 2**60 - 1]
    sets = [np.unique(rng.choice(pool, rng.integers(0, 60))) for _ in range(40)]
    found, counts = J.repeated(sets)
    want = Counter(int(x) for s in sets for x in s)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == {x: n for x, n in want.items() if n >= J.COMMON_IN_BATCH}
    assert (found[1:] > found[:-1]).all()
    assert [len(x) for x in J.repeated([])] == [0, 0]
    sets = [np.unique(rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64)) for _ in range(500)]
    tracemalloc.start()
    J.repeated(sets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(s.nbytes for s in sets) / 2  # all in one would be as large again
