"""Targets against step-by-step resharing; sums, caps, reruns and fairness of the rounding."""

from collections import defaultdict

import pytest

from veritrim.llm import mixing as M


def resharing(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        deal = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if deal[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target | deal
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            full.add(s)


ROWS = (
    [(i, "w " * (i % 50 + 1), f"s{i % 5}") for i in range(900)]
    + [(2000 + i, "word " * 40, "big") for i in range(500)]
    + [(3000 + i, " x\ty\n" * 3, None) for i in range(60)]
    + [(5000, None, "s1"), (5001, "", "s1"), (5002, " \n", "z"), (7, "w w w", "s2"), (7, "w w w", "s2"), (None, "a b", "s0"), (None, "a b", "s0")]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, size int, key string")


def test_targets_and_sums(docs):
    got = M.mix(docs, fan_in=8).collect()
    assert len(got) == len(ROWS)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += len((text or "").split())
        largest[source] = max(largest[source], len((text or "").split()))
    want = resharing(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(7), fan_in=8).collect()))


def test_rows_are_repeated(docs):
    copies = M.mix(docs)
    out = M.repeat_by_copies(docs, copies)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in copies.collect())


def test_copies_are_fair(spark):
    rows = [(i, "a b c d" if i % 2 else "a", "one" if i < 3000 else "two") for i in range(6000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("one", "two"):
        for size in (1, 4):
            mine = [r for r in got if r.source == source and r.size == size]
            assert sum(r.copies for r in mine) / len(mine) == pytest.approx(mine[0].target / mine[0].source_size, abs=0.06)


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
