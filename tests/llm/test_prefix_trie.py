"""Nodes against a plain trie, for several widths of block; NULLs, ties, long, empty and repeated conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veritrim.llm import prefix_trie as P


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        leaf = not any(len(q) > len(p) and q[: len(p)] == p for q in members) if children[p] == 0 else False
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += leaf
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


def made():
    rng = random.Random(11)
    rows = []
    for c in [*range(100, 130), *range(200, 215), 350, 351, 700]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 6, 9, 17])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é😀", ""])))
    long = [(t, "user", f"same {t}") for t in range(40)]
    rows += [(c, t, r, x if t < 40 - c % 7 else x + "!") for c in range(1000, 1006) for t, r, x in long]
    rows += [(1100, t, "user", f"deep {t % 3}") for t in range(130)]
    rows += [(101, None, None, None), (101, None, "user", None), (102, 0, "user", "tie"), (102, 0, "user", "tie"), (102, 0, "a", "tie")]
    rows += [(None, 0, "user", "nobody"), (2001, 0, "user", "turnless, its head is absent and its own turns may go"), (10**15 + 1, 3, "user", "x;:9")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, key int, place string, name string"
    return spark.createDataFrame([(*r, 1, "p", "n") for r in rows], schema).repartition(3)


@pytest.mark.parametrize("columns", [2, 3, 8])
def test_equals_plain_trie(spark, columns):
    rows = made()
    got = P.trie(P.with_shared_heads(P.ordered_turns(frame(spark, rows))), columns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(rows))


def test_own_turns_alone(spark):
    rows = [(c, t, "user", f"{t}") for c in range(3) for t in range(c + 9)]
    got = P.trie(P.ordered_turns(frame(spark, rows)), 4)
    own = {c: [("user", str(t)) for t in range(c + 9)] for c in range(3)}
    assert sorted(map(tuple, got.collect()), key=str) == brute(own)


def test_a_conversation_may_lose_all_turns(spark):
    lost = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    got = P.trie(P.with_shared_heads(P.ordered_turns(frame(spark, [(lost, 0, "user", "x")])))).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in got] == [(lost, 0, 1, 1)]
    assert got[0].ends_sha256 == hashlib.sha256(str(lost).encode()).hexdigest()


def test_empty(spark):
    assert P.trie(P.with_shared_heads(P.ordered_turns(frame(spark, [])))).collect() == []


def test_rollup_is_in_the_plan(spark):
    laid = P.blocks(P.ordered_turns(frame(spark, made())), 3)
    plan = P.nodes(laid, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "grouping_id" in plan
