"""Local consistency, likeness, and the edited texts against a plain loop."""

import hashlib
import random

import numpy as np

from veritrim.llm import fingerprint as P


def rows_of(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, guest int")
    return P.fingerprint_documents(df, parts).collect()


def test_phrases_of_equal_substrings_are_equal_inside():
    rng = random.Random(1)
    inner = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    names = []
    for before in ("", "x", "some words before ", "aaaaaaaaaaaaaaaaaaaaaaaa"):
        symbols = P._mixed(np.array([ord(c) for c in before + inner + "tail" * 9], np.uint64))
        first = np.array([0])
        for _ in range(3):
            symbols, first = P.next_level(symbols, first)
        names.append(set(symbols.tolist()))
    for other in names[1:]:
        assert len(names[0] & other) / len(names[0]) > 0.95


def test_neighbouring_labels_differ():
    symbols = P._mixed(np.arange(5000, dtype=np.uint64) // np.uint64(1))
    labels = P._labels(symbols, np.array([0, 17, 400]))
    same = labels[1:] == labels[:-1]
    same[[16, 399]] = False
    assert labels.max() < 6 and not same.any()


def test_texts_parse_alike_alone_and_together():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.choice([1, 2, 3, 50, 900]))) for _ in range(60)] + ["", "aaaa" * 99]
    assert P.fingerprints(texts) == [P.fingerprints([t])[0] for t in texts]


def test_edited_texts_follow_doc_id(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "délta", "x"]) for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(40)]
    rows = [(i * 7 % 41, t) for i, t in enumerate(texts)] + [(None, "no id " * 30), (100, None)]
    got = {r.doc_id: r for r in rows_of(spark, rows)}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = P.fingerprints([text, edited, following])
        assert (row.fingerprint, row.edited_fingerprint) == (P.written_out(a), P.written_out(b))
        assert (row.near_edited, row.near_next) == (P.likeness(a, b), P.likeness(a, c))


def test_repeated_rows_single_row_and_empty_table(spark):
    got = rows_of(spark, [(5, "same text here")] * 9 + [(5, "other")] * 2)
    assert len(got) == 11 and len({r.fingerprint for r in got}) == 2
    (one,) = rows_of(spark, [(1, "alone in the table")])
    assert one.near_next == 1.0
    assert rows_of(spark, []) == []


def test_likeness_orders_copies_edits_and_strangers():
    rng = random.Random(6)
    make = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200))
    text, other = make(), make()
    a, b, c = P.fingerprints([text, text[:900] + other[900:], other])
    assert P.likeness(a, a) == 1 and 0.4 < P.likeness(a, b) < 0.9 and P.likeness(a, c) < 0.1
