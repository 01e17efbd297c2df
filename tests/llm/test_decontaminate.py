"""Exact windows and proximity against plain loops; odd items and texts."""

import re

from veritrim.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = set()
    for item, text in items:
        w = words(text)
        windows |= {(tuple(w[i : i + size]), item) for i in range(len(w) - size + 1)} if len(w) >= size else ({(tuple(w), item)} if w else set())
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for window, item in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "a b c d e f"), (2, "x"), (3, None), (4, ""), (5, "C d E f g"), (10, "ü! ß é"), (1, "a b c d e f"), (None, "q r s t"), (7, "d d d d d")]
DOCS = [
    (1, "A b, c d e f g"), (2, None), (3, "..."), (4, "X"), (5, "x x x"), (6, "a b c d"), (7, "--c d e f g--"), (8, "Ü ß É ü ß é"),
    (9, "d " * 40), (1, "A b, c d e f g"), (1, "A b, c d e f g"), (None, "q r s t u"), (11, "nothing here"), (12, "y " * 5000 + "c d e f g"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1, ["w"]) for d in DOCS], "doc_id long, text string, start int, words array<string>")
    items = spark.createDataFrame([(*i, "t") for i in ITEMS], "item_id long, text string, term string")
    got = D.contamination(docs, items, 4).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(DOCS, ITEMS, 4)
    clean = D.without_leaks(docs, items, 4)
    want = [d for d, b in ((x[0], x[4]) for x in brute(DOCS, ITEMS, 4)) if not b]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(docs.filter("false"), items).collect() == []
    got = D.contamination(docs, items.filter("false")).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b x x x a"), (3, "a b"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a", "b")], "query_id long, first string, second string")
    got = {(r.doc_id, r.position) for r in D.proximity_hits(docs, queries, 3).collect()}
    assert got == {(1, 0), (3, 0)}
