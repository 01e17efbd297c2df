"""Exact round trips of the coding and of whole documents."""

import zlib

import numpy as np
import pytest

from veritrim.llm import simple8b as S
from veritrim.llm.catalog import byte_bpe_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_round_trip(block):
    rng = np.random.default_rng(block)
    for n in (0, 1, 2, 59, 60, 61, 500, 9000):
        for bits in (0, 1, 5, 16, 30, 31, 60, 64):
            values = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)
            mixed = np.where(rng.random(n) < 0.5, values, values & np.uint64(3))
            assert (S.decode(*S.encode(mixed, block), n, block) == mixed).all()


def test_words_are_packed():
    words, _, _ = S.encode(np.ones(4096, np.uint64))
    assert len(words) == -(-4096 // 60)


def test_pieces_equal_whole_texts():
    pieces = S.Pieces(byte_bpe_path(), most=20)
    texts = ["", " ", "  a", "a  b \n c ", "x\n\n y", "été  <|endoftext|> 12  3!", "a b c", "\t a\u00a0 b", "end ", "don't  stop 're \u3000 x", " lead"]
    for _ in range(2):
        got = pieces.encode(texts)
        assert [g.tolist() for g in got] == [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_as_by_the_plain_library_call():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(byte_bpe_path())
    texts = ["a  <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endoftext>", "a b"]
    want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    assert [g.tolist() for g in S.Pieces(byte_bpe_path()).encode(texts)] == want


def test_words_are_known_whatever_signs_follow_them():
    pieces = S.Pieces(byte_bpe_path())
    pieces.encode([" ab ab. ab, ab! ab\nab. ab;\nab,"])
    assert set(pieces) == {b" ab", b"ab", b".", b",", b"!", b";", b"\n"}


def test_random_texts_as_by_the_plain_library_call():
    from tokenizers import Tokenizer

    coder, pieces = Tokenizer.from_file(byte_bpe_path()), S.Pieces(byte_bpe_path(), most=500)
    parts = ["a", "Ab", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'LL", "\u00e9", "\u00d7", "\u00f7", "\u0180", "\u023f", "\u024f", "\u0250", "\u03a9"]
    parts += ["\u4e2d", "\u3002", "\u201c", "\u2019", "\u2028", "\u3000", "\u00a0", "\u0085", "\u1680", "\u202f", "\x1c", "\x00", "\x7f", "1", "22", "\u00b2", "\u0663", "!", "..."]
    parts += ["_", "<|endoftext|>", "\u00aa", "e\u0301", "\U0001f600", "\u200b"]
    rng = np.random.default_rng(6)
    for _ in range(20):
        texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(100)]
        want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in pieces.encode(texts)] == want


def test_documents(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(byte_bpe_path())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "no id"), (70_000, None), (70_001, ""), (3, rows[3][1]), (70_002, "very long " * 60_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, chunk int")
    path = S.write_documents(df.repartition(5), byte_bpe_path(), 2)
    got = sorted(S.read_documents(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")), strict=True):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.read_documents(spark, S.write_documents(df, byte_bpe_path(), 2)).collect() == []
