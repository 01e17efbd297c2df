"""Round trips of texts full of marks; expansion; odd conversations."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from veritrim.llm import chat as C

TRICKY = st.text(alphabet=list("<|\\im_endstar>\n aé"), max_size=40) | st.sampled_from([C.OPEN, C.CLOSE, "<\\|", "<", "|>"])


@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=6))
def test_round_trip(turns):
    formatted = "".join(f"{C.OPEN}{C.escape_role(r)}\n{C.escape(t)}{C.CLOSE}" for r, t in turns)
    assert C.turns_in(formatted) == turns


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u<|im_end|>\n"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", "a<|2"),
    (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
    (4, None, "user", "first"), (4, 1, None, None), (4, 1, "assistant", "t"), (4, 1, "assistant", "t"), (5, 2, "assistant", "z" * 100_000),
]


def test_examples_and_digests(spark):
    df = spark.createDataFrame([(*r, 9, "f") for r in ROWS], "conv_id long, turn long, role string, text string, example int, formatted string")
    made = C.examples(df).collect()
    one = sorted((r for r in made if r.conv_id == 1), key=lambda r: r.example)
    assert [None if r.target_start is None else C.unescape(r.formatted[r.target_start : r.target_end]) for r in one] == ["a1", "a<|2", None]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(one, one[1:], strict=False))
    got = {r.conv_id: r for r in C.digests(C.examples(df)).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r[1:] for r in ROWS if r[0] == conv), key=lambda t: tuple((x is not None, x) for x in t))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(r.formatted) for r in made if r.conv_id == conv)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.examples(df)).collect() == []
