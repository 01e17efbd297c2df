"""Token counts and cuts by a tokenizer the caller brings."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_counter(load: Callable[[], Callable[[str], Sequence]]) -> Callable[[Column], Column]:
    """A counting function for ``Settings.count_tokens``; ``load`` runs once per task and returns the encoder."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(lambda text: 0 if text is None else len(encode(text))).astype("int32")

    return count


# Kinds of bytes: letters and what goes on with them, digits, signs, line ends, spaces, and all that pieces are not cut by.
LETTER, DIGIT, SIGN, LINE, SPACE, ODD = range(6)
_KINDS = np.full(256, ODD, np.uint8)
_KINDS[0x21:0x7F] = SIGN
_KINDS[0x27] = ODD  # an apostrophe may join the letters after it
_KINDS[0x30:0x3A] = DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER  # lead bytes of U+00C0 to U+023F
_KINDS[0x0A], _KINDS[0x20] = LINE, SPACE
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
# White space beyond ASCII, by its first three bytes (of those of two bytes, the first two).
_WIDE_WHITE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def cut(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, whether it is one run of letters, digits, signs or one line end after a space or none) of texts.

    ``data`` holds the UTF-8 bytes of the texts, of which none is empty, one after another; ``begins`` is where each begins. A
    byte-level tokenizer splits before every space that a visible character follows. What is between two such spaces is cut
    further where one kind of character follows another, unless it has a character for which this is not sure.
    """
    kind = _KINDS[data]
    after, n = np.append(data[1:], np.uint8(0x20)), len(data)
    lead = (data == 0x20) & ~_WHITE[after]
    wide = np.flatnonzero(lead & (after >= 0xC2) & (after <= 0xE3))
    if len(wide):
        code = np.zeros(len(wide), np.int64)
        for j in range(1, 4):
            code = code << 8 | data[np.minimum(wide + j, n - 1)]
        two = code >> 8
        lead[wide[np.isin(code, _WIDE_WHITE) | (two == 0xC285) | (two == 0xC2A0)]] = False
    lead[np.append(begins[1:] - 1, n - 1)] = False  # a space at the end of its text
    start = lead.copy()
    start[begins] = True
    plain = kind < LINE
    odd = kind == ODD
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))  # the signs of U+00D7 and U+00F7
    odd |= (kind == SPACE) & ~lead
    lines = np.flatnonzero(kind == LINE)
    inner = (lines > 0) & (lines < n - 1)
    inner &= plain[np.maximum(lines - 1, 0)] & plain[np.minimum(lines + 1, n - 1)] & ~start[lines] & ~start[np.minimum(lines + 1, n - 1)]
    odd[lines[~inner]] = True
    change = np.zeros(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    first = np.flatnonzero(start)
    whole = np.logical_or.reduceat(odd, first)
    if whole.any():
        change &= ~np.repeat(whole, np.diff(first, append=n))
    start |= change
    simple = np.ones(n, bool)
    simple[first[whole]] = False
    places = np.flatnonzero(start)
    return places, simple[places]


class Pieces(dict):
    """Ids of the pieces that ``cut`` makes of texts, as bytes by bytes; unknown ones are encoded by the tokenizer.

    The tokenizer splits there too, so pieces can be encoded apart (``tests/llm`` compares with whole texts). The pieces of many
    texts are numbered together, so each different one is looked up once; simple ones go to the tokenizer's model as they are.
    At most ``most`` are kept, in two generations: when the younger is full, the elder is forgotten. Texts with the string
    of an added token are encoded whole.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores among them
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.elder = most, {}

    def _learn(self, pieces: list[bytes], simple: list[bool]) -> None:
        """Encodes pieces that are not known."""
        model = self.tokenizer.model
        rest = []
        for piece, one in zip(pieces, simple, strict=True):
            if one:
                named = piece.decode("latin-1").replace(" ", "\u0120").replace("\n", "\u010a")
                tokens = model.tokenize(named if piece.isascii() else named.translate(_BYTE_CHARACTERS))
                self[piece] = array("I", [t.id for t in tokens]).tobytes()
            else:
                rest.append(piece)
        for start in range(0, len(rest), 4096):
            some = rest[start : start + 4096]
            texts = [p.decode("utf-8") for p in some]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self[piece] = array("I", coded.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        mine = []
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif text:
                mine.append(i)
        if not mine:
            return out
        blobs = [texts[i].encode("utf-8") for i in mine]
        joined = b"".join(blobs)
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *map(len, blobs)])
        places, simple = cut(data, begins[:-1])
        offsets = pa.py_buffer(np.append(places, len(data)).astype(np.int64))
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        number, pieces = held.indices.to_numpy(), held.dictionary.to_pylist()
        if len(self) > self.most // 2:
            self.elder = dict(self)
            self.clear()
        new = []
        for k, piece in enumerate(pieces):
            if piece in self:
                continue
            if (known := self.elder.get(piece)) is None:
                new.append(k)
            else:
                self[piece] = known
        if new:
            plain = np.zeros(len(pieces), bool)
            plain[number] = simple  # equal pieces are alike
            self._learn([pieces[k] for k in new], plain[new].tolist())
        coded = [self[p] for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, froms = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(sizes) - sizes
        counts = sizes[number]
        ends = np.cumsum(counts)
        found = ids[np.repeat(froms[number] - (ends - counts), counts) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.searchsorted(places, begins)]
        for i, lo, hi in zip(mine, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = found[lo:hi]
        return out


# Texts whose tokens a function holds at once.
TEXTS_AT_ONCE = 256

Codec = tuple[Callable[[str], Sequence], Callable[[Sequence], str]]

# What the loaders have loaded in this worker process; later tasks of the process find it there.
_HELD: dict[tuple[str, str], Codec] = {}


def held_codec(load: Callable[[], Codec]) -> Codec:
    """``load()``, once for each worker process if ``load`` is a function of a module, else once for each task."""
    name = (getattr(load, "__module__", ""), getattr(load, "__qualname__", ""))
    if not name[0] or "<" in name[1] or name[0] == "__main__":
        return load()
    if name not in _HELD:
        _HELD[name] = load()
    return _HELD[name]


def token_fitter(load: Callable[[], Codec]) -> Callable[[Column, Column | int], Column]:
    """A fitting function for ``Settings.fit``: struct (prompt, tokens, truncated) from one encoding of the prompt.

    A prompt within the limit is returned unchanged, one that fills it counts as truncated. A NULL prompt has no tokens.
    """
    schema, at_once = "prompt string, tokens int, truncated boolean", TEXTS_AT_ONCE

    @F.pandas_udf(schema)
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # This function travels with copies of the globals it names; the module of the worker process keeps its own.
        from veritrim.functions.tokenizers import held_codec

        encode, decode = held_codec(load)

        def one(text: str | None, limit: int) -> tuple[str | None, int, bool]:
            coded = encode(text) if text is not None else ()
            return decode(coded[:limit]) if len(coded) > limit else text, min(len(coded), limit), len(coded) >= limit

        for texts, limits in batches:
            for start in range(0, len(texts), at_once):
                some = zip(texts[start : start + at_once], limits[start : start + at_once], strict=True)
                yield pd.DataFrame([one(t, int(n)) for t, n in some], columns=["prompt", "tokens", "truncated"])

    return lambda prompt, cap: fit(prompt, F.lit(cap))


def token_truncator(load: Callable[[], Codec]) -> Callable[[Column, Column | int], Column]:
    """A cutting function for ``Settings.truncate``; ``load`` runs once per task and returns (encode, decode).

    A text within the limit is returned unchanged.
    """

    @F.pandas_udf(T.StringType())
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode, decode = load()

        def one(text: str | None, limit: int) -> str | None:
            coded = encode(text) if text is not None else ()
            return decode(coded[:limit]) if len(coded) > limit else text

        for texts, limits in batches:
            yield pd.Series([one(t, int(n)) for t, n in zip(texts, limits, strict=True)], dtype=object)

    return lambda text, limit: cut(text, F.lit(limit))


def token_shortener(load: Callable[[], Codec]) -> Callable[[int], Callable[[str], str]]:
    """A cutting function for ``Settings.shorten``; ``load`` runs on the worker that first needs it."""

    def shortener(limit: int) -> Callable[[str], str]:
        codec: list[Codec] = []

        def shorten(text: str) -> str:
            if not codec:
                codec.append(load())
            encode, decode = codec[0]
            coded = encode(text)
            return decode(coded[:limit]) if len(coded) > limit else text

        return shorten

    return shortener


def token_splitter(load: Callable[[], Codec]) -> Callable[[Column], Column]:
    """A splitting function for ``Settings.split``: the ids of a text's tokens; NULL text has none."""
    at_once = TEXTS_AT_ONCE

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # This function travels with copies of the globals it names; the module of the worker process keeps its own.
        from veritrim.functions.tokenizers import held_codec

        encode, _ = held_codec(load)
        for texts in batches:
            for start in range(0, len(texts), at_once):
                coded = [np.asarray(() if t is None else encode(t), np.int32) for t in texts.slice(start, at_once).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))

    return split


def token_joiner(load: Callable[[], Codec]) -> Callable[[Column], Column]:
    """A joining function for ``Settings.rebuild``: the text of the ids that were kept."""

    @F.pandas_udf(T.StringType())
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # This function travels with copies of the globals it names; the module of the worker process keeps its own.
        from veritrim.functions.tokenizers import held_codec

        _, decode = held_codec(load)
        for ids in batches:
            yield ids.map(lambda kept: None if kept is None else decode([int(i) for i in kept]))

    return join
