"""Language identification with a linear-chain conditional random field over words.

A word's label depends on its affixes, its character n-grams, a lexicon learned from the labelled texts, and the labels of
its neighbours. The transitions are learned from sequences that are put together from texts of several languages, so that
the chain may switch inside a text. Forward-backward gives each word's label probabilities; a document's language is the
one with the highest mean over all its words.

The model is fitted on the driver from a bounded sample; prediction runs where the documents lie, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import arrow_map

WORDS = re.compile(r"[^\W\d_]+")
HASHES = 1 << 16
#: Characters of a word that features see at either end.
SEEN = 14
UNDETERMINED = "und"


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit. ``documents``: most labelled texts of the sample, and ``chars``: most of one text
    that the fit (not the prediction) reads."""

    documents: int = 2000
    chars: int = 20_000
    length: int = 40
    sequences_per_document: int = 3
    lexicon: int = 20_000
    rounds: int = 40
    rate: float = 0.4
    decay: float = 1e-4


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{SEEN}").view(np.uint32).reshape(len(words), SEEN)


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word, one row a word; the last hash stands for none."""
    mix = np.uint32(2654435761)
    first, last = _codes(words), _codes([w[::-1] for w in words])
    out = []

    def add(kind: int, *columns: np.ndarray) -> None:
        h = np.full(len(words), kind * 7919 + 1, np.uint32)
        for c in columns:
            h = (h ^ c) * mix
            h ^= h >> np.uint32(15)
        there = columns[-1] > 0 if kind else np.ones(len(words), bool)
        out.append(np.where(there, h % np.uint32(HASHES - 1), HASHES - 1))

    for n in (1, 2, 3, 4):
        add(n, *(first[:, i] for i in range(n)))
        add(n + 4, *(last[:, i] for i in range(n)))
    for i in range(1, SEEN - 1):
        add(9, first[:, i], first[:, i + 1])
        if i < SEEN - 2:
            add(10, first[:, i], first[:, i + 1], first[:, i + 2])
    return np.stack(out, axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of each word, expected transitions) of many sequences at once.

    ``scores`` holds the sequences one after another. They are laid out by time, the longest first, so that
    each step is one array operation over the sequences that are still going on.
    """
    labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(going)])
    rank = np.arange(at[-1]) - np.repeat(at[:-1], going)
    source = begins[rank] + np.repeat(np.arange(longest), going)
    local = np.exp(scores[source] - scores[source].max(axis=1, keepdims=True))
    moves = np.exp(transitions)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    for t in range(longest):
        lo, hi = at[t], at[t + 1]
        a = local[lo:hi] if not t else local[lo:hi] * (alpha[at[t - 1] : at[t - 1] + hi - lo] @ moves)
        alpha[lo:hi] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        lo, n = at[t], going[t + 1]
        ahead = local[at[t + 1] : at[t + 2]] * beta[at[t + 1] : at[t + 2]]
        b = ahead @ moves.T
        total = b.sum(axis=1, keepdims=True)
        beta[lo : lo + n] = b / total
        weight = alpha[lo : lo + n] / (alpha[lo : lo + n] * b).sum(axis=1, keepdims=True)
        expected += (weight.T @ ahead) * moves
    joint = alpha * beta
    out = np.empty_like(joint)
    out[source] = joint / joint.sum(axis=1, keepdims=True)
    return out, expected


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # of hashed features, by label
    lexicon: dict[str, int]
    entries: np.ndarray  # of the lexicon: log of the label's share, by label
    scale: np.ndarray  # of the lexicon's entries, by label
    transitions: np.ndarray

    def lexical(self, words: list[str]) -> np.ndarray:
        none = len(self.entries) - 1
        return self.entries[[self.lexicon.get(w, none) for w in words]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of words apart from their neighbours."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        found = features(words)
        total = self.lexical(words) * self.scale
        for column in found.T:
            total = total + self.weights[column]
        return total.astype(np.float32)


def fit(texts: list[str], langs: list[str], settings: Fit = Fit()) -> Model:
    """A model from labelled texts; deterministic. Without any words it knows no language."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(7)
    by_label: list[list[list[str]]] = [[] for _ in labels]
    for text, lang in zip(texts, langs, strict=True):
        words = WORDS.findall(text[: settings.chars].lower())
        if words:
            by_label[labels.index(lang)].append(words)
    labels = [x for x, found in zip(labels, by_label, strict=True) if found]
    by_label = [found for found in by_label if found]
    k = len(labels)
    # Sequences of one to three stretches, each of any language, all languages alike often.
    sequences, truth = [], []
    for _ in range(settings.sequences_per_document * sum(map(len, by_label))):
        words, marks = [], []
        cuts = np.sort(rng.integers(1, settings.length, rng.integers(0, 3)))
        for size in np.diff([0, *cuts, settings.length]):
            label = int(rng.integers(k))
            doc = by_label[label][rng.integers(len(by_label[label]))]
            start = int(rng.integers(max(1, len(doc) - size + 1)))
            part = doc[start : start + size]
            words += part
            marks += [label] * len(part)
        sequences.append(words)
        truth += marks
    counts: Counter = Counter((w, y) for w, y in zip((w for s in sequences for w in s), truth, strict=True))
    totals: Counter = Counter()
    for (w, _), n in counts.items():
        totals[w] += n
    # Words seen once are left out, so that the fit learns what to do with words it does not know.
    lexicon = {w: i for i, (w, n) in enumerate(totals.most_common(settings.lexicon)) if n > 1}
    shares = np.full((len(lexicon) + 1, k), 0.5)
    for (w, y), n in counts.items():
        if w in lexicon:
            shares[lexicon[w], y] += n
    entries = np.log(shares / shares.sum(axis=1, keepdims=True)) + np.log(max(k, 1))

    vocabulary = {w: i for i, w in enumerate(totals)}
    ids = np.fromiter((vocabulary[w] for s in sequences for w in s), np.int64)
    truth = np.array(truth, np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    found = features(list(vocabulary)) if vocabulary else np.zeros((0, 1), np.int64)
    model = Model(labels, np.zeros((HASHES, k)), lexicon, entries, np.full(k, 0.5), np.zeros((k, k)))
    if not len(ids):
        return model
    lexical = model.lexical(list(vocabulary))
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(lengths)[:-1]] = False
    inside[0] = False
    pairs = np.flatnonzero(inside)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[pairs - 1], truth[pairs]), 1)
    onehot = np.eye(k)[truth]
    past = [np.full_like(x, 1e-8) for x in (model.weights, model.scale, model.transitions)]
    for _ in range(settings.rounds):
        scores = lexical * model.scale
        for column in found.T:
            scores = scores + model.weights[column]
        posterior, expected = forward_backward(scores[ids], lengths, model.transitions)
        error = onehot - posterior
        per_word = np.stack([np.bincount(ids, error[:, y], len(vocabulary)) for y in range(k)], axis=1)
        flat = found.ravel()
        gradient = np.stack([np.bincount(flat, np.repeat(per_word[:, y], found.shape[1]), HASHES) for y in range(k)], axis=1)
        steps = (gradient - settings.decay * len(ids) * model.weights / HASHES, (per_word * lexical).sum(axis=0), seen - expected)
        for value, step, total in zip((model.weights, model.scale, model.transitions), steps, past, strict=True):
            total += step**2
            value += settings.rate * step / np.sqrt(total)
        model.weights[HASHES - 1] = 0
    model.weights = model.weights.astype(np.float32)
    return model


def sample(docs: DataFrame, learn: Column, settings: Fit = Fit()) -> tuple[list[str], list[str]]:
    """At most ``settings.documents`` labelled texts (text, lang), chosen by a hash of the text, at most ``chars`` of each."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    kept = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < (1 << 20) * min(1.0, settings.documents * 1.2 / max(total, 1)))
    rows = kept.select(F.substring("text", 1, settings.chars).alias("text"), "lang").limit(settings.documents).collect()
    rows = sorted((r["text"], r["lang"]) for r in rows)
    return [r[0] for r in rows], [r[1] for r in rows]


def predict(docs: DataFrame, model: Model, group_words: int = 200_000) -> DataFrame:
    """Adds lang_pred and score (mean probability of that language) to ``docs``; columns of these names are replaced.

    NULL texts and texts without letters are ``und`` with score 0, as are all if the model has no language. Whole texts
    are read; repeated rows get the same answer; other columns are kept.
    """

    class Known(dict):
        """Word numbers; new words queue up for their scores."""

        def __init__(self) -> None:
            super().__init__()
            self.new: list[str] = []
            self.scores = np.zeros((0, len(model.labels)), np.float32)

        def __missing__(self, word: str) -> int:
            self[word] = number = len(self)
            self.new.append(word)
            return number

        def table(self) -> np.ndarray:
            parts = [model.emissions(self.new[i : i + 20_000]) for i in range(0, len(self.new), 20_000)]
            self.scores, self.new = np.concatenate([self.scores, *parts]), []
            return self.scores

    def answers(texts: list[str | None], known: Known) -> tuple[list[str], list[float]]:
        ids: list[np.ndarray] = []
        for text in texts:
            words = WORDS.findall(text.lower()) if text else []
            if not any(c.isalpha() for w in words for c in w):
                words = []
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not model.labels:
            return langs, scores
        emissions = known.table()
        lengths = np.array([len(x) for x in ids], np.int64)
        order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i]]
        while order:
            upto = int(np.searchsorted(np.cumsum(lengths[order]), group_words)) + 1  # alike long ones together
            group, order = order[:upto], order[upto:]
            size = lengths[group]
            posterior, _ = forward_backward(emissions[np.concatenate([ids[i] for i in group])], size, model.transitions.astype(np.float32))
            means = np.add.reduceat(posterior.astype(np.float64), np.concatenate([[0], np.cumsum(size)[:-1]])) / size[:, None]
            for i, row in zip(group, means, strict=True):
                best = int(row.argmax())
                langs[i], scores[i] = model.labels[best], float(min(1.0, row[best]))
        return langs, scores

    kept = docs.drop("lang_pred", "score")
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                langs, scores = answers(part.column("text").cast(pa.string()).to_pylist(), known)
                columns = [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "lang_pred", "score"])
                if len(known) > 250_000:
                    known = Known()

    return arrow_map(kept, task, schema)
