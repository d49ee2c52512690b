"""Toxicity by a classifier chain: every category's model sees the probabilities of those before it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import Memo, base_rates, free_name, labelled_sample, logistic, sigmoid, task_memory, text_fold

#: Labelled rows drawn for either value of the last category, and characters of a text that the sample has at
#: most (a piece from anywhere in it).
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 12_000

#: Terms kept for each category, and the fewest sample texts a term must be in.
TERMS, LEAST_TEXTS = 400, 5

#: Leading letters of a word that count as terms of their own (stems of inflected words).
STEMS = (4, 5, 6, 7)

#: Parts of the sample for out-of-fold predictions.
FOLDS = 5

RIDGE = 1.0

_WORD = regex.compile(r"\p{L}+")


def terms_of(piece: str) -> tuple[str, ...]:
    """Words of a piece of text and their stems, each once."""
    found = {}
    for word in _WORD.findall(piece.lower()):
        found[word] = None
        for n in STEMS:
            if len(word) > n:
                found[word[:n] + "*"] = None
    return tuple(found)


@dataclass(frozen=True)
class ChainModel:
    """Linear models in the order of the chain, over one list of terms."""

    categories: list[str]
    terms: dict[str, int] = field(repr=False)
    #: By category: a weight for each term, for each earlier category, and the intercept.
    weights: list[np.ndarray] = field(repr=False)
    #: By category: what takes the log odds from the sample, which is drawn by the last category, to all labels.
    shifts: list[float] | None = None

    def numbers(self, piece: str) -> tuple[int, ...]:
        return tuple(self.terms[t] for t in terms_of(piece) if t in self.terms)

    def chain(self, present: list[int]) -> list[float]:
        """Probabilities in chain order. Each is fed to the models after it as these have learned it, from the sample."""
        fed: list[float] = []
        out: list[float] = []
        n = len(self.terms)
        for w, shift in zip(self.weights, self.shifts or [0.0] * len(self.weights)):
            x = w[present].sum() + w[-1] + sum(a * b for a, b in zip(w[n:-1], fed))
            fed.append(float(sigmoid(x)))
            out.append(float(sigmoid(x + shift)))
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    folds: int = FOLDS,
) -> ChainModel:
    """A chain over 0/1 columns of ``labels``, fitted on a bounded sample.

    The sample is drawn by the last category, the one the chain leads to; the
    probabilities given out are set back to the share of a label among all. What
    a later model learns from an earlier category are out-of-fold predictions:
    each text is predicted by models that have not seen it, down to the choice
    of their terms, and equal texts are in one fold. So the later model does not
    come to trust fitted values. A category with one value only gets a constant
    model. Repeated rows count as often as they occur; of terms that tell
    equally much the first by name are taken.
    """
    names = list(categories)
    for c in names:
        labels = labels.filter(F.col(c).isin(0, 1))
    rows = labelled_sample(
        docs, labels, names, doc_id=doc_id, text=text,
        draw_by=names[-1], per_label=sample_rows, most_chars=SAMPLE_CHARS,
    )
    sample = _Sample(rows["text"].tolist(), folds)
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    shifts: list[float] = []
    fed = np.zeros((len(rows), 0))
    rates = base_rates(labels, names)
    for c in names:
        y = rows[c].to_numpy(dtype=float)
        everything = np.ones(len(y), bool)
        weights.append(_learn(sample, everything, fed, y))
        held = np.zeros(len(y))
        for k in range(folds):
            out = sample.fold == k
            if out.any():
                terms, fitted = _learn(sample, ~out, fed, y)
                held[out] = _apply(fitted, np.c_[sample.matrix(terms)[out], fed[out]])
        fed = np.c_[fed, held]
        zeros, ones = rates[c]
        odds = y.sum() / max(1.0, len(y) - y.sum())
        shifts.append(float(np.log(ones / zeros) - np.log(odds)) if zeros and ones and 0 < odds < len(y) else 0.0)
    chosen = sorted({int(t) for terms, _ in weights for t in terms}, key=sample.names.__getitem__)
    place = {t: i for i, t in enumerate(chosen)}
    spread = []
    for terms, fitted in weights:
        row = np.zeros(len(chosen) + len(fitted) - len(terms))
        row[[place[int(t)] for t in terms]] = fitted[: len(terms)]
        row[len(chosen) :] = fitted[len(terms) :]
        spread.append(row)
    return ChainModel(names, {sample.names[t]: i for t, i in place.items()}, spread, shifts)


class _Sample:
    """Terms of the sample's texts as numbers, and their folds."""

    def __init__(self, texts: list[str], folds: int):
        numbers: dict[str, int] = {}
        found = [
            {numbers.setdefault(t, len(numbers)) for piece in set(text.split()) for t in terms_of(piece)} for text in texts
        ]
        self.names = list(numbers)
        # Ties between terms go by name, whatever the order in which they were met.
        self.by_name = np.empty(len(self.names), np.int64)
        self.by_name[sorted(range(len(self.names)), key=self.names.__getitem__)] = np.arange(len(self.names))
        self.row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        self.term = np.fromiter((t for x in found for t in x), np.int64, len(self.row))
        self.fold = text_fold(texts, folds)

    def telling(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Terms whose share of the texts differs most between the two values, in standard errors."""
        inside, outside = (
            np.bincount(self.term[pick[self.row]], minlength=len(self.names)) for pick in (rows & (y == 1), rows & (y == 0))
        )
        a, b = max(1, int((rows & (y == 1)).sum())), max(1, int((rows & (y == 0)).sum()))
        p = (inside + outside) / (a + b)
        gap = np.abs(inside / a - outside / b) / np.sqrt(np.maximum(p * (1 - p), 1e-6) * (1 / a + 1 / b))
        often = np.flatnonzero(inside + outside >= LEAST_TEXTS)
        return often[np.lexsort((self.by_name[often], -gap[often]))][:TERMS]

    def matrix(self, terms: np.ndarray) -> np.ndarray:
        place = np.full(len(self.names) + 1, -1)
        place[terms] = np.arange(len(terms))
        at = place[self.term]
        x = np.zeros((len(self.fold), len(terms)))
        x[self.row[at >= 0], at[at >= 0]] = 1
        return x


def _learn(sample: _Sample, rows: np.ndarray, fed: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a model of the given rows; the terms are chosen on these rows too."""
    terms = sample.telling(rows, y)
    return terms, _fit(np.c_[sample.matrix(terms), fed][rows], y[rows])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(y) and y.min() < y.max():
        return logistic(x, y, RIDGE)
    constant = np.zeros(x.shape[1] + 1)
    constant[-1] = 35.0 if len(y) and y[0] else -35.0
    return constant


def _apply(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ weights[:-1] + weights[-1])


def score_chain(
    docs: DataFrame, model: ChainModel, *, text: str = "text", prefix: str = "p_"
) -> DataFrame:
    """``docs`` with one probability column ``prefix + category`` for each category.

    Every whole text is read; a term counts once however often it is repeated,
    so a long clean text does not add up to a toxic one. Null counts as empty:
    it gets the probability of a text without any known term. No shuffle.
    Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with task_memory():
            own: ChainModel = shared.value
            memo = Memo(own.numbers)

            def one(text: str | None) -> list[float]:
                memo.trim()
                present: set[int] = set()
                for numbers in map(memo.__getitem__, set((text or "").split())):
                    present.update(numbers)
                return own.chain(sorted(present))

            for texts in batches:
                yield pd.Series([one(t) for t in texts], dtype=object)

    at = free_name(docs, "_chain")
    scored = docs.withColumn(at, predict(F.col(text)))
    named = {prefix + c: F.col(at)[i] for i, c in enumerate(model.categories)}
    return scored.withColumns(named).drop(at)
