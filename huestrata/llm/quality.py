"""Quality by compression: a text is good if a dictionary of good text shortens it more."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import base_rates, free_name, labelled_sample, logistic, sigmoid, task_memory, text_fold

#: Labelled rows drawn for either label, and characters of a text that the sample has at most (a piece from anywhere in it).
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000

#: Bytes of a drawn text that go into a dictionary at most (a piece from anywhere), length of a dictionary, and compression level.
PIECE_BYTES, DICTIONARY_BYTES, LEVEL = 2_000, 1 << 21, 9

RIDGE = 0.01


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, and the line that turns a difference of sizes into log odds."""

    good: bytes = field(repr=False)
    bad: bytes = field(repr=False)
    slope: float
    intercept: float

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * differences + self.intercept)


class Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.own = [self._compressor(x) for x in (good, bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        if len(content) < 8:  # too short for a dictionary
            return zstandard.ZstdCompressor(level=LEVEL)
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made)

    def difference(self, text: str) -> float:
        """How many bytes a byte of the text takes more with the bad dictionary than with the good one."""
        raw = text.encode("utf-8", "replace")
        good, bad = (len(x.compress(raw)) for x in self.own)
        return (bad - good) / (len(raw) + 1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """A model from the labelled rows of ``docs`` (label 1: good, 0: bad).

    The difference of the compressed sizes, over the length, is all that a score
    comes from. It is calibrated on out-of-fold differences: either half of the
    sample is compressed with dictionaries of the other half, and equal texts
    are in one half, so no text is measured by a dictionary it is part of. The
    final dictionaries hold texts of both. The share of either label among all
    labels sets the base rate. With rows of one label only, the score is that
    label for every text; without any, 0.5. Repeated rows count as often as they
    occur.
    """
    labels = labels.filter(F.col(label).isin(0, 1))
    rows = labelled_sample(
        docs, labels, [label], doc_id=doc_id, text=text,
        draw_by=label, per_label=sample_rows, most_chars=SAMPLE_CHARS,
    )
    good, bad = rows[rows[label] == 1]["text"].tolist(), rows[rows[label] == 0]["text"].tolist()
    if min(len(good), len(bad)) < 4:
        base = 0.0 if len(good) == len(bad) else 35.0 if len(good) > len(bad) else -35.0
        return QualityModel(b"", b"", 0.0, base)
    half_of = {1: text_fold(good, 2), 0: text_fold(bad, 2)}
    differences, target = [], []
    for half in (0, 1):
        own = [[t for t, h in zip(texts, half_of[v]) if h == half] for v, texts in ((1, good), (0, bad))]
        sizes = Sizes(*map(_dictionary, own))
        for value, texts in ((1, good), (0, bad)):
            rest = [t for t, h in zip(texts, half_of[value]) if h != half]
            differences += map(sizes.difference, rest)
            target += [float(value)] * len(rest)
    x, target = np.array(differences), np.array(target)
    mean, spread = x.mean(), x.std() + 1e-9
    slope, intercept = logistic(((x - mean) / spread)[:, None], target, RIDGE)
    # The sample has as many rows of either label; the base rate is that of all labels.
    zeros, ones = base_rates(labels, [label])[label]
    shift = np.log(ones / zeros) - np.log(target.sum() / (len(target) - target.sum()))
    return QualityModel(
        _dictionary(good), _dictionary(bad), float(slope / spread), float(intercept - slope * mean / spread + shift)
    )


def _dictionary(texts: list[str]) -> bytes:
    """Pieces of the texts, one of each, up to the length of a dictionary."""
    pieces, size = [], 0
    for raw in (t.encode("utf-8", "replace") for t in texts):
        start = zlib.crc32(raw) % max(1, len(raw) - PIECE_BYTES + 1)
        piece = raw[start : start + PIECE_BYTES]
        if size + len(piece) < DICTIONARY_BYTES:
            pieces.append(piece)
            size += len(piece) + 1
    return b"\n".join(pieces)


def score_quality(
    docs: DataFrame, model: QualityModel, *, text: str = "text", score: str = "score"
) -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for better text.

    Every whole text is compressed; there is no shuffle. Null counts as empty,
    and an empty text is scored like any other. An existing column of that name
    is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with task_memory():
            own: QualityModel = shared.value
            sizes = own.sizes()
            for texts in batches:
                yield pd.Series(own.scores(np.array([sizes.difference(t or "") for t in texts], dtype=float)))

    at = free_name(docs, "_score")
    return docs.withColumn(at, predict(F.col(text))).withColumn(score, F.col(at)).drop(at)
