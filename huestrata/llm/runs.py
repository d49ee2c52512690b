"""Periodic runs of words: stretches that repeat with a fixed period, found in one pass over the words.

A diagonal of lag q is a stretch of places i at which word i equals word i - q.
One that matches m words in a row is a stretch of m + q words with period q, so
a run of period q and at least ``repeats`` periods is a diagonal of at least
``(repeats - 1) * q`` matches. The pass keeps only the diagonals that can still
become one:

- Lags are taken in classes from 2**b to 2**(b + 1) - 1. A match in a class
  takes 3 * 2**b words at least, so a word opens or continues a diagonal only
  where the gram of that many words that ends with it occurred before.
- Of a gram's earlier occurrences only the latest counts. If it lies nearer than
  a run's period would, the gram has a period of less than 2**b beside it, and by
  the theorem of Fine and Wilf the stretch has a smaller period then.

So a word has one active lag in each class at most, whatever repeats in the
text: n words cost n log n steps and n places of memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import free_name

#: Words are what lies between these characters.
WORD = re.compile("[^\x20\x09-\x0d]+")

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, REPEATS = 6, 4

#: Words of a gram, in units of the smallest lag of its class. Two lags of a class are below that together.
_GRAM = 3

#: Characters of text that a task turns into words at a time.
_SLICE_CHARS = 4_000_000


def find_runs(words: Sequence[str], least_words: int = LEAST_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period.

    A run is a stretch of words with smallest period q and at least
    ``max(least_words, repeats * q)`` words that no neighbouring word extends.
    """
    if repeats < _GRAM + 1:
        raise ValueError(f"runs of fewer than {_GRAM + 1} periods are not looked for")
    codes = _codes(words)
    places, lags, grams = _candidates(codes)
    found: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # matched words so far, by lag
    before = -1

    def close(place: int, kept: dict[int, int]) -> None:
        """Ends the diagonals that do not go on at the word after ``place``."""
        for lag, matched in active.items():
            if lag not in kept and matched + lag >= max(least_words, repeats * lag):
                start = place + 1 - matched - lag
                if not _shorter_period(codes, start, lag):
                    found.append((start, matched + lag, lag))

    at, end = 0, len(places)
    while at < end:
        place = places[at]
        if place != before + 1:
            close(before, {})
            active = {}
        grown: dict[int, int] = {}
        while at < end and places[at] == place:
            lag = lags[at]
            grown[lag] = active[lag] + 1 if lag in active else grams[at]
            at += 1
        close(before, grown)
        active, before = grown, place
    close(before, {})
    return sorted(found, key=lambda run: (run[0], run[2]))


def _codes(words: Sequence[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _candidates(codes: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places, lags and gram lengths, by place: the latest earlier occurrence of the gram that ends at a place.

    Grams are numbered by doubling: one of 2 L words is a pair of grams of L words.
    """
    places, lags, grams = [], [], []
    ids, back = codes, np.zeros(0, np.int64)
    for size in range(2, _GRAM + 1):
        ids, back = _pairs(ids[:-1], codes[size - 1 :])
    width, low = _GRAM, 1
    # Where no gram of one length occurs twice, none of a greater length does.
    while width + low <= len(codes) and back.any():
        hit = np.flatnonzero((back >= low) & (back < 2 * low))
        places.append(hit + width - 1)
        lags.append(back[hit])
        grams.append(np.full(len(hit), width))
        ids, back = _pairs(ids[:-width], ids[width:])
        width, low = 2 * width, 2 * low
    if not places:
        return [], [], []
    all_places = np.concatenate(places)
    order = np.argsort(all_places, kind="stable")
    return all_places[order].tolist(), np.concatenate(lags)[order].tolist(), np.concatenate(grams)[order].tolist()


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs, equal for equal pairs, and how far back each pair occurred last (0: never)."""
    keys = left * (int(right.max(initial=0)) + 1) + right
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.cumsum(np.append(0, ~same))[: len(keys)]
    back = np.zeros(len(keys), np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    return ids, back


def _shorter_period(codes: np.ndarray, start: int, period: int) -> bool:
    """True if the run has a smaller period, which then divides ``period``."""
    stretch, rest, factor = codes[start : start + 2 * period], period, 2
    while rest > 1:
        if rest % factor:
            factor += 1 if factor * factor <= rest else rest - factor
            continue
        while rest % factor == 0:
            rest //= factor
        step = period // factor
        if np.array_equal(stretch[step:], stretch[:-step]):
            return True
    return False


def collapse(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words without the repeats: of every run only the first period stays."""
    if not runs:
        return list(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def with_runs(
    docs: DataFrame,
    *,
    text: str = "text",
    runs: str = "runs",
    collapsed: str = "collapsed",
    n_words: str = "n_words",
    least_words: int = LEAST_WORDS,
    repeats: int = REPEATS,
) -> DataFrame:
    """``docs`` with the periodic runs of every whole text, and the text without their repeats.

    ``runs`` is an array of (start, length, period) by start and period, in
    words from 0; ``collapsed`` joins by one space the words that no run holds
    after its first period; ``n_words`` counts the words of the text. Every row
    is worked on where it lies, so nothing is shuffled, and memory grows with
    the longest text only. Null and empty texts and texts of white space have no
    words, no runs and an empty collapsed text; repeated rows stay, each with its
    own result. Runs that start at one word stand in order of their period.
    Existing columns of these names are replaced; all others stay.
    """
    fields = "starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string, n_words bigint"

    @F.pandas_udf(fields)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                words = WORD.findall(value or "")
                own = find_runs(words, least_words, repeats)
                starts, lengths, periods = zip(*own) if own else ((), (), ())
                rows.append((list(starts), list(lengths), list(periods), " ".join(collapse(words, own)), len(words)))
            yield pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed", "n_words"])

    at = free_name(docs, "_runs")
    zipped = F.arrays_zip(
        F.col(f"{at}.starts").alias("start"), F.col(f"{at}.lengths").alias("length"), F.col(f"{at}.periods").alias("period")
    ).cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    return (
        docs.withColumn(at, found(F.col(text)))
        .withColumns({runs: zipped, collapsed: F.col(f"{at}.collapsed"), n_words: F.col(f"{at}.n_words")})
        .drop(at)
    )
