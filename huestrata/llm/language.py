"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.llm.common import VECTOR_ENTRIES, VectorMemo, draw, free_name, stored, task_memory

#: Language given to a text that is null or has no letter.
UNDETERMINED = "und"

#: Training rows drawn for every language (a bounded sample by a hash of the id).
SAMPLE_ROWS = 3000

#: Longest word list of a language, and longest n-gram list of a language and length.
WORDS, GRAMS = 30_000, 5_000

#: Terms of all lists together that reach the driver, and letters of a word in a list (longer ones go by n-grams).
MODEL_TERMS, WORD_LETTERS = 1_000_000, 48

#: Character n-grams, longest first; words are fenced with a space at either end.
LENGTHS = (5, 4, 3, 2, 1)

#: Added to every count, so that a language without a word is unlikely and not impossible.
SMOOTHING = 0.5

#: A text counts as this many words at most when its score is worked out.
EVIDENCE = 20.0

_WORD = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies by language: a row for each word and for each n-gram."""

    languages: list[str]
    words: dict[str, int] = field(repr=False)
    grams: dict[str, int] = field(repr=False)
    rows: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> LanguageModel:
        rows = np.array([*words.values(), *grams.values()], dtype=np.float32).reshape(-1, max(1, len(languages)))
        places = {word: i for i, word in enumerate(words)}
        return cls(languages, places, {gram: len(words) + i for i, gram in enumerate(grams)}, rows)

    def word(self, word: str) -> np.ndarray:
        """Log frequency by language of a known word, else the mean of the longest n-grams that are known.

        Without any known n-gram the word says nothing: zeros.
        """
        known = self.words.get(word)
        if known is not None:
            return self.rows[known]
        fenced = f" {word} "
        for length in LENGTHS:
            found = [
                at
                for i in range(len(fenced) - length + 1)
                if (at := self.grams.get(fenced[i : i + length])) is not None
            ]
            if found:
                return np.add.reduce(self.rows[found]) / len(found)
        return np.zeros(len(self.languages))

    def decide(self, total: np.ndarray, count: int) -> tuple[str, float]:
        """Language and its share of the probability, from the sum over ``count`` words.

        Ties go to the first language by name.
        """
        if not count or not self.languages:
            return UNDETERMINED, 0.0
        mean = total / count * min(count, EVIDENCE)
        odds = np.exp(mean - mean.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


class WordRows(VectorMemo):
    """Rows of words: those of the model as they are, others worked out on first use."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.word, model.rows.shape[1])
        self.model = model
        self.clear()

    def clear(self) -> None:
        """Forgets all words but the model's."""
        super().clear()
        self.update(self.model.words)
        known = self.model.rows[: len(self)].astype(float)
        self.rows = np.concatenate([known, np.zeros((max(1024, len(known)), known.shape[1]))])
        self.entries = len(self) + VECTOR_ENTRIES

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """Sum over the words of a text, and their number."""
        words = _WORD.findall(text.lower())
        if not self.model.languages:
            return np.zeros(0), len(words)
        return self.total(words), len(words)


def train(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    words: int = WORDS,
    grams: int = GRAMS,
) -> LanguageModel:
    """A model learned from the rows of ``docs`` with a language.

    Counts are made by Spark over about ``sample_rows`` rows of every language.
    A list holds the terms that occur at least so often that there are ``words``
    words, or ``grams`` n-grams of a length, at most: terms of one count are in
    it together, so no tie is broken. The bound comes from how many terms there
    are of each count, so no task sorts the terms of a language. The driver gets
    ``MODEL_TERMS`` terms of all languages at most, the lists being shorter if
    there are many. Null texts add nothing; without rows the model is empty.
    """
    sample = draw(
        docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")),
        "id",
        "lang",
        sample_rows,
    )
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = sample.select("lang", word.alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    pieces = F.array(*[_grams(F.concat(F.lit(" "), F.col("term"), F.lit(" ")), n) for n in LENGTHS])
    gram_counts = (
        counts.select("lang", "n", F.explode(F.flatten(pieces)).alias("term"))
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"))
        .withColumn("size", F.length("term"))
    )
    short = counts.filter(F.length("term") <= WORD_LETTERS).withColumn("size", F.lit(0))
    parts = stored(short.select("lang", "term", "size", "n").unionByName(gram_counts.select("lang", "term", "size", "n")))
    totals = parts.groupBy("lang", "size").agg(F.sum("n").alias("all"))
    languages = max(1, parts.select("lang").distinct().count())
    share = MODEL_TERMS / (languages * (words + grams * len(LENGTHS)))
    longest = F.when(F.col("size") == 0, int(words * min(1, share))).otherwise(int(grams * min(1, share)))
    # One row for each count that occurs: few, and they grow with the root of the words counted.
    levels = parts.groupBy("lang", "size", "n").agg(F.count("*").alias("terms"))
    so_far = F.sum("terms").over(Window.partitionBy("lang", "size").orderBy(F.desc("n")))
    least = levels.withColumn("so_far", so_far).filter(F.col("so_far") <= longest)
    bound = least.groupBy("lang", "size").agg(F.min("n").alias("least")).join(totals, ["lang", "size"])
    # A row for each language and length.
    kept = parts.join(F.broadcast(bound), ["lang", "size"]).filter(F.col("n") >= F.col("least"))
    return _model(kept.select("lang", "term", "size", "n", "all").toPandas())


def _grams(fenced: Column, n: int) -> Column:
    """All stretches of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.length(fenced) - n + 1)
    found = F.transform(starts, lambda i: F.substr(fenced, i, F.lit(n)))
    return F.when(F.length(fenced) >= n, found).otherwise(F.array().cast("array<string>"))


def _model(kept: pd.DataFrame) -> LanguageModel:
    languages = sorted(kept["lang"].unique())
    at = {name: i for i, name in enumerate(languages)}
    totals = {
        (lang, int(size)): int(total)
        for lang, size, total in kept[["lang", "size", "all"]].drop_duplicates().itertuples(index=False)
    }
    tables: dict[int, dict[str, np.ndarray]] = {}
    for lang, term, size, n in kept[["lang", "term", "size", "n"]].itertuples(index=False):
        counts = tables.setdefault(int(size), {}).setdefault(term, np.zeros(len(languages)))
        counts[at[lang]] = n
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for size, terms in tables.items():
        spread = SMOOTHING * (len(terms) + 1)
        base = np.array([math.log(totals.get((x, size), 0) + spread) for x in languages])
        for term, counts in terms.items():
            (words if size == 0 else grams)[term] = np.log(counts + SMOOTHING) - base
    return LanguageModel.of(languages, words, grams)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text: str = "text",
    lang_pred: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1.

    Every whole text is scored; there is no shuffle. A null text or one without
    a letter gets ``und`` and 0. Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task_memory():
            own: LanguageModel = shared.value
            memo = WordRows(own)
            for texts in batches:
                rows = [own.decide(*memo.of(t or "")) for t in texts]
                yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    found = free_name(docs, "_found")
    return (
        docs.withColumn(found, predict(F.col(text)))
        .withColumns({lang_pred: F.col(f"{found}.lang_pred"), score: F.col(f"{found}.score")})
        .drop(found)
    )
