"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from huestrata.llm import catalog, runs
from tests.llm.helpers import LARGER, SMALL, documents, odd_texts, table


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words, least_words=6, repeats=4):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least_words, repeats * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The query's row for a document, from its contract."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{l},{q}\n" for s, l, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_equals_a_plain_search_on_random_words():
    rng, seen = random.Random(5), 0
    for _ in range(4000):
        n, letters = rng.randrange(70), "abcde"[: rng.choice([1, 2, 2, 3, 5])]
        words = [rng.choice(letters) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            start, q = rng.randrange(n), rng.randrange(1, 10)
            for i in range(start + q, min(n, start + q * rng.randrange(2, 8) + rng.randrange(q))):
                words[i] = words[i - q]
        expected = plain_runs(words)
        seen += len(expected)
        assert runs.find_runs(words) == expected
    assert seen > 1000


@pytest.mark.parametrize(("least_words", "repeats"), [(1, 4), (12, 4), (6, 5), (20, 7)])
def test_other_lengths_and_repeats(least_words, repeats):
    rng = random.Random(repeats)
    for _ in range(800):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        assert runs.find_runs(words, least_words, repeats) == plain_runs(words, least_words, repeats)


def test_fewer_repeats_than_a_gram_allows_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(["a"] * 9, repeats=3)


def test_time_does_not_grow_with_the_square_of_a_frequent_word():
    """A word that fills a long text, and a line that fills it among other words."""
    began = time.time()
    assert runs.find_runs(["x"] * 200_000) == [(0, 200_000, 1)]
    line = "one line that comes back again and again".split()
    words = [w for i in range(20_000) for w in [*line, f"w{i}"]]
    assert runs.find_runs(words) == []
    nested = (["a"] * 100 + ["b"]) * 1000
    assert len(runs.find_runs(nested)) == 1001
    assert time.time() - began < 30


def test_query_equals_the_plain_version(spark):
    for folder in (SMALL, LARGER):
        got = {tuple(r) for r in catalog.QUERIES["op11_runs"](spark, folder).collect()}
        short = table(spark, "documents", folder).filter(F.length("text") < 4000).select("doc_id", "text")
        rows = short.unionByName(table(spark, "documents", folder).filter("text IS NULL").select("doc_id", "text"))
        expected = {plain_row(r["doc_id"], r["text"]) for r in rows.collect()}
        assert len(expected) > 100 and expected <= got
        assert len(got) == table(spark, "documents", folder).count()


def test_odd_texts_and_planted_repeats(spark, tmp_path):
    texts = [*odd_texts(), "a b " * 30, "\x1c x" * 9, "  　 " * 9]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["op11_runs"](spark, str(tmp_path)).collect()}
    assert got == {plain_row(i, t) for i, t in enumerate(texts)}


def test_nulls_clashes_repeats_and_no_rows(spark):
    rows = [(None, "a a a a a a", 1, "x"), (None, "a a a a a a", 1, "x"), (2, None, 2, "y"), (3, " \t\n", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _runs int, runs string")
    got = [tuple(r) for r in runs.with_runs(docs).orderBy("doc_id").collect()]
    found = [(0, 6, 1)]
    assert got == [
        (None, "a a a a a a", 1, found, "a", 6), (None, "a a a a a a", 1, found, "a", 6),
        (2, None, 2, [], "", 0), (3, " \t\n", 3, [], "", 0),
    ]
    assert runs.with_runs(docs.limit(0)).count() == 0
    assert catalog.planted(docs).filter("doc_id IS NULL").first()["text"] == "a a a a a a"
