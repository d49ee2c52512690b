"""Classifiers: what they must decide, and accuracy on rows they have not learned from."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from huestrata.llm import catalog, language, quality, toxicity
from huestrata.llm.common import draw, held_out, labelled_sample, logistic, text_fold
from tests.llm.helpers import LARGER, LARGEST, documents, table


def test_held_out_follows_the_id(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert documents(spark, ["x"], [None]).select(held_out().alias("h")).first().h is False


def test_draw_is_the_same_for_any_partitioning(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') AS label")
    one, many = (draw(df.repartition(n), "id", "label", 300) for n in (1, 7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    assert 230 < counts["a"] < 370 and 230 < counts["b"] < 370
    assert draw(df.filter("false"), "id", "label", 3).collect() == []


def test_known_words_come_first_then_the_longest_ngrams():
    words = {"chat": np.array([-1.0, -9.0])}
    grams = {" cha": np.array([-5.0, -2.0]), "t": np.array([-3.0, -4.0])}
    model = language.LanguageModel.of(["en", "fr"], words, grams)
    assert model.word("chat").tolist() == [-1, -9]
    assert model.word("chap").tolist() == [-5, -2]  # four characters beat one
    assert model.word("tt").tolist() == [-3, -4]
    assert model.word("zzz").tolist() == [0, 0]


def test_language_decisions(spark):
    texts = ["the cat and the dog", "le chat et le chien", "", None, "12 34 !!", "the THE the", "x" * 20_000]
    train = documents(spark, ["the cat and the dog sat"] * 4 + ["le chat et le chien est"] * 4)
    train = train.withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise("fr"))
    model = language.train(train)
    docs = documents(spark, texts).withColumn("lang_pred", F.lit("clash")).withColumn("_found", F.lit(1))
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["en", "fr", "und", "und", "und", "en"]
    assert rows[0].score > 0.9 and rows[2].score == 0 and 0 <= rows[6].score <= 1
    assert rows[0]._found == 1


def test_language_without_training_rows(spark):
    docs = documents(spark, ["some text", None])
    model = language.train(docs)  # no row has a language
    assert {(r.lang_pred, r.score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    assert language.identify(docs.filter("false"), model).collect() == []


def test_language_on_held_out_rows(spark):
    rows = catalog.op10_language(spark, LARGER).join(table(spark, "documents", LARGER), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def ranking(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels) if y == v] for v in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_on_held_out_rows(spark):
    """On the largest scale: the smaller ones hold out a dozen bad texts only."""
    rows = catalog.op6_quality(spark, LARGEST).join(table(spark, "labels", LARGEST), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert ranking([r.score for r in held], [r.quality for r in held]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_sees_whole_texts_and_awkward_ones(spark):
    model = catalog.quality_model(spark, LARGER)
    clean = table(spark, "documents", LARGER).orderBy("doc_id").first().text
    docs = documents(spark, [None, "", clean, clean + " $$$ ### &&& %%%" * 3000, clean]).withColumn("score", F.lit("x"))
    s = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert s[0] == s[1] and s[2] == s[4] and s[3] != s[2]
    assert all(math.isfinite(x) and 0 <= x <= 1 for x in s.values())


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(i, 1) for i in range(9)], 1.0), ([(i, 0) for i in range(9)], 0.0)])
def test_quality_with_too_few_labels(spark, labels, want):
    docs = documents(spark, [f"text number {i}" for i in range(9)])
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in quality.score_quality(docs, model).collect()] == pytest.approx([want] * 9, abs=1e-9)


def test_toxicity_on_held_out_rows(spark):
    rows = catalog.op1_toxicity(spark, LARGER).join(
        table(spark, "labels", LARGER).withColumnRenamed("toxic", "label"), "doc_id"
    ).collect()
    held = [r for r in rows if r.held_out]
    assert ranking([r.score for r in held], [r.label for r in held]) > 0.9
    assert np.mean([r.toxic for r in held if not r.label]) < 0.03


def test_later_categories_see_earlier_ones(spark):
    """The second label follows the first one; only the chain's input can tell it in texts without its own word."""
    rng = np.random.default_rng(0)
    texts, rows = [], []
    for i in range(400):
        a = int(rng.random() < 0.5)
        texts.append(" ".join(["plain"] * 3 + (["nasty"] if a else []) + [f"w{rng.integers(50)}"]))
        rows.append((i, a, a))
    labels = spark.createDataFrame(rows, "doc_id long, first int, second int")
    docs = documents(spark, texts)
    model = toxicity.train(docs, labels, ["first", "second"])
    assert model.categories == ["first", "second"]
    assert len(model.weights[1]) == len(model.weights[0]) + 1  # one more input: the first probability
    assert model.weights[1][-2] > 0.5
    scored = toxicity.score_chain(documents(spark, ["a nasty thing", "a plain thing", None, ""]), model)
    p = {r.doc_id: (r.p_first, r.p_second) for r in scored.collect()}
    assert min(p[0]) > 0.7 and max(p[1]) < 0.3 and p[2] == p[3]


def test_toxicity_with_one_value_and_no_rows(spark):
    docs = documents(spark, ["one", "two"])
    one = toxicity.train(docs, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int"), ["toxic"])
    assert all(r.p_toxic < 1e-9 for r in toxicity.score_chain(docs, one).collect())
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"])
    assert all(r.p_toxic < 1e-9 for r in toxicity.score_chain(docs, none).collect())
    assert toxicity.score_chain(docs.filter("false"), one).collect() == []


def test_a_repeated_word_does_not_add_up(spark):
    model = toxicity.ChainModel(["t"], {"bad": 0}, [np.array([1.0, -2.0])])
    rows = toxicity.score_chain(documents(spark, ["bad", "bad " * 1000, "Bad, bad!"]), model).collect()
    assert len({r.p_t for r in rows}) == 1


def test_logistic_finds_the_weights():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert logistic(x, y, 1e-6) == pytest.approx([2, -1, 0.5], abs=0.2)


def test_language_lists_hold_whole_levels_of_counts(spark):
    """Of the counts that occur, the highest go into a list as long as it stays within its bound."""
    texts = ["aa " * 9 + "bb " * 5 + "cc dd ee", "aa " * 9 + "bb " * 5 + "ff " * 2]
    docs = documents(spark, texts).withColumn("lang", F.lit("x"))
    for words, want in ((1, {"aa"}), (2, {"aa", "bb"}), (3, {"aa", "bb", "ff"}), (5, {"aa", "bb", "ff"}), (6, {"aa", "bb", "ff", "cc", "dd", "ee"})):
        assert set(language.train(docs, words=words).words) == want
    long = documents(spark, ["y" * 49 + " zz zz"]).withColumn("lang", F.lit("x"))
    assert set(language.train(long).words) == {"zz"}


def test_language_scores_equal_a_plain_recomputation(spark):
    """Every row of the query again, from the counts of the drawn documents in plain Python."""
    from collections import Counter

    docs = table(spark, "documents", LARGER).select("doc_id", "text", "lang")
    drawn = draw(docs.filter(~held_out()), "doc_id", "lang", language.SAMPLE_ROWS).collect()
    counts = {}
    for r in drawn:
        for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()):
            counts.setdefault(r["lang"], Counter())[w] += 1
    languages = sorted(counts)
    tables, totals = {}, {}
    for lang, of in counts.items():
        sized = {0: Counter({w: n for w, n in of.items() if len(w) <= language.WORD_LETTERS})}
        for w, n in of.items():
            fenced = f" {w} "
            for size in language.LENGTHS:
                for i in range(len(fenced) - size + 1):
                    sized.setdefault(size, Counter())[fenced[i : i + size]] += n
        for size, terms in sized.items():
            totals[lang, size] = sum(terms.values())
            most, kept = language.WORDS if size == 0 else language.GRAMS, {}
            for level in sorted(set(terms.values()), reverse=True):
                of_level = {t: n for t, n in terms.items() if n == level}
                if len(kept) + len(of_level) > most:
                    break
                kept |= of_level
            for t, n in kept.items():
                tables.setdefault(size, {}).setdefault(t, {})[lang] = n

    def log_rows(size, term):
        spread = language.SMOOTHING * (len(tables[size]) + 1)
        row = tables[size][term]
        return [math.log(row.get(x, 0) + language.SMOOTHING) - math.log(totals.get((x, size), 0) + spread) for x in languages]

    def word_rows(word):
        if word in tables[0]:
            return log_rows(0, word)
        for size in language.LENGTHS:
            fenced = f" {word} "
            found = [log_rows(size, g) for i in range(len(fenced) - size + 1) if (g := fenced[i : i + size]) in tables.get(size, {})]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(languages)

    rows = {r["doc_id"]: r for r in catalog.QUERIES["op10_language"](spark, LARGER).collect()}
    checked = 0
    for r in docs.collect()[::9]:
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not words:
            assert (rows[r["doc_id"]]["lang_pred"], rows[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        sums = [sum(x) for x in zip(*map(word_rows, words))]
        mean = [x / len(words) * min(len(words), language.EVIDENCE) for x in sums]
        odds = [math.exp(x - max(mean)) for x in mean]
        assert rows[r["doc_id"]]["lang_pred"] == languages[odds.index(max(odds))]
        assert abs(rows[r["doc_id"]]["score"] - max(odds) / sum(odds)) < 1e-4
        checked += 1
    assert checked > 60


def test_quality_scores_equal_a_plain_recomputation(spark):
    """Every row of the query again: two compressions, one line, one logistic curve."""
    model = catalog.quality_model(spark, LARGER)
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op6_quality"](spark, LARGER).collect()}
    docs = table(spark, "documents", LARGER).collect()
    assert len(rows) == len(docs)
    packers = []
    for content in (model.good, model.bad):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=made))
    for r in docs:
        raw = (r["text"] or "").encode()
        good, bad = (len(p.compress(raw)) for p in packers)
        odds = model.slope * (bad - good) / (len(raw) + 1) + model.intercept
        want = 1 / (1 + math.exp(-odds))
        got = rows[r["doc_id"]]
        assert abs(got["score"] - want) < 1e-9 and got["predicted"] == (got["score"] >= 0.5)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert 0 < len(model.good) <= quality.DICTIONARY_BYTES and 0 < len(model.bad) <= quality.DICTIONARY_BYTES


def test_toxicity_scores_equal_a_plain_recomputation(spark):
    model = catalog.toxicity_model(spark, LARGER)
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op1_toxicity"](spark, LARGER).collect()}
    n = len(model.terms)
    for r in table(spark, "documents", LARGER).collect():
        words = set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
        words |= {w[:k] + "*" for w in words for k in toxicity.STEMS if len(w) > k}
        fed, want = [], []
        for weights, shift in zip(model.weights, model.shifts):
            x = sum(w for t, w in zip(model.terms, weights) if t in words)
            x += sum(a * b for a, b in zip(weights[n:-1], fed)) + weights[-1]
            fed.append(1 / (1 + math.exp(-x)))
            want.append(1 / (1 + math.exp(-(x + shift))))
        got = rows[r["doc_id"]]
        assert [got["p_junk"], got["p_toxic"]] == pytest.approx(want, abs=1e-9)
        assert got["score"] == got["p_toxic"] and got["toxic"] == (got["score"] >= catalog.TOXIC_FROM)


def test_out_of_fold_models_have_not_seen_the_fold_nor_equal_texts(spark, monkeypatch):
    texts = [f"word{i % 40} other{i % 7}" for i in range(120)]  # each text several times
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(120)], "doc_id long, a int, b int")
    seen = []
    real = toxicity._Sample.telling

    def telling(self, rows, y):
        seen.append((rows, self.fold))
        return real(self, rows, y)

    monkeypatch.setattr(toxicity._Sample, "telling", telling)
    model = toxicity.train(documents(spark, texts), labels, ["a", "b"])
    whole = [rows.all() for rows, _ in seen]
    assert whole.count(True) == 2 and len(seen) > 6
    for rows, fold in seen:
        left_out = set(fold[~rows])
        assert rows.all() or (len(left_out) == 1 and not left_out & set(fold[rows]))
    assert (text_fold(["x", "y", "x"], 5)[[0, 2]] == text_fold(["x"], 5)).all()
    assert len(model.shifts) == 2


def test_probabilities_are_set_back_to_the_share_of_all_labels(spark):
    """One text in twenty is toxic for no reason the words give: a plain text gets about that probability."""
    texts = [f"same words {i % 3}" for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 20 == 7)) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, texts), labels, ["toxic"], sample_rows=80)
    (score,) = (r.p_toxic for r in toxicity.score_chain(documents(spark, ["unknown"]), model).collect())
    assert 0.02 < score < 0.12


def test_long_texts_are_learned_from_by_a_piece_from_anywhere(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(500)) for _ in range(40)] + ["short"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    rows = labelled_sample(documents(spark, texts), labels, ["quality"], draw_by="quality", per_label=100, most_chars=60)
    assert len(rows) == 41
    pieces = [t for t in rows["text"] if t != "short"]
    assert {len(t) for t in pieces} == {60}
    places = [next(at for at in range(441) if any(t == x[at : at + 60] for x in texts)) for t in pieces]
    assert len(set(places)) > 5


@pytest.mark.parametrize("rows", ["repeated", "clashing", "empty"])
def test_classifiers_on_repeated_clashing_and_no_rows(spark, rows):
    texts = [f"good text number {i} about things" for i in range(30)] + [f"junk $$$ {i} nasty" for i in range(30)]
    labels = spark.createDataFrame([(i, int(i < 30), int(i >= 30)) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    models = [quality.train(docs, labels), toxicity.train(docs, labels, ["toxic"])]
    if rows == "repeated":
        twice = docs.unionByName(docs)
        again = [quality.train(twice, labels), toxicity.train(twice, labels, ["toxic"])]
        for model in (models, again):
            good = {r.doc_id: r.score for r in quality.score_quality(docs, model[0]).collect()}
            toxic = {r.doc_id: r.p_toxic for r in toxicity.score_chain(twice, model[1]).collect()}
            assert min(good[i] for i in range(30)) > max(good[i] for i in range(30, 60))
            assert min(toxic[i] for i in range(30, 60)) > max(toxic[i] for i in range(30))
        return
    docs = docs.withColumns({"_score": F.lit(1), "_chain": F.lit(2), "p_toxic": F.lit("x"), "score": F.lit("y")})
    docs = docs.limit(0) if rows == "empty" else docs.withColumn("text", F.concat("text", F.lit(" a" * 50_000)))
    good, toxic = quality.score_quality(docs, models[0]), toxicity.score_chain(docs, models[1])
    assert good.columns == docs.columns and toxic.columns == docs.columns
    assert good.count() == toxic.count() == docs.count()
    assert good.filter("_score <> 1 OR _chain <> 2 OR p_toxic <> 'x'").count() == 0
    assert toxic.filter("_score <> 1 OR _chain <> 2 OR score <> 'y'").count() == 0
