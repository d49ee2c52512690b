"""Small inputs for the training-data operators."""

import random

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "s", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def odd_texts(seed=3):
    """Empty, long, repeated and awkward texts."""
    rng = random.Random(seed)
    letters = "abcdefgh  \n\t'sTt réeuÉß<|>endoftext0123é́ 　\x1c漢字🙂.,!?-"
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    fixed = [
        None, "", " ", "  \n  ", "a" * 5000, "ab " * 4000, "x  <|endoftext|> y<|endoftext|>", "it's WE'LL don't",
        "ΑΣ Σας İstanbul ﬁn Å", "tab\tsep\r\nline", "\x1c a\x85b", "same text here", "same text here",
    ]
    return fixed + mixed
