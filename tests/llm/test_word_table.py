"""The distinct-word table against the tokenizers library, whole texts."""

import hashlib
import json
import struct

import pytest
from tokenizers import Tokenizer

from huestrata.llm import catalog, word_table
from tests.llm.helpers import SMALL, documents, odd_texts, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(catalog.WORD_TOKENIZER)


def packed(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)


AWKWARD = [
    "a<|endoftext|>b <|startoftext|><|endoftext|> c", "<|endoftext|", "<|ENDOFTEXT|>", "don't WE'LL 's", "é é É", "漢字かな交じり",
    "ãģģ あぁ", "\x00 nul \x00", "tab\tnew\nline\r\n", "½ ² ١٢٣ 12345", "x" * 30_000, "   ", "ﬁ ﬀ Å K", "İ I ı",
]


def test_odd_texts_equal_the_library(spark, library):
    texts = odd_texts() + AWKWARD
    got = word_table.encode(documents(spark, texts), catalog.WORD_TOKENIZER).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["ids"], r["decoded"]) == packed(library, texts[r["doc_id"]])


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["op12_word_bpe"](spark, SMALL).collect()}
    rows = table(spark, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, text = packed(library, r["text"])
        digests = [hashlib.sha256(x).hexdigest() for x in (ids, text.encode())]
        assert got[r["doc_id"]] == (len(ids) // 4, *digests)


def test_many_blocks_and_slots(spark, library, monkeypatch):
    """Small blocks and slots: each word still gets its ids from one slot, for all blocks."""
    monkeypatch.setattr(word_table, "SLOT_WORDS", 50)
    docs = table(spark, "documents").repartition(7)
    got = {r["doc_id"]: r["ids"] for r in word_table.encode(docs, catalog.WORD_TOKENIZER).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: packed(library, t)[0] for i, t in texts.items()}


def test_a_block_ends_when_it_is_full(monkeypatch):
    monkeypatch.setattr(word_table, "BLOCK_CHARS", 10)
    block = word_table._Block(word_table._words(catalog.WORD_TOKENIZER))
    block.add(1, "four")
    assert not block.full
    block.add(2, "longer than ten")
    assert block.full


def test_a_word_of_a_slot_is_encoded_once(spark, monkeypatch):
    import pyarrow as pa

    calls = []

    class Counted:
        def encode(self, word):
            calls.append(word)
            return [len(word)]

    monkeypatch.setattr(word_table, "_words", lambda path: Counted())
    rows = pa.table({
        "block": ["a", "b"], "slot": [0, 0], "places": [b"", b""],
        "words": [word_table._pack_words(["the", "x"]), word_table._pack_words(["the", "yy"])],
    })

    class Grouped:
        def groupBy(self, name):
            return self

        def applyInArrow(self, work, schema):
            return work(rows)

    out = word_table._answers(Grouped(), "any")
    assert sorted(calls) == ["the", "x", "yy"]
    assert [word_table._unpack(x.as_py()).tolist() for x in out.column("ids")] == [[3, 1], [3, 2]]


def test_nulls_repeats_text_keys_clashes_and_no_rows(spark, library):
    rows = [(None, "a b", 1), ("k", None, 2), ("k", "a b", 3), ("k", "a b", 3), ("e", "", 4)]
    docs = spark.createDataFrame(rows, "name string, text string, ids int").withColumnRenamed("name", "decoded_key")
    got = word_table.encode(docs, catalog.WORD_TOKENIZER, key="decoded_key").collect()
    expected = [(k, *packed(library, t)) for k, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert word_table.encode(docs.limit(0), catalog.WORD_TOKENIZER, key="decoded_key").count() == 0
    empty = docs.filter("decoded_key = 'e'")
    assert [tuple(r) for r in word_table.encode(empty, catalog.WORD_TOKENIZER, key="decoded_key").collect()] == [("e", b"", "")]


def test_decode_of_packed_ids(spark, library):
    ids, text = packed(library, "Hello, decoded WORLD <|endoftext|>")
    unknown = struct.pack("<2I", 4_000_000_000, 320)
    rows = spark.createDataFrame([(1, ids, 0), (2, None, 0), (3, unknown, 0), (4, b"", 0)], "k int, ids binary, decoded int")
    got = {r["k"]: r["decoded"] for r in word_table.decode(rows, catalog.WORD_TOKENIZER).collect()}
    assert got == {1: text, 2: None, 3: library.decode([320], skip_special_tokens=False), 4: ""}


def test_tokenizers_it_would_get_wrong_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        word_table.encode(documents(spark, ["a"]), catalog.BYTE_TOKENIZER)
    with open(catalog.WORD_TOKENIZER, encoding="utf-8") as file:
        made = json.load(file)
    made["added_tokens"][0]["lstrip"] = True
    own = tmp_path / "own.json"
    own.write_text(json.dumps(made), encoding="utf-8")
    with pytest.raises(ValueError):
        word_table.Words(str(own))
