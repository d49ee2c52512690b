"""Encoding, counting and packing against the libraries, on whole texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from huestrata.llm import bpe, catalog, packing, token_cache
from huestrata.llm.chunks import pieces
from huestrata.llm.wordwise import WordEncoder
from tests.llm.helpers import SMALL, documents, odd_texts, table


@pytest.fixture(scope="module")
def reference():
    with open(catalog.BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def texts_of(spark):
    return odd_texts() + [r.text for r in table(spark, "documents").select("text").collect()]


def test_pieces_give_the_text_back():
    for text in odd_texts()[1:]:
        assert " ".join(pieces(text)) == text


@pytest.mark.parametrize("long", [64, 3, 10_000])
def test_replay_equals_the_library(spark, reference, monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG_WORD", long)
    rng = random.Random(long)
    words = ["", " the", "aaaaaaa", "abababab", "élève", "🙂🙂", " internationalization", "\n\n\n", "x" * 300]
    words += ["".join(rng.choice("abcest in\u00e9") for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    words += ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.replay([w.encode() for w in words], catalog.BYTE_RANKS)]
    assert got == [reference._core_bpe.encode_single_piece(w.encode()) if w else [] for w in words]
    assert bpe.replay([], catalog.BYTE_RANKS) == []


def test_encode_and_decode_whole_texts(spark, reference):
    texts = texts_of(spark)
    docs = documents(spark, texts).repartition(5)
    encoded = bpe.encode(docs.withColumn("ids", F.lit("clash")), catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    rows = encoded.withColumn("raw", bpe.decode(catalog.BYTE_RANKS)("ids")).collect()
    assert encoded.columns == [*docs.columns, "ids"] and len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(row.raw) == text.encode()


def test_small_blocks_and_a_short_memory(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    own = bpe.BlockEncoder(catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for t in odd_texts()]
    for size in (1, 3, 50):
        for i in range(0, len(texts), size):
            part = texts[i : i + size]
            got = [np.frombuffer(x, "<u4").tolist() for x in own.texts(part)]
            assert got == [reference.encode_ordinary(t) for t in part]


def test_blocks_cut_within_a_batch(spark, reference, monkeypatch):
    for chars in (1, 100, 10**7):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
        texts = odd_texts()[:40]
        got = bpe.encode(documents(spark, texts), catalog.BYTE_RANKS, public_tokenizers.PATTERN).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {
            i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)
        }


def test_op4_digests(spark, reference):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in catalog.op4_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("path", [catalog.BYTE_TOKENIZER, catalog.WORD_TOKENIZER])
def test_word_encoder_equals_the_library(spark, path):
    own, library = WordEncoder(path), Tokenizer.from_file(path)
    extra = [f"{chr(c)}A{chr(c)}'s {chr(c)}" for c in range(1, 0x2C0)] + ["a×b µªº ſŸŉ", "''s 's'S", "a < b <|x|>"]
    for text in [t or "" for t in texts_of(spark)] + extra:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.text(text), "<u4").tolist() == ids and own.count(text) == len(ids)


def test_counts_by_cache(spark, tmp_path):
    texts = odd_texts()
    cache = str(tmp_path / "cache")
    docs = documents(spark, texts + texts[:20], list(range(len(texts))) + [None] * 20)
    library = Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts + texts[:20])
    first = token_cache.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), cache, catalog.BYTE_TOKENIZER)
    assert sorted(r.n_tokens for r in first.collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    # A second run finds all digests, and only new texts are appended.
    again = token_cache.count_tokens(docs.union(documents(spark, ["brand new"])), cache, catalog.BYTE_TOKENIZER)
    assert len(again.collect()) == len(want) + 1
    assert spark.read.parquet(cache).count() == stored + 1


def test_counts_come_from_the_cache_of_this_tokenizer(spark, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_cache.tokenizer_digest(catalog.BYTE_TOKENIZER)
    digest = hashlib.sha256(b"hello there").digest()
    rows = [(digest, version, 77), (digest, "another version", 5), (digest, version, 77)]
    spark.createDataFrame(rows, token_cache.CACHE_SCHEMA).write.parquet(cache)
    got = token_cache.count_tokens(documents(spark, ["hello there"]), cache, catalog.BYTE_TOKENIZER).collect()
    assert [r.n_tokens for r in got] == [77]


def check_packing(rows, ids_of):
    """Every id in exactly one piece, sequences gapless, none over the capacity; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        place = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids_of[doc])
            raw = np.array(ids_of[doc][place : place + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            place += r.length
        assert place == len(ids_of[doc])
    padding = 0
    for parts in by_sequence.values():
        place = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == place and r.length > 0
            place += r.length
        assert place <= packing.CAPACITY
        padding += 0 if place & (place - 1) == 0 else packing.CAPACITY - place
    return padding


def test_packing_keeps_every_id_once(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(catalog.WORD_TOKENIZER)
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = catalog.packed(documents(spark, texts).repartition(3)).collect()
    assert check_packing(rows, ids_of) == 0


def test_packing_continues_documents_in_the_next_block(spark):
    ids_of = {i: list(range(n)) for i, n in enumerate([5000, 1, 0, 2048, 4096, 77, 3000, 1])}
    docs = spark.createDataFrame(
        [(i, np.array(x, "<u4").tobytes()) for i, x in ids_of.items()] + [(99, None)], "doc_id long, ids binary"
    ).coalesce(1)
    rows = packing.pack(docs, block_sequences=2).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(rows, {i: x for i, x in ids_of.items() if x}) == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1500, 600).tolist()
    parts = packing.balance(lengths, 2048, packing.QUADRATIC)
    cost = {}
    for _, _, length, sequence, _ in parts:
        cost[sequence] = cost.get(sequence, 0) + length + packing.QUADRATIC * length * length
    full = [c for s, c in cost.items() if c > 2048]
    assert max(full) / min(full) < 1.1
    # A cut fills a sequence, so there are no more cuts than sequences.
    assert len(parts) <= len(lengths) + len(cost)


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    assert bpe.encode(none, catalog.BYTE_RANKS, public_tokenizers.PATTERN).collect() == []
    assert catalog.packed(none).collect() == []
    counted = token_cache.count_tokens(none, str(tmp_path / "c"), catalog.BYTE_TOKENIZER)
    assert counted.collect() == []


def test_counts_beside_columns_of_clashing_names(spark, tmp_path):
    docs = documents(spark, ["a b c", "a b c", None]).withColumns(
        {"_digest": F.lit("own"), "_count": F.lit(5), "content_digest": F.lit(6), "n_tokens": F.lit(-1)}
    )
    counted = token_cache.count_tokens(docs, str(tmp_path / "cache"), catalog.BYTE_TOKENIZER)
    assert counted.columns == [*[c for c in docs.columns if c != "n_tokens"], "n_tokens"]
    rows = {r["doc_id"]: r for r in counted.collect()}
    assert [rows[i]["n_tokens"] for i in range(3)] == [3, 3, 0]
    assert all((r["_digest"], r["_count"], r["content_digest"]) == ("own", 5, 6) for r in rows.values())


def test_encoding_beside_columns_of_clashing_names(spark, reference):
    """``ids`` and ``decoded`` are replaced where asked for; every other column keeps its values."""
    texts = ["clash one", None, "clash one"]
    docs = documents(spark, texts).withColumns({"_encoded": F.lit("own"), "decoded": F.lit("x"), "ids": F.lit(1)})
    plain = bpe.encode(docs, catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    assert plain.columns == docs.columns
    both = bpe.encode(docs, catalog.BYTE_RANKS, public_tokenizers.PATTERN, decoded="decoded")
    assert sorted(both.columns) == sorted(docs.columns)
    for r in plain.collect():
        assert r["_encoded"] == "own" and r["decoded"] == "x"
    for r in both.collect():
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text and r["_encoded"] == "own"


def test_packing_beside_columns_of_clashing_names(spark):
    docs = documents(spark, ["a b c", "d e f"]).withColumns(
        {c: F.lit(-1) for c in ("start", "length", "offset", "sequence_id", "doc_tokens")}
    )
    plain = sorted(map(tuple, catalog.packed(documents(spark, ["a b c", "d e f"]).coalesce(1)).collect()))
    assert sorted(map(tuple, catalog.packed(docs.coalesce(1)).collect())) == plain


def test_texts_are_packed_in_one_step(spark):
    """One Python worker for each task: no evaluation of ids beside the packing; the pieces are those of both steps."""
    docs = documents(spark, odd_texts()).repartition(3).localCheckpoint()
    plan = catalog.packed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    ids = packing.tokenize(catalog.WORD_TOKENIZER, end_id=1)("text")
    apart = packing.pack(docs.select(F.col("doc_id").alias("own"), ids.alias("ids")), doc_id="own", block_sequences=2)
    both = packing.pack_texts(docs, catalog.WORD_TOKENIZER, end_id=1, block_sequences=2)
    assert both.columns == apart.columns
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
