"""BPE encoding and decoding through a table of distinct words.

1. Tasks split texts into words. A block of texts becomes its distinct words and,
   for every text, the places of its words among them.
2. The distinct words of all blocks are dealt by a hash to slots, and a slot
   encodes each word once. A frequent word comes to its slot once from each block.
3. The ids return to the blocks, a join by position puts them in the place of the
   words, and a join with the id-to-piece table decodes them.

Only whole blocks cross the network, in compressed columns. The blocks are a
table in the shared folder, so a lost executor costs a reread.
"""

from __future__ import annotations

import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huestrata.llm.common import keep_one, stored, task_memory

#: Characters and texts of a block, about; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_TEXTS = 32_000_000, 200_000

#: Words of all blocks that meet in a slot, about.
SLOT_WORDS = 300_000

#: Blocks that a task of the last step puts together.
TASK_BLOCKS = 1

#: Texts taken out of an Arrow batch, and put into one, at a time.
_TEXTS = 256

#: Mark of a word that is in the model's alphabet already.
_MAPPED = "\0"

#: Texts of ASCII and precomposed Latin letters alone: normal form C and lower case keep them so.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")

#: How a lower-casing splitter that drops white space cuts such texts.
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\\[-`{-~]+")


class Words:
    """Splits texts as a tokenizer of the tokenizers library does before its model, and encodes single words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that strip, are normalised or stand alone are not supported")
        self.special = {t.content: i for i, t in added.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        probe = "It's 42 ÉaÎß-cd!?\n'Re"
        plain = [w for word in _PLAIN_WORDS.findall(probe.lower()) for w in self._mapped(word)]
        self.plain = self._mapped(probe) == plain

    def _mapped(self, text: str) -> list[str]:
        normalizer, splitter = self.library.normalizer, self.library.pre_tokenizer
        normal = normalizer.normalize_str(text) if normalizer else text
        return [w for w, _ in splitter.pre_tokenize_str(normal)] if splitter else [normal]

    def split(self, text: str) -> list[str]:
        """Words of a text; ``mapped`` gives the model's form of each."""
        if self.plain and _PLAIN.fullmatch(text) and not (self.cut and self.cut.search(text)):
            return _PLAIN_WORDS.findall(text.lower())
        words = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                words.append(_MAPPED + part)
            elif part:
                words += [_MAPPED + w for w in self._mapped(part)]
        return words

    def mapped(self, word: str) -> str:
        if word[0] == _MAPPED:
            return word[1:]
        return word if word.isascii() else self._mapped(word)[0]

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.library.model.tokenize(word)]


def _words(path: str) -> Words:
    """The splitter and encoder of a tokenizer, loaded once in a worker."""
    return keep_one(("words", path), lambda: Words(path))


class _Places(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, all lowest bytes first, so that equal bytes lie together."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], np.uint32)
    return zstandard.compress(len(raw).to_bytes(4, "little") + lengths.tobytes() + b"".join(raw), 3)


def _unpack_words(packed: bytes) -> list[str]:
    raw = zstandard.decompress(packed)
    count = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64) + 4 + 4 * count
    starts = np.append(4 + 4 * count, ends)[:count]
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


class _Block:
    """Texts taken in so far, as places of words."""

    def __init__(self, own: Words):
        self.own, self.places = own, _Places()
        self.keys: list = []
        self.parts: list[np.ndarray] = []
        self.chars = 0

    def add(self, key, text: str) -> None:
        words = self.own.split(text)
        self.keys.append(key)
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.keys) >= BLOCK_TEXTS

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        """The block as one row. Frequent words get small numbers."""
        units = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(units, minlength=len(self.places)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = list(self.places)
        mapped = [self.own.mapped(words[i]) for i in order.tolist()]
        values = {
            "block": uuid.uuid4().hex,
            "keys": self.keys,
            "lengths": _pack(np.array([len(p) for p in self.parts], np.uint32)),
            "units": _pack(rank[units]),
            "words": _pack_words(mapped),
            "n_words": len(mapped),
        }
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


def _split(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType
    fields = [("block", T.StringType()), ("keys", T.ArrayType(kind)), ("lengths", T.BinaryType()),
              ("units", T.BinaryType()), ("words", T.BinaryType()), ("n_words", T.LongType())]
    schema = T.StructType([T.StructField(name, t) for name, t in fields])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory(keeps=True):
            own, block, arrow = _words(tokenizer), None, None
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                if arrow is None:
                    plain = {"block": pa.string(), "n_words": pa.int64(), "keys": pa.list_(keys.type)}
                    arrow = pa.schema([(name, plain.get(name, pa.binary())) for name, _ in fields])
                for start in range(0, len(keys), _TEXTS):
                    for k, t in zip(keys.slice(start, _TEXTS).to_pylist(), texts.slice(start, _TEXTS).to_pylist()):
                        block = block or _Block(own)
                        block.add(k, t)
                        if block.full:
                            yield block.row(arrow)
                            block = None
            if block:
                yield block.row(arrow)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit(""))).mapInArrow(blocks, schema)


def _packets(blocks: DataFrame, slots: int) -> DataFrame:
    """``block, slot, places, words``: the distinct words of every block, by slot."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _unpack_words(packed)
                slot = np.fromiter((zlib.crc32(w.encode()) % slots for w in words), np.int64, len(words))
                order = np.argsort(slot, kind="stable")
                cuts = np.flatnonzero(np.diff(slot[order], prepend=-1))
                rows = []
                for own in np.split(order, cuts[1:]) if len(words) else []:
                    # Alphabetical order packs better.
                    places = sorted(own.tolist(), key=words.__getitem__)
                    rows.append((int(slot[own[0]]), _pack(np.array(places)), _pack_words([words[i] for i in places])))
                if rows:
                    slot_of, places, texts = zip(*rows)
                    columns = [pa.array([block] * len(rows)), pa.array(slot_of, pa.int32()), pa.array(places), pa.array(texts)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "slot", "places", "words"])

    return blocks.select("block", "words").mapInArrow(dealt, "block string, slot int, places binary, words binary")


def _answers(packets: DataFrame, tokenizer: str) -> DataFrame:
    """``block, places, counts, ids``: every distinct word of a slot is encoded once."""

    def encoded(table: pa.Table) -> pa.Table:
        own, known = _words(tokenizer), {}
        counts, ids = [], []
        for packed in table.column("words"):
            found = []
            for word in _unpack_words(packed.as_py()):
                if word not in known:
                    known[word] = own.encode(word)
                found.append(known[word])
            counts.append(_pack(np.array([len(x) for x in found], np.uint32)))
            ids.append(_pack(np.array([i for x in found for i in x], np.uint32)))
        columns = [table.column("block"), table.column("places"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "places", "counts", "ids"])

    return packets.groupBy("slot").applyInArrow(encoded, "block string, places binary, counts binary, ids binary")


def pieces(tokenizer: str) -> dict[int, str]:
    """The id-to-piece table, special tokens included. It is as large as the vocabulary, whatever the corpus."""
    from tokenizers import Tokenizer

    return {i: piece for piece, i in Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).items()}


def _joins_by_space(tokenizer: str) -> None:
    with open(tokenizer, encoding="utf-8") as file:
        if json.load(file).get("decoder") is not None:
            raise ValueError("tokenizers with a decoder of their own are not supported")


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded`` for every row of ``docs``.

    ``ids`` are those of the tokenizers library without special tokens added, as
    little-endian unsigned 32-bit integers; special strings inside a text are
    the special tokens, as there. ``decoded`` is the library's decoding of them
    with special tokens kept, for a tokenizer without a decoder: the pieces
    joined by spaces.

    A null text counts as empty; empty texts have no ids and decode to the empty
    text. A null key and repeated keys and rows stay as they are, a result for
    each row. A text longer than a block is a block of its own, and memory grows
    with it. Columns other than ``key`` are not returned, so none can clash. An
    empty table gives no rows.
    """
    _joins_by_space(tokenizer)
    blocks = stored(_split(docs, tokenizer, key, text))
    n_blocks, n_words = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    slots = max(1, math.ceil(n_words / SLOT_WORDS))
    back = _answers(_packets(blocks, slots), tokenizer).groupBy("block").agg(
        F.collect_list(F.struct("places", "counts", "ids")).alias("answers")
    )
    # The answers of a block are as many as its slots. Blocks of empty texts have none.
    tasks = max(1, math.ceil(n_blocks / TASK_BLOCKS))
    both = blocks.drop("words").repartition(tasks, "block").join(back, "block", "left")
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )
    piece_of = docs.sparkSession.sparkContext.broadcast(pieces(tokenizer))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, lengths, units, n_words, answers = (batch.column(c)[row] for c in range(5))
                yield from _texts(keys.values, lengths.as_py(), units.as_py(), n_words.as_py(), answers, piece_of.value, key)

    return both.select("keys", "lengths", "units", "n_words", "answers").mapInArrow(joined, schema)


def _texts(keys, lengths, units, n_words, answers, piece_of, key) -> Iterator[pa.RecordBatch]:
    """The texts of a block, put together word by word."""
    ids_of: list[bytes] = [b""] * n_words
    text_of: list[str] = [""] * n_words
    for answer in answers.values or [] if answers.is_valid else []:
        places, counts, ids = (_unpack(answer[c].as_py()) for c in ("places", "counts", "ids"))
        raw, pieces_ = ids.astype("<u4").tobytes(), decode_ids(ids, piece_of)
        ends = np.cumsum(counts, dtype=np.int64).tolist()
        start = 0
        for place, end in zip(places.tolist(), ends):
            ids_of[place], text_of[place] = raw[4 * start : 4 * end], " ".join(pieces_[start:end])
            start = end
    all_units, ends = _unpack(units), np.cumsum(_unpack(lengths), dtype=np.int64)
    starts = np.append(0, ends)
    for at in range(0, len(ends), _TEXTS):
        ids, decoded = [], []
        for a, b in zip(starts[at : at + _TEXTS].tolist(), ends[at : at + _TEXTS].tolist()):
            own = all_units[a:b].tolist()
            ids.append(b"".join(map(ids_of.__getitem__, own)))
            decoded.append(" ".join(filter(None, map(text_of.__getitem__, own))))
        columns = [keys.slice(at, _TEXTS), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"])


def decode_ids(ids: np.ndarray, piece_of: dict[int, str]) -> list[str]:
    """Pieces of ids by a join with the id-to-piece table; an id that is not in it has none, as in the library."""
    return [piece_of[i] for i in ids.tolist() if i in piece_of]


def decode(encoded: DataFrame, tokenizer: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ids, as the library decodes them with special tokens kept.

    Null ids give a null text. An existing column ``decoded`` is replaced.
    """
    _joins_by_space(tokenizer)
    piece_of = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else " ".join(decode_ids(np.frombuffer(x, "<u4"), piece_of.value)))

    return encoded.withColumn(decoded, texts(F.col(ids)))
