"""Packing of documents into sequences of equal cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.wordwise import encoder

#: Tokens of a sequence, and sequences packed together.
CAPACITY, BLOCK_SEQUENCES = 2048, 512

#: Cost of a piece of n tokens: n + QUADRATIC * n * n (12 * width parameters a token against attention).
QUADRATIC = 1 / (12 * 1024)

#: Rows taken out of an Arrow batch at a time.
_ROWS = 256

#: Bits of a sequence id below the number of the task's partition.
PARTITION_SHIFT = 36


def tokenize(tokenizer: str, end_id: int):
    """Arrow function from texts to packed ids (little-endian unsigned 32-bit), ``end_id`` last."""
    end = np.array([end_id], dtype="<u4").tobytes()

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with encoder(tokenizer) as own:
            for texts in batches:
                yield pd.Series([own.text(t or "") + end for t in texts], dtype=object)

    return encoded


def capacities(total: int, capacity: int) -> np.ndarray:
    """Full sequences, then one for each binary digit of the rest: their sum is ``total``."""
    rest = total % capacity
    small = [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
    return np.array([capacity] * (total // capacity) + small, dtype=np.int64)


def balance(lengths: Sequence[int], capacity: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces; every sequence ends up full.

    Whole sequences are cut from the long documents first. What is left goes in
    descending order to the cheapest sequence with room for all of it; if there
    is none, the cheapest with any room takes what it can.
    """
    room = capacities(sum(lengths), capacity)
    cost = np.zeros(len(room))
    filled = np.zeros(len(room), dtype=np.int64)
    out, rests, used = [], [], 0
    for doc, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            out.append((doc, start, capacity, used, 0))
            room[used], used = 0, used + 1
        if length % capacity:
            rests.append((length % capacity, doc, length - length % capacity))
    for length, doc, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        while length:
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                fits = np.flatnonzero(room)
            best = int(fits[cost[fits].argmin()])
            part = min(length, int(room[best]))
            out.append((doc, start, part, best, int(filled[best])))
            cost[best] += part + quadratic * part * part
            filled[best] += part
            room[best] -= part
            start, length = start + part, length - part
    return out


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    ids: str = "ids",
    capacity: int = CAPACITY,
    block_sequences: int = BLOCK_SEQUENCES,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A task packs its rows in blocks of ``block_sequences`` full sequences, so it
    holds one block at a time and nothing is shuffled; the document at the end
    of a block is continued in the next. Only a task's last block has a rest,
    and that is cut into sequences whose lengths are powers of two, so no
    sequence needs padding. Documents without ids give no row; equal ids,
    null ids and repeated rows are packed one by one like any others.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        for own, raw in _rows(batches):
            yield own, np.frombuffer(raw or b"", "<u4")

    return _packed(docs, doc_id, ids, numbered, capacity, block_sequences, quadratic)


def pack_texts(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    block_sequences: int = BLOCK_SEQUENCES,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """``pack`` of the ids that ``tokenize`` gives for the texts, in one step.

    The ids of a text go from the tokenizer straight into a block, so a task has
    one Python worker instead of two, and neither texts nor ids wait in the JVM
    between them.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        with encoder(tokenizer) as encode:
            for own, content in _rows(batches):
                yield own, np.frombuffer(encode.text(content or "") + end, "<u4")

    return _packed(docs, doc_id, text, numbered, capacity, block_sequences, quadratic)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object]]:
    """The two values of every row; those of few rows of a batch are Python objects at a time."""
    for batch in batches:
        for start in range(0, len(batch), _ROWS):
            part = batch.slice(start, _ROWS)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _packed(
    docs: DataFrame,
    doc_id: str,
    content: str,
    numbered: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[object, np.ndarray]]],
    capacity: int,
    block_sequences: int,
    quadratic: float,
) -> DataFrame:
    """Pieces of the documents whose ids ``numbered`` makes of the columns ``doc_id`` and ``content``."""
    block = capacity * block_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << PARTITION_SHIFT
        held: list[tuple[object, int, int, np.ndarray]] = []  # id, start, tokens in all, ids from there
        size = sequences = 0
        kind = None

        def kinded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def emit(items: list) -> pa.RecordBatch:
            nonlocal sequences
            rows = []
            for item, start, length, sequence, offset in balance([len(x[3]) for x in items], capacity, quadratic):
                own, before, tokens, numbers = items[item]
                rows.append((own, before + start, length, numbers[start : start + length].tobytes(), tokens, base + sequences + sequence, offset))
            sequences += len(capacities(sum(len(x[3]) for x in items), capacity))
            columns = list(zip(*rows))
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for own, numbers in numbered(kinded(batches)):
            tokens, start = len(numbers), 0
            while size + tokens - start >= block:
                held.append((own, start, tokens, numbers[start : start + block - size]))
                start += block - size
                yield emit(held)
                held, size = [], 0
            if start < tokens:
                held.append((own, start, tokens, numbers[start:]))
                size += tokens - start
        if held:
            yield emit(held)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return own.mapInArrow(run, schema)
