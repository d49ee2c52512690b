"""Byte-level BPE by replaying the merges over all words of a block of the corpus."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.chunks import pieces
from huestrata.llm.common import free_name

#: Characters of text whose words are replayed together, about.
BLOCK_CHARS = 4_000_000

#: Bytes of a word from which on it is merged on its own.
LONG_WORD = 64

#: Words, and pieces of text, after which a task forgets what it knows. Bounds its memory, never its results.
MEMO_ENTRIES = 200_000


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        lines = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in lines}


def _linked(words: Sequence[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """``replay`` for long words, one place at a time: a repeated pair costs no round of its own."""
    symbols: list[bytes] = []
    following: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    for word in words:
        first = len(symbols)
        starts.append(first)
        parts = [word] if word in ranks else [word[i : i + 1] for i in range(len(word))]
        last = first + len(parts) - 1
        symbols += parts
        before += [-1, *range(first, last)][: len(parts)]
        following += [*range(first + 1, last + 1), -1][: len(parts)]
    at: dict[int, list[int]] = {}
    waiting: list[int] = []

    def enter(left: int) -> int | None:
        right = following[left]
        if right < 0:
            return None
        rank = ranks.get(symbols[left] + symbols[right])
        if rank is not None:
            if rank in at:
                at[rank].append(left)
            else:
                at[rank] = [left]
                heapq.heappush(waiting, rank)
        return rank

    for left, right in enumerate(following):
        if right >= 0:
            rank = ranks.get(symbols[left] + symbols[right])
            if rank is not None:
                if rank in at:
                    at[rank].append(left)
                else:
                    at[rank] = [left]
    waiting += at
    heapq.heapify(waiting)
    merged_away = bytearray(len(symbols))
    while waiting:
        rank = heapq.heappop(waiting)
        places = sorted(at.pop(rank))
        for done, left in enumerate(places, 1):
            right = following[left]
            if merged_away[left] or right < 0 or ranks.get(symbols[left] + symbols[right]) != rank:
                continue
            symbols[left] += symbols[right]
            merged_away[right] = 1
            after = following[left] = following[right]
            if after >= 0:
                before[after] = left
            new = [enter(left)]
            if before[left] >= 0:
                new.append(enter(before[left]))
            if any(r is not None and r < rank for r in new) and done < len(places):
                at.setdefault(rank, []).extend(places[done:])
                heapq.heappush(waiting, rank)
                break
    out = []
    for word, place in zip(words, starts):
        ids = []
        while place >= 0 and word:
            ids.append(ranks[symbols[place]])
            place = following[place]
        out.append(ids)
    return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs of tokens (left * 2**32 + right) whose bytes together are a token, and its rank."""
    ranks = read_ranks(path)
    found = [
        (left << 32 | right, rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
    ]
    table = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    return np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])


def replay(words: Sequence[bytes], path: str) -> list[bytes]:
    """Packed ids of every word. Merges are applied to all words together, lowest rank first.

    All words lie in one linked list of symbols. ``at`` is the inverted index
    from the rank of a pair to the places of its left symbols. A merge is applied
    to all its places at once and enters only the two pairs that a merged symbol
    forms with its neighbours. A word takes part in a merge once, at its first
    place; its other places wait, since a new pair of lower rank would go first.
    A word that is a token as it stands is that token.
    """
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * len(words)
    rest = []
    for i, word in enumerate(words):
        if not word or word in ranks:
            out[i] = _packed([ranks[word]] if word else [])
        elif len(word) > LONG_WORD:
            out[i] = _packed(_linked([word], ranks)[0])
        else:
            rest.append(i)
    if not rest:
        return out
    keys, values = _pairs(path)
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    lengths = np.array([len(words[i]) for i in rest])
    token = single[np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)]
    word_of = np.repeat(np.arange(len(rest)), lengths)
    place = np.arange(len(token))
    after, before = place + 1, place - 1
    ends = np.cumsum(lengths)
    after[ends - 1] = -1
    before[ends - lengths] = -1

    def rank_of(left: np.ndarray) -> np.ndarray:
        """Rank of the pairs that start at some places, -1 for none."""
        pair = token[left] << 32 | token[after[left]]
        spot = np.searchsorted(keys, pair)
        spot[spot == len(keys)] = 0
        return np.where(keys[spot] == pair, values[spot], -1)

    left = place[after >= 0]
    found = rank_of(left)
    left, found = left[found >= 0], found[found >= 0]
    order = np.argsort(found, kind="stable")
    left, found = left[order], found[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    at = dict(zip(found[starts].tolist(), (x.tolist() for x in np.split(left, starts[1:]))))
    waiting = sorted(at)
    while waiting:
        rank = heapq.heappop(waiting)
        places = np.unique(np.array(at.pop(rank)))
        places = places[(token[places] >= 0) & (after[places] >= 0)]
        places = places[rank_of(places) == rank]
        if not len(places):
            continue
        own = word_of[places]
        first = np.append(True, own[1:] != own[:-1])
        if not first.all():
            at[rank] = places[~first].tolist()
            heapq.heappush(waiting, rank)
            places = places[first]
        right = after[places]
        behind = after[right]
        token[places], token[right] = rank, -1
        after[places] = behind
        inner = behind >= 0
        before[behind[inner]] = places[inner]
        ahead = before[places]
        new = np.concatenate([ahead[ahead >= 0], places[inner]])
        ranks_of_new = rank_of(new)
        there = ranks_of_new >= 0
        for r, p in zip(ranks_of_new[there].tolist(), new[there].tolist()):
            if r in at:
                at[r].append(p)
            else:
                at[r] = [p]
                heapq.heappush(waiting, r)
    kept = token >= 0
    packed = token[kept].astype("<u4").tobytes()
    bounds = np.append(0, np.cumsum(np.bincount(word_of[kept], minlength=len(rest)))) * 4
    for i, start, end in zip(rest, bounds[:-1].tolist(), bounds[1:].tolist()):
        out[i] = packed[start:end]
    return out


class BlockEncoder:
    """Packed ids of texts, the words of a block of texts at a time.

    The distinct words of a block that are not known yet are replayed together.
    What is known is kept up to a bound, for the blocks that follow.
    """

    def __init__(self, ranks: str, pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _learn(self, texts: list[str]) -> None:
        for known in (self.words, self.inner):
            if len(known) > MEMO_ENTRIES:
                known.clear()
        new: set[str] = set()
        words: set[str] = set()
        for text in texts:
            first, *rest = pieces(text)
            words.update(self.split.findall(first))
            new.update(rest)
        new.difference_update(self.inner)
        parts = {piece: self.split.findall(" " + piece) for piece in new}
        for found in parts.values():
            words.update(found)
        words.difference_update(self.words)
        ordered = list(words)
        ids = replay([w.encode() for w in ordered], self.ranks)
        self.words.update(zip(ordered, ids))
        for piece, found in parts.items():
            self.inner[piece] = b"".join(map(self.words.__getitem__, found))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        self._learn(texts)
        for text in texts:
            first, *rest = pieces(text)
            start = b"".join(map(self.words.__getitem__, self.split.findall(first)))
            yield start + b"".join(map(self.inner.__getitem__, rest))


def encode(
    docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the ids of every whole text, as little-endian unsigned 32-bit integers.

    The corpus is replayed block by block, where Spark has put it: a task takes
    the distinct words of about ``BLOCK_CHARS`` characters of text, applies all
    merges to all of them in rank order, and puts the texts together. Nothing is
    shuffled, and a task holds one block. Null counts as empty, empty texts give
    no ids, a text longer than a block is a block of its own, and repeated rows
    stay. With ``decoded`` the ids are decoded again in the same task, into a
    column of that name. Existing columns of these names are replaced.
    """
    fields = "ids binary, decoded binary" if decoded else "ids binary"

    @F.pandas_udf(fields)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = BlockEncoder(ranks, pattern)
        back = decoder(ranks) if decoded else None
        for batch in batches:
            texts = [t or "" for t in batch]
            ends = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(ends // BLOCK_CHARS, prepend=0)) if len(texts) else []
            found: list[bytes] = []
            for start, end in zip([0, *cuts], [*cuts, len(texts)]):
                found += own.texts(texts[start:end])
            columns = {"ids": found}
            if back:
                columns["decoded"] = [back(x) for x in found]
            yield pd.DataFrame(columns, dtype=object)

    at = free_name(docs, "_encoded")
    named = {ids: F.col(f"{at}.ids")} | ({decoded: F.col(f"{at}.decoded")} if decoded else {})
    return docs.withColumn(at, encoded(F.col(text))).withColumns(named).drop(at)


def decoder(ranks: str) -> Callable[[bytes], bytes]:
    """Function from packed ids to the bytes they stand for."""
    token = {rank: raw for raw, rank in read_ranks(ranks).items()}
    return lambda ids: b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(ranks: str):
    """Arrow function from packed ids to the bytes they stand for."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = decoder(ranks)
        for batch in batches:
            yield pd.Series([back(x) for x in batch], dtype=object)

    return decoded
