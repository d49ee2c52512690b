"""Token ids by the tokenizers library, each distinct word encoded once in a worker."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

from huestrata.llm.chunks import pieces
from huestrata.llm.common import Memo, keep_one, task_memory

#: Start of a special token as text; a piece with one goes to the library whole.
_SPECIAL = "<"

#: Texts of ASCII and precomposed Latin letters alone. Lower case stays in the set, and normal form changes nothing.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")

#: How a lower-casing tokenizer that drops white space splits such texts.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\\[-`{-~]+")


#: Pieces whose number of ids is memorised.
COUNT_ENTRIES = 250_000


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Packed ids (little-endian unsigned 32-bit) of texts.

    The library's own normalizer, pre-tokenizer and model do the work, for one
    piece of text and one word at a time, and the results are memorised. For a
    tokenizer that lower-cases and drops white space, a plain pattern splits
    plain texts, as the library would.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.normalizer = self.library.normalizer
        self.splitter, self.model = self.library.pre_tokenizer, self.library.model
        self.counts = Memo(lambda piece: len(self.piece(" " + piece)) // 4, COUNT_ENTRIES)
        # Letters beyond ASCII stand as their bytes in the model's alphabet; the splitter maps them.
        self.lower_words = Memo(
            lambda word: self._ids(word) if word.isascii() else b"".join(self._ids(w) for w, _ in self._split(word))
        )
        self.inner = Memo(lambda piece: self.piece(" " + piece))
        probe = "It's 42 ÉaÎß-cd!?\n'Re"
        self.lowers = [w for w, _ in self._split(self._normal(probe))] == [
            mapped for word in _WORDS.findall(probe.lower()) for mapped, _ in self._split(word)
        ]

    def _ids(self, word: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(word)])

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _split(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.splitter.pre_tokenize_str(text)

    def piece(self, piece: str) -> bytes:
        if _SPECIAL in piece:
            return _packed(self.library.encode(piece, add_special_tokens=False).ids)
        return b"".join(self._ids(w) for w, _ in self._split(self._normal(piece)))

    def count(self, text: str) -> int:
        """Number of ids; memorises numbers alone."""
        first, *rest = pieces(text)
        total = len(self.piece(first)) // 4 + sum(map(self.counts.__getitem__, rest))
        self.counts.trim()
        return total

    def text(self, text: str) -> bytes:
        if self.lowers and "<|" not in text and _PLAIN.fullmatch(text):
            packed = b"".join(map(self.lower_words.__getitem__, _WORDS.findall(text.lower())))
        else:
            first, *rest = pieces(text)
            packed = self.piece(first) + b"".join(map(self.inner.__getitem__, rest))
        self.lower_words.trim()
        self.inner.trim()
        return packed


    def forget(self) -> None:
        for memo in (self.lower_words, self.inner, self.counts):
            memo.clear()


@contextmanager
def encoder(path: str) -> Iterator[WordEncoder]:
    """The encoder of a tokenizer. A worker loads it once, and forgets the words at the end of a task."""
    with task_memory(keeps=True):
        own = keep_one(("encoder", path), lambda: WordEncoder(path))
        try:
            yield own
        finally:
            own.forget()
