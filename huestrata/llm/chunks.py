"""Cutting texts at places where no tokenizer used here can join what lies on either side.

Pre-tokenization splits a text before a space that is followed by anything but
white space: a token may start with that space, and none reaches across it.
(Of a longer run of white space, all but the last character form a token of
their own.) Pieces cut there can be encoded one by one, and equal pieces once.
A place before ``<`` stays uncut: a special token may start there, and the white
space in front of one is split by another rule.
"""

from __future__ import annotations

import re

_WIDE = re.compile(r" [\s<]| \Z")
_CUT = re.compile(r" (?=[^\s<])")


def pieces(text: str) -> list[str]:
    """The text without the spaces at which it is cut; every piece but the first had one in front."""
    if _WIDE.search(text) is None:
        return text.split(" ")
    return _CUT.split(text)
