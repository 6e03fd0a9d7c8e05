"""Splitting of text into pre-tokens by the pattern of the rank files, and the byte-to-character map of their vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Code points below U+0100 on which Python's classes differ from the pattern's, and all code points above.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeĀ-\U0010ffff]")
# The same language as the pattern wherever _UNSURE finds nothing; the built-in engine runs it in half the time.
_PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function that lists the pre-tokens of a text, in order and without gaps."""
    import public_tokenizers

    full = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return full.findall

    def split(text: str) -> list[str]:
        return (full if _UNSURE.search(text) else _PLAIN).findall(text)

    return split
