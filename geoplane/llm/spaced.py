"""Texts cut at single spaces, where the tokenizers of this subpackage always end a token; equal parts are met once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are no white space by any reading.
SOLID = "[!-~¡-ɏͰ-ϿЀ-ӿ]"
CUT = re.compile(f"(?<={SOLID}) (?={SOLID})")
#: Characters of text that are worked on at once; a longer text is worked on in stretches.
STRETCH = 1 << 21


def stretches(texts: list[str | None], limit: int = STRETCH) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Lists of (row, stretch of its text, whether it is the text's first) of about ``limit`` characters; null is empty.

    A text over the limit comes in several stretches, cut at single spaces, which the next stretch begins after.
    """
    rows, out, first, size = [], [], [], 0
    for row, text in enumerate(texts):
        text, at, begins = text or "", 0, True
        while True:
            cut = CUT.search(text, at + limit) if len(text) - at > limit else None
            part = text[at : cut.start()] if cut else text[at:]
            if size and size + len(part) > limit:
                yield rows, out, first
                rows, out, first, size = [], [], [], 0
            rows.append(row)
            out.append(part)
            first.append(begins)
            size += len(part) + 1
            if not cut:
                break
            at, begins = cut.end(), False
    if rows:
        yield rows, out, first


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of words of each text, each word's place among the distinct words, and the distinct words.

    A word stands for itself after one space: joined by spaces, and with one before, the words give a space and the text.
    """
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = CUT.split(text)
        counts[k] = len(own)
        words += own
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return counts, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
