"""64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, with numpy.

A word's hash is a polynomial over random 64-bit values of its bytes, taken
from running sums over a whole slice of texts, then scrambled together with
the word's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seqspark.llm.common import mix64, powers

#: Bytes of text taken together; a longer text is taken alone.
SLICE = 1 << 19
_R = 0x9E3779B97F4A7C17  # odd, and one less than it is twice an odd number
_INVERSE = pow(_R, -1, 1 << 64)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers; those for one slice are kept."""
    if n <= SLICE + 1:
        if base not in _kept:
            _kept[base] = powers(base, SLICE + 1)
        return _kept[base][:n]
    return powers(base, n)


def slices(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts as UTF-8 (null: empty), about ``SLICE`` bytes at a time."""
    out, total = [], 0
    for t in column.cast(pa.large_binary()).to_pylist():
        t = t or b""
        if out and total + len(t) + 1 > SLICE:
            yield out
            out, total = [], 0
        out.append(t)
        total += len(t) + 1
    if out:
        yield out


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hashes of all words, first word of each text and the end, byte starts, byte ends, the joined bytes)."""
    data = b"\n".join(texts)
    if lower:
        data = data.lower()  # of bytes: A-Z only
    buf = np.frombuffer(data, dtype=np.uint8)
    n = len(buf)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    value = _VALUE[buf]
    value *= _powers(_R, n)
    np.cumsum(value, out=sums[1:])
    h = (sums[end] - sums[begin]) * _powers(_INVERSE, n + 1)[begin]
    h = mix64(h + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(begin, at), begin, end, data


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about ``most`` bytes that end at white space."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + most)
        yield text[at : end.start() if end else len(text)]
        at = end.start() if end else len(text)


def hashed(column: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text; a long text is hashed in pieces, so that memory beyond the text and its hashes stays bounded."""
    for texts in slices(column):
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
            yield np.concatenate([hash_words([p], lower)[0] for p in pieces(texts[0], SLICE)])
            continue
        h, first, *_ = hash_words(texts, lower)
        for k in range(len(texts)):
            yield h[first[k] : first[k + 1]]
