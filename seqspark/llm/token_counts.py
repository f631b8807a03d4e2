"""Operator 1: token counts by the whole-token shortcut.

Method. The vocabulary is a SentencePiece BPE model. No piece of it holds a
word mark after another character, so no merge crosses from a character to a
following word mark: a normalised text falls into segments (word marks, then
other characters) that are encoded independently, and its token count is the
sum over its segments. ``prove`` checks that property of a vocabulary, and
finds, offline and once per worker, every vocabulary string that the model
encodes alone as exactly one token. A segment in that set counts 1 without any
merging; only the rest is merged by the library, and remembered in a bounded
table.

Edge cases. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each
get their result. Control strings such as ``<s>`` in a text are ordinary text,
as in the library. A text of any length is counted whole; a text that is one
segment (no spaces) goes to the library as it is. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.

Scale. One pass over the scan, no shuffle, no state beyond two tables of at
most ``REMEMBERED`` entries in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Encoded segments that a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Longer segments are encoded each time.
LONGEST = 64
MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> frozenset[str]:
    """The words (without their word mark) that the model encodes as one token; raises if the vocabulary lets merges cross words."""
    sp = _model(path)
    if sp.piece_to_id(MARK) == sp.unk_id():
        raise ValueError(f"{path}: the word mark is no piece")
    words = []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}", piece):
            raise ValueError(f"{path}: merges may cross words in {piece!r}")
        if piece[0] == MARK and len(piece) > 1 and piece[1] != MARK:
            words.append(piece[1:])
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class Counter:
    """Counts tokens of texts; ``whole`` holds the words proven to be one token."""

    def __init__(self, path: str):
        self.sp = _model(path)
        self.whole = dict.fromkeys(prove(path), 1)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, segment: str) -> int:
        """Tokens of a word mark followed by ``segment``."""
        return len(self.sp.encode(segment, num_threads=1))

    def rest(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.merged(word)
        if len(word) <= LONGEST:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        # every space is a word mark, and one stands before the text
        if "  " in text or text[0] == " " or text[-1] == " ":
            words, total = [], 0
            for marks, word in _segments(" " + text):
                if marks == 1 and word:
                    words.append(word)
                elif not word and marks == 1:
                    total += 1
                else:
                    total += self.merged(" " * (marks - 1) + word)
        else:
            words, total = text.split(" "), 0
        whole, young = self.whole.get, self.young.get
        for w in words:
            total += whole(w) or young(w) or self.rest(w)
        return total


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """(number of word marks, characters after them) of each segment."""
    for m in re.finditer("( *)([^ ]*)", text):
        if m.end() > m.start():
            yield len(m[1]), m[2]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for b in batches:
            texts = b.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, n, pa.compute.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
