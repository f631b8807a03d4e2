"""Fast, exact token ids for the two BPE vocabularies of the ``tokenizers`` library.

Ids are made for whole texts but word by word, and kept as little-endian
unsigned 32-bit bytes, so that a text's ids are one ``bytes.join``:

* a text falls apart before a run of spaces or line ends that follows another
  character; neither vocabulary's splitting rule joins anything across such a
  place. Texts with any other white space beside spaces are not cut there, but
  given whole to the library;
* parts that were not seen lately are merged, many at a time, by tiktoken's engine, which merges
  by the rank of the joined string. That is the library's merging exactly if
  every vocabulary string merges alone to itself and no two merges make the
  same string; ``prove_ranks`` shows that for a vocabulary file (a test runs
  it), and other tests compare with the library;
* parts with characters beyond Latin (U+0180 on), control characters or an
  added token's string go to the library, so that its normaliser decides.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

REMEMBERED = 250_000
LONGEST = 64
#: Characters of text taken together.
GROUP = 1 << 19
#: Plain parts: no control characters, no white space but spaces and line ends, nothing beyond Latin Extended-A.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-įı-ſ]*")
_PARTS = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: The same parts of a text without two of these in a row, but line ends alone.
_SINGLE = re.compile(" ?[^ \n]+|\n| ")
#: Ends a word inside the merge engine; control characters are not plain, so no word holds it.
_END = b"\x7f"


def prove_ranks(path: str) -> bool:
    """Whether every merge's string merges alone to itself and is made by one merge only."""
    model = json.load(open(path))["model"]
    suffix = model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {m: k for k, m in enumerate(merges)}
    if len({a + b for a, b in merges}) < len(merges):
        return False
    for a, b in merges:
        s = a + b
        parts = [*s[: -len(suffix) - 1], s[-len(suffix) - 1 :]] if suffix and s.endswith(suffix) else list(s)
        while len(parts) > 1:
            r, k = min((rank.get((parts[k], parts[k + 1]), len(merges)), k) for k in range(len(parts) - 1))
            if r == len(merges):
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Token ids of texts as ``bytes``, 4 for each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        data = json.load(open(path))
        model, of = data["model"], _byte_of()
        if not all(t["content"].startswith("<|") and not t["normalized"] for t in data["added_tokens"]):
            raise ValueError(f"{path}: added tokens of another form")
        self.suffix = model.get("end_of_word_suffix") or ""
        raw = lambda s: bytes(of[c] for c in s)
        strings = [bytes([b]) for b in range(256)]
        ids = [model["vocab"][c] for c in sorted(of, key=of.get)]
        if self.suffix:
            ends = [(b, c) for c, b in sorted(of.items(), key=lambda x: x[1]) if b != _END[0]]
            strings += [bytes([b]) + _END for b, _ in ends]
            ids += [model["vocab"][c + self.suffix] for _, c in ends]
        for m in model["merges"]:
            s = "".join(m.split(" ")) if isinstance(m, str) else "".join(m)
            strings.append(raw(s[: -len(self.suffix)]) + _END if self.suffix and s.endswith(self.suffix) else raw(s))
            ids.append(model["vocab"][s])
        import regex

        self.id_of = np.array(ids, dtype="<u4")
        if self.suffix:
            self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
            pattern, self.line = r"[^\x7f]*\x7f", strings.index(b"\n" + _END)
        else:
            pattern, self.line = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", strings.index(b"\n")
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(strings)}, special_tokens={})._core_bpe.encode_ordinary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of plain parts without line ends, all merged in one call."""
        text = "\n".join(parts)
        if self.suffix:
            text = text.lower()  # of plain characters: one by one, as the library does
            text = "\x7f".join(self.pieces(text)) + "\x7f"
        ranks = np.array(self.merge(text), dtype=np.int64)
        data = self.id_of[ranks].tobytes()
        ends = (4 * np.flatnonzero(ranks == self.line)).tolist()
        at = 0
        for end in [*ends, len(data)]:
            yield data[at:end]
            at = end + 4

    def _learn(self, new: set[str]) -> None:
        """Brings the ids of ``new``, parts that the young table lacks, into it."""
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young = self.young, {}
        plain = []
        for p in new:
            found = self.old.get(p)
            if found is not None:
                self.young[p] = found
            elif "<|" not in p and (p.isascii() and p.isprintable() or "\n" not in p and _PLAIN.fullmatch(p)):
                if p:
                    plain.append(p)
                else:
                    self.young[p] = b""
            else:
                self.young[p] = self.by_library(_MARKED.get(p, p))
        if plain:
            self.young.update(zip(plain, self._merged(plain), strict=True))

    def _parts(self, text: str) -> list[str] | None:
        """The text's parts, or None if only the whole text will do."""
        if self.suffix:
            return text.replace("\n", " ").split(" ")  # white space never reaches a token
        if _OTHER_SPACE.search(text):
            return None
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return _PARTS.findall(text)
        # a comma or full stop between a word and a space is a piece of its own
        return _SINGLE.findall(_COMMA.sub(" \x00 ", _STOP.sub(" \x01 ", text)))

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of whole texts, no special tokens added, nothing cut off; null is empty."""
        k = 0
        while k < len(texts):
            group, size, missing = [], 0, []
            known = self.young.get
            while k < len(texts) and (not group or size < GROUP):
                text = texts[k] or ""
                parts = self._parts(text) if text else []
                found, gaps = None, []
                if parts is not None:
                    found, at = list(map(known, parts)), -1
                    for _ in range(found.count(None)):
                        at = found.index(None, at + 1)
                        gaps.append(at)
                        missing.append(parts[at])
                group.append((text, parts, found, gaps))
                size += len(text)
                k += 1
            new = set(missing)
            self._learn(new)
            ids = self.young.__getitem__
            for text, parts, found, gaps in group:
                if found is None:
                    yield self.by_library(text)
                else:
                    for at in gaps:
                        found[at] = ids(parts[at])
                    yield b"".join(found)
            for p in new:
                if len(p) > LONGEST:
                    del self.young[p]

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))


#: Parts that stand for a comma and a full stop without a space before them.
_MARKED = {" \x00": ",", " \x01": "."}
_COMMA, _STOP = re.compile(r",(?<=[^\W_],) "), re.compile(r"\.(?<=[^\W_]\.) ")
_OTHER_SPACE = re.compile("[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)
