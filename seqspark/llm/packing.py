"""Operator 3: packing token sequences by bin completion.

Method. Documents longer than the capacity are cut into full pieces and a rest.
Pieces of one length are alike, so the packing is solved on the histogram of
lengths, at most ``capacity`` numbers for any input. ``pack`` is bin
completion: around the largest length left it makes some fillings (exact pairs,
exact triples of the 64 largest lengths, greedy ones; not all undominated ones),
keeps ``KEPT`` that none of the others dominates, best fit first, uses one as
often as the counts allow, and goes on; it backtracks
depth first, prunes a branch whose waste already rules out fewer sequences than the
incumbent has, and starts from the better of best-fit decreasing and the first
dive. It stops at the lower bound or after a dive and ``nodes`` more steps. Each use exhausts some length's
count, so the plan has a few thousand patterns at most, whatever the number of documents.

Pieces then take their places by rank within their length.

Scale. One tokenising pass; then only (id, piece, length, crc) rows move. Ranks
come from two passes over ranges of (length, id, piece), so a length that a
third of all pieces share is spread over many tasks. The plan's table (bounded
by the capacity, not by the data) goes to every task.

Edge cases. A null text is empty: its piece is the end id alone. Repeated rows
are packed as rows of their own. Texts of any length are taken whole. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.bpe import load
from seqspark.llm.common import materialize, released, running_total

#: Fillings kept at a node.
KEPT = 6


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be dealt into the items of ``a`` (both decreasing)."""
    if len(a) > len(b):
        return False
    room = list(a)

    def deal(k: int) -> bool:
        if k == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[k] and r not in tried:
                tried.add(r)
                room[j] -= b[k]
                if deal(k + 1):
                    return True
                room[j] += b[k]
        return False

    return deal(0)


def fillings(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths left, best fit first."""
    top = min(room, len(counts) - 1)
    have = np.flatnonzero(counts[: top + 1])
    if len(have) == 0:
        return [()]
    if have[-1] == room:
        return [(room,)]  # dominates every other
    found: dict[tuple[int, ...], None] = {}
    # two that fit exactly
    there = counts[: room + 1] > 0
    pair = np.flatnonzero(there & there[::-1])
    pair = pair[pair * 2 >= room]
    for x in pair[::-1][: 2 * KEPT].tolist():
        if 2 * x > room or counts[x] > 1:
            found[(x, room - x)] = None
    if len(found) < KEPT:
        # three that fit exactly
        for a in have[::-1][:64].tolist():
            rest = room - a
            if rest <= 0:
                continue
            low = there[: rest + 1]
            two = np.flatnonzero(low & low[::-1])
            two = two[(two * 2 >= rest) & (two <= a)]
            for x in two[::-1].tolist():
                need = (a, x, rest - x)
                if all(counts[v] >= need.count(v) for v in need):
                    found[need] = None
                    break
            if len(found) >= 2 * KEPT:
                break
    # greedy ones: each of the largest lengths that fit, then best fit on
    for start in range(min(KEPT, len(have))):
        rest, items, used = room, [], {}
        limit = int(have[-1 - start])
        while rest > 0:
            at = int(np.searchsorted(have, min(rest, limit), side="right")) - 1
            while at >= 0 and used.get(int(have[at]), 0) >= counts[have[at]]:
                at -= 1
            if at < 0:
                break
            x = int(have[at])
            used[x] = used.get(x, 0) + 1
            items.append(x)
            rest -= x
            limit = rest
        found[tuple(items)] = None
    order = sorted(found, key=lambda f: (room - sum(f), len(f), [-v for v in f]))
    out: list[tuple[int, ...]] = []
    for f in order:
        if len(f) > 8 or not any(len(g) <= 8 and dominates(g, f) for g in out):
            out.append(f)
        if len(out) == KEPT:
            break
    return out


def _best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, of best-fit decreasing on a histogram (lengths that fill a sequence alone are not among them)."""
    left = counts.copy()
    plan = []
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        left[big] -= 1
        room, items = capacity - big, [big]
        while True:
            fit = np.flatnonzero(left[: room + 1])
            if len(fit) == 0:
                break
            x = int(fit[-1])
            n = min(int(left[x]), room // x)
            items += [x] * n
            left[x] -= n
            room -= n * x
        need = {x: items.count(x) for x in set(items)}
        more = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= more * n
        plan.append((tuple(items), 1 + more))
    return plan


def pack(counts: np.ndarray, capacity: int, nodes: int = 1_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and their numbers of sequences, for a histogram of lengths 1 .. capacity."""
    left = np.asarray(counts, dtype=np.int64).copy()
    left[0] = 0
    full = int(left[capacity])
    left[capacity] = 0
    head = [((capacity,), full)] if full else []
    total = int((left * np.arange(capacity + 1)).sum())
    if total == 0:
        return head
    # no two lengths over half the capacity share a sequence
    bound = max(-(-total // capacity), int(left[capacity // 2 + 1 :].sum()))
    best = _best_fit_decreasing(left, capacity)
    bins = sum(n for _, n in best)
    nodes += 2 * len(best)  # enough for a whole dive
    trail: list[tuple[tuple[int, ...], int]] = []
    stack: list[tuple[list, int]] = []
    used, rest = 0, total

    def options() -> list[tuple[int, ...]]:
        big = int(np.flatnonzero(left)[-1])
        left[big] -= 1
        out = [(big, *f) for f in fillings(left, capacity - big)]
        left[big] += 1
        return out

    def turn(pattern: tuple[int, ...], n: int, sign: int) -> None:
        for x in pattern:
            left[x] += sign * n

    if bins > bound:
        stack.append((options(), 0))
    while stack and nodes > 0 and bins > bound:
        nodes -= 1
        choices, k = stack[-1]
        if len(trail) == len(stack):  # back from below: undo this node's last choice
            pattern, n = trail.pop()
            turn(pattern, n, 1)
            used, rest = used - n, rest + n * sum(pattern)
        if k == len(choices):
            stack.pop()
            continue
        stack[-1] = (choices, k + 1)
        pattern = choices[k]
        n = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        turn(pattern, n, -1)
        used, rest = used + n, rest - n * sum(pattern)
        trail.append((pattern, n))
        if rest == 0:
            if used < bins:
                best, bins = list(trail), used
        elif used + -(-rest // capacity) < bins:
            stack.append((options(), 0))
    return head + best


def _seats(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first rank, first sequence, pieces in each sequence, offset of the first of these."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, n in plan:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            m = pattern.count(x)
            rows.setdefault(x, []).append((taken.get(x, 0), base, m, offset))
            taken[x] = taken.get(x, 0) + m * n
            offset += m * x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            out: list[tuple] = []
            for doc, made in zip(b.column(0).to_pylist(), bpe.encode_many(b.column(1).to_pylist()), strict=True):
                ids = made + end
                for k in range(0, len(ids), 4 * capacity):
                    piece = ids[k : k + 4 * capacity]
                    out.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), 1))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "one"])
        load.cache_clear()  # the vocabulary and its tables would stay in the worker

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    pieces = materialize(source.mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, one long"), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r[0]] = r[1]
    seats = _seats(pack(counts, capacity))
    ranked = running_total(pieces, ["doc_id", "piece", "ids_crc32"], "one", "rank", by="length")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                first, base, m, off = seats[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], side="right") - 1
                j = rank[part] - first[k]
                sequence[part] = base[k] + j // m[k]
                offset[part] = off[k] + j % m[k] * length[part]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seat, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
