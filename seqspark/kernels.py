"""Dynamic-programming kernels in numpy, free of Spark."""

from __future__ import annotations

import numpy as np


def _codes(seqs: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(seqs), width), fill, np.int32)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int32)
    return out


def local_align(texts: list[str], patterns: list[str], match: int, mismatch: int, gap_open: int, gap_extend: int, trace: bool) -> list[tuple]:
    """Affine local alignments of many pairs at once: (score, start_i, start_j, end_i, end_j, cigar).

    All pairs advance together along anti-diagonals of one padded table. A cell
    prefers the diagonal, then a gap in the text (E), then one in the pattern
    (F); a gap is extended only where that is strictly better. The first best cell in
    row-major order ends the alignment.
    """
    pairs = len(texts)
    rows, cols = max([len(t) for t in texts], default=0), max([len(p) for p in patterns], default=0)
    m, n = np.array([len(t) for t in texts], int), np.array([len(p) for p in patterns], int)
    if pairs == 0:
        return []
    a, b = _codes(texts, max(rows, 1), -1), _codes(patterns, max(cols, 1), -2)
    low = -(1 << 28)
    # by row index, for the last diagonals: H twice back, H, E and F once back
    h2 = np.zeros((pairs, rows + 1), np.int32)
    h1 = np.zeros((pairs, rows + 1), np.int32)
    e1 = np.full((pairs, rows + 1), low, np.int32)
    f1 = np.full((pairs, rows + 1), low, np.int32)
    best, best_i, best_j = np.zeros(pairs, np.int64), np.full(pairs, -1), np.full(pairs, -1)
    moves = np.zeros((pairs, rows + 1, cols + 1), np.uint8) if trace else None
    for d in range(2, rows + cols + 1):
        lo, hi = max(1, d - cols), min(rows, d - 1)
        if lo > hi:
            continue
        i = np.arange(lo, hi + 1)
        j = d - i
        inside = (i[None, :] <= m[:, None]) & (j[None, :] <= n[:, None])
        score = np.where(a[:, i - 1] == b[:, j - 1], match, mismatch)
        diag = h2[:, i - 1] + score
        open_e, ext_e = h1[:, i] - gap_open, e1[:, i] - gap_extend
        open_f, ext_f = h1[:, i - 1] - gap_open, f1[:, i - 1] - gap_extend
        longer_e, longer_f = ext_e > open_e, ext_f > open_f
        e, f = np.where(longer_e, ext_e, open_e), np.where(longer_f, ext_f, open_f)
        h, source = diag.copy(), np.ones_like(diag, dtype=np.uint8)
        for k, v in ((2, e), (3, f)):
            more = v > h
            h[more] = v[more]
            source[more] = k
        stop = (h <= 0) | ~inside
        h[stop] = 0
        source[stop] = 0
        if trace:
            moves[:, i, j] = source + 4 * longer_e.astype(np.uint8) + 8 * longer_f.astype(np.uint8)
        top = h.max(axis=1)
        for k in np.flatnonzero((top >= best) & (top > 0)):
            # of equal scores the first cell in row-major order, which may lie on a later diagonal
            r = lo + int(np.argmax(h[k]))
            c = d - r
            if top[k] > best[k] or (r, c) < (best_i[k], best_j[k]):
                best[k], best_i[k], best_j[k] = top[k], r, c
        h2, h1 = h1, h2
        h1[:, :] = 0
        h1[:, i] = h
        e1[:, :], f1[:, :] = low, low
        e1[:, i], f1[:, i] = e, f
    out = []
    for k in range(pairs):
        if best[k] == 0:
            out.append((0, -1, -1, -1, -1, ""))
            continue
        i, j = int(best_i[k]), int(best_j[k])
        if not trace:
            out.append((int(best[k]), -1, -1, i - 1, j - 1, ""))
            continue
        ops, state = [], "H"
        end = i - 1, j - 1
        while True:
            move = int(moves[k, i, j])
            if state == "H":
                if move & 3 == 0:
                    break
                if move & 3 == 1:
                    ops.append("M" if texts[k][i - 1] == patterns[k][j - 1] else "X")
                    i, j = i - 1, j - 1
                    continue
                state = "E" if move & 3 == 2 else "F"
            if state == "E":
                ops.append("D")
                j -= 1
                state = "E" if move & 4 else "H"
            else:
                ops.append("I")
                i -= 1
                state = "F" if move & 8 else "H"
        out.append((int(best[k]), i, j, *end, "".join(reversed(ops))))
    return out


def neighbour_joining(dist: np.ndarray) -> list[tuple[int, int]]:
    """(left, right) of the internal nodes n .. 2n-2, in order of making; ties go to the first pair in order of the live list."""
    n = len(dist)
    size = max(2 * n - 1, 1)
    d = np.zeros((size, size), np.float64)
    d[:n, :n] = dist.astype(np.float32).astype(np.float64)
    live = list(range(n))
    made: list[tuple[int, int]] = []
    while len(live) > 2:
        m = len(live)
        sub = d[np.ix_(live, live)]
        r = np.zeros(m)
        for b in range(m):  # one column after another: the order of additions decides ties
            r += sub[:, b]
        q = (m - 2) * sub - r[:, None] - r[None, :]
        q[np.tril_indices(m)] = np.inf
        at = int(np.argmin(q))
        x, y = live[at // m], live[at % m]
        new = n + len(made)
        rest = [v for v in live if v not in (x, y)]
        d[new, rest] = 0.5 * (d[x, rest] + d[y, rest] - d[x, y])
        d[rest, new] = d[new, rest]
        made.append((x, y))
        live = [*rest, new]
    if n > 1:
        made.append((live[0], live[1]))
    return made


class Profile:
    """Rows of one alignment with, for each column, the share of each symbol and the occupancy."""

    def __init__(self, rows: list[str], ids: list[int], weights: np.ndarray):
        self.rows, self.ids = rows, ids
        codes = np.array([np.frombuffer(r.encode("latin-1"), np.uint8) for r in rows])
        share = weights[codes]  # rows x columns x symbols
        self.share = (share.sum(axis=0, dtype=np.float32) / np.float32(len(rows))).astype(np.float32)
        self.occupancy = self.share.sum(axis=1, dtype=np.float32)


def gap_costs(occ: np.ndarray, gap_open: float, gap_extend: float, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
    """Costs of opening and of extending a gap opposite each column."""
    occ = occ.astype(np.float32)
    if not scaled:
        return np.full_like(occ, gap_open), np.full_like(occ, gap_extend)
    full = occ >= 1
    go, ge = np.float32(gap_open), np.float32(gap_extend)
    opening = np.where(full, go * occ, np.maximum(np.float32(0.1) * go, np.float32(0.5) * go * occ))
    extending = np.where(full, ge, np.maximum(np.float32(0.2) * ge, ge * occ))
    return opening.astype(np.float32), extending.astype(np.float32)


def align_profiles(x: Profile, y: Profile, scores: np.ndarray, gap_open: float, gap_extend: float, free_ends: bool, scaled: bool) -> tuple[float, list[str]]:
    """Score and the column operations (M, I: only x, D: only y) of the best alignment of two profiles, all columns of both included."""
    a, b = len(x.share), len(y.share)
    low = np.float32(-1e30)
    s = np.zeros((a, b), np.float32)
    for p in np.flatnonzero(x.share.any(axis=0)):  # symbol pairs in order, single precision: the order decides ties
        for q in np.flatnonzero(y.share.any(axis=0)):
            s += np.outer(x.share[:, p], y.share[:, q]).astype(np.float32) * np.float32(scores[p, q])
    xo, xe = gap_costs(x.occupancy, gap_open, gap_extend, scaled)
    yo, ye = gap_costs(y.occupancy, gap_open, gap_extend, scaled)
    m = np.full((a + 1, b + 1), low, np.float32)
    ix, iy = m.copy(), m.copy()
    m[0, 0] = 0
    source = np.zeros((a + 1, b + 1), np.uint8)  # of M: 0 M, 1 Ix, 2 Iy
    ext_x, ext_y = np.zeros((a + 1, b + 1), bool), np.zeros((a + 1, b + 1), bool)
    if free_ends:
        m[:, 0] = ix[:, 0] = 0
        m[0, :] = iy[0, :] = 0
    else:
        for i in range(1, a + 1):
            ix[i, 0] = -(xo[i - 1] + np.float32(i - 1) * xe[i - 1])
        for j in range(1, b + 1):
            iy[0, j] = -(yo[j - 1] + np.float32(j - 1) * ye[j - 1])
    ext_x[1:, 0] = True
    ext_y[0, 1:] = True
    for d in range(2, a + b + 1):
        i = np.arange(max(1, d - b), min(a, d - 1) + 1)
        j = d - i
        pm, px, py = m[i - 1, j - 1], ix[i - 1, j - 1], iy[i - 1, j - 1]
        best, src = pm.copy(), np.zeros(len(i), np.uint8)
        for k, v in ((1, px), (2, py)):
            more = v > best
            best[more] = v[more]
            src[more] = k
        m[i, j] = best + s[i - 1, j - 1]
        source[i, j] = src
        o, e = m[i - 1, j] - xo[i - 1], ix[i - 1, j] - xe[i - 1]
        ext_x[i, j] = e > o
        ix[i, j] = np.maximum(o, e)
        o, e = m[i, j - 1] - yo[j - 1], iy[i, j - 1] - ye[j - 1]
        ext_y[i, j] = e > o
        iy[i, j] = np.maximum(o, e)
    if free_ends:
        score, i, j, state = low, a, b, 0
        for r in range(a + 1):
            for k, v in ((0, m[r, b]), (1, ix[r, b])):
                if v > score:
                    score, i, j, state = v, r, b, k
        for c in range(b + 1):
            for k, v in ((0, m[a, c]), (2, iy[a, c])):
                if v > score:
                    score, i, j, state = v, a, c, k
    else:
        score, i, j, state = m[a, b], a, b, 0
    ops = ["D"] * (b - j) + ["I"] * (a - i)
    while i > 0 and j > 0:
        if state == 0:
            ops.append("M")
            state = int(source[i, j])
            i, j = i - 1, j - 1
        elif state == 1:
            ops.append("I")
            state = 1 if ext_x[i, j] else 0
            i -= 1
        else:
            ops.append("D")
            state = 2 if ext_y[i, j] else 0
            j -= 1
    ops += ["D"] * j + ["I"] * i
    return float(score), ops[::-1]


def merge_rows(x: Profile, y: Profile, ops: list[str]) -> tuple[list[str], list[int]]:
    """The rows of both under one alignment."""

    def spread(row: str, skip: str) -> str:
        it = iter(row)
        return "".join("-" if o == skip else next(it) for o in ops)

    return [spread(r, "D") for r in x.rows] + [spread(r, "I") for r in y.rows], [*x.ids, *y.ids]


def sum_of_pairs(rows: list[str], pair_score: np.ndarray, gap_open: float, gap_extend: float) -> float:
    """All pairs of rows: letter scores, less an affine cost for each one-sided gap run; columns that are gaps in both are skipped."""
    total = 0.0
    codes = [np.frombuffer(r.encode("latin-1"), np.uint8) for r in rows]
    gap = ord("-")
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = codes[i], codes[j]
            keep = ~((a == gap) & (b == gap))
            a, b = a[keep], b[keep]
            one = (a == gap) | (b == gap)
            total += float(pair_score[a[~one], b[~one]].sum())
            edges = np.diff(np.concatenate(([0], one.astype(np.int8), [0])))
            runs = np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)
            total -= float((gap_open + (runs - 1) * gap_extend).sum())
    return total
