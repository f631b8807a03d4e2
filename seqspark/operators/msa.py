"""Progressive multiple alignment of groups of sequences (``msa_id``, ``ord``, ``seq_id``, ``sequence``).

One group is one task: k-mer distances, neighbour joining, then profiles merged
up the tree. Groups run in parallel; a group must fit one worker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.sequence import is_amino_acids, is_nucleotides
from seqspark.kernels import Profile, align_profiles, merge_rows, neighbour_joining, sum_of_pairs
from seqspark.tables import AMINO, GENETIC_CODES, IUPAC, LOWER_BASES, PRESETS, Params, blosum62

MODES = ("dna", "protein", "codon")


def letter_weights(alpha: int) -> np.ndarray:
    """For each byte the share of each symbol that it stands for."""
    out = np.zeros((256, alpha), np.float32)
    if alpha == 4:
        for code, bases in IUPAC.items():
            for c in {code, code.lower()} if code.lower() in LOWER_BASES else {code}:
                for b in bases:
                    out[ord(c), "ACGT".index(b)] = np.float32(1) / np.float32(len(bases))
    elif alpha == 20:
        for k, a in enumerate(AMINO):
            out[[ord(a), ord(a.lower())], k] = 1
        for code, pair in (("B", "ND"), ("Z", "QE"), ("J", "IL")):
            for a in pair:
                out[ord(code), AMINO.index(a)] = 0.5
        out[ord("U"), AMINO.index("C")] = 1
        out[[ord("X"), ord("O")], :] = np.float32(1) / np.float32(20)
    else:
        for k in range(65):
            out[128 + k, k] = 1
    return out


def symbol_scores(params: Params, code: int) -> np.ndarray:
    if params.alpha == 4:
        out = np.full((4, 4), params.transversion, np.float32)
        out[[0, 2, 1, 3], [2, 0, 3, 1]] = params.transition
        np.fill_diagonal(out, params.match)
        return out
    if params.alpha == 20:
        return blosum62()
    amino, b = GENETIC_CODES[code], blosum62()
    out = np.zeros((65, 65), np.float32)
    for p in range(64):
        for q in range(64):
            x, y = amino[p], amino[q]
            if "*" in (x, y):
                out[p, q] = 0 if x == y else -params.stop_penalty
            else:
                out[p, q] = b[AMINO.index(x), AMINO.index(y)] + params.nt_bonus * sum((p >> s & 3) == (q >> s & 3) for s in (4, 2, 0))
    return out


def _encode(s: str, code: int) -> tuple[str, int, int, int]:
    """(tokens as characters 128 + index, frame, stops, partial) in the frame with fewest stops."""
    s = s.upper().replace("U", "T")
    order, amino = "TCAG", GENETIC_CODES[code]

    def index(c: str) -> int:
        return 16 * order.index(c[0]) + 4 * order.index(c[1]) + order.index(c[2]) if len(c) == 3 and all(x in order for x in c) else 64

    best = None
    for frame in range(3):
        tokens = [index(s[k : k + 3]) for k in range(frame, len(s) - 2, 3)]
        stops = sum(t < 64 and amino[t] == "*" for t in tokens)
        if best is None or stops < best[1]:
            best = (frame, stops, tokens)
    frame, stops, tokens = best
    partial = int((len(s) - frame) % 3 != 0 and len(s) > frame)
    return "".join(chr(128 + t) for t in [*tokens, *[64] * partial]) or chr(192), frame, stops, partial


def _decode(row: str) -> str:
    order = "TCAG"
    return "".join("---" if c == "-" else "NNN" if ord(c) == 192 else order[ord(c) - 128 >> 4] + order[(ord(c) - 128 >> 2) & 3] + order[(ord(c) - 128) & 3] for c in row)


def _distances(seqs: list[str], k: int, weights: np.ndarray) -> np.ndarray:
    plain = [{s[i : i + k] for i in range(len(s) - k + 1) if all(weights[ord(c)].max() == 1 for c in s[i : i + k])} for s in seqs]
    n = len(seqs)
    out = np.zeros((n, n), np.float32)
    for i in range(n):
        for j in range(i + 1, n):
            least = min(len(plain[i]), len(plain[j]))
            out[i, j] = out[j, i] = np.float32(1) if least == 0 else np.float32(1) - np.float32(len(plain[i] & plain[j])) / np.float32(least)
    return out


def _stripped(p: Profile, limit: float) -> tuple[list[str], np.ndarray]:
    """Rows without the columns that are gaps in more than ``limit`` of them, and which columns stay."""
    gaps = np.array([np.frombuffer(r.encode("latin-1"), np.uint8) for r in p.rows]) == ord("-")
    stay = gaps.mean(axis=0) <= limit
    return ["".join(np.array(list(r))[stay]) for r in p.rows], stay


def _expanded(ops: list[str], x_stay: np.ndarray, y_stay: np.ndarray) -> list[str]:
    """Operations over all columns from those over the columns that stayed; dropped columns stand alone, in place."""
    out, i, j = [], 0, 0

    def dropped() -> None:
        nonlocal i, j
        while i < len(x_stay) and not x_stay[i]:
            out.append("I")
            i += 1
        while j < len(y_stay) and not y_stay[j]:
            out.append("D")
            j += 1

    for o in ops:
        dropped()
        out.append(o)
        i += o in "MI"
        j += o in "MD"
    dropped()
    return out


def align_group(seqs: list[str], params: Params, code: int = 1, rounds: int = 0) -> list[str]:
    """Equal-width rows, in the order of the sequences."""
    if len(seqs) < 2:
        return list(seqs)
    weights, scores = letter_weights(params.alpha), symbol_scores(params, code)
    make = lambda rows, ids: Profile(rows, ids, weights)
    args = scores, params.gap_open, params.gap_extend, params.free_ends, params.position_gaps

    def joined(x: Profile, y: Profile) -> Profile:
        xr, xs = _stripped(x, params.gappy)
        yr, ys = _stripped(y, params.gappy)
        if xs.any() and ys.any():
            ops = _expanded(align_profiles(make(xr, x.ids), make(yr, y.ids), *args)[1], xs, ys)
        else:
            ops = align_profiles(x, y, *args)[1]
        return make(*merge_rows(x, y, ops))

    nodes = {k: make([s], [k]) for k, s in enumerate(seqs)}
    made = neighbour_joining(_distances(seqs, params.kmer_k, weights))
    below: list[set[int]] = [{k} for k in range(len(seqs))]
    for k, (a, b) in enumerate(made):
        nodes[len(seqs) + k] = joined(nodes.pop(a), nodes.pop(b))
        below.append(below[a] | below[b])
    last = nodes.popitem()[1]
    rows = dict(zip(last.ids, last.rows, strict=True))
    pair = np.zeros((256, 256))
    for a in range(256):
        pair[a] = ((weights[a] @ scores) * weights).sum(axis=1)
    ordered = [rows[k] for k in range(len(seqs))]
    for _ in range(rounds if len(seqs) > 2 else 0):
        better = False
        for side in below[:-1]:
            parts = [[k for k in range(len(seqs)) if (k in side) == inside] for inside in (True, False)]
            halves = []
            for ids in parts:
                cols = [c for c in range(len(ordered[0])) if any(ordered[k][c] != "-" for k in ids)]
                halves.append(make(["".join(ordered[k][c] for c in cols) for k in ids], ids))
            new_rows, ids = merge_rows(*halves, align_profiles(*halves, *args)[1])
            new = [r for _, r in sorted(zip(ids, new_rows, strict=True))]
            if sum_of_pairs(new, pair, params.gap_open, params.gap_extend) > sum_of_pairs(ordered, pair, params.gap_open, params.gap_extend):
                ordered, better = new, True
        if not better:
            break
    return ordered


def request_error(mode: str, gc_def: int, iter_refine: int) -> str | None:
    if mode not in MODES:
        return f"mode must be one of {', '.join(MODES)}"
    if gc_def not in GENETIC_CODES:
        return "gc_def must be 1 or 2"
    if gc_def != 1 and mode != "codon":
        return "gc_def needs codon mode"
    if iter_refine < 0:
        return "iter_refine must not be negative"
    return None


def group_status(seqs: DataFrame, mode: str) -> DataFrame:
    """``msa_id``, ``status``, ``error``: an empty or null sequence, or letters outside the alphabet, refuse the group."""
    fits: Column = is_amino_acids(F.col("sequence")) if mode == "protein" else is_nucleotides(F.col("sequence"))
    empty = F.coalesce(F.length("sequence"), F.lit(0)) == 0
    out = seqs.groupBy("msa_id").agg(F.bool_or(empty).alias("e"), F.bool_or(~F.coalesce(fits, F.lit(True))).alias("b"))
    error = F.when(F.col("e"), "empty sequence").when(F.col("b"), f"letters outside the {mode} alphabet")
    return out.select("msa_id", F.when(error.isNull(), "ok").otherwise("invalid_argument").alias("status"), error.alias("error"))


def msa_align(seqs: DataFrame, mode: str = "dna", gc_def: int = 1, iter_refine: int = 0) -> DataFrame:
    """``msa_id``, ``ord``, ``seq_id``, ``aligned``, ``width``, ``frame``, ``stops``, ``partial`` (the last three -1 outside codon mode); refused groups are left out."""
    error = request_error(mode, gc_def, iter_refine)
    if error:
        raise ValueError(error)
    params = PRESETS[mode]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        seqs_, facts = list(pdf["sequence"]), [(-1, -1, -1)] * len(pdf)
        if mode == "codon":
            made = [_encode(s, gc_def) for s in seqs_]
            facts = [m[1:] for m in made]
            rows = [_decode(r) for r in align_group([m[0] for m in made], params, gc_def, iter_refine)]
        else:
            rows = align_group(seqs_, params, gc_def, iter_refine)
        return pd.DataFrame({"msa_id": pdf["msa_id"], "ord": pdf["ord"], "seq_id": pdf["seq_id"], "aligned": rows, "width": len(rows[0]), "frame": [f[0] for f in facts], "stops": [f[1] for f in facts], "partial": [f[2] for f in facts]})

    good = group_status(seqs, mode).where("status = 'ok'").select(F.col("msa_id").alias("_m"))
    ok = seqs.join(good, F.col("msa_id") == F.col("_m"), "left_semi").select(F.col("msa_id").cast("long"), F.col("ord").cast("long"), F.col("seq_id").cast("string"), "sequence")
    return ok.groupBy("msa_id").applyInPandas(run, "msa_id long, ord long, seq_id string, aligned string, width int, frame int, stops int, partial int")


def output_contract(aligned: DataFrame) -> DataFrame:
    """``msa_id``, ``rows``, ``rectangular``."""
    return aligned.groupBy("msa_id").agg(F.count("*").alias("rows"), (F.min(F.length("aligned")) == F.max(F.length("aligned"))).alias("rectangular"))
