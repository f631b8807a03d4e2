"""Fixed values of the sequence model: alphabets, genetic codes, substitution scores, presets.

These are fixed by the model (results depend on each of them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: IUPAC nucleotide codes and the bases that each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT",
}
#: Lower-case letters that count as bases; other lower-case codes count as gaps.
LOWER_BASES = "acgtun"

#: Amino acids in the order of the substitution matrix.
AMINO = "ARNDCQEGHILKMFPSTWYV"
#: BLOSUM62, lower triangle, rows in the order of ``AMINO``.
BLOSUM62_ROWS = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def blosum62() -> np.ndarray:
    out = np.zeros((20, 20), np.float32)
    for i, row in enumerate(BLOSUM62_ROWS.split("\n")[1:-1]):
        out[i, : i + 1] = [int(x) for x in row.split()]
    return np.maximum(out, out.T) + np.minimum(out, out.T) - np.diag(np.diag(out))


#: Codons count T, C, A, G as 0 .. 3; amino acids of the 64 codons in that order, by genetic code.
CODON_BASES = "TCAG"
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
}


def stop_codons(code: int) -> list[str]:
    b = CODON_BASES
    return [b[k // 16] + b[k // 4 % 4] + b[k % 4] for k, a in enumerate(GENETIC_CODES[code]) if a == "*"]


@dataclass(frozen=True)
class Params:
    """Parameters of multiple alignment."""

    alpha: int = 4
    kmer_k: int = 5
    match: float = 2
    transition: float = -1
    transversion: float = -2
    gap_open: float = 3
    gap_extend: float = 1
    free_ends: bool = True
    position_gaps: bool = True
    gappy: float = 0.95
    stop_penalty: float = 60
    nt_bonus: float = 1


PRESETS = {
    "dna": Params(),
    "protein": Params(alpha=20, kmer_k=2, gap_open=11, gap_extend=1, free_ends=False),
    "codon": Params(alpha=65, kmer_k=3, gap_open=11, gap_extend=1),
}
#: Cells of one traced local alignment, at most.
MOST_CELLS = 1 << 26
MOST_SMAX = 511
