"""Kernels against plain dynamic programming and literal values."""

import random

import numpy as np
import pytest

from seqspark.kernels import local_align, neighbour_joining
from seqspark.operators.msa import _decode, _encode, align_group
from seqspark.operators.pairwise import levenshtein_dp, wavefront_cigar
from seqspark.sources.fasta import parse
from seqspark.sources.newick import parse_newick
from seqspark.tables import PRESETS, blosum62


@pytest.mark.parametrize("a,b,d", [("ACGT", "ACGT", 0), ("ACGT", "ACGA", 1), ("GG", "TTT", 3), ("CT", "CCC", 2), ("CG", "GAC", 3), ("TTTTTTTT", "TTTT", 4), ("ACGTACGT", "TTTTTTTT", 6), ("", "ACGT", 4), ("ACGT", "", 4), ("", "", 0)])
def test_edit_literals(a, b, d):
    cigar = wavefront_cigar(a, b, max(len(a), len(b)))
    assert levenshtein_dp(a, b) == d == sum(c != "M" for c in cigar)


def test_edit_random():
    rng = random.Random(2)
    for _ in range(800):
        p, t = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14))) for _ in range(2))
        cigar, i, j = wavefront_cigar(p, t, 30), 0, 0
        for c in cigar:
            if c in "MX":
                assert (p[i] == t[j]) == (c == "M")
            i, j = i + (c in "MXD"), j + (c in "MXI")
        d = levenshtein_dp(p, t)
        assert (i, j, sum(c != "M" for c in cigar)) == (len(p), len(t), d)
        if p and t and d:
            assert wavefront_cigar(p, t, d - 1) is None


def _plain_sw(t, p, match, mismatch, go, ge):
    h = np.zeros((len(t) + 1, len(p) + 1), int)
    e, f, best = h - 10**6, h - 10**6, (0, -1, -1)
    for i in range(1, len(t) + 1):
        for j in range(1, len(p) + 1):
            e[i, j] = max(h[i, j - 1] - go, e[i, j - 1] - ge)
            f[i, j] = max(h[i - 1, j] - go, f[i - 1, j] - ge)
            h[i, j] = max(0, h[i - 1, j - 1] + (match if t[i - 1] == p[j - 1] else mismatch), e[i, j], f[i, j])
            if h[i, j] > best[0]:
                best = (h[i, j], i - 1, j - 1)
    return best


def test_local_random():
    rng = random.Random(1)
    texts, patterns = (["".join(rng.choice("ACG") for _ in range(rng.randint(0, 15))) for _ in range(150)] for _ in range(2))
    for scheme in ((2, -3, 5, 2), (1, -1, 2, 1)):
        for t, p, r in zip(texts, patterns, local_align(texts, patterns, *scheme, True), strict=True):
            assert (r[0], r[3], r[4]) == _plain_sw(t, p, *scheme)


def test_local_literals():
    got = local_align(["TTTACGTGTT", "AAAAAAAA"], ["ACGTGT", "CCCCCCCC"], 2, -3, 5, 2, True)
    assert got == [(12, 3, 0, 8, 5, "MMMMMM"), (0, -1, -1, -1, -1, "")]
    assert [r[0] for r in local_align(["ACGTTTACGT", "ACACACAC"], ["ACGTACGT", "ACAC"], 1, -1, 2, 1, False)] == [5, 4]


def test_tree_and_tables():
    d = np.array([[0, 1, 5, 5], [1, 0, 5, 5], [5, 5, 0, 1], [5, 5, 1, 0]], float)
    assert neighbour_joining(d) == [(0, 1), (2, 3), (4, 5)]
    assert neighbour_joining(np.zeros((1, 1))) == []
    b = blosum62()
    assert (b == b.T).all() and b[17, 17] == 11


def test_msa_literals():
    dna = PRESETS["dna"]
    assert align_group(["ACGTACGT", "ACGTACGT"], dna) == ["ACGTACGT"] * 2
    a, b = align_group(["ACGTACGT", "ACGTTTTACGT"], dna)
    assert len(a) == len(b) == 11 and a.count("-") == 3 and a[0] != "-" != a[-1]
    a, b = align_group(["ACGTTGCAAGGCTTACCGTA", "TGCAAGGC"], dna)
    assert len(a) == 20 and b.strip("-") == "TGCAAGGC"
    assert align_group(["ACGT"], dna) == ["ACGT"]
    tokens, frame, stops, partial = _encode("TAAATAAGTAG", 1)
    assert (frame, stops, partial) == (0, 1, 1) and _decode(tokens) == "TAAATAAGTNNN"


def test_parsers():
    assert parse(">a first\r\nAC\r\n\r\nGT\n>b\nnN\n") == [("a", "first", "ACGT"), ("b", "", "nN")]
    for bad in ("ACGT\n", ">\nAC\n", ">a\n>b\nAC\n", ""):
        with pytest.raises(ValueError):
            parse(bad)
    nodes = parse_newick("((a:1,'b c':2)x:3,[note]d);")
    assert sorted(n for _, _, n in nodes if n) == ["a", "b c", "d", "x"] and nodes[0][1] == -1
