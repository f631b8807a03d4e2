"""Columns over nucleotide and amino-acid sequences. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqspark.tables import CODON_BASES, GENETIC_CODES, IUPAC, LOWER_BASES, stop_codons

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letters(text: Column) -> Column:
    """ASCII letters, upper-cased: text as a protein."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def as_dna(text: Column) -> Column:
    """Text as nucleotides: its letters, dealt over A, C, G, T."""
    return F.translate(letters(text), LETTERS, ("ACGT" * 7)[:26])


def is_nucleotides(s: Column) -> Column:
    return s.rlike("(?i)^[ACGTURYSWKMBDHVN?]*$")


def is_amino_acids(s: Column) -> Column:
    return s.rlike("^[A-Za-z*?]*$")


def ungapped(row: Column) -> Column:
    return F.replace(row, F.lit("-"), F.lit(""))


def base_share(s: Column, base: str) -> Column:
    """Sum over the letters of the share of ``base`` in what each stands for."""
    out = F.lit(0.0)
    for code, bases in IUPAC.items():
        if base in bases:
            out = out + F.regexp_count(s, F.lit(f"[{code}{code.lower() if code.lower() in LOWER_BASES else ''}]")) / float(len(bases))
    return out


def codons(s: Column, frame: Column | int = 0) -> Column:
    """Complete codons from ``frame`` on, in one pass over the sequence."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.regexp_extract_all(F.substring(s, frame + 1, F.length(s)), F.lit("(?s)(.{3})"))


def stops_in_frame(s: Column, frame: int, code: int = 1) -> Column:
    return F.size(F.filter(codons(s, frame), lambda c: c.isin(*stop_codons(code))))


def best_frame(s: Column, code: int = 1) -> Column:
    """A struct ``stops``, ``frame``: the frame with fewest stops, the first of several."""
    return F.array_min(F.array(*[F.struct(stops_in_frame(s, f, code).alias("stops"), F.lit(f).alias("frame")) for f in range(3)]))


def codon_index(codon: Column) -> Column:
    """0 .. 63 with T, C, A, G as 0 .. 3; 64 where a letter is ambiguous or missing."""
    at = [F.instr(F.lit(CODON_BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    plain = F.upper(codon).rlike("^[TCAG]{3}$")
    return F.when(plain, 16 * at[0] + 4 * at[1] + at[2]).otherwise(64)


def codon_tokens(s: Column, code: int = 1) -> Column:
    """A struct ``frame``, ``stops``, ``partial``, ``tokens`` in the best frame; a trailing partial codon is token 64."""

    def of(best: Column) -> Column:
        partial = ((F.length(s) - best["frame"]) % 3 != 0) & (F.length(s) > best["frame"])
        tokens = F.transform(codons(F.upper(s), best["frame"]), codon_index)
        return F.struct(
            best["frame"].alias("frame"), best["stops"].alias("stops"), partial.cast("int").alias("partial"),
            F.when(partial, F.concat(tokens, F.array(F.lit(64)))).otherwise(tokens).alias("tokens"),
        )

    return let(best_frame(F.upper(s), code), of)


def decode_tokens(tokens: Column) -> Column:
    """Three letters for each token; -1 is a gap, 64 is unknown."""
    b = F.lit(CODON_BASES)
    letter = lambda k: F.substring(b, k + 1, F.lit(1))

    def one(t: Column) -> Column:
        return F.when(t < 0, "---").when(t == 64, "NNN").otherwise(F.concat(letter((t / 16).cast("int")), letter((t / 4).cast("int") % 4), letter(t % 4)))

    return F.array_join(F.transform(tokens, one), "")


def translate_nt(s: Column, frame: Column | int = 0, code: int = 1) -> Column:
    """Amino acids of the complete codons; X where a codon is ambiguous."""
    table = F.lit(GENETIC_CODES[code] + "X")
    return F.array_join(F.transform(codons(F.upper(s), frame), lambda c: F.substring(table, codon_index(c) + 1, F.lit(1))), "")


def kmer_set(s: Column, k: int = 5, alphabet: str = "ACGT") -> Column:
    """Distinct k-mers of plain letters; an ambiguous letter breaks the run. U counts as T."""
    up = F.replace(F.upper(s), F.lit("U"), F.lit("T")) if alphabet == "ACGT" else F.upper(s)
    return F.array_distinct(F.regexp_extract_all(up, F.lit(f"(?=([{alphabet}]{{{k}}}))")))


def gap_runs(row: Column) -> Column:
    """Lengths of the maximal gap runs."""
    return F.transform(F.regexp_extract_all(row, F.lit("(-+)")), F.length)
