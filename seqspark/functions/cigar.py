"""CIGAR columns, over the operations M (match), X (mismatch), I (takes text), D (takes pattern). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(cigar: Column) -> Column:
    """Maximal runs, as an array of strings."""
    return F.regexp_extract_all(cigar, F.lit("(M+|X+|I+|D+)"))


def run_length(cigar: Column) -> Column:
    """``3M1X2I``; an empty CIGAR is ``-``."""
    packed = F.array_join(F.transform(runs(cigar), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
    return F.when(packed == "", F.lit("-")).otherwise(packed)


def cost(cigar: Column) -> Column:
    return F.regexp_count(cigar, F.lit("[XID]"))


def soft_frameshifts(cigar: Column) -> Column:
    """Maximal I or D runs whose length is no multiple of 3."""
    return F.size(F.filter(F.regexp_extract_all(cigar, F.lit("(I+|D+)")), lambda r: F.length(r) % 3 != 0))


def net_frameshift(cigar: Column) -> Column:
    """(I - D) modulo 3 as -1, 0 or 1."""
    m = F.pmod(F.regexp_count(cigar, F.lit("I")) - F.regexp_count(cigar, F.lit("D")), F.lit(3))
    return F.when(m == 2, -1).otherwise(m)


def replay(cigar: Column, pattern: Column, text: Column) -> Column:
    """A struct ``p``, ``t`` (letters taken), ``cost``, ``ok``: the CIGAR acted out on both sequences from their starts.

    ``ok`` turns false at the first operation that runs past an end, or whose
    letters do not bear it out.
    """
    op = lambda a, c: a == c

    def step(s: Column, c: Column) -> Column:
        takes_p, takes_t = c.isin("M", "X", "D"), c.isin("M", "X", "I")
        p, t = s["p"] + takes_p.cast("int"), s["t"] + takes_t.cast("int")
        same = F.substring(pattern, s["p"] + 1, F.lit(1)) == F.substring(text, s["t"] + 1, F.lit(1))
        fits = (p <= F.length(pattern)) & (t <= F.length(text)) & c.isin("M", "X", "I", "D")
        fits = fits & F.when(op(c, "M"), same).when(op(c, "X"), ~same).otherwise(F.lit(True))
        return F.struct(p.alias("p"), t.alias("t"), (s["cost"] + (c != "M").cast("int")).alias("cost"), (s["ok"] & fits).alias("ok"))

    ops = F.when(cigar == "", F.array().cast("array<string>")).otherwise(F.split(cigar, ""))
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("t"), F.lit(0).alias("cost"), F.lit(True).alias("ok"))
    return F.aggregate(F.filter(ops, lambda c: c != ""), zero, step)


def global_check(cigar: Column, pattern: Column, text: Column, score: Column) -> Column:
    """A struct ``rescore_ok``, ``wellformed_ok``; both false where there is no CIGAR."""
    r = replay(cigar, pattern, text)
    whole = r["ok"] & (r["p"] == F.length(pattern)) & (r["t"] == F.length(text))
    some = F.length(cigar) > 0
    return F.struct((some & (r["cost"] == score)).alias("rescore_ok"), (some & whole).alias("wellformed_ok"))


def coverage(start: Column, end: Column, length: Column) -> Column:
    return (end - start + 1) / length


def qc_flag(unaligned: Column, cov: Column, min_cov: float, shift: Column, stops: Column) -> Column:
    """``NO_ALIGN``, or ``LOW_COV``, ``FS=+1``, ``STOP=n`` joined by ``+``, or ``OK``."""
    parts = F.concat_ws(
        "+", F.when(cov < min_cov, "LOW_COV"), F.when(shift == 1, "FS=+1").when(shift == -1, "FS=-1"), F.when(stops > 0, F.concat(F.lit("STOP="), stops.cast("string")))
    )
    return F.when(unaligned, "NO_ALIGN").otherwise(F.coalesce(F.nullif(parts, F.lit("")), F.lit("OK")))
