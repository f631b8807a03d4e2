"""Homology and reading-frame quality control of records against a bait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.cigar import coverage, net_frameshift, qc_flag, soft_frameshifts
from seqspark.functions.sequence import stops_in_frame
from seqspark.operators.local import align_sw
from seqspark.tables import stop_codons


def choose_bait(baits: DataFrame, code: int = 1) -> DataFrame:
    """One row (``seq_id``, ``sequence``, ``frame``): fewest stops, then an ATG start, then the longer record, then the earlier one."""
    frames = baits.withColumn("frame", F.explode(F.array(*[F.lit(f) for f in range(3)])))
    stops = F.coalesce(*[F.when(F.col("frame") == f, stops_in_frame(F.upper("sequence"), f, code)) for f in range(3)])
    start = F.upper(F.substring(F.col("sequence"), F.col("frame") + 1, F.lit(3))) == "ATG"
    rank = F.struct(stops, F.when(start, 0).otherwise(1), -F.length("sequence"), "ord", "frame")
    return frames.agg(F.min_by(F.struct("seq_id", "sequence", "frame"), rank).alias("b")).select("b.*")


def guided_stops(cigar: Column, text: Column, start_i: Column, start_j: Column, frame: Column, code: int = 1) -> Column:
    """A struct ``stops``, ``stop_end``: stop codons of the text in the bait's reading frame.

    A codon counts if its three bait positions were met without a D; an
    insertion does not break it. A stop in the last complete codon is the end
    (``stop_end`` 1) and is not among ``stops``.
    """

    def step(s: Column, op: Column) -> Column:
        on = op.isin("M", "X")
        phase = F.pmod(s["j"] - frame, F.lit(3))
        base = F.upper(F.substring(text, s["i"] + 1, F.lit(1)))
        codon = F.when(op == "D", "").when(on & (phase == 0), base).when(on & (s["codon"] != ""), F.concat(s["codon"], base)).when(on, "").otherwise(s["codon"])
        full = on & (phase == 2) & (F.length(codon) == 3)
        stop = full & codon.isin(*stop_codons(code))
        return F.struct(
            (s["i"] + op.isin("M", "X", "I").cast("int")).alias("i"), (s["j"] + op.isin("M", "X", "D").cast("int")).alias("j"),
            F.when(full, "").otherwise(codon).alias("codon"), (s["stops"] + stop.cast("int")).alias("stops"), F.when(full, stop.cast("int")).otherwise(s["last"]).alias("last"),
        )

    zero = F.struct(start_i.cast("int").alias("i"), start_j.cast("int").alias("j"), F.lit("").alias("codon"), F.lit(0).alias("stops"), F.lit(0).alias("last"))
    ops = F.filter(F.split(cigar, ""), lambda c: c != "")
    return F.aggregate(ops, zero, step, lambda s: F.struct((s["stops"] - s["last"]).alias("stops"), s["last"].alias("stop_end")))


def gene_qc(seqs: DataFrame, baits: DataFrame, code: int = 1, min_cov: float = 0.5, min_score: int = 0, scheme: tuple[int, int, int, int] = (1, -1, 2, 1)) -> DataFrame:
    """One row for each record: acc, len, score, si, sj, ei, ej, cov_text, fs_runs, fs_net, stops, stop_end, flag."""
    bait = choose_bait(baits, code).select(F.col("sequence").alias("pattern"), F.col("frame").alias("bait_frame"))
    pairs = seqs.withColumnRenamed("sequence", "text").join(F.broadcast(bait), on=F.lit(True))  # one row
    a = align_sw(pairs, *scheme)
    a = a.withColumn("g", guided_stops(F.col("cigar"), F.col("text"), F.col("start_i"), F.col("start_j"), F.col("bait_frame"), code))
    none = ~F.col("resolved") | (F.col("sw_score") <= min_score)
    cov = F.when(F.col("sw_score") > 0, coverage(F.col("start_i"), F.col("end_i"), F.length("text"))).otherwise(0.0)
    shift = net_frameshift(F.col("cigar"))
    return a.select(
        F.col("seq_id").alias("acc"), F.length("text").alias("len"), F.col("sw_score").alias("score"), F.col("start_i").alias("si"), F.col("start_j").alias("sj"), F.col("end_i").alias("ei"), F.col("end_j").alias("ej"),
        F.round(cov, 3).alias("cov_text"), soft_frameshifts(F.col("cigar")).alias("fs_runs"), shift.alias("fs_net"), F.col("g.stops").alias("stops"), F.col("g.stop_end").alias("stop_end"),
        qc_flag(none, cov, min_cov, shift, F.col("g.stops")).alias("flag"),
    )


def flag_counts(qc: DataFrame) -> DataFrame:
    """How many records carry each flag; one record may count in several."""
    f = F.col("flag")
    return qc.agg(F.count("*").alias("n"), F.count_if(f == "OK").alias("ok"), F.count_if(f == "NO_ALIGN").alias("no_align"), F.count_if(f.contains("LOW_COV")).alias("low_cov"), F.count_if(f.contains("FS=")).alias("frameshift"), F.count_if(f.contains("STOP=")).alias("stop"))
