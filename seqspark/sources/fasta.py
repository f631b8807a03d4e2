"""FASTA as tables: ``file``, ``ord``, ``seq_id``, ``description``, ``sequence``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, ord long, seq_id string, description string, sequence string"


def parse(text: str, strict: bool = True) -> list[tuple[str, str, str]]:
    """(id, description, sequence) of each record; raises ``ValueError`` on malformed input if ``strict``.

    Lines end in LF, CRLF or CR; blank lines are skipped; letters are kept as they are.
    """
    out: list[tuple[str, str, list[str]]] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.startswith(">"):
            if strict and out and not any(out[-1][2]):
                raise ValueError(f"record {out[-1][0]!r} has no sequence")
            name, _, rest = line[1:].strip().replace("\t", " ").partition(" ")
            if strict and not name:
                raise ValueError("a record has no id")
            out.append((name, rest.strip(), []))
        elif line.strip() and not (not out and line[0] in " \t"):
            if not out:
                if strict:
                    raise ValueError("text before the first record")
                continue
            if line[0] not in " \t":
                out[-1][2].append(line)
    if strict and not out:
        raise ValueError("no records")
    if strict and not any(out[-1][2]):
        raise ValueError(f"record {out[-1][0]!r} has no sequence")
    return [(a, b, "".join(c)) for a, b, c in out]


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every record of the files at ``path`` (one file is one row of input, so it is read by one task)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(f, k, *r) for f, t in zip(pdf["file"], pdf["value"], strict=True) for k, r in enumerate(parse(t, strict))]
            yield pd.DataFrame(rows, columns=["file", "ord", "seq_id", "description", "sequence"])

    # line ends are kept: the separator never occurs in a FASTA file
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, SCHEMA)


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """One column ``value`` in input order: each record's two lines."""
    return seqs.orderBy("ord").select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Writes records in order, one part file for each range of the order."""
    fasta_lines(seqs).write.mode("overwrite").text(path)


def last_of_each_id(seqs: DataFrame) -> DataFrame:
    """``seq_id``, ``sequence``: duplicate ids joined in order, upper case."""
    return seqs.groupBy("seq_id").agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sequence"))), lambda x: x["sequence"]), "")).alias("sequence"))
