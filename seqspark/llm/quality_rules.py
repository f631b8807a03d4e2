"""Operator 10: quality rules by cross-document line frequency. DataFrame functions only.

Method. Each line that holds a word is normalised (A-Z lower-cased, white space
to single spaces, trimmed) and hashed. For each host the distinct documents of
each line are counted. A line in more than ``max(min_docs, max_share * documents
of the host)`` documents is boilerplate and removed; a document that loses more
than ``max_loss`` of its words that way is depleted and rejected. Copies of one
document count as one document: a document stands by a hash of all its
normalised lines in their order, which its copies share.

Base rules come first: fewer than 50 words, or over half of the words in 3-word
windows that the text repeats, fail a document.

Scale. Two scans and no shuffle of texts. The line counts shuffle (host, line,
document) hashes, pre-aggregated on the map side, so a line that a third of all
documents hold arrives as partial counts. A host has fewer than
``lines per document / max_share`` boilerplate lines; they join as one array for
each host, broadcast only when their counted number is at most
``BROADCAST_LINES``, else by a shuffle on host whose skewed side AQE splits.

Edge cases. A null text has no words and fails. A null host is a host of its own. Repeated
rows each get their result and count as one document. Lines and texts of any
length are taken whole. Other columns are ignored, or kept by
``quality_filter``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_LINES = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def normal_line(line: Column) -> Column:
    return F.translate(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), SPACE, " "), UPPER, LOWER)


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that the sequence holds twice or more, by 64-bit window hashes."""

    def covered(wins: Column) -> Column:
        pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            n = F.size(s)
            again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).cast("long").alias("n"), i.cast("int").alias("last"))
        # each marked window adds the words since the last one's start, size at most
        return F.aggregate(let(pairs, marked), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).cast("int").alias("last")), step, lambda acc: acc["n"])

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - size)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    def counted(wins: Column) -> Column:
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(covered(wins))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), counted))


def base_rules(df: DataFrame, text: Column, min_words: int = 50) -> DataFrame:
    """Adds the base counts and ``base_failed``."""
    t = F.coalesce(text, F.lit(""))
    lines = lines_of(t)
    out = (
        df.withColumn("_words", words_of(t))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: (F.size(h) - F.size(F.array_distinct(h))).cast("long")))
        .withColumn("n_repeat_words", repeat_words(F.col("_words")))
    )
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_words")


def boilerplate_lines(df: DataFrame, text_col: str, host_col: str, min_docs: int = 20, max_share: float = 0.1) -> DataFrame:
    """Of each host (``_host``) the line hashes above the limits (``_bad``, an array) and their number."""
    lines = F.transform(lines_of(F.coalesce(F.col(text_col), F.lit(""))), line_hash)
    both = let(lines, lambda x: F.struct(F.xxhash64(x).alias("doc"), F.array_distinct(x).alias("lines")))
    rows = df.select(F.col(host_col).alias("_host"), both.alias("_both")).where(F.size("_both.lines") > 0)
    rows = rows.select("_host", F.col("_both.doc").alias("_doc"), F.col("_both.lines").alias("_lines"))
    # a null line in every document counts the host's documents in the same pass
    each = rows.select("_host", "_doc", F.explode(F.concat("_lines", F.array(F.lit(None).cast("long")))).alias("_line")).distinct()
    held = materialize(each.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where((F.col("_n") > min_docs) | F.col("_line").isNull()), "lines")
    hosts = held.where("_line is null").select(F.col("_host").alias("_h2"), F.col("_n").alias("_docs"))
    over = held.where("_line is not null").join(hosts, F.col("_host").eqNullSafe(F.col("_h2"))).where(F.col("_n") > max_share * F.col("_docs"))
    return over.groupBy("_host").agg(F.collect_set("_line").alias("_bad"))


def judged(df: DataFrame, text_col: str = "text", host_col: str = "source", max_loss: float = 0.5, **limits) -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``kept`` and ``_bad``, the line hashes that its host loses."""
    bad = boilerplate_lines(df, text_col, host_col, **limits)
    bad = materialize(bad.withColumnRenamed("_host", "_bad_host"), "boilerplate")
    n = bad.agg(F.coalesce(F.sum(F.size("_bad")), F.lit(0)) + F.count("*")).first()[0]
    side = F.broadcast(bad) if n <= BROADCAST_LINES else bad
    out = base_rules(df, df[text_col]).join(side, F.col(host_col).eqNullSafe(F.col("_bad_host")), "left").drop("_bad_host")
    lost = F.when(F.col("_bad").isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(F.filter(lines_of(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.array_contains(F.col("_bad"), line_hash(x))), F.lit(0).cast("long"), lambda a, x: a + F.size(words_of(x)))
    )
    return out.withColumn("kept", ~F.col("base_failed") & (lost <= max_loss * F.col("n_words")))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row for each row: the id, ``n_words``, the base counts, ``base_failed`` and ``kept``."""
    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_source"))
    out = judged(own, "_text", "_source", **limits)
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(df: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, with their columns as they were and boilerplate lines removed from their texts."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"), F.col(host_col).alias("_source"))
    out = judged(packed, "_text", "_source", **limits).where("kept")
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains(F.col("_bad"), line_hash(x))), "\n")
    out = out.withColumn("_text", F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(left))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns])
