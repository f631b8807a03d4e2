"""Operator 9: URL filters by a blocked Bloom filter and an exact hash join. DataFrame functions only.

Method. Listed canonical URLs (``host/path`` prefixes, or whole URLs) go into a
split-block Bloom filter: a key picks one block of eight 64-bit words and sets
one bit in each word. Each page's canonical URL yields the keys that a listed
entry could have: every tail of its host with as many labels as some entry
has, with every head of its path as long as some entry's path. Keys whose bits
are all set are possible hits; they go to an exact hash join with the list,
which removes false positives. Of several entries the longest wins.

The filter is a table of its blocks. It is broadcast only when the counted
list bounds it to ``BROADCAST_BYTES``; beyond that it joins by shuffle. Only
distinct (host, path) pairs are probed, so a URL that a third of all pages
share is probed once, and the verdicts join back on that pair.

Edge cases. A null url, or one without ``://``, has empty host and path, fits
no entry and gets ``default``. Repeated rows are kept. Entries listed twice
count once if they agree (else the smaller verdict string wins). An empty list gives every
page ``default``. Columns of the input other than id and url are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
WORDS = 8
#: Odd multipliers, one for each word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bits(h: Column) -> list[Column]:
    """For each word of a block the bit that a key sets."""
    return [F.shiftrightunsigned(F.shiftleft(F.pmod(h, F.lit(1 << 31)) * F.lit(s), 1), 58).cast("int") for s in SALTS]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's table: ``block`` and its words ``w0`` .. ``w7``; ``keys`` has one column ``key``."""
    h = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
    return h.groupBy("block").agg(*[F.bit_or(_one(b)).alias(f"w{k}") for k, b in enumerate(_bits(F.col("h")))])


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def possible_hits(probes: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """The rows of ``probes`` (with a column ``key``) whose bits are all set."""
    p = probes.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("_h", F.xxhash64("key", F.lit(1)))
    set_ = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(_one(b)) != 0 for k, b in enumerate(_bits(F.col("_h")))])
    side = F.broadcast(bloom) if small else bloom
    return p.join(side, p["_b"] == side["block"]).where(set_).select(*probes.columns)


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: the id, ``host``, ``path``, ``rule`` (the entry's ``host`` + ``path``, or null) and ``verdict``.

    ``listed`` has ``host`` (lower case; it fits its subdomains too), ``path``
    (a prefix, empty for all) and ``verdict``.
    """
    entries = listed.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(F.col("host").alias("_eh"), F.col("path").alias("_ep"), F.col("verdict").alias("_ev"), _key(F.col("host"), F.col("path")).alias("_ek"))
    labels = F.size(F.split("_eh", r"\."))
    # bounded by the longest host and path that are listed, not by their number
    shape = entries.agg(F.count("*"), F.collect_set(labels), F.collect_set(F.length("_ep"))).first()
    n, label_counts, lengths = shape[0], sorted(shape[1]), sorted(shape[2])
    page = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if n == 0:
        return page.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    blocks = max(1, -(-n * 12 // 512))
    small = blocks * 80 <= BROADCAST_BYTES
    tails = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in label_counts]))
    long_enough = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length("path"))
    probes = (
        page.select("host", "path").where(F.col("host") != "").distinct()
        .withColumn("_tail", F.explode(tails))
        .withColumn("_head", F.explode(F.transform(long_enough, lambda k: F.substring(F.col("path"), F.lit(1), k))))
        .select("host", "path", _key(F.col("_tail"), F.col("_head")).alias("key"))
    )
    bloom = bloom_filter(entries.select(F.col("_ek").alias("key")), blocks)
    hits = possible_hits(probes, bloom, blocks, small)
    exact = hits.join(entries, hits["key"] == entries["_ek"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("_ek"), F.concat("_eh", "_ep").alias("rule"), F.col("_ev").alias("verdict"))).alias("_best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_best")
    out = page.join(best, (page["host"] == best["_h"]) & (page["path"] == best["_p"]), "left")
    return out.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
