"""Registry of the engine's queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import cigar as cg
from seqspark.functions import sequence as sq
from seqspark.operators import distances, local, msa, pairwise, qc, report, score, tree
from seqspark.plans import derive as dv
from seqspark.tables import GENETIC_CODES, IUPAC, LOWER_BASES, stop_codons

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "edit_distance_bounded"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ---- pairs ----

_BOUNDED = f"""{dv.SQL_PAIRS},
f AS (SELECT batch_id, min(smax) AS batch_smax FROM pairs GROUP BY batch_id),
a AS (SELECT pairs.*, batch_smax, CASE WHEN length(pattern) = 0 OR length(text) = 0 THEN greatest(length(pattern), length(text))
  WHEN levenshtein(pattern, text) <= batch_smax THEN levenshtein(pattern, text) ELSE -1 END AS edit_distance FROM pairs JOIN f USING (batch_id))"""


@query(f"WITH {_BOUNDED} SELECT batch_id, ord, batch_smax, CAST(edit_distance AS INTEGER) AS edit_distance, edit_distance >= 0 AS resolved FROM a")
def edit_distance_bounded(spark, sf_dir):
    return pairwise.align_edit(dv.part_pairs(spark, sf_dir)).select("batch_id", "ord", "batch_smax", "edit_distance", "resolved")


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: upper(x)) AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_zip(ws[:-2], ws[2:])) AS z FROM w WHERE len(ws) > 1)
SELECT doc_id, count(*) AS pairs, CAST(sum(levenshtein(z[1], z[2])) AS BIGINT) AS total, CAST(max(levenshtein(z[1], z[2])) AS INTEGER) AS largest FROM p GROUP BY doc_id""")
def edit_distance_words(spark, sf_dir):
    """Edit distances of every two consecutive words of every text."""
    words = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)")), F.upper)
    d = dv.table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).where(F.size("ws") > 1)
    each = d.select("doc_id", sq.let(F.col("ws"), lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.levenshtein(a, b))).alias("e"))
    return each.select("doc_id", F.size("e").cast("long").alias("pairs"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("e").alias("largest"))


@query(f"WITH {dv.SQL_PAIRS} SELECT batch_id, min(smax) AS batch_smax, true AS any_cigar FROM pairs GROUP BY batch_id")
def batch_smax_min(spark, sf_dir):
    return pairwise.batch_facts(dv.part_pairs(spark, sf_dir)).select("batch_id", "batch_smax", "any_cigar")


_BAD = "CASE WHEN p_size % 13 = 0 THEN -1 WHEN p_size % 17 = 0 THEN 512 ELSE p_size END"


@query(f"""WITH p AS (SELECT CAST(p_partkey // 10 AS BIGINT) AS batch_id, {_BAD} AS smax FROM part)
SELECT batch_id, CASE WHEN bool_or(smax < 0 OR smax > 511) THEN 'invalid_argument' ELSE 'ok' END AS status,
CASE WHEN bool_or(smax < 0 OR smax > 511) THEN 'smax must be in [0, 511]' END AS error FROM p GROUP BY batch_id""")
def pair_validation(spark, sf_dir):
    p = dv.table(spark, sf_dir, "part")
    pairs = p.select(F.floor(F.col("p_partkey") / 10).cast("long").alias("batch_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("pattern"), F.col("p_type").alias("text"), F.expr(_BAD).cast("int").alias("smax"), F.lit(False).alias("with_cigar"))
    return pairwise.batch_facts(pairs).select("batch_id", "status", "error")


@query(f"WITH {_BOUNDED} SELECT batch_id, 'ok' AS status, count(*) FILTER (edit_distance >= 0) AS resolved_count, count(*) FILTER (edit_distance < 0) AS unresolved_count FROM a GROUP BY batch_id")
def resolved_counts(spark, sf_dir):
    return pairwise.batch_summary(pairwise.align_edit(dv.part_pairs(spark, sf_dir)))


@query(f"WITH {_BOUNDED} SELECT ord, CAST(edit_distance AS INTEGER) AS edit_distance, edit_distance >= 0 AND length(pattern) + length(text) > 0 AS rescore_ok, edit_distance >= 0 AND length(pattern) + length(text) > 0 AS wellformed_ok FROM a")
def cigar_validate(spark, sf_dir):
    return pairwise.align_edit(dv.part_pairs(spark, sf_dir), cigars=True).select("ord", "edit_distance", "rescore_ok", "wellformed_ok")


@query()
def edit_cigar(spark, sf_dir):
    return pairwise.align_edit(dv.part_pairs(spark, sf_dir), cigars=True).select("ord", "edit_distance", "cigar")


# ---- local alignment ----


def sw_sql(pairs: str, match: int, mismatch: int, go: int, ge: int) -> str:
    """Rows of the table one after another; in a row E is the best earlier cell less its gap."""
    return f"""{pairs},
r(ord, i, h, f, best) AS (
  SELECT ord, 0, list_transform(range(0, length(pattern) + 1), lambda x: 0), list_transform(range(0, length(pattern) + 1), lambda x: -1000000), 0 FROM pairs
  UNION ALL
  SELECT ord, i, h, f, greatest(best, list_max(h)) FROM (
    SELECT ord, i, f, best, list_transform(range(1, len(z) + 1), lambda j: greatest(z[j], coalesce(list_max(list_transform(range(1, j), lambda k: z[k] - {go} - (j - k - 1) * {ge})), -1000000))) AS h FROM (
      SELECT ord, i, f, best, list_transform(range(1, len(f) + 1), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(0, f[j], h[j - 1] + CASE WHEN substring(text, i, 1) = substring(pattern, j - 1, 1) THEN {match} ELSE {mismatch} END) END) AS z FROM (
        SELECT r.ord, r.i + 1 AS i, r.h, list_transform(range(1, len(r.h) + 1), lambda j: CASE WHEN j = 1 THEN -1000000 ELSE greatest(r.h[j] - {go}, r.f[j] - {ge}) END) AS f, r.best, pairs.text, pairs.pattern
        FROM r JOIN pairs USING (ord) WHERE r.i < length(pairs.text))))),
sw AS (SELECT ord, CAST(max(best) AS INTEGER) AS sw_score FROM r GROUP BY ord)"""


@query(f"WITH RECURSIVE {sw_sql(dv.SQL_PAIRS, 2, -3, 5, 2)} SELECT ord, sw_score FROM sw")
def sw_score(spark, sf_dir):
    return local.align_sw(dv.part_pairs(spark, sf_dir), cigars=False).select("ord", "sw_score")


_TO_REF = f"pairs AS (SELECT CAST(p_partkey AS BIGINT) AS ord, {dv.sql_map('p_name')} AS text, (SELECT {dv.sql_map('p_name')} FROM part ORDER BY p_partkey LIMIT 1) AS pattern FROM part)"


@query(f"WITH RECURSIVE {sw_sql(_TO_REF, 1, -1, 2, 1)} SELECT ord, sw_score FROM sw")
def sw_to_reference(spark, sf_dir):
    """Every part's name against the first part's."""
    s = dv.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ord"), sq.as_dna(F.col("p_name")).alias("sequence"))
    return local.align_to_reference(s, s.orderBy("ord").limit(1)).select("ord", "sw_score")


@query(f"WITH RECURSIVE {sw_sql(dv.SQL_PAIRS, 2, -3, 5, 2)} SELECT ord, sw_score, sw_score > 0 AS placed FROM sw")
def sw_cigar_validate(spark, sf_dir):
    """The traced alignments, replayed: each CIGAR must end where the alignment does."""
    a = local.align_sw(dv.part_pairs(spark, sf_dir))
    inside = lambda s, lo, hi: F.when(F.col(lo) >= 0, F.substring(F.col(s), F.col(lo) + 1, F.col(hi) - F.col(lo) + 1)).otherwise("")
    r = cg.replay(F.col("cigar"), inside("pattern", "start_j", "end_j"), inside("text", "start_i", "end_i"))
    a = a.withColumn("r", r)
    return a.select("ord", "sw_score", (F.col("r.ok") & (F.col("r.p") == F.col("end_j") - F.col("start_j") + 1) & (F.col("r.t") == F.col("end_i") - F.col("start_i") + 1) & (F.col("start_i") >= 0)).alias("placed"))


@query()
def sw_cigar(spark, sf_dir):
    return local.align_sw(dv.part_pairs(spark, sf_dir)).select("ord", "sw_score", "start_i", "start_j", "end_i", "end_j", "cigar")


@query("""WITH p AS (SELECT CAST(p_partkey // 5 AS BIGINT) AS batch_id, p_partkey AS ord, p_size % 4 AS a, p_size % 5 - 3 AS b, p_size % 6 AS c, p_size % 3 AS d FROM part),
e AS (SELECT *, CASE WHEN a <= 0 THEN 'match must be positive' WHEN b >= a THEN 'mismatch must be below match' WHEN c <= 0 OR d <= 0 THEN 'gap costs must be positive' WHEN d > c THEN 'gap_extend must not exceed gap_open' END AS why FROM p),
g AS (SELECT batch_id, arg_min(why, ord) FILTER (why IS NOT NULL) AS why, count(DISTINCT {'a': a, 'b': b, 'c': c, 'd': d}) > 1 AS mixed FROM e GROUP BY batch_id)
SELECT batch_id, CASE WHEN why IS NULL AND NOT mixed THEN 'ok' ELSE 'invalid_argument' END AS status, coalesce(why, CASE WHEN mixed THEN 'mixed schemes in one batch' END) AS error FROM g""")
def sw_scheme_validation(spark, sf_dir):
    p = dv.table(spark, sf_dir, "part")
    s = F.col("p_size")
    pairs = p.select(F.floor(F.col("p_partkey") / 5).cast("long").alias("batch_id"), F.col("p_partkey").alias("ord"), (s % 4).alias("match"), (s % 5 - 3).alias("mismatch"), (s % 6).alias("gap_open"), (s % 3).alias("gap_extend"), F.lit(True).alias("with_cigar"))
    return local.scheme_status(pairs)


# ---- CIGARs, over texts mapped to operations ----


def _ops(spark, sf_dir):
    return dv.sequences(spark, sf_dir, to=dv.OPS)


_OPS = dv.sql_sequences(to=dv.OPS)


@query(f"""WITH {_OPS} SELECT seq_id, md5(CASE WHEN sequence = '' THEN '-' ELSE array_to_string(list_transform(regexp_extract_all(sequence, 'M+|X+|I+|D+'), lambda x: length(x)::VARCHAR || x[1]), '') END) AS rle FROM s""")
def cigar_rle(spark, sf_dir):
    return _ops(spark, sf_dir).select("seq_id", F.md5(cg.run_length(F.col("sequence"))).alias("rle"))


@query(f"WITH {_OPS} SELECT seq_id, CAST(length(replace(sequence, 'M', '')) AS INTEGER) AS cost FROM s")
def cigar_cost(spark, sf_dir):
    return _ops(spark, sf_dir).select("seq_id", cg.cost(F.col("sequence")).alias("cost"))


@query(f"WITH {_OPS} SELECT seq_id, CAST(len(list_filter(regexp_extract_all(sequence, 'I+|D+'), lambda x: length(x) % 3 <> 0)) AS INTEGER) AS fs_runs FROM s")
def frameshift_runs(spark, sf_dir):
    return _ops(spark, sf_dir).select("seq_id", cg.soft_frameshifts(F.col("sequence")).alias("fs_runs"))


@query(f"""WITH {_OPS}, n AS (SELECT seq_id, (((length(replace(sequence, 'D', '')) - length(replace(sequence, 'I', ''))) % 3) + 3) % 3 AS m FROM s)
SELECT seq_id, CAST(CASE WHEN m = 2 THEN -1 ELSE m END AS INTEGER) AS fs_net FROM n""")
def frameshift_net(spark, sf_dir):
    return _ops(spark, sf_dir).select("seq_id", cg.net_frameshift(F.col("sequence")).cast("int").alias("fs_net"))


@query("""WITH p AS (SELECT p_partkey, p_size % 7 = 0 AS none, p_retailprice / 2000.0 AS cov, p_size % 3 - 1 AS shift, p_size % 5 AS stops FROM part)
SELECT p_partkey, round(cov, 3) AS cov_text, CASE WHEN none THEN 'NO_ALIGN' ELSE coalesce(nullif(concat_ws('+', CASE WHEN cov < 0.5 THEN 'LOW_COV' END,
CASE WHEN shift = 1 THEN 'FS=+1' WHEN shift = -1 THEN 'FS=-1' END, CASE WHEN stops > 0 THEN 'STOP=' || stops END), ''), 'OK') END AS flag FROM p""")
def qc_flags(spark, sf_dir):
    p = dv.table(spark, sf_dir, "part")
    s, cov = F.col("p_size"), F.col("p_retailprice") / 2000.0
    return p.select("p_partkey", F.round(cov, 3).alias("cov_text"), cg.qc_flag(s % 7 == 0, cov, 0.5, s % 3 - 1, s % 5).alias("flag"))


# ---- sequences ----

_PROTEIN = f"s AS (SELECT CAST(doc_id AS BIGINT) AS seq_id, {dv.sql_letters('text')} AS sequence FROM documents)"


def _share_sql(base: str) -> str:
    return " + ".join(f"length(regexp_replace(sequence, '[^{c}{c.lower() if c.lower() in LOWER_BASES else ''}]', '', 'g')) / {len(b)}.0" for c, b in IUPAC.items() if base in b)


@query(f"WITH {_PROTEIN} SELECT seq_id, " + ", ".join(f"round({_share_sql(b)}, 4) AS {b.lower()}" for b in "ACGT") + " FROM s")
def iupac_counts(spark, sf_dir):
    s = dv.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("seq_id"), sq.letters(F.col("text")).alias("sequence"))
    return s.select("seq_id", *[F.round(sq.base_share(F.col("sequence"), b), 4).alias(b.lower()) for b in "ACGT"])


_STOPS = ", ".join(f"'{c}'" for c in stop_codons(1))


def _codons_sql(frame: str) -> str:
    return f"list_transform(range(0, greatest((length(sequence) - {frame}) // 3, 0)), lambda k: substring(sequence, {frame} + 3 * k + 1, 3))"


_FRAMES = f"""{dv.sql_sequences()},
st AS (SELECT *, {', '.join(f"len(list_filter({_codons_sql(str(f))}, lambda c: c IN ({_STOPS}))) AS s{f}" for f in range(3))} FROM s),
fr AS (SELECT *, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS frame FROM st)"""
_INDEX = "16 * (strpos('TCAG', c[1]) - 1) + 4 * (strpos('TCAG', c[2]) - 1) + strpos('TCAG', c[3])"


@query(f"WITH {_FRAMES} SELECT seq_id, CAST(s0 AS INTEGER) AS s0, CAST(s1 AS INTEGER) AS s1, CAST(s2 AS INTEGER) AS s2 FROM st")
def stops_in_frame(spark, sf_dir):
    return dv.sequences(spark, sf_dir).select("seq_id", *[sq.stops_in_frame(F.col("sequence"), f).alias(f"s{f}") for f in range(3)])


@query(f"""WITH {_FRAMES} SELECT seq_id, frame, CAST(least(s0, s1, s2) AS INTEGER) AS stops, CAST((length(sequence) - frame) % 3 <> 0 AND length(sequence) > frame AS INTEGER) AS partial,
CAST((length(sequence) - frame + 2) // 3 AS INTEGER) AS tokens FROM fr""")
def codon_frame(spark, sf_dir):
    t = dv.sequences(spark, sf_dir).where(F.length("sequence") > 2).withColumn("c", sq.codon_tokens(F.col("sequence")))
    return t.select("seq_id", "c.frame", "c.stops", "c.partial", F.size("c.tokens").alias("tokens"))


ORACLE["codon_frame"] += " WHERE length(sequence) > 2"


@query(f"""WITH {_FRAMES} SELECT seq_id, md5(array_to_string({_codons_sql('frame')}, '') || CASE WHEN (length(sequence) - frame) % 3 <> 0 THEN 'NNN' ELSE '' END) AS decoded FROM fr WHERE length(sequence) > 2""")
def codon_decode(spark, sf_dir):
    t = dv.sequences(spark, sf_dir).where(F.length("sequence") > 2).withColumn("c", sq.codon_tokens(F.col("sequence")))
    return t.select("seq_id", F.md5(sq.decode_tokens(F.col("c.tokens"))).alias("decoded"))


@query(f"WITH {dv.sql_sequences()} SELECT seq_id, md5(array_to_string(list_transform({_codons_sql('0')}, lambda c: substring('{GENETIC_CODES[1]}', {_INDEX}, 1)), '')) AS amino FROM s")
def translate(spark, sf_dir):
    return dv.sequences(spark, sf_dir).select("seq_id", F.md5(sq.translate_nt(F.col("sequence"))).alias("amino"))


def _kmers_sql(k: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length(sequence) - {k} + 2, 1)), lambda i: substring(sequence, i, {k})))"


@query(f"WITH {dv.sql_sequences()} SELECT seq_id, CAST(len({_kmers_sql(5)}) AS INTEGER) AS kmers FROM s")
def kmer_set_size(spark, sf_dir):
    return dv.sequences(spark, sf_dir).select("seq_id", F.size(sq.kmer_set(F.col("sequence"))).alias("kmers"))


_DIST = f"""{dv.sql_groups()}, k AS (SELECT msa_id, ord, {_kmers_sql(5)} AS ks FROM g),
e AS (SELECT a.msa_id, a.ord AS i, b.ord AS j, len(list_intersect(a.ks, b.ks)) AS shared, least(len(a.ks), len(b.ks)) AS m FROM k a JOIN k b ON a.msa_id = b.msa_id AND a.ord < b.ord),
d AS (SELECT msa_id, i, j, CAST(shared AS BIGINT) AS shared, CASE WHEN m = 0 THEN 1.0 ELSE 1.0 - shared::DOUBLE / m END AS d FROM e)"""


@query(f"WITH {_DIST} SELECT msa_id, i, j, shared, round(d, 5) AS d FROM d")
def kmer_distance(spark, sf_dir):
    return distances.kmer_distances(dv.groups(spark, sf_dir)).withColumn("d", F.round(F.col("d").cast("double"), 5))


@query(f"""WITH {_DIST}, b AS (SELECT msa_id, i, j, CAST(d AS FLOAT) AS d FROM d UNION ALL SELECT msa_id, j, i, CAST(d AS FLOAT) FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY msa_id, i ORDER BY d, j) AS rank FROM b) SELECT msa_id, i, CAST(rank AS INTEGER) AS rank, j FROM r WHERE rank <= 3""")
def knn_topk(spark, sf_dir):
    return distances.nearest_neighbours(distances.kmer_distances(dv.groups(spark, sf_dir))).drop("d")


@query(f"WITH {dv.sql_groups()}, k AS (SELECT ord, {_kmers_sql(4)} AS ks FROM g) SELECT a.ord, CAST(len(list_intersect(a.ks, b.ks)) AS INTEGER) AS both FROM k a JOIN k b ON b.ord = a.ord + 1")
def set_intersection(spark, sf_dir):
    k = dv.groups(spark, sf_dir).select("ord", sq.kmer_set(F.col("sequence"), 4).alias("ks"))
    n = k.select((F.col("ord") - 1).alias("_o"), F.col("ks").alias("other"))
    return k.join(n, F.col("ord") == F.col("_o")).select("ord", F.size(F.array_intersect("ks", "other")).alias("both"))


# ---- trees ----

_UP = "up(node, level) AS (SELECT node, 0 FROM t WHERE l < 0 UNION ALL SELECT t.node, up.level + 1 FROM up JOIN t ON t.l = up.node OR t.r = up.node)"


@query(f"WITH RECURSIVE {dv.sql_heap()}, {_UP} SELECT node, CAST(max(level) AS INTEGER) AS level FROM up GROUP BY node")
def tree_levels(spark, sf_dir):
    return tree.tree_levels(dv.heap_tree(spark, sf_dir)).select("node", "level")


def _splits_sql(t: str) -> str:
    return f"""b{t}(node, leaf) AS (SELECT node, node FROM {t} WHERE l < 0 UNION SELECT {t}.node, b{t}.leaf FROM b{t} JOIN {t} ON {t}.l = b{t}.node OR {t}.r = b{t}.node),
o{t} AS (SELECT list_sort(list(leaf)) AS side, list_sort(list_filter((SELECT list(node) FROM {t} WHERE l < 0), lambda x: NOT list_contains(list(leaf), x))) AS other FROM b{t} GROUP BY node),
s{t} AS (SELECT DISTINCT CASE WHEN len(side) < len(other) OR (len(side) = len(other) AND side < other) THEN side ELSE other END AS split FROM o{t} WHERE len(side) > 1 AND len(other) > 1)"""


@query(f"WITH RECURSIVE {dv.sql_heap()}, {_splits_sql('t')} SELECT array_to_string(split, ',') AS split FROM st")
def tree_splits(spark, sf_dir):
    return tree.splits(dv.heap_tree(spark, sf_dir)).select(F.array_join(F.transform("split", lambda x: x.cast("string")), ",").alias("split"))


@query(f"""WITH RECURSIVE {dv.sql_heap('t')}, {dv.sql_heap('u', True)}, {_splits_sql('t')}, {_splits_sql('u')},
c AS (SELECT (SELECT count(*) FROM (FROM st INTERSECT FROM su)) AS shared, (SELECT count(*) FROM st) + (SELECT count(*) FROM su) AS total)
SELECT CAST(0 AS BIGINT) AS msa_id, shared, total - 2 * shared AS rf, round((total - 2 * shared) / total, 6) AS rf_norm FROM c""")
def split_symdiff(spark, sf_dir):
    a, b = tree.splits(dv.heap_tree(spark, sf_dir)), tree.splits(dv.heap_tree(spark, sf_dir, turned=True))
    return tree.robinson_foulds(a, b).withColumn("rf_norm", F.round("rf_norm", 6))


_PROJECTED = "list_sort(list_filter(split, lambda x: x % 3 <> 0))"


@query(f"""WITH RECURSIVE {dv.sql_heap()}, {_splits_sql('t')},
e AS (SELECT list_sort(list(node)) AS every FROM t WHERE l < 0 AND node % 3 <> 0),
p AS (SELECT {_PROJECTED} AS side, list_sort(list_filter(every, lambda x: NOT list_contains(split, x))) AS other FROM st, e)
SELECT DISTINCT array_to_string(CASE WHEN len(side) < len(other) OR (len(side) = len(other) AND side < other) THEN side ELSE other END, ',') AS split
FROM p WHERE len(side) > 1 AND len(other) > 1""")
def project_taxa(spark, sf_dir):
    t = dv.heap_tree(spark, sf_dir)
    shared = t.where("left < 0 AND node % 3 <> 0").select("msa_id", F.col("node").alias("leaf"))
    return tree.project_splits(tree.splits(t), shared).select(F.array_join(F.transform("split", lambda x: x.cast("string")), ",").alias("split"))


@query(f"""WITH RECURSIVE {dv.sql_heap()},
up(leaf, node, far) AS (SELECT node, node, 0 FROM t WHERE l < 0 UNION ALL SELECT up.leaf, t.node, up.far + 1 + up.node % 4 FROM up JOIN t ON t.l = up.node OR t.r = up.node)
SELECT a.leaf AS i, b.leaf AS j, CAST(min(a.far + b.far) AS DOUBLE) AS d FROM up a JOIN up b ON a.node = b.node AND a.leaf < b.leaf GROUP BY a.leaf, b.leaf""")
def patristic_distance(spark, sf_dir):
    t = dv.heap_tree(spark, sf_dir).withColumn("length", (1 + F.col("node") % 4).cast("double"))
    return tree.patristic_distances(t).select("i", "j", "d")


def _nj(spark, sf_dir):
    g = dv.groups(spark, sf_dir)
    first = g.groupBy("msa_id").agg(F.min("ord").alias("o"), F.count("*").alias("n"))
    e = distances.kmer_distances(g).join(first.select(F.col("msa_id").alias("m"), "o"), F.col("msa_id") == F.col("m"))
    edges = e.select("msa_id", (F.col("i") - F.col("o")).cast("int").alias("i"), (F.col("j") - F.col("o")).cast("int").alias("j"), "d")
    return tree.nj_tree(edges, first.select("msa_id", "n"))


@query()
def nj_tree(spark, sf_dir):
    return _nj(spark, sf_dir)


@query(f"WITH {dv.sql_groups()} SELECT msa_id, 2 * count(*) - 1 AS nodes, count(*) AS leaves, true AS once FROM g GROUP BY msa_id")
def nj_tree_shape(spark, sf_dir):
    """Every tree is binary over all its leaves, and each node but the root is a child once."""
    t = _nj(spark, sf_dir)
    kids = F.collect_list(F.when(F.col("left") >= 0, F.array("left", "right")))
    return t.groupBy("msa_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves"), F.flatten(kids).alias("k")).select("msa_id", "nodes", "leaves", ((F.size("k") == F.size(F.array_distinct("k"))) & (F.size("k") == F.col("nodes") - 1)).alias("once"))


@query()
def newick(spark, sf_dir):
    t = _nj(spark, sf_dir)
    return tree.to_newick(t, t.select("msa_id", "node", F.col("node").cast("string").alias("name")))


# ---- multiple alignment: rows without gaps are the input, and groups are rectangular ----


def _msa(spark, sf_dir, mode, to):
    a = msa.msa_align(dv.groups(spark, sf_dir, to), mode)
    ok = msa.output_contract(a).select(F.col("msa_id").alias("_m"), "rectangular")
    return a.join(ok, F.col("msa_id") == F.col("_m")).select("msa_id", "ord", sq.ungapped(F.col("aligned")).alias("residues"), "rectangular")


@query(f"WITH {dv.sql_groups()} SELECT msa_id, ord, sequence AS residues, true AS rectangular FROM g")
def msa_dna(spark, sf_dir):
    return _msa(spark, sf_dir, "dna", dv.BASES)


@query(f"WITH {dv.sql_groups('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} SELECT msa_id, ord, sequence AS residues, true AS rectangular FROM g")
def msa_protein(spark, sf_dir):
    return _msa(spark, sf_dir, "protein", sq.LETTERS)


@query(f"""WITH {_FRAMES.replace(dv.sql_sequences(), dv.sql_sequences('benchmark', 'item_id'))} SELECT CAST(seq_id // 8 AS BIGINT) AS msa_id, seq_id AS ord,
array_to_string({_codons_sql('frame')}, '') || CASE WHEN (length(sequence) - frame) % 3 <> 0 THEN 'NNN' ELSE '' END AS residues, true AS rectangular FROM fr""")
def msa_codon(spark, sf_dir):
    return _msa(spark, sf_dir, "codon", dv.BASES)


# ---- scoring, over rows with gaps ----

_GAPPED = dv.sql_groups(dv.GAPPED, "aligned")
_CELLS = f"{_GAPPED}, c AS (SELECT msa_id, ord, unnest(range(0, length(aligned))) AS col, unnest(string_split(aligned, '')) AS letter FROM g WHERE aligned <> '')"
_RES = f"{_CELLS}, truth AS (SELECT msa_id, ord, row_number() OVER (PARTITION BY msa_id, ord ORDER BY col) AS k, col, letter FROM c WHERE letter <> '-')"


def _gapped(spark, sf_dir):
    return dv.groups(spark, sf_dir, dv.GAPPED, "aligned")


def _closed(spark, sf_dir):
    """The same rows with every second gap closed up: a test alignment."""
    return _gapped(spark, sf_dir).withColumn("aligned", F.regexp_replace("aligned", "-([^-]*-)", "$1"))


_TEST = _RES + ", tg AS (SELECT msa_id, ord, regexp_replace(aligned, '-([^-]*-)', '\\1', 'g') AS aligned FROM g), tc AS (SELECT msa_id, ord, unnest(range(0, length(aligned))) AS col, unnest(string_split(aligned, '')) AS letter FROM tg WHERE aligned <> ''), test AS (SELECT msa_id, ord, row_number() OVER (PARTITION BY msa_id, ord ORDER BY col) AS k, col AS got FROM tc WHERE letter <> '-'), j AS (SELECT truth.*, got FROM truth LEFT JOIN test USING (msa_id, ord, k))"


@query(f"WITH {_CELLS} SELECT msa_id, CAST(col AS INTEGER) AS col, count(*) AS rows, " + ", ".join(f"count(*) FILTER (letter = '{x}') AS {n}" for n, x in (("gaps", "-"), ("a", "A"), ("c", "C"), ("g", "G"), ("t", "T"))) + " FROM c GROUP BY msa_id, col")
def profile_counts(spark, sf_dir):
    return score.column_counts(_gapped(spark, sf_dir))


@query(f"WITH {_RES} SELECT msa_id, ord, CAST(k AS INTEGER) AS k, CAST(col AS INTEGER) AS col, letter FROM truth")
def residue_ordinal(spark, sf_dir):
    return score.residues(_gapped(spark, sf_dir))


@query(f"WITH {_GAPPED}, r AS (SELECT ord, list_transform(regexp_extract_all(aligned, '-+'), lambda x: length(x)) AS runs FROM g) SELECT ord, CAST(len(runs) AS INTEGER) AS n, CAST(coalesce(list_sum(runs), 0) AS BIGINT) AS gaps, CAST(list_max(runs) AS INTEGER) AS longest FROM r")
def gap_runs(spark, sf_dir):
    g = _gapped(spark, sf_dir).withColumn("runs", sq.gap_runs(F.col("aligned")))
    return g.select("ord", F.size("runs").alias("n"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x).alias("gaps"), F.array_max("runs").alias("longest"))


@query(f"""WITH {_TEST}, n AS (SELECT msa_id, col, got, count(*) AS n FROM j GROUP BY msa_id, col, got),
m AS (SELECT msa_id, col, sum(n) AS m, sum(CASE WHEN got IS NOT NULL THEN n * (n - 1) / 2 ELSE 0 END) AS kept FROM n GROUP BY msa_id, col)
SELECT msa_id, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(m * (m - 1) / 2) AS BIGINT) AS pairs, round(sum(kept) / sum(m * (m - 1) / 2), 6) AS sps FROM m GROUP BY msa_id""")
def sim_sps(spark, sf_dir):
    return score.pair_score(_closed(spark, sf_dir), _gapped(spark, sf_dir)).withColumn("sps", F.round("sps", 6))


@query(f"""WITH {_TEST}, m AS (SELECT msa_id, col, count(*) AS m, count(got) AS here, min(got) = max(got) AS one FROM j GROUP BY msa_id, col HAVING count(*) >= 2)
SELECT msa_id, count(*) FILTER (one AND here = m) AS intact, count(*) AS cols, round(count(*) FILTER (one AND here = m) / count(*), 6) AS tc FROM m GROUP BY msa_id""")
def sim_tc(spark, sf_dir):
    return score.column_score(_closed(spark, sf_dir), _gapped(spark, sf_dir)).withColumn("tc", F.round("tc", 6))


@query(f"""WITH {_CELLS}, b AS (SELECT msa_id, ord, col // 3 AS block, count(*) FILTER (letter = '-') AS gaps, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT msa_id, block, bool_and(gaps IN (0, 3)) AS pure FROM b WHERE n = 3 GROUP BY msa_id, block) SELECT msa_id, count(*) FILTER (pure) AS pure, count(*) AS blocks FROM p GROUP BY msa_id""")
def triplet_purity(spark, sf_dir):
    return score.triplet_purity(_gapped(spark, sf_dir))


# ---- quality control and reports ----


def _qc(spark, sf_dir):
    s = dv.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.col("p_partkey").cast("string").alias("seq_id"), sq.as_dna(F.concat("p_name", "p_type")).alias("sequence"))
    b = dv.groups(spark, sf_dir)
    return qc.gene_qc(s, b)


@query()
def gene_qc(spark, sf_dir):
    """Every part's name and type as one record, against the best bait of the benchmark items."""
    return _qc(spark, sf_dir)


@query(f"""WITH {dv.sql_sequences('benchmark', 'item_id')}, f AS (SELECT seq_id, sequence, unnest([0, 1, 2]) AS frame FROM s),
r AS (SELECT *, len(list_filter({_codons_sql('frame')}, lambda c: c IN ({_STOPS}))) AS stops, substring(sequence, frame + 1, 3) <> 'ATG' AS late FROM f)
SELECT CAST(seq_id AS VARCHAR) AS seq_id, frame FROM r ORDER BY stops, late, length(sequence) DESC, seq_id, frame LIMIT 1""")
def bait_choice(spark, sf_dir):
    return qc.choose_bait(dv.groups(spark, sf_dir)).select("seq_id", "frame")


def _results(spark, sf_dir):
    d, lab = dv.table(spark, sf_dir, "documents"), dv.table(spark, sf_dir, "labels")
    return d.join(lab.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").drop("_d")


_JOINED = "r AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_JOINED} SELECT lang, source, count(quality) AS n, round(avg(quality), 6) AS mean, median(quality::DOUBLE) AS median, min(quality)::DOUBLE AS least, max(quality)::DOUBLE AS most FROM r GROUP BY lang, source")
def group_mean_median(spark, sf_dir):
    return report.group_statistics(_results(spark, sf_dir), ["lang", "source"], "quality").withColumn("mean", F.round("mean", 6))


_CASES = "c AS (SELECT lang, source, avg(n_chars) AS v FROM documents GROUP BY lang, source)"


@query(f"WITH {_CASES}, j AS (SELECT a.v AS va, b.v AS vb FROM c a JOIN c b USING (source) WHERE a.lang = 'en' AND b.lang = 'fr') SELECT count(*) FILTER (va > vb) AS wins, count(*) FILTER (va = vb) AS ties, count(*) FILTER (va < vb) AS losses FROM j")
def win_tie_loss(spark, sf_dir):
    c = dv.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("v"))
    return report.win_tie_loss(c, ["source"], "lang", "v", "en", "fr")


@query("WITH k AS (SELECT unnest([1, 3, 5, 10, 25]) AS k) SELECT k, round(avg((s_suppkey % 40 < k)::INTEGER), 6) AS recall FROM k, supplier GROUP BY k")
def recall_at_k(spark, sf_dir):
    r = dv.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("rank"))
    return report.recall_at(r, "rank", [1, 3, 5, 10, 25]).withColumn("recall", F.round("recall", 6))


@query(f"WITH {_JOINED} SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL) AS missing FROM r GROUP BY source")
def left_join_missing(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_guard(spark, sf_dir):
    return dv.table(spark, sf_dir, "documents").join(dv.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query()
def bootstrap_ci(spark, sf_dir):
    return report.bootstrap_mean(_results(spark, sf_dir), "lang", "quality")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / 2) AS x FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.x AS x, b.x AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
d AS (SELECT i, j, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2, list_sum(list_transform(x, lambda e: e * e)) AS xx, list_sum(list_transform(y, lambda e: e * e)) AS yy FROM p)
SELECT i, j, round(acosh(greatest(1 + 2 * d2 / ((1 - xx) * (1 - yy)), 1 + 1e-5)), 5) AS d FROM d""")
def poincare_distance(spark, sf_dir):
    """Hyperbolic distances of all pairs of one label, vectors halved into the ball."""
    half = F.transform(F.col("embedding"), lambda x: x.cast("double") / 2)
    v = dv.table(spark, sf_dir, "embeddings").select("vec_id", "label", half.alias("x"))
    v = v.withColumn("xx", F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    a, b = v.alias("a"), v.alias("b")
    p = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    d2 = F.aggregate(F.zip_with("a.x", "b.x", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    arg = 1 + 2 * d2 / ((1 - F.col("a.xx")) * (1 - F.col("b.xx")))
    return p.select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.round(F.acosh(F.greatest(arg, F.lit(1 + 1e-5))), 5).alias("d"))
