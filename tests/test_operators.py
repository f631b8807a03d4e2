"""Operators on small tables: contracts, refusals, sources, streaming."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqspark.functions import cigar as cg
from seqspark.operators import local, msa, pairwise
from seqspark.plans import registry
from seqspark.sources.fasta import read_fasta, write_fasta
from seqspark.sources.tabular import read_pairs
from seqspark.streaming.pairs import PAIRS, read_pair_stream, stream_edit_distance


def _pairs(spark, rows):
    return spark.createDataFrame(rows, PAIRS)


def test_batch_contract(spark):
    rows = [(1, 0, "ACGT", "ACGA", 3, True), (1, 1, "AAAA", "TTTT", 9, True), (2, 0, "", "ACGT", 1, True), (2, 1, "", "", 1, True), (3, 0, "A", "A", 512, False), (4, 0, None, "A", 5, False)]
    got = {(r.batch_id, r.ord): r for r in pairwise.align_edit(_pairs(spark, rows), cigars=True).collect()}
    assert got[1, 0].edit_distance == 1 and got[1, 0].cigar == "MMMX" and got[1, 0].rescore_ok and got[1, 0].wellformed_ok
    assert got[1, 1].edit_distance == -1 and not got[1, 1].resolved
    assert got[2, 0].edit_distance == 4 and got[2, 0].cigar == "IIII"
    assert got[2, 1].edit_distance == 0 and got[2, 1].cigar == "" and not got[2, 1].wellformed_ok
    assert got[3, 0].status == got[4, 0].status == "invalid_argument"
    assert pairwise.align_edit(_pairs(spark, [])).count() == 0


def test_scheme_refusals(spark):
    rows = [(1, 0, 0, -1, 2, 1, True), (2, 0, 2, 2, 2, 1, True), (3, 0, 2, -3, 1, 2, True), (4, 0, 2, -3, 1, 2, False), (5, 0, 2, -3, 5, 2, True), (5, 1, 1, -3, 5, 2, True)]
    df = spark.createDataFrame(rows, "batch_id long, ord long, match int, mismatch int, gap_open int, gap_extend int, with_cigar boolean")
    assert {r.batch_id: r.status for r in local.scheme_status(df).collect()} == {1: "invalid_argument", 2: "invalid_argument", 3: "invalid_argument", 4: "ok", 5: "invalid_argument"}


def test_cigar_columns(spark):
    df = spark.createDataFrame([("MMMXII",), ("",), ("DDDD",)], "c string")
    got = [tuple(r) for r in df.select(cg.run_length(F.col("c")), cg.cost(F.col("c")), cg.soft_frameshifts(F.col("c")), cg.net_frameshift(F.col("c"))).collect()]
    assert got == [("3M1X2I", 3, 1, -1), ("-", 0, 0, 0), ("4D", 4, 1, -1)]


def test_msa_refuses(spark):
    df = spark.createDataFrame([(1, 0, "a", "ACGT"), (1, 1, "b", "AC!T"), (2, 0, "c", "ACGT"), (2, 1, "d", "ACG"), (3, 0, "e", "")], "msa_id long, ord long, seq_id string, sequence string")
    assert {r.msa_id: r.status for r in msa.group_status(df, "dna").collect()} == {1: "invalid_argument", 2: "ok", 3: "invalid_argument"}
    assert {r.msa_id for r in msa.msa_align(df).collect()} == {2}


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "nnN")], "ord long, seq_id string, sequence string")
    write_fasta(df, str(tmp_path / "f"))
    got = read_fasta(spark, str(tmp_path / "f")).select("seq_id", "sequence").collect()
    assert sorted(tuple(r) for r in got) == [("a", "ACGT"), ("b", "nnN")]
    (tmp_path / "p.tsv").write_text("pattern\ttext\n# note\n\nAC\tGT\n")
    assert [tuple(r) for r in read_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("AC", "GT")]


def test_stream(spark, tmp_path):
    _pairs(spark, [(1, 0, "ACGT", "ACGA", 3, True), (1, 1, "AAAA", "TTTT", 2, True)]).write.parquet(str(tmp_path / "in"))
    out = stream_edit_distance(read_pair_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("pairs_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r.edit_distance for r in spark.table("pairs_out").collect()) == [-1, 1]


def test_bootstrap_is_the_reference(spark, monkeypatch):
    values = {"en": [k * k / 7 for k in range(23)], "fr": [0.5]}
    results = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "lang string, quality double")
    monkeypatch.setattr(registry, "_results", lambda *_: results)
    got = {r.key: (r.low, r.high) for r in registry.QUERIES["bootstrap_ci"](spark, "").collect()}
    for key, v in values.items():
        rng = random.Random(0)
        means = sorted(sum(rng.choice(v) for _ in v) / len(v) for _ in range(10_000))
        assert got[key] == (means[250], means[9750])


def test_deep_trees(spark):
    from seqspark.operators import tree

    n = 1500  # a ladder: leaves 0 .. n-1, each inner node joins the one before and the next leaf
    rows = [(1, k, -1, -1) for k in range(n)] + [(1, n + k, n + k - 1 if k else 0, k + 1) for k in range(n - 1)] + [(2, 7, -1, -1)]
    t = spark.createDataFrame(rows, "msa_id long, node int, left int, right int")
    levels = {(r.msa_id, r.node): r.level for r in tree.tree_levels(t).collect()}
    assert levels[1, 2 * n - 2] == n - 1 and levels[1, 0] == 0 and levels[2, 7] == 0
    found = {tuple(r.split) for r in tree.splits(t.where("msa_id = 2 or node >= 0")).collect()}
    assert len(found) == n - 3 and (0, 1) in found and (n - 2, n - 1) in found
    few = spark.createDataFrame([(1, [0, 1]), (1, [2, 3]), (1, [0, 1, 4])], "msa_id long, split array<int>")
    taxa = spark.createDataFrame([(1, k) for k in (0, 1, 2, 4, 5)], "msa_id long, leaf int")
    assert {tuple(r.split) for r in tree.project_splits(few, taxa).collect()} == {(0, 1), (2, 5)}


def test_patristic(spark):
    from seqspark.operators import tree

    rows = [(1, 0, -1, -1, 1.0), (1, 1, -1, -1, 2.0), (1, 2, -1, -1, 4.0), (1, 3, 0, 1, 8.0), (1, 4, 3, 2, None)]
    t = spark.createDataFrame(rows, "msa_id long, node int, left int, right int, length double")
    assert {(r.i, r.j, r.d) for r in tree.patristic_distances(t).collect()} == {(0, 1, 3.0), (0, 2, 13.0), (1, 2, 14.0)}


def test_patristic_in_parts(spark, monkeypatch):
    from seqspark.operators import tree

    monkeypatch.setattr(tree, "PART_PAIRS", 50)
    rng, live, rows = random.Random(4), list(range(60)), [(1, k, -1, -1, k % 5 + 0.5) for k in range(60)]
    up = {}
    for node in range(60, 119):
        a, b = (live.pop(rng.randrange(len(live))) for _ in range(2))
        up |= {a: node, b: node}
        live.append(node)
        rows.append((1, node, a, b, float(node % 3)))
    rows += [(2, 0, -1, -1, 1.0), (3, 5, -1, -1, 1.5), (3, 2, -1, -1, 2.0), (3, 9, 5, 2, None)]
    far = {r[1]: r[4] for r in rows if r[0] == 1}

    def above(k):
        out, d = {}, 0.0
        while k is not None:
            out[k], d, k = d, d + far[k], up.get(k)
        return out

    want = {(3, 2, 5, 3.5)}
    for j in range(60):
        for i in range(j):
            x, y = above(i), above(j)
            want.add((1, i, j, min(x[k] + y[k] for k in x if k in y)))
    out = tree.patristic_distances(spark.createDataFrame(rows, "msa_id long, node int, left int, right int, length double"))
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    # one part of a tree makes small batches only
    steps = np.array([(k, k, 0, k + 1, 1.0) for k in range(3000)] + [(3000, 0, 1500, 3000, 0.0)], dtype=tree._STEP)
    sizes = [len(d) for *_, d in tree._meets(steps, 0, 3000)]
    assert sum(sizes) == 1500 * 1500 and max(sizes) <= tree.BATCH_PAIRS


def test_newick_comments():
    from seqspark.sources.newick import parse_newick

    deep = "[" * 30 + "x" + "]" * 30
    assert [r[2] for r in parse_newick(f"(a{deep}:1,'b[1]':2)r;")] == ["r", "a", "b[1]"]
