import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readpool.config import ClusterConfig
from readpool.operators import representatives as R
from readpool.operators import sketch
from readpool.functions.sequences import within_edits
from readpool.plans import components, held, pipeline


def test_one_window_ranks_as_representatives_do(spark):
    r = random.Random(3)
    clusters = spark.createDataFrame([(i, r.randrange(12)) for i in range(40)] + [(50, 50), (51, 51)], "read_id bigint, cluster bigint")
    scored = spark.createDataFrame([(i, r.randrange(1, 5)) for i in range(0, 40, 2)], "read_id bigint, score bigint")
    state = pipeline.State(clusters, scored)
    held = pipeline.Held.of(state, 42)
    assert isinstance(held, pipeline.Held) and held.singles() == state.singles()
    for s in (state, held):
        rows = s.ranked(5)
        for rank in range(5):
            want = {x["read_id"] for x in R.focus(clusters, R.representatives(clusters, scored, 5), rank).collect()}
            assert {x["read_id"] for x in rows.filter(F.col("single") | (F.col("rank") == rank)).collect()} == want
    assert sorted(held.scores.collect()) == sorted(scored.collect())
    twice = pipeline.State(clusters.unionByName(clusters.limit(1)), scored)
    assert pipeline.Held.of(twice, 43) is twice  # ids that repeat


def reads_of(spark, n=40):
    r = random.Random(5)
    strands = ["".join(r.choice("ACGT") for _ in range(90)) for _ in range(8)]
    rows = [(i, "".join(c if r.random() > 0.04 else r.choice("ACGT") for c in r.choice(strands))) for i in range(n)]
    return spark.createDataFrame(rows, "read_id bigint, seq string")


def test_small_state_changes_nothing(spark, monkeypatch):
    """The last stage has the same rounds and results whether the driver or tables hold its state."""
    config = ClusterConfig(min_final_rounds=12)
    reads = reads_of(spark)
    prepared = pipeline.prepare(reads, config)
    alone = pipeline.State(reads.selectExpr("read_id", "read_id AS cluster"), spark.createDataFrame([], "read_id bigint, score bigint"))
    edges, firsts = pipeline.final_edges, []
    monkeypatch.setattr(pipeline, "final_edges", lambda *x: firsts.append((x[4], x[3])) or edges(*x))
    held = pipeline.final_clustering(prepared, alone, config)
    seen, firsts[:] = list(firsts), []
    monkeypatch.setattr(pipeline, "HERE", 0)
    monkeypatch.setattr(components, "HERE", 0)
    tables = pipeline.final_clustering(prepared, alone, config)
    assert firsts == seen
    assert sorted(held.clusters.collect()) == sorted(tables.clusters.collect())
    assert sorted(held.scores.collect()) == sorted(tables.scores.collect()) and held.scores.count()


def test_few_edges_start_few_jobs(spark):
    """A job of rounds that joins something took some 20 Spark jobs more, most of them for components of a few edges."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few edges", "")
    got = components.connected_components(edges).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")
    spark.sparkContext.setJobGroup("", "")
    assert {(x["node"], x["component"]) for x in got} == {(i, 0) for i in range(41)}
    assert len(jobs) <= 6


@pytest.mark.parametrize("text", ["ACGTACGTACGTACGT", "AAAAAAAAAA", "ACGTA", "ACGTAC"])
def test_sketches_count_repeated_grams(spark, text):
    reads = spark.createDataFrame([(1, text), (2, None), (3, text), (3, text)], "read_id bigint, seq string")
    got = {x["read_id"]: x["n_bag"] for x in sketch.sketches(reads, ClusterConfig()).collect()}
    n = len(text) - 5
    assert got == ({1: n, 3: 2 * n} if n > 0 else {})


def test_few_reads_are_clustered_as_tables_are(spark, monkeypatch):
    """Chunks, clusters in chunks and last rounds are the same whether the driver runs the rounds or tables do."""
    config = ClusterConfig(min_final_rounds=12, chunk_rounds=20, chunk_high=0.6, chunk_low=0.2, final_high=0.6, final_low=0.2)
    reads = reads_of(spark, 60)
    few = pipeline.run(reads, config)
    monkeypatch.setattr(pipeline, "HERE", 0)
    tables = pipeline.run(reads, config)
    for name in ("chunks", "clusters", "scores"):
        assert sorted(getattr(few, name).collect()) == sorted(getattr(tables, name).collect()) and getattr(few, name).count()
    assert 1 < few.chunks.select("chunk_id").distinct().count() < 60


def test_rounds_of_few_reads_start_few_jobs(spark):
    """Every round of chunks and every turn of the last stage was several Spark jobs, so a run of few reads took hundreds."""
    spark.sparkContext.setJobGroup("few reads", "")
    pipeline.run(reads_of(spark), ClusterConfig(min_final_rounds=40)).clusters.collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few reads")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 40


def test_edits_by_diagonals_are_those_of_levenshtein(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = [("", ""), ("", "AC"), ("A", "C"), ("ACGT" * 50, "CGTA" * 50)]
    for _ in range(300):
        a = list(some(r.choice([1, 4, 13, 60, 200])))
        for _ in range(r.randrange(16)):
            at = r.randrange(len(a) + 1)
            a[at : at + r.randrange(2)] = some(r.randrange(2))
        rows.append((some(3) * 9 if r.random() < 0.1 else "".join(a), "".join(a[r.randrange(3) :])))
    for limit in (0, 3, 12):
        want = spark.createDataFrame(rows, "a string, b string").select("a", "b", within_edits("a", "b", limit).alias("near")).collect()
        assert all(held.near(x["a"], x["b"], limit) == x["near"] for x in want)
        assert {x["near"] for x in want} == {True, False}


def test_a_report_of_few_reads_starts_few_jobs(spark):
    from readpool import registry

    spark.sparkContext.setJobGroup("report", "")
    lines = registry.queries()["run_report"](spark, "/root/testdata/sf0.001").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("report")
    spark.sparkContext.setJobGroup("", "")
    assert len(lines) > 10 and len(jobs) <= 120


def test_edits_move_only_the_reads_of_their_pairs(spark):
    """For pairs whose texts the driver lacks, the texts of all reads were shuffled twice, each time."""
    reads, limit = reads_of(spark, 60), 6
    ids = np.array([(a, b) for a in range(0, 20, 2) for b in range(a + 1, 20, 3)])
    out = held.near_pairs(reads, ids, limit)
    both = spark.createDataFrame(ids.tolist(), "a bigint, b bigint").join(reads.toDF("a", "x"), "a").join(reads.toDF("b", "y"), "b")
    want = {(r["a"], r["b"]) for r in both.filter(within_edits("x", "y", limit)).select("a", "b").collect()}
    assert {(r["a"], r["b"]) for r in out.collect()} == want and 0 < len(want) < len(ids)
    moved = out._jdf.queryExecution().executedPlan().toString()
    assert moved.count("BroadcastHashJoin [read_id") >= 2 and "LeftSemi" in moved
    lacks = held.HeldSketches(np.arange(60), sketch.sketches(reads, ClusterConfig()), reads, ClusterConfig(edit_limit=limit))
    lacks.texts = {}
    lacks.decide([tuple(p) for p in ids.tolist()])
    assert {p for p, near in lacks.decided.items() if near} == want and len(lacks.decided) == len(ids)


def test_the_driver_returns_what_held_rounds_leave(spark, monkeypatch):
    """Its heap stood at its limit beside the sketches of 256,410 reads."""
    seen, tidied = [], held.tidied
    monkeypatch.setattr(held, "tidied", lambda s: seen.append(tidied(s)))
    reads, config = reads_of(spark, 60), ClusterConfig()
    few = held.HeldSketches(np.arange(60), sketch.sketches(reads, config), reads, config)
    assert len(seen) == 1 and few.sig.nbytes == 2 * few.sig.size
    few.fetch_texts()
    assert len(seen) == 2
    few.texts = {}
    few.decide([(0, 1), (2, 3)])
    assert len(seen) == 3
    held.HeldChunks(np.arange(60), reads, config).fetch(1, 0, config.anchors(4, 2, 4, "test"), 8)
    assert len(seen) == 4
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    old = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = old()
    tidied(spark)
    assert old() > before


def test_lots_of_pairs_look_through_open_reads_only(spark, monkeypatch):
    """Each lot of pairs whose texts the driver lacks read the texts of all reads."""
    r = random.Random(6)
    long = [(100 + i, "".join(r.choice("ACGT") for _ in range(900))) for i in range(20)]  # too many codes for such a pair
    reads, config = reads_of(spark, 30).union(spark.createDataFrame(long, "read_id bigint, seq string")), ClusterConfig()
    ids, seen, near = held.unique_ids(reads), [], held.near_pairs
    monkeypatch.setattr(held, "near_pairs", lambda reads, *x: seen.append(reads.count()) or near(reads, *x))
    monkeypatch.setattr(held, "LETTERS", 500)
    few = held.HeldSketches(ids, sketch.sketches(reads, config), reads, config)
    pairs = [(a, a + 1) for a in range(0, 29)]
    few.decide(pairs)
    few.decide([(3, 40)])  # one that is not among them
    texts = dict(reads.collect())
    assert 0 < len(few.texts) < 30 and seen == [30, 50]
    assert few.decided == {p: held.near(texts[ids[p[0]]], texts[ids[p[1]]], config.edit_limit) for p in [*pairs, (3, 40)]}


def test_the_driver_holds_a_gigabyte_of_reads(spark, monkeypatch):
    """Over 262,144 reads every round was some Spark jobs again, and sets of grams stood in memory; rounds ran one after another."""
    monkeypatch.setattr(held, "unique_ids", lambda reads: reads)
    assert pipeline.Prepared("ids", None, 512_820).few_ids() == "ids"
    reads, config = reads_of(spark, 60), ClusterConfig()
    few = held.HeldSketches(np.arange(60), sketch.sketches(reads, config), reads, config)
    assert isinstance(few.bits, np.memmap) and few.bits.any(axis=1).all()
    rounds = [(r, p, np.arange(60)) for r, p in enumerate(config.bands())]
    want = [few.adjacent(*turn) for turn in rounds]
    a, b, rnd = few.edges(rounds, 0.0, 0.0)
    for r, (x, y) in enumerate(want):
        on = rnd == r
        assert a[on].tolist() == x.tolist() and b[on].tolist() == y.tolist()
