import random

import pytest

from readpool.config import ClusterConfig
from readpool.operators import metrics
from readpool.operators import representatives as R
from readpool.plans import pipeline
from readpool.plans.components import connected_components


def noisy(r, s):
    out = []
    for c in s:
        x = r.random()
        if x < 0.015:
            continue
        if x < 0.03:
            out.append(r.choice("ACGT"))
        out.append(r.choice("ACGT") if 0.03 <= x < 0.045 else c)
    return "".join(out)


def least_reached(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 2), (2, 5), (5, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(i % 17, i % 23 + 20) for i in range(60)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == least_reached(edges)


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == least_reached(edges)


def test_representatives_and_focus(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "read_id bigint, cluster bigint")
    scored = spark.createDataFrame([(2, 5), (3, 5)], "read_id bigint, score bigint")
    reps = R.representatives(clusters, scored, 2)
    assert sorted(map(tuple, reps.collect())) == [(1, 1, 2, 5), (1, 2, 3, 5), (4, 1, 4, 0)]
    assert sorted(map(tuple, R.focus(clusters, reps, 1).collect())) == [(3, 1), (4, 4)]
    assert sorted(map(tuple, R.focus(clusters, reps, 3).collect())) == [(4, 4)]  # no fourth member: the cluster is left out


def table(spark, pairs):
    rows = [(i, p, t) for i, (p, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "read_id bigint, cluster bigint, label string")
    return df.select("read_id", "cluster"), df.select("read_id", "label")


def test_perfect_partition_scores_one(spark):
    pred, truth = table(spark, [(0, "a"), (0, "a"), (2, "b"), (3, "c")])
    cells = metrics.contingency(pred, truth)
    assert {r["accuracy"] for r in metrics.accuracy(cells).collect()} == {1.0}
    assert [f(cells).first()[0] for f in (metrics.nmi, metrics.ari, metrics.purity)] == [1.0, 1.0, 1.0]
    assert metrics.errors(cells).first().asDict() == {"n": 4, "fp": 0, "tn": 4, "fn": 0, "tp": 4, "ts": 1.0}


def test_metrics_by_hand(spark):
    pred, truth = table(spark, [(0, "a"), (0, "a"), (0, "b"), (3, "b"), (3, "b"), (5, "a")])
    cells = metrics.contingency(pred, truth)
    assert metrics.purity(cells).first()[0] == pytest.approx(5 / 6)
    assert metrics.ari(cells).first()[0] == pytest.approx((2 - 4 * 6 / 15) / ((4 + 6) / 2 - 4 * 6 / 15), abs=1e-9)
    assert metrics.errors(cells).first().asDict() == {"n": 6, "fp": 1, "tn": 5, "fn": 3, "tp": 3, "ts": round(3 / 7, 9)}
    by = {r["gamma"]: r["accuracy"] for r in metrics.accuracy(cells).collect()}
    assert by[0.6] == pytest.approx(1 / 3) and by[0.7] == 0.0


def test_positional_vectors_ignore_reads(spark):
    pairs = [(0, "b"), (0, "b"), (2, "a"), (2, "a")]
    pred, truth = table(spark, pairs)
    assert metrics.nmi(metrics.positional(pred, truth)).first()[0] == 1.0
    pred, truth = table(spark, [(0, "b"), (1, "a"), (1, "a"), (1, "a")])
    assert metrics.ari(metrics.contingency(pred, truth)).first()[0] == 1.0
    assert metrics.ari(metrics.positional(pred, truth)).first()[0] < 1.0


def test_empty_and_single(spark):
    pred, truth = table(spark, [])
    assert metrics.nmi(metrics.contingency(pred, truth)).first()[0] == 0.0
    pred, truth = table(spark, [(0, "a")])
    assert metrics.ari(metrics.contingency(pred, truth)).first()[0] == 1.0


def test_run_recovers_noisy_strands(spark):
    r = random.Random(11)
    strands = ["".join(r.choice("ACGT") for _ in range(110)) for _ in range(15)]
    reads = [(s, noisy(r, strands[s])) for s in range(15) for _ in range(r.randint(2, 8))]
    r.shuffle(reads)
    df = spark.createDataFrame([(i, x, str(s)) for i, (s, x) in enumerate(reads)], "read_id bigint, seq string, label string")
    config = ClusterConfig(min_final_rounds=40, chunk_rounds=8)
    result = pipeline.run(df.select("read_id", "seq"), config)
    cells = metrics.contingency(result.clusters, df.select("read_id", "label"))
    assert result.clusters.count() == len(reads)
    assert metrics.ari(cells).first()[0] > 0.9
    text = pipeline.report(result, df.select("read_id", "label"))
    assert text.startswith("seconds: ") and "\nnmi:\n" in text and set(result.stages) == {"prepare", "chunks", "clusters in chunks", "final clusters"}
    again = pipeline.run(df.select("read_id", "seq"), config)
    assert sorted(again.clusters.collect()) == sorted(result.clusters.collect())


def test_rounds_without_work_change_the_rank(spark):
    """Rank by rank: after 20 rounds at the latest, or after 8 that did little."""
    config = ClusterConfig()
    ranks = pipeline.idle_ranks(pipeline.Schedule(config), 45, 10, 1)
    assert ranks == [0] * 8 + [1] * 8 + [2] * 4 + [3] * 8 + [4] * 8 + [0] * 4 + [1] * 5
    busy = pipeline.Schedule(config)
    chosen = []
    for i in range(25):
        if busy.begin():
            chosen.append((i, busy.rank))
        busy.end(100, 4, 1)  # much work: chosen anew each 5 rounds, of the same rank
    assert chosen == [(0, 0), (5, 0), (10, 0), (15, 0), (20, 1)] and busy.bad == 0


def test_last_stage_runs_all_rounds(spark, monkeypatch):
    reads = spark.createDataFrame([(i, "ACGTTGCA" * (i + 1)) for i in range(4)], "read_id bigint, seq string")
    config = ClusterConfig()
    prepared = pipeline.prepare(reads, config)
    state = pipeline.State(reads.selectExpr("read_id", "read_id AS cluster"), spark.createDataFrame([], "read_id bigint, score bigint"))
    seen = []
    none = spark.createDataFrame([], "a bigint, b bigint, rounds array<int>, single_a boolean, single_b boolean")
    monkeypatch.setattr(pipeline, "final_edges", lambda prepared, state, config, ranks, first: seen.append((first, ranks)) or none)
    pipeline.final_clustering(prepared, state, config)
    assert sum(len(ranks) for _, ranks in seen) == 300
    assert [x for _, ranks in seen for x in ranks] == pipeline.idle_ranks(pipeline.Schedule(config), 300, 4, 1)


def test_last_stage_stops_without_single_reads(spark):
    reads = spark.createDataFrame([(i, "ACGTTGCAGGATTACA" * 3) for i in range(4)], "read_id bigint, seq string")
    config = ClusterConfig(min_final_rounds=12)
    prepared = pipeline.prepare(reads, config)
    alone = pipeline.State(reads.selectExpr("read_id", "read_id AS cluster"), spark.createDataFrame([], "read_id bigint, score bigint"))
    out = pipeline.final_clustering(prepared, alone, config)
    assert {r["cluster"] for r in out.clusters.collect()} == {0} and out.scores.count() == 4


def test_run_of_nothing(spark):
    empty = spark.createDataFrame([], "read_id bigint, seq string")
    assert pipeline.run(empty, ClusterConfig(min_final_rounds=20)).clusters.count() == 0
