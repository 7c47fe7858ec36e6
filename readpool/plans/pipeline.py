"""The clustering run: chunks by common substrings, clusters inside chunks, then clusters over all, by representatives.

Rounds that do not depend on each other are one job: all rounds inside chunks, and all rounds between two changes of the
representatives. What carries over (chunks, clusters, scores) is a table in the shared folder after each step.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from readpool.config import ClusterConfig, budgets, substring_sizes
from readpool.functions.sequences import band_key, tiebreak
from readpool.operators import blocking, metrics, verify
from readpool.operators import representatives as reps_
from readpool.operators.sketch import sketches
from readpool.plans import held as held_
from readpool.plans.components import connected_components, dropped, least_reached, whole_numbers, written, written_with

log = logging.getLogger(__name__)

HERE = 1 << 20  # reads that the driver holds


@dataclass
class State:
    """Clusters (read_id, cluster) and scores (read_id, score) so far."""

    clusters: DataFrame
    scores: DataFrame

    def ranked(self, most: int) -> DataFrame:
        """(read_id, rank, single): single reads, and the first `most` of each cluster, by rank from 0 on."""
        return reps_.ranked(self.clusters, self.scores).filter(F.col("single") | (F.col("rank") < most))

    def singles(self) -> int:
        return reps_.cluster_counts(self.clusters).first()["n_singles"]


class Held(State):
    """The same of HERE reads at most, held by the driver (24 MB), as rows that one process sorts in a second cost a job only overhead."""

    def __init__(self, spark: SparkSession, ids: np.ndarray, cluster: np.ndarray, score: np.ndarray):
        self.spark, self.ids, self.cluster, self.score = spark, ids, cluster, score  # by id; score 0: none

    @staticmethod
    def of(state: State, n: int) -> State:
        """`state` held, unless there are more reads, or ids that repeat or are no whole numbers."""
        if n > HERE or isinstance(state, Held) or not isinstance(state.clusters.schema["read_id"].dataType, LongType):
            return state
        rows, points = state.clusters.select("read_id", "cluster").toArrow(), state.scores.select("read_id", "score").toArrow()
        ids, cluster = rows.column("read_id").to_numpy(), rows.column("cluster").to_numpy()
        order = np.argsort(ids)
        ids, cluster = ids[order], cluster[order]
        if rows.column("read_id").null_count or (ids[1:] == ids[:-1]).any():
            return state
        held = Held(state.clusters.sparkSession, ids, cluster, np.zeros(len(ids), np.int64))
        held.score[np.searchsorted(ids, points.column("read_id").to_numpy())] = points.column("score").to_numpy()
        return held

    @property
    def clusters(self) -> DataFrame:
        return whole_numbers(self.spark, read_id=self.ids, cluster=self.cluster)

    @property
    def scores(self) -> DataFrame:
        some = self.score > 0
        return whole_numbers(self.spark, read_id=self.ids[some], score=self.score[some])

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The rank of every read in its cluster, and whether it is alone, by id."""
        order = np.lexsort((self.ids, -self.score, self.cluster))
        start = np.flatnonzero(np.append(True, np.diff(self.cluster[order]) != 0))
        size = np.diff(np.append(start, len(order)))
        rank, single = np.empty(len(order), np.int64), np.empty(len(order), bool)
        rank[order], single[order] = np.arange(len(order)) - np.repeat(start, size), np.repeat(size == 1, size)
        return rank, single

    def ranked(self, most: int) -> DataFrame:
        rank, single = self.ranks()
        on = single | (rank < most)
        rows = whole_numbers(self.spark, read_id=self.ids[on], rank=rank[on], single=single[on].astype(np.int64))
        return rows.select("read_id", "rank", (F.col("single") == 1).alias("single"))

    def singles(self) -> int:
        return int((np.unique(self.cluster, return_counts=True)[1] == 1).sum())

    def joined(self, edges: pa.Table, before: int) -> Held:
        """The state after joining the ends of `edges` (a, b, rounds) that were met before round `before`."""
        mult = np.bincount(np.repeat(np.arange(edges.num_rows), lengths(edges)), rounds_of(edges) < before, edges.num_rows).astype(np.int64)
        used, score, cluster = mult > 0, self.score.copy(), self.cluster.copy()
        ends = [np.searchsorted(self.ids, edges.column(c).to_numpy()[used]) for c in ("a", "b")]
        for x in ends:
            np.add.at(score, x, mult[used])
        nodes, least = least_reached(*(self.cluster[x] for x in ends))
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, cluster), len(nodes) - 1)
            cluster = np.where(nodes[at] == cluster, least[at], cluster)
        return Held(self.spark, self.ids, cluster, score)


def rounds_of(edges: pa.Table) -> np.ndarray:
    return edges.column("rounds").combine_chunks().flatten().to_numpy()


def lengths(edges: pa.Table) -> np.ndarray:
    return pc.list_value_length(edges.column("rounds")).to_numpy()


def handled_by_round(edges: pa.Table) -> dict[int, int]:
    """The number of single reads that are first joined in each round."""
    n = lengths(edges)
    first = rounds_of(edges)[np.cumsum(n) - n]
    ends = [(edges.column(c).to_numpy()[on], first[on]) for c in "ab" for on in [edges.column(f"single_{c}").to_numpy()]]
    ids, at = (np.concatenate(x) for x in zip(*ends, strict=True))
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    at, n = np.unique(at[np.append(True, ids[1:] != ids[:-1])[: len(ids)]], return_counts=True)
    return dict(zip(at.tolist(), n.tolist(), strict=True))


@dataclass
class Prepared:
    """What all stages read."""

    reads: DataFrame  # read_id, seq
    sketched: DataFrame  # read_id, sig, n_bag, bits
    n: int
    kept: dict = field(default_factory=dict)  # what the driver holds of few reads

    def few_ids(self) -> np.ndarray | None:
        """The sorted ids of HERE reads at most that the driver can tell apart."""
        if not 0 < self.n <= HERE:
            return None
        if "ids" not in self.kept:
            self.kept["ids"] = held_.unique_ids(self.reads)
        return self.kept["ids"]

    def few(self, config: ClusterConfig) -> held_.HeldSketches | None:
        """The sketches of so few reads."""
        ids = self.few_ids()
        if ids is not None and self.kept.get("config") != config:
            self.kept |= {"config": config, "sketches": held_.HeldSketches(ids, self.sketched, self.reads, config)}
        return None if ids is None else self.kept["sketches"]


def prepare(reads: DataFrame, config: ClusterConfig) -> Prepared:
    reads, seen = written_with(reads.select("read_id", "seq"), n=F.count(F.lit(1)))
    return Prepared(reads, written(sketches(reads, config)), seen["n"])


def chunk_turns(chunks: DataFrame, reads: DataFrame, anchors: list[tuple[str, ...]], length: int, first: int, config: ClusterConfig) -> DataFrame:
    """(a, b): edges between chunk ids from some rounds of substring keys, each over a few reads of every chunk."""
    turns = chunks.withColumn("turn", F.explode(F.array(*map(F.lit, range(len(anchors))))))
    mark = tiebreak(f"{config.seed}:chunk", F.concat_ws(":", F.col("turn") + first, F.col("read_id")))
    rows = reps_.sampled(turns, ["turn", "chunk_id"], config.reps_per_chunk, mark).join(reads.select("read_id", "seq"), "read_id")
    return blocking.substring_edges(rows, anchors, length)


def chunk_partition(prepared: Prepared, config: ClusterConfig) -> DataFrame:
    """(read_id, chunk_id): rounds go on until few merges come from them, first with two anchors, then with one longer.

    Poor rounds count from the last change of phase on, whether or not good ones lie between; as many as a phase allows are only
    counted, the next one ends it. With `chunk_block` above 1 that many rounds are one job and draw from the same chunks; the
    rate of merges is that of the block, and each of its rounds counts as poor if it is low.
    """
    reads, n, ids = prepared.reads, prepared.n, prepared.few_ids()
    chunks = written(reads.select("read_id", F.col("read_id").alias("chunk_id")))
    if not n:
        return chunks
    few = None if ids is None else held_.HeldChunks(ids, reads, config)
    length = reads.agg(F.min(F.struct("read_id", F.length("seq").alias("l")))["l"]).first()[0]
    phase, bad, done = 1, 0, 0
    while done < config.chunk_rounds:
        count = min(config.chunk_block, config.chunk_rounds - done)
        width, more = substring_sizes(length, n, phase)
        want = count if few is None else min(max(count, few.ahead()), config.chunk_rounds - done)
        anchors = config.anchors(width, 2 if phase == 1 else 1, done + want, f"chunk:{phase}")[done:]
        began = time.time()
        if few is not None:
            if any((phase, done + i) not in few.keys for i in range(count)):
                few.fetch(phase, done, anchors, width + more)
            seen = {"n": few.joined(phase, range(done, done + count))}
        else:
            edges, seen = written_with(chunk_turns(chunks, reads, anchors, width + more, done, config), n=F.count(F.lit(1)))
            if seen["n"]:
                joined, seen = written_with(connected_components(edges).filter("node <> component"), n=F.count(F.lit(1)))
                chunks = written(chunks.join(joined, F.col("chunk_id") == F.col("node"), "left").select("read_id", F.coalesce("component", "chunk_id").alias("chunk_id")))
        done += count
        log.info("chunks, round %d: %.1f s, %d merges, rate %.5f, %d anchors", done, time.time() - began, seen["n"], seen["n"] / n, len(anchors[0]))
        if seen["n"] / n / count < config.min_merge_rate:
            bad += count
            if bad > (config.bad_rounds_first if phase == 1 else config.bad_rounds_second):
                if phase == 2:
                    break
                phase, bad = 2, 0
    return chunks if few is None else whole_numbers(reads.sparkSession, read_id=few.ids, chunk_id=few.chunk)


def joined_state(state: State | None, prepared: Prepared, pairs: DataFrame, high: float, low: float, config: ClusterConfig) -> State:
    """The state after verifying candidate pairs (round, a, b) and joining the ends of accepted ones."""
    checked = verify.verified(verify.counted(pairs), prepared.sketched, prepared.reads, high, low, config.edit_limit)
    return with_edges(state, prepared, written(checked.filter("accepted").select("a", "b", "mult")))


def with_edges(state: State | None, prepared: Prepared, edges: DataFrame) -> State:
    """The state after joining the ends of `edges` (a, b, mult), a table."""
    new = reps_.scores(edges)
    if state is None:
        return State(written(reps_.merged(prepared.reads, edges)), written(new))
    total = state.scores.unionByName(new).groupBy("read_id").agg(F.sum("score").cast("bigint").alias("score"))
    return State(written(reps_.merged(prepared.reads, edges, state.clusters)), written(total))


def chunk_candidates(prepared: Prepared, chunks: DataFrame, config: ClusterConfig) -> DataFrame:
    """(round, a, b): neighbours in the band buckets of chunks of a reasonable size, over all rounds."""
    large = reps_.reasonable(chunks, config.reasonable_chunk).filter("n > 1").select("chunk_id")
    rows = prepared.sketched.join(chunks.join(large, "chunk_id", "left_semi"), "read_id")
    keyed = blocking.band_keys(rows, config.bands(), config.code_bits)
    return blocking.adjacent_pairs(keyed, ["round", "chunk_id", "key"], config.seed)


def cluster_in_chunks(prepared: Prepared, chunks: DataFrame, config: ClusterConfig) -> State:
    few = prepared.few(config)
    rows = None if few is None else chunks.select("read_id", "chunk_id").toArrow().sort_by("read_id")
    if rows is not None and np.array_equal(few.ids, rows.column("read_id").to_numpy()):
        chunk = rows.column("chunk_id").to_numpy()
        _, own, size = np.unique(chunk, return_inverse=True, return_counts=True)
        on = (size >= config.reasonable_chunk * (len(chunk) / len(size)))[own] & (size > 1)[own]
        at, within = np.flatnonzero(on), chunk[on]
        pairs = [(r, p, at, within) for r, p in enumerate(config.bands())]
        edges = few.table(*few.edges(pairs, config.chunk_high, config.chunk_low), np.ones(prepared.n, bool))
        alone = Held(prepared.reads.sparkSession, few.ids, few.ids, np.zeros(prepared.n, np.int64))
        return alone.joined(edges, config.rounds) if edges.num_rows else alone
    return joined_state(None, prepared, chunk_candidates(prepared, chunks, config), config.chunk_high, config.chunk_low, config)


@dataclass
class Schedule:
    """Where the last stage stands: the next round, the rank of representatives, and rounds in a row that did little."""

    config: ClusterConfig
    round: int = 0
    rank: int = -1
    idle: int = 0  # rounds of a low rate since the last choice of representatives
    bad: int = 0  # rounds that joined few single reads
    rate: float = 0.0  # of the last round

    def begin(self) -> bool:
        """Whether representatives are chosen anew before the next round."""
        c = self.config
        self.idle = self.idle + 1 if self.rate <= c.low_work_rate else 0
        change = self.round % c.rotation == 0 or self.idle >= c.patience
        again = self.round % c.refresh == 0 and self.rate >= c.high_work_rate
        if change:
            self.rank = (self.rank + 1) % c.reps_per_cluster
        if change or again:
            self.idle = 0
        return change or again

    def end(self, singles: int, handled: int, work: int) -> None:
        """After a round that found `singles` single reads and joined `handled` of them."""
        self.rate = handled / singles if singles else 0.0
        self.bad = self.bad + 1 if handled <= work else 0
        self.round += 1


def idle_ranks(schedule: Schedule, count: int, singles: int, work: int) -> list[int]:
    """The rank in each of the next `count` rounds if they join nothing."""
    ahead, ranks = replace(schedule), []
    for _ in range(count):
        ahead.begin()
        ranks.append(ahead.rank)
        ahead.end(singles, 0, work)
    return ranks


def final_edges(prepared: Prepared, state: State, config: ClusterConfig, ranks: list[int], first: int) -> DataFrame | pa.Table:
    """(a, b, rounds, single_a, single_b): accepted pairs of the rounds from `first` on, which single reads and the
    representatives of each round's rank take part in. An Arrow table if the driver holds the reads."""
    bands = config.bands(first + len(ranks), "final")[first:]
    few = prepared.few(config) if isinstance(state, Held) else None
    if few is not None and np.array_equal(state.ids, few.ids):
        rank, single = state.ranks()
        at = {of: np.flatnonzero(single | (rank == of)) for of in set(ranks)}
        pairs = [(first + i, p, at[of]) for i, (of, p) in enumerate(zip(ranks, bands, strict=True))]
        return few.table(*few.edges(pairs, config.final_high, config.final_low), single)
    focus = state.ranked(config.reps_per_cluster)
    # Rounds are rows, not code, so that Spark compiles the job once and not anew for each stretch of rounds.
    rounds = prepared.reads.sparkSession.createDataFrame([(first + i, rank, list(p)) for i, (rank, p) in enumerate(zip(ranks, bands, strict=True))], "round int, of int, places array<int>")
    focus = focus.join(F.broadcast(rounds), F.col("single") | (F.col("rank") == F.col("of")))
    key = band_key("sig", tuple(F.col("places")[j] for j in range(config.k)), config.code_bits).alias("key")
    keyed = prepared.sketched.select("read_id", "sig").join(focus, "read_id").select("round", key, "read_id", "single")
    pairs = blocking.adjacent_pairs(keyed, ["round", "key"], config.seed, "single")
    flags = [F.first(c).alias(c) for c in ("single_a", "single_b")]
    pairs = pairs.groupBy("a", "b").agg(F.array_sort(F.collect_list("round")).alias("rounds"), *flags)
    edges = verify.verified(pairs, prepared.sketched, prepared.reads, config.final_high, config.final_low, config.edit_limit).filter("accepted")
    return edges.select("a", "b", "rounds", "single_a", "single_b")


def final_clustering(prepared: Prepared, state: State, config: ClusterConfig) -> State:
    """Rounds over single reads and one representative of each cluster, with the rules of `Schedule`; from min_final_rounds on
    they end once no single read is left, or after enough rounds in a row that joined few.

    A job runs the rounds that follow if nothing is joined, `ahead` at most. Where something is, the rounds count up to the end of
    the representatives' turn in which it was, and what comes after is run anew; representatives are chosen anew there too.
    """
    limits, schedule, count = budgets(prepared.n, config), Schedule(config), config.patience
    state = Held.of(state, prepared.n)
    singles = state.singles()
    while schedule.round < limits["rounds"] and prepared.n:
        began, first = time.time(), schedule.round
        ranks = idle_ranks(schedule, min(count, limits["rounds"] - first), singles, limits["work"])
        edges, held = final_edges(prepared, state, config, ranks, first), None
        if isinstance(edges, pa.Table):
            held = edges if edges.num_rows else None
            seen = {"n": edges.num_rows, "first": int(rounds_of(edges).min()) if edges.num_rows else None}
        else:
            edges, seen = written_with(edges, n=F.count(F.lit(1)), first=F.min(F.col("rounds")[0]))
            held = edges.toArrow() if isinstance(state, Held) and 0 < seen["n"] <= HERE else None
        handled: dict[int, int] = {}
        end = first + len(ranks)
        if held is not None:
            handled = handled_by_round(held)
        elif seen["n"]:
            ends = edges.select(F.explode(F.array(F.struct("a", F.col("single_a").alias("single"), F.col("rounds")[0].alias("at")), F.struct(F.col("b").alias("a"), F.col("single_b").alias("single"), F.col("rounds")[0].alias("at")))).alias("e"))
            joined = ends.select("e.*").filter("single").groupBy("a").agg(F.min("at").alias("at"))
            handled = {r["at"]: r["n"] for r in joined.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
        while schedule.round < end:
            left = singles - sum(n for at, n in handled.items() if at < schedule.round)
            trial = replace(schedule)
            anew = trial.begin()
            # Rounds after something was joined are only good while the same representatives would have gone on.
            if seen["n"] and schedule.round > seen["first"] and (anew or trial.rank != ranks[schedule.round - first]):
                break
            schedule = trial
            schedule.end(left, handled.get(schedule.round, 0), limits["work"])
            if schedule.round >= config.min_final_rounds and (not left or schedule.bad >= limits["bad_rounds"]):
                limits["rounds"] = schedule.round
                break
        if held is not None:
            state = state.joined(held, schedule.round)
        elif seen["n"]:
            used = edges.select("a", "b", F.size(F.filter("rounds", lambda r: r < schedule.round)).cast("bigint").alias("mult")).filter("mult > 0")
            state = Held.of(with_edges(state, prepared, used), prepared.n)
        singles = state.singles() if seen["n"] else singles
        log.info("last stage, rounds %d to %d: %.1f s, rank %d, %d accepted pairs, %d single reads", first, schedule.round, time.time() - began, schedule.rank, seen["n"], singles)
        count = config.patience if seen["n"] else min(2 * count, config.ahead)
        if isinstance(edges, DataFrame):
            dropped(edges)
    return State(state.clusters, state.scores)


@dataclass
class Result:
    clusters: DataFrame
    scores: DataFrame
    chunks: DataFrame
    seconds: float
    stages: dict[str, float] = field(default_factory=dict)  # seconds of each stage


def run(reads: DataFrame, config: ClusterConfig | None = None) -> Result:
    """Clusters of `reads` (read_id, seq): (read_id, cluster), a cluster's id being its least member."""
    config, began, stages = config or ClusterConfig(), time.time(), {}

    def timed(name: str, made):
        start = time.time()
        out = made()
        stages[name] = time.time() - start
        log.info("%s: %.1f s", name, stages[name])
        return out

    prepared = timed("prepare", lambda: prepare(reads, config))
    chunks = timed("chunks", lambda: chunk_partition(prepared, config))
    state = timed("clusters in chunks", lambda: cluster_in_chunks(prepared, chunks, config))
    state = timed("final clusters", lambda: final_clustering(prepared, state, config))
    return Result(state.clusters, state.scores, chunks, time.time() - began, stages)


def report(result: Result, truth: DataFrame, names=metrics.DEFAULT_METRICS) -> str:
    """The text report against truth (read_id, label); the metrics' own time does not count."""
    table = written(metrics.contingency(result.clusters, truth))
    return metrics.report(result.seconds, reps_.cluster_counts(result.clusters).first().asDict(), {k: metrics.REGISTRY[k](table) for k in names})
