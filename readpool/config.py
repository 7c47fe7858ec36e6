"""All parameters of a clustering run, in one frozen value."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass


@dataclass(frozen=True)
class ClusterConfig:
    """Parameters with their defaults; `seed` stands for every random choice."""

    q: int = 6  # letters of a gram
    k: int = 3  # sketch positions of a band
    m: int = 40  # sketch length
    rounds: int = 32  # banding rounds inside chunks
    edit_limit: int = 12
    seed: int = 7
    reps_per_cluster: int = 5
    reps_per_chunk: int = 3
    # Chunks
    chunk_rounds: int = 64
    chunk_block: int = 1  # rounds that draw from the same chunks, in one job
    min_merge_rate: float = 0.002
    bad_rounds_first: int = 3
    bad_rounds_second: int = 4
    reasonable_chunk: float = 0.5
    # Similarity bounds inside chunks and over all clusters
    chunk_high: float = 0.32
    chunk_low: float = 0.28
    final_high: float = 0.25
    final_low: float = 0.22
    # Final stage
    min_final_rounds: int = 300
    rotation: int = 20  # rounds after which the rank of representatives changes at the latest
    patience: int = 8  # rounds of little work after which it changes too
    refresh: int = 5  # rounds between looks for much work, after which representatives are chosen anew
    low_work_rate: float = 0.005
    high_work_rate: float = 0.03
    min_bad_rounds: int = 4
    ahead: int = 40  # rounds at most that one job runs on the chance that they join nothing

    def __post_init__(self):
        if 2 * self.q * self.k > 62:
            raise ValueError("a band key of 2 * q * k bits must fit a bigint")
        if not 0 < self.k <= self.m:
            raise ValueError("k must lie between 1 and m")

    @property
    def code_bits(self) -> int:
        return 2 * self.q

    def permutations(self) -> list[tuple[int, int, int]]:
        """(a, b, c) of each sketch position: a and c odd, all below 4**q."""
        r, n = random.Random(f"{self.seed}:permutation"), 1 << self.code_bits
        return [(r.randrange(1, n, 2), r.randrange(n), r.randrange(1, n, 2)) for _ in range(self.m)]

    def bands(self, rounds: int | None = None, stage: str = "band") -> list[tuple[int, ...]]:
        """The sketch positions of each round, drawn without repetition."""
        r = random.Random(f"{self.seed}:{stage}")
        return [tuple(r.sample(range(self.m), self.k)) for _ in range(self.rounds if rounds is None else rounds)]

    def anchors(self, width: int, count: int, rounds: int, stage: str) -> list[tuple[str, ...]]:
        """`count` anchor strings of `width` letters for each round."""
        r = random.Random(f"{self.seed}:{stage}")
        return [tuple("".join(r.choice("ACGT") for _ in range(width)) for _ in range(count)) for _ in range(rounds)]


def log4_ceil(x: int) -> int:
    """The least e with 4**e >= x, in whole numbers."""
    e = 0
    while 4**e < x:
        e += 1
    return e


def substring_sizes(first_length: int, n_reads: int, phase: int) -> tuple[int, int]:
    """(anchor width, further letters) of the substring keys: phase 1 takes two anchors, phase 2 one longer one."""
    w, t = log4_ceil(first_length), log4_ceil(n_reads)
    if phase == 1:
        w = max(w - 1, 1)
        return w, max(t - 1, w)
    return w, max(t, w)


def budgets(n_reads: int, config: ClusterConfig | None = None) -> dict[str, int]:
    """Round and work limits of the final stage for a pool of n_reads."""
    config = config or ClusterConfig()
    if n_reads <= 0:
        return {"bad_rounds": 1000, "work": 0, "rounds": config.min_final_rounds}
    return {
        "bad_rounds": min(max(math.ceil(10_000_000 / n_reads), config.min_bad_rounds), 1000),
        "work": math.ceil(n_reads ** (1 / 5)),
        "rounds": max(math.ceil(n_reads ** (1 / 2.2)), config.min_final_rounds),
    }
