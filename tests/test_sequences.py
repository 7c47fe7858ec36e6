import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readpool.config import ClusterConfig, budgets, log4_ceil, substring_sizes
from readpool.functions import sequences as S
from readpool.operators import blocking, verify
from readpool.operators.sketch import sketches


def codes(seq, q):
    return [sum("ACGT".index(seq[i + p]) * 4**p for p in range(q)) for i in range(len(seq) - q + 1)]


def permuted(x, c, bits):
    a, b, c = c
    mask = (1 << bits) - 1
    x = (a * x + b) & mask
    x ^= x >> (bits // 2)
    x = (c * x) & mask
    return x ^ (x >> max(1, bits // 2 - 1))


def random_seq(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_qgrams_keep_repeats_and_short_reads_are_empty(spark):
    seqs = ["ACGTACGTAC", "AAAAAAAA", "ACGTA", "ACGTAC", ""]
    rows = spark.createDataFrame([(s,) for s in seqs] + [(None,)], "seq string").select("seq", S.qgrams("seq", 6).alias("g")).collect()
    for r in rows:
        assert r["g"] == (None if r["seq"] is None else codes(r["seq"], 6))


def test_dice_divides_set_overlap_by_bag_sizes(spark):
    df = spark.createDataFrame([([1, 1, 2], [1, 1, 2]), ([1, 2], [3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(S.dice("a", "b")).collect()] == pytest.approx([4 / 6, 0.0, 0.0])


def test_edit_limit_is_not_fooled_by_the_sentinel(spark):
    df = spark.createDataFrame([("A" * 30, "C" * 30), ("ACGT", "AGT")], "a string, b string")
    assert [r[0] for r in df.select(S.within_edits("a", "b", 12)).collect()] == [False, True]


def test_accepted_tests_similarity_before_edits(spark):
    df = spark.createDataFrame([(0.4, "A" * 40, "C" * 40), (0.3, "ACGT", "ACGA"), (0.3, "A" * 40, "C" * 40), (0.1, "A", "A")], "sd double, a string, b string")
    assert [r[0] for r in df.select(S.accepted(F.col("sd"), "a", "b", 0.32, 0.28, 12)).collect()] == [True, True, False, False]


def test_anchored_falls_back_to_the_beginning_and_stops_at_the_end(spark):
    df = spark.createDataFrame([("AACGTT",)], "seq string")
    row = df.select(S.anchored("seq", F.lit("CG"), 3), S.anchored("seq", F.lit("GGG"), 3), S.anchored("seq", F.lit("TT"), 5)).first()
    assert tuple(row) == ("CGT", "AAC", "TT")
    a, b = df.select(S.substring_key("seq", ["CG", "TT"], 3), S.substring_key("seq", ["TT", "CG"], 3)).first()
    assert a == b


def test_band_key_reaches_its_highest_value(spark):
    df = spark.createDataFrame([([4095, 4095, 4095],)], "sig array<int>")
    assert df.select(S.band_key("sig", (0, 1, 2), 12)).first()[0] == 2**36 - 1
    with pytest.raises(ValueError):
        ClusterConfig(q=11, k=3)


@given(st.integers(0, 500), st.sampled_from([3, 4, 6]))
def test_permutations_are_bijections(seed, q):
    config = ClusterConfig(q=q, k=2, m=3, seed=seed)
    for c in config.permutations():
        assert len({permuted(x, c, config.code_bits) for x in range(4**q)}) == 4**q


def test_sketches_match_their_definition(spark):
    r, config = random.Random(1), ClusterConfig()
    reads = [(i, random_seq(r, r.choice([6, 20, 110]))) for i in range(20)]
    got = {x["read_id"]: x["sig"] for x in sketches(spark.createDataFrame(reads, "read_id bigint, seq string"), config).collect()}
    for i, s in reads:
        assert got[i] == [min(permuted(x, c, 12) for x in codes(s, 6)) for c in config.permutations()]


def test_dice_of_sets_is_dice_of_grams(spark):
    r, config = random.Random(3), ClusterConfig()
    reads = {i: random_seq(r, r.choice([6, 9, 60, 400])) for i in range(12)}
    reads |= {20: reads[0], 21: "ACGTAC" * 9, 22: "ACGTAC" * 12}
    df = spark.createDataFrame(list(reads.items()), "read_id bigint, seq string")
    pairs = spark.createDataFrame([(a, b) for a in reads for b in reads if a < b], "a bigint, b bigint")
    for x in verify.compared(pairs, sketches(df, config)).collect():
        a, b = codes(reads[x["a"]], 6), codes(reads[x["b"]], 6)
        assert (x["n_a"], x["n_b"]) == (len(a), len(b)) and x["sd"] == pytest.approx(2 * len(set(a) & set(b)) / (len(a) + len(b)))


def test_edits_decide_between_the_bounds(spark):
    r, config = random.Random(4), ClusterConfig()
    base = random_seq(r, 90)
    edited = list(base)
    for i in range(4, 88, 8):
        edited[i] = "ACGT"[("ACGT".index(edited[i]) + 1) % 4]
    reads = {1: base, 2: "".join(edited), 3: base[:34] + random_seq(r, 56), 4: base[:34] + random_seq(r, 400)}
    df = spark.createDataFrame(list(reads.items()), "read_id bigint, seq string")
    rows = verify.verified(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint"), sketches(df, config), df, 0.9, 0.1, 12).collect()
    assert {x["b"]: x["accepted"] for x in rows} == {2: True, 3: False, 4: False} and all(x["sd"] < 0.9 for x in rows)


def test_candidates_are_neighbours_and_linear(spark):
    keyed = spark.createDataFrame([(0, 7, i) for i in range(30)] + [(1, 7, 99)], "round int, key bigint, read_id bigint")
    pairs = blocking.adjacent_pairs(keyed, ["round", "key"], 7).collect()
    assert len(pairs) == 29 and {x for p in pairs for x in (p["a"], p["b"])} == set(range(30))


def test_verified_keeps_multiplicity(spark):
    config = ClusterConfig()
    reads = spark.createDataFrame([(1, "ACGTACGGTTCA"), (2, "ACGTACGGTTCA"), (3, "TTTTTTTTTTTT")], "read_id bigint, seq string")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (1, 1, 3)], "round int, a bigint, b bigint")
    rows = {(r["a"], r["b"]): r for r in verify.verified(verify.counted(pairs), sketches(reads, config), reads, 0.32, 0.28, 12).collect()}
    assert rows[1, 2]["mult"] == 2 and rows[1, 2]["accepted"] and not rows[1, 3]["accepted"]


def test_parameter_sizes():
    assert [log4_ceil(x) for x in (1, 4, 5, 110, 75009)] == [0, 1, 2, 4, 9]
    assert substring_sizes(110, 75009, 1) == (3, 8) and substring_sizes(110, 75009, 2) == (4, 9)
    assert budgets(75009) == {"bad_rounds": 134, "work": 10, "rounds": 300}
