import pytest

from readpool.sources import blocks

SAMPLE = "\n".join(["ACGTACGTAA", "*" * 29, "ACGTACGTAC", "ACGTACGTAT", "ACGTTCGTAA", "", "", "GGGTACGTAA", "*" * 29, "GGGTACGTAC", "GGGTACGTAT", "GGGTTCGTAA", "", ""])


def pool_of(spark, tmp_path, text, **options):
    path = tmp_path / "reads.txt"
    path.write_bytes(text.encode())
    return blocks.read_pool(spark, str(path), **options)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_two_blocks_of_three(spark, tmp_path):
    pool = pool_of(spark, tmp_path, SAMPLE)
    assert rows(pool.originals) == [(0, "ACGTACGTAA"), (1, "GGGTACGTAA")]
    assert [(r["read_id"], r["cluster_id"]) for r in pool.reads.orderBy("read_id").collect()] == [(i, i // 3) for i in range(6)]
    assert pool.rejects.count() == 0


@pytest.mark.parametrize("blank", ["", "\n", "\n\n\n\n\n"])
def test_line_ends_and_blank_lines_do_not_matter(spark, tmp_path, blank):
    text = SAMPLE.replace("\n\n\n", "\n" + blank).replace("\n", "  \r\n")
    pool = pool_of(spark, tmp_path, text)
    assert pool.originals.count() == 2 and pool.reads.count() == 6 and pool.rejects.count() == 0


def test_empty_file(spark, tmp_path):
    pool = pool_of(spark, tmp_path, "")
    assert pool.originals.count() == pool.reads.count() == pool.rejects.count() == 0


def test_block_without_copies_and_text_before_the_first(spark, tmp_path):
    pool = pool_of(spark, tmp_path, "lost line\nACGTACGT\n***\n\n\nGGGGGGGG\n***\nGGGGGGGA\n")
    assert rows(pool.originals) == [(0, "ACGTACGT"), (1, "GGGGGGGG")]
    assert [r["seq"] for r in pool.reads.collect()] == ["GGGGGGGA"]


def test_bad_lines_are_rejected_with_a_reason(spark, tmp_path):
    pool = pool_of(spark, tmp_path, "ACGTACGT\n***\n***\nACG\nacgtacgt\nACGTNACG\nACGTACGA\n")
    assert [r["seq"] for r in pool.reads.collect()] == ["ACGTACGA"]
    assert sorted(r["reason"] for r in pool.rejects.collect()) == ["letter outside ACGT", "letter outside ACGT", "separator without a strand", "shorter than a gram"]


def test_equal_strands_and_reads_stay_apart(spark, tmp_path):
    text = "ACGTACGT\n***\nACGTACGA\nACGTACGA\n\n\nACGTACGT\n***\nACGTACGA\n"
    pool = pool_of(spark, tmp_path, text)
    assert pool.originals.count() == 2 and pool.reads.count() == 3


def test_strict_files_split_and_keep_their_order(spark, tmp_path):
    """Blocks with two blank lines after each, in a file of many splits: ids follow the file."""
    text = "".join(f"{'ACGT'[i % 4] * 8}ACGT\n{blocks.SEPARATOR}\n" + "".join(f"{'ACGT'[i % 4] * 8}{'ACGT'[k] * 4}\n" for k in range(i % 4)) + "\n\n" for i in range(60))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        whole, split = pool_of(spark, tmp_path, text), pool_of(spark, tmp_path, text, strict=True)
        assert rows(split.originals) == rows(whole.originals) and split.rejects.count() == 0
        assert rows(split.reads.select("read_id", "cluster_id", "seq")) == rows(whole.reads.select("read_id", "cluster_id", "seq"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lookup_of_known_and_unknown_reads(spark):
    pool = spark.createDataFrame([("ACGTAC", 4), ("ACGTAC", 2), ("GGGTAC", 3)], "seq string, strand_id bigint")
    wanted = spark.createDataFrame([("ACGTAC",), ("TTTTTT",)], "seq string")
    assert rows(blocks.lookup(wanted, pool)) == [("ACGTAC", "2"), ("TTTTTT", blocks.UNKNOWN)]


def test_round_trip(spark, tmp_path):
    pool = pool_of(spark, tmp_path, SAMPLE)
    members = pool.reads.selectExpr("cluster_id AS cluster", "read_id", "cluster_id AS strand_id", "seq")
    blocks.write_blocks(members, pool.originals, str(tmp_path / "out"))
    again = blocks.read_pool(spark, str(tmp_path / "out"))
    assert sorted(r["seq"] for r in again.reads.collect()) == sorted(r["seq"] for r in pool.reads.collect())
    assert sorted(r["strand"] for r in again.originals.collect()) == sorted(r["strand"] for r in pool.originals.collect())


def test_majority_prefers_the_strand_met_first(spark):
    members = spark.createDataFrame([(0, 1, 5), (0, 2, 3), (0, 3, 3), (0, 4, 5), (9, 9, 1)], "cluster bigint, read_id bigint, strand_id bigint")
    assert rows(blocks.majority_strand(members)) == [(0, 5), (9, 1)]


def test_shuffled_ids_are_a_permutation_that_reruns_repeat(spark):
    reads = spark.createDataFrame([(i, "A") for i in range(50)], "read_id bigint, seq string")
    ids = [r["read_id"] for r in blocks.shuffled_ids(reads, 3).collect()]
    assert sorted(ids) == list(range(50)) and ids == [r["read_id"] for r in blocks.shuffled_ids(reads, 3).collect()]
