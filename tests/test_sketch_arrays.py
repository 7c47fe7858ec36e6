import random

from pyspark.sql import functions as F

from readpool.config import ClusterConfig
from readpool.functions.sequences import permuted, qgrams
from readpool.operators import sketch


def test_sketches_are_the_least_permuted_codes_of_sets(spark):
    """Rows of one id are one read, also across Arrow batches; reads of few grams look past the first places."""
    r, config = random.Random(4), ClusterConfig()
    rows = [(None if i % 9 == 0 else i // 2, "".join(r.choice("ACGT") for _ in range(r.choice([0, 5, 6, 9, 80, 3000])))) for i in range(70)] + [(500, None)]
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {x["read_id"]: x for x in sketch.sketches(reads, config).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    codes = reads.select("read_id", F.explode(qgrams("seq", config.q)).alias("c"))
    values = F.array(*(F.min(permuted(F.col("c"), p, config.code_bits)) for p in config.permutations()))
    want = {x["read_id"]: x for x in codes.groupBy("read_id").agg(values.alias("sig"), F.count(F.lit(1)).alias("n"), F.collect_set("c").alias("s")).collect()}
    assert got.keys() == want.keys() and None in got
    for k, x in got.items():
        assert (x["sig"], x["n_bag"]) == (want[k]["sig"], want[k]["n"])
        assert {64 * w + b for w, word in enumerate(x["bits"]) for b in range(64) if word >> b & 1} == set(want[k]["s"])


def test_grams_are_not_made_rows(spark):
    """A read of 1,900 letters was 1,900 rows with 40 minima each: some 100 times the time."""
    plan = sketch.sketches(spark.createDataFrame([(1, "ACGTACGT")], "read_id bigint, seq string"), ClusterConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
