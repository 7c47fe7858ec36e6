import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readpool.llm import common, mixing, pieces, toxicity
from tests.llm import cases


def collections(spark) -> int:
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())


def test_executors_run_their_collector(spark):
    before = collections(spark)
    common.collected(spark)
    assert collections(spark) > before


def test_each_stage_begins_with_free_heaps(spark, monkeypatch):
    """The heap of all stages so far stood beside the last one's Python workers."""
    seen = []
    monkeypatch.setattr(common, "collected", seen.append)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        with pytest.raises(Exception):  # noqa: B017, PT011
            stage(spark, None, "/no/such/folder")
        assert len(seen) == k + 1


@pytest.mark.parametrize("made", [pieces.encoded, pieces.round_trips, mixing.take])
def test_workers_give_back_memory(spark, monkeypatch, made):
    given = spark.sparkContext.accumulator(0)
    for module in (pieces, mixing):
        monkeypatch.setattr(module, "give_back_memory", lambda: given.add(1), raising=False)
    rows = made(cases.frame(spark)).agg(F.count(F.lit(1)), F.sum(F.hash("doc_id"))).collect()
    assert rows[0][0] > 0 and given.value > 0


def test_the_driver_collects_during_a_long_job(spark, monkeypatch):
    """The driver's heap was collected only after a job, however long."""
    common.stored(spark.range(4))  # what the first job of a session waits for
    monkeypatch.setattr(common, "COLLECT", 0.3)
    monkeypatch.setattr(common, "_watched", {})
    slow = spark.range(0, 4, 1, 1).mapInArrow(lambda batches: (__import__("time").sleep(2) or b for b in batches), "id long")
    before = collections(spark)
    assert common.stored(slow).count() == 4
    between = collections(spark)
    assert between >= before + 3
    assert slow.count() == 4 and collections(spark) >= between + 2  # a job of the caller's own
    thread = common._watched[spark.sparkContext.applicationId]
    common.collecting(spark)
    assert common._watched == {spark.sparkContext.applicationId: thread}
    thread.join(20)
    assert not thread.is_alive()


def test_rows_to_learn_from_come_in_few_jobs(spark, monkeypatch):
    """Every range of rows was a job of its own, as many as the input has partitions."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.extend(sample))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("learn", "learn")
        toxicity.fitted(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("learn")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    held = docs.filter(~common.held_out("doc_id", 4, 2)).orderBy(F.xxhash64("doc_id"))
    assert [t for t, _ in seen] == [r["text"] for r in held.collect()]
    assert len(jobs) < 40
