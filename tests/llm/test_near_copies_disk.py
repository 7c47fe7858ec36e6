import pyarrow as pa
from pyspark.sql import functions as F

from readpool.llm import common, jaccard


def test_texts_are_compared_once_for_differences(spark):
    rows = [(1, b, 40, 40, 30, 12, [7, 8, b], b) for b in range(2, 12)]
    members = spark.createDataFrame(rows, "a long, b long, na int, nb int, inter int, d int, diff array<long>, cb long")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)

    jaccard.across(members.mapInArrow(run, members.schema)).count()
    assert seen.value == len(rows)


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    gone = common.stored(spark.range(0, 2000, 10).select(F.col("id").alias("gone__")))
    out = jaccard.without(rows, "k", gone)
    assert sorted(r["k"] for r in out.collect()) == [k for k in range(2000) if k % 10]
    assert out.columns == ["k", "text"] and out.filter("text <> concat('text ', k)").isEmpty()
    none = common.stored(spark.range(0).select(F.col("id").alias("gone__")))
    assert jaccard.without(rows, "k", none).count() == 2000
    texts = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftAnti" in line or "Union" in line]
    assert "Union" in texts[0] and any("LeftAnti" in x for x in texts[1:])


def test_small_lists_are_dealt_by_list_once(spark, monkeypatch):
    """The sets of all lists were shuffled once to find pivots and once to join them."""
    rows = [(k, s << 1 | s % 2, 12 if k == 3 else 4) for k, sets in {1: (5, 6, 7, 8), 2: (6, 7, 9, 10), 3: range(4, 16), 4: (30, 31, 32, 33)}.items() for s in sets]
    entries = spark.createDataFrame(rows, "k long, e long, c int")
    nodes = spark.createDataFrame([(s << 17, 1 if s == 30 else 0, 0) for s in range(40)], "s long, leave0 int, leave1 int")
    whole = sorted(jaccard.pivots_of(entries, nodes).collect())
    monkeypatch.setattr(jaccard, "SPLIT", 5)
    out = jaccard.pivots_of(entries, nodes)
    assert sorted(out.collect()) == whole
    assert {(r["k"], r["p"], r["m"]) for r in whole} == {(1, 7, 4), (2, 7, 4), (3, 7, 12), (4, 33, 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("\n")[0] and "c#" in plan and "<= 5" in plan and "> 5" in plan


def test_differences_of_a_pivot_in_one_task_are_not_shuffled(spark, monkeypatch):
    """All differences were dealt by shingle, counted, joined and dealt by set again, also where one task had all sets of a pivot."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)]
    for i in range(1, 15):
        changed = words[: 50 - i % 3] + [f"x{i % 4}{j}" for j in range(9 + i % 3)]
        texts.append(" ".join(changed + [f"y{i}"] * (i % 2)))
    docs = spark.createDataFrame([(v, 100 + v, t) for v, t in enumerate(texts)], "v long, s long, text string")
    packed = [(v, len(t), bytearray(pa.compress(t.encode(), "zstd", asbytes=True))) for v, _, t in docs.collect()]
    known = spark.createDataFrame(packed, "v long, size int, z binary")
    pairs = spark.createDataFrame([(0, b) for b in range(1, 15)], "a long, b long")
    rows = jaccard.compared(pairs, known, 3, 2, diffs=True)
    for r in rows.collect():
        assert r["ordered"] and len(set(r["diff"])) == len(r["diff"]) <= r["d"]
    members = rows.withColumn("cb", F.col("b"))
    whole = {p: sorted(map(tuple, jaccard.across(members, p).collect())) for p in (60, 80)}
    plain = members.drop("ordered")
    assert whole == {p: sorted(map(tuple, jaccard.across(plain, p).collect())) for p in (60, 80)} and whole[80]
    monkeypatch.setattr(jaccard, "SPLIT", 4)  # the sets of the pivot meet in no one task
    split = jaccard.compared(pairs, known, 3, 2, diffs=True)
    assert not any(r["ordered"] for r in split.collect())
    assert whole == {p: sorted(map(tuple, jaccard.across(split.withColumn("cb", F.col("b")), p).collect())) for p in (60, 80)}
