import random

import pytest

from readpool.llm import chat, topk
from tests.llm import cases

TURNS = "conv_id bigint, turn bigint, role string, text string"


def expected_chats(rows):
    """(conv_id, turns, copies) of the conversations that no other begins with, by comparing all of them."""
    talks = {}
    none_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, x or "")
    for c, t, r, x in sorted(set(rows), key=lambda q: (none_first(q[1]), text_first(q[2]), text_first(q[3]))):
        talks.setdefault(c, []).append((r, x))
    kept = []
    for c, said in talks.items():
        if any(len(o) > len(said) and o[: len(said)] == said for o in talks.values()):
            continue
        equal = [k for k, o in talks.items() if o == said]
        if c == min((k for k in equal if k is not None), default=None):
            kept.append((c, len(said), len(equal)))
    return sorted(kept, key=repr)


def talks(seed):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["hi", "yes", "a long answer"]) if t else r.choice(["start", "begin", None])))
    rows += rows[:7] + [(None, 1, "user", "start"), (100, None, None, None), (101, 0, "", ""), (102, 0, None, ""), (103, 5, "user", "start"), (103, 5, "user", "start")]
    rows += [(200, t, "user", f"turn {t}") for t in range(700)] + [(201, t, "user", f"turn {t}") for t in range(650)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots_collapse(spark, seed):
    rows = talks(seed)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS pos", "'y' AS h1", "'z' AS block")
    out = chat.formatted(df).collect()
    got = {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in out}
    assert sorted(got, key=repr) == expected_chats(rows)
    long = sorted((r for r in out if r["conv_id"] == 200), key=lambda r: r["part"])
    assert [r["part"] for r in long] == [0, 1, 2]
    assert "".join(r["rendered"] for r in long) == "".join(f"<|im_start|>user\nturn {t}<|im_end|>\n" for t in range(700))


def test_few_turns_are_one_row_and_the_sql_agrees(spark, tmp_path):
    """Turn numbers may be far apart; what counts is the place."""
    import duckdb

    rows = [(1, t, "user", f"turn {t}") for t in (0, 1000, 2000, 3000)] + [(2, 0, "user", "turn 0"), (None, 3, None, "x"), (None, 3, None, "x"), (4, None, "user", None), (5, None, "user", None)]
    rows += [(6, 7 * t, "user", f"long {t}") for t in range(300)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op2_chat_formatting(spark, str(tmp_path))
    want = con.execute(chat.OP2_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert sum(r["conv_id"] == 1 for r in got.collect()) == 1


def test_chats_run_without_python(spark):
    plan = chat.formatted(spark.createDataFrame(talks(1), TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_chats(spark):
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0


def expected_top(rows, k, divisor):
    import math

    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in fine if i % divisor == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for n, q in fine if n == i for j, v in fine if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def vectors(seed, n=150, d=37):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 3) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    rows += [rows[20], rows[21], (None, rows[0][1]), (n + 50, None), (n + 51, [None] * d), (n + 52, [float("nan")] * d), (n + 53, [float("inf")] + [0.0] * (d - 1)), (n + 60, [1.0, 2.0]), (n + 80, [1.0, 3.0]), (n + 90, [])]
    return rows


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 4)])
def test_top_k_is_exact(spark, blocks):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS d", "3 AS part")
    out = topk.top_k(df, block_rows=blocks[0], query_rows=blocks[1], dim_block=8)
    assert sorted(map(tuple, out.collect())) == expected_top(rows, 20, 20)


def test_top_k_and_its_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    rows = [(i, [float(i % 7), 0.25 * i, -1.5]) for i in range(45)] + [(1, [1.0, 0.25, -1.5]), (20, [6.0, 5.0, -1.5]), (None, [1.0, 1.0, 1.0]), (60, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk.op10_topk_search(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(topk.OP10_SQL).fetchall())


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2e17]), (2, [3e17])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(df, divisor=20).orderBy("rank").collect()] == [2, 1]


def test_top_k_of_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    large = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e9, 1.0]), (2, [1e30, 1.0])], "vec_id bigint, embedding array<double>")
    assert topk.top_k(large).count() == 2
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]


def test_pipeline_stages_take_edge_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    docs = cases.documents()
    cases.frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(r.random() < 0.1)) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    full = cases.with_clashes(cases.frame(spark))
    for name, stage in corpus_pipeline.STAGES:
        for df in (full, full.limit(0)):
            out = stage(spark, df, str(tmp_path))
            assert out.count() == 0 if df is not full else out.count() > 0
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "lang", "source", "token_ids", "n_tokens"]


def test_pipeline_decisions(spark, tmp_path):
    """Each stage against plain rules: toxic texts go, later line runs go, near copies go, sizes follow the mix."""
    import corpus_pipeline

    r = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "or", "ist", "um", "ela")]
    run = "\n".join(cases.words(r, 30, words) for _ in range(3))
    docs = [[i, "\n".join(cases.words(r, 40, words) for _ in range(3)), "en", f"s{i % 3}", 0] for i in range(60)]
    docs[10][1] += "\nyou are an idiot and a moron"
    docs[20][1] += "\n" + run
    docs[30][1] += "\n" + run
    docs[40][1] = docs[41][1] = docs[5][1]
    docs[50][1] = docs[6][1].replace("\n", " \n", 1).replace(" ", "  ", 3)
    cases.frame(spark, [tuple(d) for d in docs]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = now.collect()
    ids = {k: {x["doc_id"] for x in v} for k, v in seen.items()}
    assert ids["toxicity"] == set(range(60)) - {10}
    texts = {x["doc_id"]: x["text"] for x in seen["line_dedup"]}
    assert {40, 41}.isdisjoint(texts) and texts[20] == docs[20][1] and texts[30] == docs[30][1].removesuffix("\n" + run)
    assert ids["ngram_jaccard"] == set(texts) - {50} or ids["ngram_jaccard"] == set(texts)
    assert ids["mixing"] <= ids["ngram_jaccard"] and ids["sentencepiece"] == ids["mixing"]
    assert all(x["n_chars"] == len(x["text"]) for x in seen["mixing"])
