"""The registered queries on a table of edge cases: columns, one row for each document, folds, and the SQL where there is some."""

import zlib

import duckdb
import pytest

from readpool.llm import registry
from tests.llm import cases

COLUMNS = {
    "op1_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature codec duration_s n_keyframes keyframes",
    "op2_chat_formatting": "conv_id part n_turns n_copies rendered",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_line_dedup": "doc_id n_lines n_deleted n_runs kept_sha256",
    "op6_toxicity": "doc_id held_out score predicted n_clauses n_hits",
    "op7_sentencepiece": "doc_id n_tokens token_ids decoded_sha256 round_trip",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_jaccard_join": "doc_id n_shingles component_id",
    "op10_topk_search": "query_id rank vec_id score",
}
FOLDS = {"op3_language_id": (3, 1), "op6_toxicity": (4, 2)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    cases.frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(c, t, "user", f"turn {t * (c % 3)}") for c in range(12) for t in range(c % 5)] + [(None, 0, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i, [float(i % 7), i / 8]) for i in range(45)] + [(None, [1.0, 1.0]), (60, None)], "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_all_are_here():
    assert set(registry.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, folder, name):
    out = registry.queries()[name](spark, folder)
    assert out.columns == COLUMNS[name].split()
    rows = out.collect()
    if "doc_id" in out.columns:
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((d[0] for d in cases.documents()), key=repr)
    if name in FOLDS:
        n, k = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == k) for r in rows if r["doc_id"] is not None)
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "labels", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(registry.oracle_sql()[name])
        assert [c[0] for c in want.description] == out.columns
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
