"""Reads hold all letters of a document or turn: against brute force on a small table, and against the SQL."""

import os

import duckdb
import pytest

from readpool import registry
from readpool.sources import tables

DATA = "/root/testdata/sf0.001"
HEAD = "the quick brown fox jumps over the lazy dog " * 6


def letters(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in text.lower() if "a" <= c <= "z")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("reads")
    rows = [(1, HEAD + "ends one way"), (2, HEAD + "and another way " * 9), (3, HEAD + "ends one way"), (4, "abc"), (None, HEAD), (5, None), (6, "a b c, d e f")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), {i: letters(t) for i, t in rows if i and t and len(letters(t)) >= 6}


def test_whole_letter_sequences(spark, folder):
    path, want = folder
    assert {r["read_id"]: r["seq"] for r in tables.document_reads(spark, path).collect()} == want
    assert {(r["n"], r["first"]) for r in registry.distinct_reads(spark, path).collect()} == {(2, 1), (1, 2), (1, 6)}
    codes = {(r["read_id"], r["pos"]): r["code"] for r in registry.qgram_codes(spark, path).collect()}
    value = lambda s: sum("ACGT".index(c) * 4**p for p, c in enumerate(s))
    assert codes == {(i, p): value(s[p : p + 6]) for i, s in want.items() for p in range(len(s) - 5)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["reads_projected", "qgram_set_sizes", "minhash_signature", "verified_pairs", "substring_chunks", "cluster_representatives", "stage2_clusters"])
def test_against_sql(spark, name):
    sql = registry.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(sql).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    as_rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_blocks_of_whole_turns(spark, tmp_path):
    rows = [(1, 0, HEAD), (1, 1, HEAD + "one"), (1, 2, "a b"), (1, 3, HEAD + "other"), (2, 0, "hello there"), (2, 1, HEAD)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, registry.parse_blocks(spark, str(tmp_path)).select("read_id", "seq", "strand").collect()))
    assert got == [(0, letters(HEAD + "one"), letters(HEAD)), (1, letters(HEAD + "other"), letters(HEAD)), (2, letters(HEAD), letters("hello there"))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_blocks_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(registry.oracle_sql()["parse_blocks"]).df()
    got = registry.parse_blocks(spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_lookup_of_every_read(spark, tmp_path):
    rows = [(i, f"read of some letters {'abcdefghijklm'[i % 13] * 3}", "en", f"s{i % 4}") for i in range(1, 40)] + [(50, "no label at all", None, "s1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, text, lang, source in rows[:-1]:
        seq = letters(text)
        want[seq] = min(want.get(seq, "~"), f"{lang}/{source}")
    want[letters(rows[-1][1])] = "-1"
    assert {r["seq"]: r["strand_id"] for r in registry.read_lookup(spark, str(tmp_path)).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_lookup_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["read_lookup"]).df()
    got = registry.read_lookup(spark, DATA).toPandas()[list(want.columns)]
    assert len(want) > 100 and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
