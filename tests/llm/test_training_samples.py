"""Training samples: a row beyond the bound of characters is left out alone, and every language has rows."""

from readpool.llm import langid, toxicity
from tests.llm import cases


def test_a_long_row_does_not_end_the_language_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda sample: sample)
    docs = [(i, f"text {i}", "en" if i % 2 else "fr", "s", 0) for i in range(40)]
    short = langid.fitted(cases.frame(spark, docs), max_chars=10_000)
    first = short[0][0]
    longer = [(i, "x" * 20_000 if t == first else t, y, s, n) for i, t, y, s, n in docs]
    assert langid.fitted(cases.frame(spark, longer), max_chars=10_000) == short[1:]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda sample: sample)
    docs = [(i, f"text {i}", f"l{i % 300}", "s", 0) for i in range(3000)]
    assert {y for _, y in langid.fitted(cases.frame(spark, docs))} == {f"l{i}" for i in range(300)}


def test_a_long_row_does_not_end_the_toxicity_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda sample: sample)
    docs = [(i, f"text {i}", "en", "s", 0) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    short = toxicity.fitted(cases.frame(spark, docs), labels, max_chars=10_000)
    longer = [(i, "x" * 20_000 if t == short[0][0] else t, y, s, n) for i, t, y, s, n in docs]
    assert toxicity.fitted(cases.frame(spark, longer), labels, max_chars=10_000) == short[1:]
