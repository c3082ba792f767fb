"""Findings on data that the small tables don't have: nothing is left out."""

import numpy as np
import pytest

pytest.importorskip("assize.llm")
from assize.llm import pairs as P  # noqa: E402


def test_usual_word_pairs_are_counted_over_all_answers_by_language(spark, monkeypatch):
    few = "alfa beta gama delta epsi zeta etha theta jota kapa lamda myra nyra xira omik pira rhora sigma tora ypsil phira chira psira omega"
    many = " ".join(f"word{i}" for i in range(30))
    schema = "field_name string, record_id bigint, key bigint, task string, input string, lang string, response string"
    rows = [("f", i, i, "", many, "en", many + f" tail{i}.") for i in range(2000)] + [("f", 2000 + i, 2000 + i, "", few, "xx", few + f" last{i}.") for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    languages = P.Languages([[P._Numbers()[w] for w in t.split()] for t in (many, few)], ["en", "xx"])
    got = P.count_all(df.repartition(3), languages)
    assert (got == P.count_pairs([r[-1] for r in rows], languages, P._Numbers())).all()
    assert got[:, -1].tolist() == [2000, 6]
    seen = []
    real = P.Reader.__init__
    monkeypatch.setattr(P.Reader, "__init__", lambda self, lang, common: (seen.append((lang, common)), real(self, lang, common))[1])
    P.broken_pairs(df.unionByName(df), sample_pairs=400)
    lang, common = seen[0]
    n = np.array([P._Numbers()[w] for w in few.split()], np.int64)
    at = (P._grams(n, 2) % np.uint64(P.BUCKETS)).astype(np.int64)
    k = int(np.argmax(lang.scores(n)))
    assert common[k, at].all()  # six of six answers of a small language, few of which the sample has
