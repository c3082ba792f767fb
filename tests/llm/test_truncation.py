import pytest

pytest.importorskip("assize.llm")
from assize.llm.truncation import longer_copies, truncated_values, truncation_rates  # noqa: E402

SCHEMA = "field_name string, record_id bigint, value string, cut string, tail int"


def rows(spark, *values):
    return spark.createDataFrame([("f", i, v, "clash", i) for i, v in enumerate(values)], SCHEMA)


def found(spark, *values):
    return {r.record_id: r.longer_copy for r in truncated_values(rows(spark, *values)).collect()}


def test_form_and_prefix_evidence(spark):
    got = found(spark, "It sees the note no.", "It sees the note no. 45 of the list. It holds.", "I say no.", "The part about the wind is fi", "The part about the wind is fine.", None, "")
    assert got == {0: True, 3: True}


def test_repeated_rows_count_once_and_empty_table(spark):
    df = rows(spark, "The part about the wi")
    assert truncated_values(df.unionByName(df)).count() == 1
    assert truncated_values(df.limit(0)).count() == 0


def test_longer_copies_against_brute_force(spark):
    texts = ["The quick brown fox jumps over the lazy dog again and again", "The quick brown fox sleeps", "A completely different sentence that is long enough for several steps", "Short one here"]
    tails = [t[:n] for t in texts for n in (9, 14, 16, 17, 25, 31, 32, 33, 40, 48) if n <= len(t)] + texts + ["The quick brown cat", "nothing at all"]
    t = spark.createDataFrame([(x,) for x in tails], "tail string")
    v = spark.createDataFrame([(x,) for x in texts], "value string")
    got = {r.tail for r in longer_copies(t, v).collect()}
    want = {x for x in tails if any(y.startswith(x) and any(c.isalnum() for c in y[len(x) : len(x) + 6]) for y in texts)}
    assert got == want


def test_hot_prefix(spark):
    same = [f"The very same opening of a sentence number {i}." for i in range(300)]
    assert found(spark, *same, "The very same opening of a sent") == {300: True}


def test_rates(spark):
    v = spark.createDataFrame([("f", 1, "It holds.", "a"), ("f", 2, "It ho", "a"), ("f", 2, "It ho", "a"), ("f", 3, None, "a"), ("f", 4, "So i", None)], "field_name string, record_id bigint, value string, source string")
    got = {(r.source, r.n_values, r.n_cut, r.cut_share) for r in truncation_rates(v, truncated_values(v)).collect()}
    assert got == {("a", 2, 1, 0.5), (None, 1, 1, 1.0)}


def test_any_word_may_have_a_stop_that_ends_nothing(spark):
    whole = [f"Das steht in Abb. {i} der Anlage. Siehe Nr. {i} dazu. Das steht bei Approximativ. {i} Stellen." for i in range(5)]
    got = found(spark, *whole, "Das steht in Abb.", "Siehe Nr.", "Das steht bei Approximativ.", "Das ist gut.", "Das steht da.")
    assert got == {5: True, 6: True, 7: True}
