import itertools
import math
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from assize.functions import hashing, scoring, stats, text, vectors

TRUTH_TABLE = [
    ('{"score": 3.7}', "3"), ('"score": "4.0"', "4"), ('"score": 007', "7"), ('"score": 10/10', "10"), ("overall_score: 4", "4"), ('"score": "bad", "score": 5', "5"),
    ('{"score":\n "false"}', "false"), ("score: True", "True"), ('"score": -2', None), ("'score': 3", None), ("Score: 4", None), ("**score**: 4", None),
    ('"score": "3 out of 5"', None), ("Error", None), ('{\\"score\\": \\"Response 2\\"}', None), ('{\\"score\\": 2}', "2"), ("", None), (None, None), ('"score": 0', "0"), ('"score": "Response 1"', "Response 1"),
    ('"score": 99999999999999999999', "99999999999999999999"),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_scores(spark):
    df = spark.createDataFrame([(t, w) for t, w in TRUTH_TABLE], "t string, w string")
    got = df.select("t", "w", scoring.extract_score(F.col("t")).alias("g"), scoring.int_score(F.col("t")).alias("n")).collect()
    assert [(r.t, r.g) for r in got] == TRUTH_TABLE
    assert {r.t: r.n for r in got}['"score": 99999999999999999999'] is None
    assert {r.t: r.n for r in got}["score: True"] is None and {r.t: r.n for r in got}['{"score": 3.7}'] == 3


def test_matches(spark):
    df = spark.createDataFrame([("True", "true"), ("3", "3"), (None, None), ("03", "3")], "a string, g string")
    for how, want in (("exact", [False, True, False, False]), ("casefold", [True, True, False, False]), ("int", [False, True, False, True])):
        assert [r.x for r in df.select(scoring.matches(F.col("a"), F.col("g"), how).alias("x")).collect()] == want
    with pytest.raises(ValueError):
        scoring.matches(F.lit(1), F.lit(1), "other")


def test_pick_is_a_pure_function(spark):
    df = spark.range(2000)
    a = [r.x for r in df.select(hashing.pick(F.col("id"), 3, 7).alias("x")).orderBy("id").collect()]
    assert set(a) == set(range(7)) and a == [r.x for r in df.repartition(5).select("id", hashing.pick(F.col("id"), 3, 7).alias("x")).orderBy("id").collect()]
    assert one(spark, hashing.pick(F.col("k"), 1, 0), k="a") is None and one(spark, hashing.pick(F.col("k"), 1, 5), k=None) is None
    assert sorted(one(spark, hashing.hash_order(F.col("a"), F.lit("k"), 1), a=["x", "y", "y"])) == ["x", "y", "y"]
    assert one(spark, hashing.pick_from(F.col("a"), F.lit("k"), 1), a=[]) is None


def tau_brute(rows):
    p = q = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s = (a - c) * (b - d)
        p, q, tx, ty = p + (s > 0), q + (s < 0), tx + (a == c), ty + (b == d)
    n0 = len(rows) * (len(rows) - 1) / 2
    below = (n0 - tx) * (n0 - ty)
    return (p - q) / math.sqrt(below) if below > 0 else None


def test_statistics_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("a", rng.randint(1, 5), rng.randint(1, 5)) for _ in range(90)] + [("b", 1, rng.randint(1, 5)) for _ in range(9)] + [("c", 1, 2), ("d", None, 2), (None, 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    tau = {r.g: r.tau for r in stats.kendall_tau_b(df, "x", "y", ["g"]).collect()}
    for g in ("a", "b", "c", None):
        want = tau_brute([(x, y) for k, x, y in rows if k == g and x is not None])
        assert tau[g] == (None if want is None else pytest.approx(want)), g
    assert "d" not in tau
    all_ = stats.kendall_tau_b(df, "x", "y", []).collect()
    assert len(all_) == 1 and all_[0].tau == pytest.approx(tau_brute([(x, y) for _, x, y in rows if x is not None]))
    r = {x.g: x.r for x in df.groupBy("g").agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    import numpy as np

    a = np.array([(x, y) for g, x, y in rows if g == "a"])
    assert r["a"] == pytest.approx(np.corrcoef(a.T)[0, 1]) and r["b"] is None and r["c"] is None and r["d"] is None
    assert one(spark, stats.safe_ratio(F.lit(1), F.lit(0)), k="a") is None


def test_options(spark):
    p = lambda s: one(spark, text.parse_options(F.col("s")), s=s)
    assert p("(A) x (B) y") == ["x", "y"] and p("(A) one\n(B) two (see C)\n(C) three") == ["one", "two (see C)", "three"]
    assert p("(B) y") == [] and p("none") == [] and p(None) is None and p("(A) x (C) z") == ["x (C) z"]
    assert one(spark, text.join_options(F.col("o")), o=["x", "y"]) == "(A) x\n(B) y"
    assert one(spark, text.label_options(F.col("o")), o=["x"] * 5) is None
    assert one(spark, text.option_text(F.col("o"), F.lit("(B)")), o=["x", "y (z)"]) == "y (z)"
    assert one(spark, text.options_part(F.col("s")), s="Q?\nOptions:\n(A) x") == "(A) x" and one(spark, text.options_part(F.col("s")), s="Q?") is None


def test_text_pieces(spark):
    t = "Intro\n### TASK\n do it \n### INPUT\nthis\n\n### RESPONSE\nr"
    assert one(spark, text.task_and_input(F.col("s")), s=t) == "do it \n### INPUT\nthis" and one(spark, text.task_and_input(F.col("s")), s="bare") is None
    assert one(spark, text.instruct(F.lit("a"), F.col("s")), s="q") == "Instruction: a\nQuery: q"
    assert one(spark, text.camel(F.col("s")), s="word_sorting_two") == "WordSortingTwo"
    assert one(spark, text.comma_list(F.col("s")), s="a, b ,c") == ["a", "b", "c"]
    assert one(spark, text.id_domain(F.col("s")), s="chat-hard/7-0-2") == "chat" and one(spark, text.id_origin(F.col("s")), s="chat-hard/7-0-2") == "chat-hard/7"
    i, j = text.id_cell(F.col("s"))
    assert (one(spark, i, s="a/7-0-2"), one(spark, j, s="a/7-0-2"), one(spark, i, s="x")) == (0, 2, None)
    assert one(spark, text.think_text(F.col("s"), F.lit("r")), s=None) == "<think></think>r"
    assert one(spark, text.word_count(F.col("s")), s=" a  b\nc ") == 3 and one(spark, text.word_count(F.col("s")), s="") == 0
    assert one(spark, text.letter(F.lit(2)), s="") == "C" and one(spark, text.letter_index(F.lit("(C)")), s="") == 2
    ex = F.array(F.struct(F.lit("2+2").alias("input"), F.lit("4").alias("target")))
    assert one(spark, text.fewshot_block(ex), s="") == "Below are some examples:\nQuestion: 2+2 Answer: 4\n"
    assert one(spark, text.example_block(ex), s="").startswith("Examples\nExample 1:\n{")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2_normalise(F.col("a")).alias("n"), vectors.l2_normalise(F.col("b")).alias("z"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.squared_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].n == pytest.approx([0.6, 0.8]) and got[0].z == [0.0, 0.0] and got[0].c is None and got[0].d == 25.0 and got[1].c == 0.0
    assert df.agg(vectors.mean_vector(F.col("a"), 2).alias("m")).first().m == [2.0, 2.0]


def test_concordance_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(20):
        cells = sorted({(int(a), int(b)) for a, b in rng.integers(-3, 6, (rng.integers(1, 25), 2))})
        x, y = (np.array(v, float) for v in zip(*cells))
        c = rng.integers(1, 5, len(cells)).astype(float)
        want = sum(c[i] * c[j] * np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]) for i in range(len(cells)) for j in range(i))
        assert stats.concordance(x, y, c) == want
