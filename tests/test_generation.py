import pytest
from pyspark.sql import functions as F

from assize.operators import generation
from assize.plans.lineage import settle


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "mode", "score"),
    [
        ('{"explanation": "e", "score": 4}', "pointwise", "4"), ('{"score": "5", "explanation": ""}', "pointwise", "5"), ('{"explanation": "e", "score": 6}', "pointwise", None), ('{"explanation": "e", "score": 4, "x": 1}', "pointwise", None),
        ('{"score": 4}', "pointwise", None), ('{"explanation": null, "score": 4}', "pointwise", None), ("score: 4", "pointwise", None), (None, "pointwise", None), ("", "binary", None),
        ('{"explanation": "e", "score": true}', "binary", "true"), ('{"explanation": "e", "score": "False"}', "binary", "False"), ('{"explanation": "e", "score": "Response 2"}', "pairwise", "Response 2"), ('{"explanation": "e", "score": "2"}', "pairwise", None), ('{"explanation": "e", "sco', "pairwise", None),
    ],
)
def test_closed_answers(spark, text, mode, score):
    got = one(spark, text, lambda c: generation.closed_answer(c, mode))
    assert (got.score if got else None) == score


def test_closed_rubrics(spark):
    good = '{"description": "d", "scoring": {"score_1": "a", "score_2": "b", "score_3": "c", "score_4": "d", "score_5": "e"}}'
    assert one(spark, good, lambda c: generation.closed_rubric(c, "pointwise")).scoring["5"] == "e"
    assert one(spark, good, lambda c: generation.closed_rubric(c, "binary")) is None
    assert one(spark, '{"scoring": {"true": "a", "false": "b"}}', lambda c: generation.closed_rubric(c, "binary")) is None
    assert one(spark, "nothing", lambda c: generation.closed_rubric(c, "binary")) is None
    with pytest.raises(ValueError):
        generation.closed_rubric(F.lit(""), "other")


def test_rubric_prompts(spark):
    ex = "array<struct<input:string,target:string>>"
    tasks = spark.createDataFrame([(1, "rate it", [1.0, 0.0], [("i", "t")]), (2, "sort it", [0.0, 1.0], [])], f"id bigint, task string, embedding array<float>, examples {ex}")
    known = spark.createDataFrame([(10 + i, f"known {i}", {"1": "low"}, [1.0 - i / 4, i / 4]) for i in range(5)], "id bigint, description string, scoring map<string,string>, embedding array<float>")
    got = generation.rubric_prompts(tasks, known, k=2, seeds=3).collect()
    assert len(got) == 6 and {(r.id, r.seed) for r in got} == {(i, s) for i in (1, 2) for s in range(3)}
    p = {r.id: r.prompt for r in got}
    assert p[1].index("known 0") < p[1].index("known 1") and "known 4" not in p[1] and "Question: i Answer: t" in p[1]
    assert p[2].index("known 4") < p[2].index("known 3") and "Below are" not in p[2]
    assert "known" not in generation.rubric_prompts(tasks, known, k=0, seeds=1).first().prompt.replace("Example", "")


def test_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None)], "id int, cluster int")
    assert [r.category for r in generation.label_clusters(df, F.lit("Maths, Law ,")).orderBy("id").collect()] == ["Maths", "Law", "", None]


def test_negative_answers(spark):
    df = spark.createDataFrame([("a", "q1", "g", ["w"]), ("b", "bad", "g", None)], "ID string, question string, golden_answer string, wrong_answers array<string>")

    def make():
        def client(p):
            if "Question: bad" in p:
                raise ValueError
            return "fixed" if "Negative Answer: raw" in p else "raw"

        return client

    run = lambda **k: {r.ID: r.negative_answer for r in generation.negative_answers(df, make, settle, pause=0, other_pause=0, **k).collect()}
    assert run(policy="none") == {"a": "fixed", "b": None} and run(policy="drop") == {"a": "fixed"}
