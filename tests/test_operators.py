import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assize.operators import completion, curation, evaluators, negatives, pairing, prompts, reshape, rubrics, sampling

RUBRIC = [("d0", {"true": "holds", "false": "fails"}), ("d1", {"true": "fits", "false": "misses"}), ("d2", {"true": "y", "false": "n"})]


def rubric(rows=RUBRIC):
    return F.array(*[F.struct(F.lit(d).alias("description"), F.create_map(*[F.lit(x) for kv in s.items() for x in kv]).alias("scoring")) for d, s in rows])


def paired(spark, rows):
    return spark.createDataFrame(rows, "id string, answer string, parse_failed boolean, score string, subject string")


def test_parse_predictions(spark):
    df = spark.createDataFrame([(1, '{"score": 4}'), (2, "true"), (3, None), (4, "Error"), (5, "score: true")], "id int, response string")
    a = {r.id: (r.answer, r.parse_failed) for r in pairing.parse_predictions(df).collect()}
    assert a == {1: ("4", False), 2: (None, False), 3: (None, True), 4: (None, False), 5: ("true", False)}
    b = {r.id: (r.answer, r.parse_failed) for r in pairing.parse_predictions(df, integer=True).collect()}
    assert b == {1: ("4", False), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, True)}
    assert {r.id for r in pairing.parse_predictions(df, error_fails=True).where("parse_failed").collect()} == {3, 4}


def test_accuracy_counts_nulls_and_failures(spark):
    df = paired(spark, [("1", "true", False, "true", "a"), ("2", "True", False, "true", "a"), ("3", None, False, "true", "b"), ("4", None, True, "true", "b")])
    r = evaluators.accuracy(df, []).first()
    assert (r.n, r.failed, r.correct, r.valid_accuracy, r.raw_accuracy) == (4, 1, 1, 0.3333, 0.25)
    assert evaluators.accuracy(df, [], "casefold").first().correct == 2
    assert evaluators.accuracy(df.limit(0), ["subject"]).count() == 0
    r = evaluators.accuracy(df.where("parse_failed"), []).first()
    assert r.valid_accuracy is None and r.raw_accuracy == 0
    s = {x.subject: (x.total, x.correct, x.failed, x.accuracy) for x in evaluators.accuracy_by_subject(df, "subject").collect()}
    assert s == {"a": (2, 2, 0, 1.0), "b": (2, 0, 1, 0.0)}
    assert evaluators.micro_average(evaluators.accuracy_by_subject(df, "subject")).first().accuracy == 0.5


def test_agreement(spark):
    df = paired(spark, [(str(i), str(a), False, str(g), "s") for i, (a, g) in enumerate([(1, 1), (2, 3), (3, 2), (5, 5)])] + [("9", None, True, "4", "s")])
    r = evaluators.agreement(df, []).first()
    assert (r.n, r.failed, r.correct) == (5, 1, 2) and r.kendall_tau == pytest.approx(0.6667) and r.pearson_r == pytest.approx(round(np.corrcoef([1, 2, 3, 5], [1, 3, 2, 5])[0, 1], 4))
    one = evaluators.agreement(df.limit(1), ["subject"]).first()
    assert one.pearson_r is None and one.kendall_tau is None


def test_sections(spark):
    sub = spark.createDataFrame([("x", 0.5), ("y", 1.0)], "subset string, accuracy double")
    sec = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 3.0), ("A", "gone", 9.0), ("B", "gone", 1.0)], "section string, subset string, weight double")
    s = evaluators.section_scores(sub, sec)
    assert {r.section: r.score for r in s.collect()} == {"A": 0.875, "B": 0.0}
    assert evaluators.section_average(s).first().average == 0.4375
    assert evaluators.benchmark_sections(spark).count() == len(evaluators.SUBSET_SIZES) == 23


def test_style_grand_mean_is_cell_mean_when_full(spark):
    rows = [(f"chat-x/{k}-{i}-{j}", "A" if (k + i * j) % 3 else "b", False, "a", "") for k in range(4) for i in range(3) for j in range(3)]
    df = paired(spark, rows)
    m = evaluators.style_matrix(df)
    d = evaluators.style_difficulty(m).first()
    assert d.domain == "chat" and d.average == pytest.approx(np.mean([r[1] == "A" for r in rows]))
    assert evaluators.style_summary(evaluators.style_difficulty(m)).first().total == pytest.approx(d.average)
    half = evaluators.style_difficulty(evaluators.style_matrix(df.where("id like '%-0-0'"))).first()
    assert half.easy == 0 and half.normal == pytest.approx(3 * np.mean([r[1] == "A" for r in rows if r[0].endswith("-0-0")]))


def test_evaluate_dispatch(spark):
    resp = spark.createDataFrame([("1", '{"score": "true"}'), ("2", "score: false")], "id string, response string")
    truth = spark.createDataFrame([("1", 1), ("2", 1), ("3", 0)], "id string, score int")
    assert evaluators.evaluate("XSUM_faithfulness", resp, truth).first().correct == 1
    assert evaluators.evaluate("BBH", resp, truth.selectExpr("id", "'true' score")).first().raw_accuracy == 0.5
    t5 = spark.createDataFrame([("1", 4)], "id string, score int")
    assert evaluators.evaluate("FeedbackBench", spark.createDataFrame([("1", "score: 4")], "id string, response string"), t5).first().correct == 1
    with pytest.raises(ValueError):
        evaluators.evaluate("other", resp, truth)
    assert evaluators.choose_datasets(["BBH", "zzz"]) == (["BBH"], ["zzz"]) and len(evaluators.choose_datasets(["all"])[0]) == 8
    with pytest.raises(ValueError):
        evaluators.choose_datasets(["zzz"])
    long = evaluators.metrics_long(evaluators.accuracy(paired(spark, [("1", "t", False, "t", "a")]), ["subject"]), ["subject"])
    assert {r.metric for r in long.collect()} == {"n", "failed", "correct", "valid_accuracy", "raw_accuracy"}


def test_positional_pairing(spark):
    a = spark.createDataFrame([(5, "e"), (1, "a"), (3, "c")], "id int, x string")
    b = spark.createDataFrame([(2, "b"), (9, "z")], "id int, y string")
    got = sorted((r.ordinal, r.id, r.id_right, r.y_right) for r in pairing.pair_by_position(a, b).collect())
    assert got == [(0, 1, 2, "b"), (1, 3, 9, "z"), (2, 5, None, None)]
    n = pairing.with_ordinal(spark.range(1000).repartition(7), "id")
    assert n.where("id <> ordinal").count() == 0
    assert pairing.with_ordinal(spark.range(0), "id").count() == 0


def test_lookup_keeps_null_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, base string")
    t = spark.createDataFrame([(1, "new"), (2, None)], "id int, response string")
    got = {r.id: r.v for r in pairing.lookup(df, t, "id", "response", F.col("base"), "v").collect()}
    assert got == {1: "new", 2: None, 3: "z", None: "n"}


def test_rubrics(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"description": "d", "scoring": {f"score_{i}": f"s{i}" for i in range(1, 6)}}, {"description": "e", "scoring": {"response_1": "a", "response_2": "b"}}]))
    r = rubrics.load_rubrics(spark, str(p)).collect()
    assert [x["mode"] for x in r] == ["pointwise", "pairwise"] and r[0].scoring["3"] == "s3"
    p.write_text(json.dumps([{"description": "d", "scoring": {"1": "x"}}]))
    with pytest.raises(Exception, match="fit no mode"):
        rubrics.load_rubrics(spark, str(p)).collect()
    assert rubrics.load_rubrics(spark, str(p), strict=False).first()["mode"] is None
    with pytest.raises(ValueError):
        rubrics.check_mode("other")


def test_retrieval(spark):
    items = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "id bigint, embedding array<float>")
    got = rubrics.retrieve_top_k(items.where("id in (0, 7)"), items, 3).collect()
    v = np.array([[np.cos(i), np.sin(i)] for i in range(40)])
    for q in (0, 7):
        want = np.argsort(-(v @ v[q]), kind="stable")[:3].tolist()
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert rubrics.retrieve_top_k(items.limit(1), items, 0).count() == 0 and rubrics.retrieve_top_k(items.limit(0), items, 3).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([(0, "in", "ra", "rb"), (1, "in", "ra", "rb"), (3, None, "ra", None)], "id int, input string, a string, b string")
    p = prompts.prompt_rows(df, rubric(), "binary", "input", "a").orderBy("id").collect()
    assert p[0].prompt.startswith("Evaluate the response based on") and "\n\n### INPUT\nin\n\n### RESPONSE\nra\n\n### EVALUATION RUBRIC\ntrue: " in p[0].prompt and p[0].prompt.endswith("### EVALUATION")
    two = rubric([("d", {"response_1": "x", "response_2": "y"})])
    q = prompts.prompt_rows(df, two, "pairwise", "input", "a", "b").orderBy("id").collect()
    assert "### RESPONSE 1\nra\n\n### RESPONSE 2\nrb" in q[0].prompt and "### RESPONSE 1\nrb\n\n### RESPONSE 2\nra" in q[1].prompt
    assert "### RESPONSE 1\nra\n\n### RESPONSE 2\n\n" in q[2].prompt
    fixed = df.select(prompts.fixed_prompt("binary", rubric(), F.col("input"), F.col("a"), index=1).alias("p")).first().p
    assert "### TASK\nd1\n" in fixed and json.loads(prompts.answer_schema("binary"))["required"] == ["explanation", "score"]
    with pytest.raises(ValueError):
        prompts.render("pairwise", F.lit(""), F.lit(""), F.lit(""), F.lit(None))
    chat = df.select(prompts.as_chat(F.col("a")).alias("c")).first().c
    assert chat[0].role == "user" and chat[0].content == "ra"
    w = df.select(prompts.wrong_answer_prompt(F.lit("q"), F.lit("c"), F.array(F.lit("w1"))).alias("a"), prompts.wrong_answer_prompt(F.lit("q"), F.lit("c"), F.lit(None).cast("array<string>")).alias("b")).first()
    assert "Wrong Answers:\n- w1\n" in w.a and "Wrong Answers" not in w.b and w.b.endswith("Response:")


def test_negatives_never_equal_the_target(spark):
    df = spark.createDataFrame([(i, "Q?\nOptions:\n(A) w (1)\n(B) x\n(C) y\n(D) z", "(" + "ABCD"[i % 4] + ")") for i in range(200)], "id int, input string, target string")
    rows = negatives.choice_negatives(df).collect()
    for r in rows:
        right = r.options["ABCD".index(r.target[1])]
        assert r.random_negative != r.target[1] and r.shuffled_target != r.target[1]
        assert f"({r.shuffled_target}) {right}" in r.shuffled_options
    assert len({r.random_negative for r in rows}) == 4
    single = negatives.choice_negatives(spark.createDataFrame([(1, "(A) only", "A")], "id int, input string, target string")).first()
    assert single.random_negative is None and single.shuffled_target == "A"
    num = negatives.number_negatives(spark.createDataFrame([(i, i % 17) for i in range(300)], "id int, target int")).collect()
    assert all(r[c] != r.target for r in num for c in ("random_negative", "easy_negative", "hard_negative"))
    assert np.std([r.easy_negative - r.target for r in num]) > np.std([r.hard_negative - r.target for r in num])
    same = negatives.number_negatives(spark.createDataFrame([(i, 4) for i in range(20)], "id int, target int")).collect()
    assert {abs(r.easy_negative - 4) for r in same} == {1}


def test_word_and_bracket_negatives(spark):
    words = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(2 + i % 9))) for i in range(100)] + [(998, "same same"), (999, "one")], "id int, target string")
    for r in words.select("id", "target", negatives.swap_words(F.col("target"), F.col("id"), 1).alias("a"), negatives.swap_share(F.col("target"), F.col("id"), 2).alias("b")).collect():
        for x in (r.a, r.b):
            assert sorted(x.split()) == sorted(r.target.split()) and (x != r.target) == (r.id < 998), r
    b = spark.createDataFrame([(i, ") ] }", "( [ {") for i in range(90)] + [(100, ")", "("), (101, ")", "none")], "id int, target string, input string")
    out = b.select("*", negatives.corrupt_brackets(F.col("target"), F.col("input"), F.col("id"), 5).alias("x")).collect()
    assert all(r.x != r.target for r in out if r.id < 101) and {len(r.x.split()) for r in out if r.id < 90} == {2, 3, 4}


def test_flips_votes_and_similarity(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "No")], "id int, target string")
    assert {r.target: r.random_negative for r in negatives.flip_binary(df).collect()} == {"Yes": "No", "No": "Yes"}
    three = df.unionByName(spark.createDataFrame([(3, "Maybe")], df.schema))
    assert {r.random_negative for r in negatives.flip_binary(three).collect()} == {None}
    v = spark.createDataFrame([("a", True, "b", False, "c", None), ("a", True, "b", True, "c", True)], "answer_m string, judge_m boolean, answer_n string, judge_n boolean, answer_o string, judge_o boolean")
    assert [r.wrong_answers for r in negatives.wrong_answers(v, ["m", "n", "o"]).collect()] == [["b", "c"], None]
    o = spark.createDataFrame([(1, "r", [1.0, 0.0], True), (1, "near", [0.9, 0.1], False), (1, "far", [0.0, 1.0], False)], "id int, option string, embedding array<float>, is_right boolean")
    assert tuple(negatives.by_similarity(o).first()) == (1, "far", "near")
    kinds = spark.createDataFrame([("navigate",), ("snarks",), ("zzz",)], "t string").select(negatives.task_kind(F.col("t")).alias("k")).collect()
    assert [r.k for r in kinds] == ["binary", "multiple_choice", None] and len(negatives.TASK_KINDS["multiple_choice"]) == len(set(negatives.TASK_KINDS["multiple_choice"])) == 17


def test_curation(spark):
    t = spark.createDataFrame([(1, "score: 4", "4", "tr", "p"), (2, "score: 3", "4", "tr", "p"), (3, "none", None, "tr", "p"), (4, None, "1", None, "p")], "id int, r1_response string, actual_score string, r1_reasoning_trace string, prompt string")
    assert {r.id for r in curation.agreeing_traces(t).collect()} == {1, 3}
    resp = spark.createDataFrame([(1, s, f"score: {4 if s < 3 else 5}") for s in range(5)] + [(1, 0, "score: 4"), (2, 0, "x")], "id int, seed int, response string")
    truth = spark.createDataFrame([(1, "4"), (2, "4")], "id int, score string")
    counts = curation.seed_counts(resp, truth)
    assert {r.id: r.n_correct for r in counts.collect()} == {1: 3, 2: 0}
    assert {r.id for r in curation.keep_by_count(t, counts, lambda n: n >= 3).collect()} == {1} and curation.keep_by_count(t, counts).count() == 0
    s = spark.createDataFrame([(1, "short")], "id int, response string")
    m = {r.id: r.r1_raw_sft_summarized for r in curation.merge_summaries(t, s).collect()}
    assert m == {1: "<think>short</think>score: 4", 2: "<think>tr</think>score: 3", 3: "<think>tr</think>none", 4: "<think></think>"}
    assert curation.long_traces(spark.createDataFrame([("a b c",), ("a",), (None,)], "r1_raw_sft string"), 2).count() == 1
    assert curation.training_rows(curation.merge_summaries(t, s)).columns == ["prompt", "response"]


def test_sampling(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 1), (1, 0), (-1, -1))])
    df = spark.createDataFrame([(i, x.tolist(), i // 30) for i, x in enumerate(v)], "id bigint, embedding array<float>, label int")
    a = sampling.assign_nearest(df, sampling.centroids(df, "label", "embedding", 2))
    assert a.where("cluster <> label").count() == 0
    takes = sampling.allocate(a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), 20)
    assert [(r.cluster, r["take"]) for r in takes.orderBy("cluster").collect()] == [(0, 5), (1, 5), (2, 10)]
    with pytest.raises(ValueError):
        sampling.allocate(takes.select("cluster", "n"), 2)
    s = sampling.diverse_sample(a.drop("label"), takes).toPandas()
    assert len(s) == 20 == s.id.nunique() and s.groupby("cluster").size().to_dict() == {0: 5, 1: 5, 2: 10}
    assert (s[s.how == "near"].groupby("cluster").size() == [1, 1, 2]).all()
    assert sampling.silhouette(df) == pytest.approx(sampling.exact_silhouette(v, np.repeat([0, 1, 2], 30)), abs=1e-6)
    k, _, scores = sampling.choose_k(df, (2, 3, 4))
    assert k == 3 and scores[3] == max(scores.values())
    g = sampling.agglomerate(df.withColumn("block", F.lit(1)), (0.3, 0.6)).toPandas()
    assert g.groupby(g.id // 30).label.nunique().tolist() == [1, 1, 1] and g.label.nunique() == 3
    n = sampling.nearest_rows(a, 2).toPandas()
    assert n.groupby("cluster").size().tolist() == [2, 2, 2]
    e = sampling.stub_vectors(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t", 8).collect()
    assert np.linalg.norm(e[0].embedding) == pytest.approx(1) and np.linalg.norm(e[1].embedding) == 0


def test_mmr_against_brute_force():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(25, 4))
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    chosen, left, want = [0, 1], list(range(2, 25)), []
    for _ in range(6):
        mean = v[chosen].mean(0)
        best = max(left, key=lambda c: 0.7 * cos(v[c], mean) - 0.3 * max(cos(v[c], v[s]) for s in chosen))
        want.append(best)
        chosen.append(best)
        left.remove(best)
    assert sampling.mmr(v, [0, 1], list(range(2, 25)), 6) == want
    assert sampling.mmr(v, [], [3, 4], 9) == sorted(sampling.mmr(v, [], [3, 4], 9), key=[*sampling.mmr(v, [], [3, 4], 9)].index)


def test_reshape(spark):
    rm = spark.createDataFrame([("a/1", "p", ["c0", "c1", "c2"], ["r0", "r1", "r2"])], "id string, prompt string, chosen array<string>, rejected array<string>")
    rows = reshape.style_pairs(rm).collect()
    assert len(rows) == 9 and {r.id for r in rows} == {f"a/1-{i}-{j}" for i in range(3) for j in range(3)} and all(r.chosen[1] == r.id[-3] and r.rejected[1] == r.id[-1] for r in rows)
    two = rubric([("d", {"response_1": "x", "response_2": "y"})])
    pw = reshape.pairwise_prompts(reshape.style_pairs(rm), two).orderBy("id").collect()
    assert [r.score for r in pw] == ["Response 1" if k % 2 == 0 else "Response 2" for k in range(9)]
    assert all((f"### RESPONSE {r.score[-1]}\n{r.chosen}\n") in r.prompt for r in pw)
    mc = spark.createDataFrame([(7, "q", ["a", "b", "c", "d"], 2, "phys"), (8, "q", ["a"], 0, "phys")], "id int, question string, choices array<string>, answer int, subject string")
    got = {r.id: (r.response, r.score) for r in reshape.choice_rows(mc).collect()}
    assert got["7-true"] == ("(C)", "true") and got["7-false"][0] in ("(A)", "(B)", "(D)") and got["8-false"][0] is None
    assert reshape.choice_prompts(mc, rubric()).count() == 4
    g = spark.createDataFrame([("n1", "q", "gold", "neg")], "ID string, question string, golden_answer string, negative_answer string")
    assert {(r.ID, r.response, r.score) for r in reshape.golden_prompts([g, g.selectExpr("'t1' ID", "question", "golden_answer", "negative_answer")], rubric()).collect()} == {("n1-true", "gold", "true"), ("n1-false", "neg", "false"), ("t1-true", "gold", "true"), ("t1-false", "neg", "false")}
    m = "array<struct<role:string,content:string>>"
    sk = spark.createDataFrame([(1, [("user", "u"), ("assistant", "c")], [("assistant", "r"), ("user", "u")], "s")], f"id int, chosen {m}, rejected {m}, source string")
    assert tuple(reshape.preference_rows(sk).first()) == (1, "u", "c", "r", "s")
    x = spark.createDataFrame([("art", "sum", 1, 4)], "article string, summary string, faithfulness int, coherence int")
    five = rubric([("d", {str(i): f"s{i}" for i in range(1, 6)})])
    art = reshape.article_prompts(x.unionByName(x.selectExpr("'b' article", "summary", "faithfulness", "coherence")), {"faithfulness": rubric(), "coherence": five}).collect()
    assert {(r.split, r.id) for r in art} == {(s, i) for s in ("faithfulness", "coherence") for i in (0, 1)}
    fb = spark.createDataFrame([("c", "i", "r", 3, 9, *"abcde", "x")], "orig_criteria string, orig_instruction string, orig_response string, orig_score int, __index_level_0__ int, orig_score1_description string, orig_score2_description string, orig_score3_description string, orig_score4_description string, orig_score5_description string, input string")
    f = reshape.feedback_prompts(fb)
    assert set(f.columns) == {"orig_criteria", "orig_instruction", "orig_response", "score", "id", "prompt"} and "3: c\n" in f.first().prompt
    s = spark.createDataFrame([(1, "src", "hyp", 1.0, 2.0)], "id int, source string, hyp string, expert_a double, expert_b double")
    assert {(r.metric, r.score) for r in reshape.unpivot_metrics(s, ["a", "b"]).collect()} == {("a", 1.0), ("b", 2.0)}
    t = spark.createDataFrame([(1, "in", "ans", None)], "id int, input string, target string, random_negative string")
    assert [r.id for r in reshape.task_prompts(t, rubric(), {"target": "true", "random_negative": "false", "missing": "false"}).collect()] == ["1-target"]


def test_rubric_folders(spark, tmp_path):
    two = lambda k: [{"description": f"{k}{i}", "scoring": {"true": "a", "false": "b"}} for i in range(3)]
    for k in ("x", "y"):
        (tmp_path / f"{k}_rubric.json").write_text(json.dumps(two(k), indent=2))
    got = {(r.file, r.n, r.description) for r in rubrics.load_rubrics(spark, str(tmp_path)).repartition(5).collect()}
    assert got == {(f"{k}_rubric.json", i, f"{k}{i}") for k in "xy" for i in range(3)}
    (tmp_path / "z_rubric.json").write_text("no json")
    with pytest.raises(Exception, match="no array of rubrics"):
        rubrics.load_rubrics(spark, str(tmp_path)).collect()
    assert rubrics.load_rubrics(spark, str(tmp_path), strict=False).count() == 6


def test_calls_at_once_and_in_batches(spark):
    p = spark.createDataFrame([(str(i), f"p{i}") for i in range(16)], "id string, prompt string").coalesce(1)

    def slow():
        import time

        return lambda x: (time.sleep(0.4), x)[1]

    import time

    completion.complete(p, slow).collect()
    t = time.time()
    assert {(r.id, r.response) for r in completion.complete(p, slow).collect()} == {(str(i), f"p{i}") for i in range(16)}
    assert time.time() - t < 16 * 0.4 / 2

    def lists():
        def client(xs):
            assert isinstance(xs, list) and len(xs) <= 5
            if "p7" in xs:
                raise ValueError
            return [(x.upper(), "because") for x in xs]

        return client

    got = {r.id: (r.response, r.reasoning_content) for r in completion.complete(p, lists, batch=5, other_pause=0).collect()}
    assert got["0"] == ("P0", "because") and got["7"] == ("Error", "Error") == got["5"] and got["15"] == ("P15", "because")

    def wrong():
        return lambda x: x.no_such_name

    with pytest.raises(Exception, match="no_such_name"):
        completion.complete(p, wrong, pause=0, other_pause=0).collect()


def test_embedding_boundary(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    seen = lambda: lambda xs: [[len(x), 0.0] for x in xs]
    got = {r.id: r.e for r in completion.embed(df, "t", seen, 2, name="e").collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: [0.0, 0.0]}
    raw = {r.id: r.e for r in completion.embed(df, "t", seen, 2, instruction="Find.", batch=1, normalise=False, name="e").collect()}
    assert raw[1][0] == len("Instruct: Find.\nQuery: abc") and raw[2] is None
    with pytest.raises(Exception, match="not 3"):
        completion.embed(df, "t", seen, 3).collect()


def test_dendrogram_against_merging_the_least_distance(spark):
    def plain(v, t):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        groups = [[i] for i in range(len(v))]
        while len(groups) > 1:
            d, a, b = min(((1 - u[x] @ u[y].T).mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            if d >= t:
                break
            groups[a] += groups.pop(b)
        return {frozenset(g) for g in groups}

    rng = np.random.default_rng(3)
    for _ in range(5):
        v = rng.normal(size=(40, 6))
        for t in (0.3, 0.7, 1.0):
            labels = sampling.average_linkage(v, t)
            assert {frozenset(np.nonzero(labels == k)[0].tolist()) for k in set(labels.tolist())} == plain(v, t)


def test_completion_policies(spark):
    p = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "slow")], "id string, prompt string")

    def make():
        tries = {}

        def client(x):
            tries[x] = tries.get(x, 0) + 1
            if x == "bad":
                raise ValueError(x)
            if x == "slow" and tries[x] < 3:
                raise completion.RateLimited
            return f"<{x}>"

        return client

    run = lambda **k: {r.id: r.response for r in completion.complete(p, make, pause=0, other_pause=0, **k).collect()}
    assert run() == {"1": "<ok>", "2": "Error", "3": "<slow>"}
    assert run(policy="none", retry_all=False) == {"1": "<ok>", "2": None, "3": "<slow>"}
    assert run(policy="drop") == {"1": "<ok>", "3": "<slow>"}
    with pytest.raises(Exception, match="bad"):
        run(policy="drop", retry_all=False)
    with pytest.raises(ValueError):
        completion.complete(p, make, policy="other")
    done = completion.complete(p.limit(1), completion.stub_client)
    assert completion.pending(p, done).count() == 2 and completion.seeded(p).count() == 15
