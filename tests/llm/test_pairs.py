import pytest

pytest.importorskip("assize.llm")
from assize.llm.inputs import judged_pairs  # noqa: E402
from assize.llm.answers import read_answer  # noqa: E402
from assize.llm.pairs import LABELS, Languages, Rows, broken_pairs, covered, cut_text, fit, fit_label, sections, spread  # noqa: E402


@pytest.fixture(scope="module")
def pairs(spark):
    return spread(judged_pairs(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def model(pairs):
    return fit(pairs.where("record_id % 2 = 0"))


def by_hand(rng, r, other, inp):
    """A second way to break answers, apart from the one that trains: by whole words and lines."""
    ws = r.split(" ")
    cut = " ".join(ws[: rng.randrange(len(ws) // 3 + 1, len(ws) - 1)]) if len(ws) > 12 and "\n- " not in r and "\n1" not in r and "\n•" not in r else ""
    if cut and cut[-1].isalpha():
        yield cut, "truncated"
    if other and len(other.split()) > 25:
        yield other, "other_language"
    if len(inp.split()) > 8:
        yield f'"{inp.strip()}"', "copy"
        yield inp.strip().replace(",", " ,"), "copy"


def test_second_generator_on_pairs_that_no_model_chose(pairs, model):
    """Odd records, whole or broken themselves: about a tenth of the bases are, so that some labels can't be met."""
    import random

    rng = random.Random(8)
    rows = pairs.where("record_id % 2 = 1 and response is not null and length(input) > 0 and lang is not null").orderBy("field_name", "record_id").limit(400).collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r.response)
    got = {k: [0, 0, 0] for k in LABELS}
    for r in rows:
        s = model.reader.source(r.task, r.input)
        other = rng.choice(by_lang[rng.choice([k for k in by_lang if k != r.lang])])
        for x, label in by_hand(rng, r.response, other, r.input):
            d = model.defect(x, s)
            got[label][0] += d == label
            got[label][1] += d is not None
            got[label][2] += 1
    for k in ("truncated", "other_language", "copy"):
        right, found, n = got[k]
        assert n > 60 and right / n > 0.83 and found / n > 0.9, (k, got[k])


def test_hand_labelled(model):
    s = model.reader.source("Judge the answer.", "The storm reached the coast at night and the harbour was closed for two days. Nobody was hurt, and the ferries ran again on Sunday.")
    broken = {
        "refusal": ["I would like to sit this one out, since judging such texts isn't allowed for me.", "Sorry, grading this is something I cannot do. Please ask a teacher.", "As a language model I must not judge this.", "Es tut mir leid, das darf ich nicht bewerten.", "Lo siento, no puedo valorar esto."],
        "truncated": ["The reply is clear about the storm and the harbour, but it leaves out the fer", "The reply is clear about the storm, and the part about the", '{"explanation": "The reply is clear about the storm and then it na', '{"explanation": "The reply is clear about the storm and then it na", "score": "true"}', "- The reply is clear.\n- It names the harbour.\n- It leaves out the"],
        "empty": ["", "N/A", "{}", '{"explanation": "", "score": null}', "```\n```", "Error: timeout"],
        "copy": ["The storm reached the coast at night and the harbour was closed for two days. Nobody was hurt, and the ferries ran again on Sunday.", "THE STORM REACHED THE COAST AT NIGHT AND THE HARBOUR WAS CLOSED FOR TWO DAYS. NOBODY WAS HURT."],
        "other_language": ["Die Antwort ist klar und nennt den Sturm, aber der zweite Absatz bleibt ungenau und die Begründung wirkt etwas zu kurz.", "La réponse est claire et cite la tempête, mais le deuxième paragraphe reste vague et le raisonnement paraît un peu court."],
    }
    n = right = 0
    for label, texts in broken.items():
        for x in texts:
            n, right = n + 1, right + (model.defect(x, s) == label)
    assert right >= n - 2, (right, n)


def test_ngrams_and_features_both_decide(model):
    texts = ["I cannot judge this text, as my rules forbid it.", "The reply is clear about the storm and the", "N/A"]
    s = model.reader.source("", "The storm reached the coast at night.")
    for x in texts:
        dense, grams, values = model.reader.features(x, s)
        full = model.logits(dense, grams, values)
        assert abs(full - model.logits(dense, grams, values * 0)).max() > 0.25
        assert abs(full - model.logits(dense * 0, grams, values)).max() > 0.5


def test_more_languages_than_ever_before():
    import numpy as np

    rng = np.random.default_rng(1)
    own = [rng.integers(0, 2**31, 40) for _ in range(70)]
    texts = [rng.choice(own[k], 12, replace=False) for k in range(70) for _ in range(12)]
    langs = Languages(texts, [f"l{k:02d}" for k in range(70) for _ in range(12)])
    assert len(langs.names) == 70
    assert all(int(np.argmax(langs.scores(own[k]))) == k for k in range(70))


def test_fit_label_separates():
    import numpy as np

    rng = np.random.default_rng(2)
    y = np.arange(400) % 2
    grams = [np.unique(np.concatenate([rng.integers(0, 50, 5) + 100 * k, rng.integers(1000, 1100, 5)])).astype(np.int32) for k in y]
    rows = Rows(np.ones((400, 2), np.float32), grams, [np.full(len(g), 0.3, np.float32) for g in grams], y, np.arange(400), np.ones(400, bool))
    w, d, t = fit_label(rows, 1)
    assert ((rows.logits(w, d) > t) == (y == 1)).mean() > 0.98


def test_cut_text_ends_inside():
    import random

    for i in range(200):
        got = cut_text(random.Random(i), "The first sentence is here. The second one follows, and it is long. Done with it now.")
        assert got and not got.endswith((".", "!")) or "." in got[-4:]
    assert cut_text(random.Random(1), "short") is None
    assert not any(read_answer(x).cut for x in ["- one part of it\n- another part"])


def test_decoys(model):
    s = model.reader.source("Judge the answer.", "The storm reached the coast at night and the harbour was closed for two days.")
    sound = [
        "The reply says it cannot answer, which is honest. The part about the storm is clear. The example with 4 units makes the storm easy to follow.",
        'The input states “The storm reached the coast at night and the harbour was closed for two days.” and the reply builds on it. Its tone is plain, and the part about the harbour is clearly argued.',
        "Response 1", '{"score": "true"}',
    ]
    for x in sound:
        assert model.defect(x, s) is None, x
    assert model.defect("The storm reached the coast at night and the harbour was closed for two days.", s) == "copy"
    assert model.defect("I'm sorry, but I cannot help with judging this text.", s) == "refusal"
    assert model.defect(None, s) == model.defect(" ", s) == model.defect("N/A", s) == "empty"


def test_edges(spark, pairs):
    schema = "field_name string, record_id bigint, key bigint, task string, input string, lang string, response string, defect int"
    rows = pairs.select("field_name", "record_id", "key", "task", "input", "lang", "response").limit(200).collect()
    df = spark.createDataFrame([(*r, 1) for r in rows] + [("response", -1, None, None, None, None, None, 1), ("response", -2, 5, None, None, None, "word " * 30_000 + "end.", 1), ("response", None, 5, None, None, None, "x", 1)], schema)
    got = broken_pairs(df.unionByName(df)).collect()
    assert len({(r.field_name, r.record_id) for r in got}) == len(got)
    assert {r.defect for r in got if r.record_id == -1} == {"empty"}
    assert broken_pairs(df.limit(0)).count() == 0


def test_sections(spark):
    df = spark.createDataFrame([("Open.\n\n### TASK\nDo it.\n\n### INPUT\nSome text.\nMore.\n\n### RESPONSE\nR",), ("bare text",), (None,)], "p string")
    task, inp = sections(df.p)
    assert [tuple(r) for r in df.select(task, inp).collect()] == [("Do it.\n", "Some text.\nMore.\n"), ("", "bare text"), ("", "")]


def test_covered():
    import numpy as np

    from assize.llm.pairs import _grams

    src = np.arange(10, 30)
    assert covered(np.arange(12, 20), np.unique(_grams(src, 4))).all()
    assert covered(np.array([1, 2, 3, 12, 13, 14, 15]), np.unique(_grams(src, 4))).tolist() == [False] * 3 + [True] * 4
    assert not covered(np.array([1]), np.unique(_grams(src, 4))).any()


def test_prompts_of_one_key_and_length_are_told_apart(spark):
    schema = "field_name string, record_id bigint, key bigint, task string, input string, lang string, response string"
    a, b = "The storm reached the coast at night and closed the harbour.", "A garden needs good soil and water so that its roots can grow"
    rows = [("response", i, None, "", x, "en", a) for i, x in ((1, a), (2, b[: len(a)]))] + [("response", i, i, "", f"Some input number {i} about things.", "en", f"The reply {i} is clear and names the thing. It is good.") for i in range(3, 200)]
    got = {r.record_id: r.defect for r in broken_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got.get(1) == "copy" and got.get(2) != "copy"
