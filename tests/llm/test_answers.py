import json

import pytest

pytest.importorskip("assize.llm")
from assize.llm.answers import ends_open, read_answer  # noqa: E402


@pytest.mark.parametrize("text", [None, "", "  \n", "N/A", "null", "---", "{}", "[]", '{"score": null}', '{"explanation": " ", "score": ""}', "```json\n```", "<answer></answer>", "(no output)", "Error", "error: timeout"])
def test_empty(text):
    assert read_answer(text).shell == "empty" and not read_answer(text).cut


@pytest.mark.parametrize("text", ["4", "true", "Response 1", "score: Response 2", "**score**: 3", '{"score": "false"}', "```json\n{\"score\": 4}\n```", "[true]", "Verdict: 5", "10/10"])
def test_bare_verdicts(text):
    a = read_answer(text)
    assert a.shell == "verdict" and not a.cut


@pytest.mark.parametrize(
    "text",
    [
        "It holds. Score: 4", "It holds.\n\nscore: true", "It holds.\n(checked twice)", "It holds. ✔", "It holds. => Response 2", "It holds. (done)", "It holds.\n— end of review —", "It holds. …", "It holds. [...]", "Is it so?", 'He said "stop."',
        "- one thing\n- another thing\n- a third thing", "1) one\n2) two", "- It holds.\n- It fits.", "- It holds.\n\n**score**: 2", '{"explanation": "It holds.", "score": 1}', "```\nIt holds.\n```", "It says “so”.", "It costs 4.5.",
    ],
)
def test_finished(text):
    assert not read_answer(text).cut


@pytest.mark.parametrize(
    "text",
    [
        "It holds. The seco", "It holds. The second part", "It holds,", "It points to cf.", "It holds. He said “and so.", '{"explanation": "It holds. The seco', '{"explanation": "It holds.", "score', "```json\n{\"explanation\": \"It holds.\"",
        '{"explanation": "It holds. The seco", "score": 3}', "- It holds.\n- The sec", "It holds.\n\nscore:", "It holds.\nFinal sc", "1. It holds.\n2.", '```json\n{"explanation": "The seco", "score": 3}\n```', "Respon",
        "It holds. The seco…", "It holds. The seco...", "It holds. The seco [...]", "It holds. The seco\ufffd", "It holds.\n\n**score**", "It holds.\n**", "It holds.\n**scor*", '{"explanation": "It holds. The se\ufffd", "score": 1}',
    ],
)
def test_cut(text):
    assert read_answer(text).cut


def test_long_text_is_read_whole():
    long = "This is a sentence. " * 20_000
    assert not read_answer(long).cut
    assert read_answer(long + "And th").cut
    assert read_answer(json.dumps({"explanation": long + "And th", "score": 1})).cut


def test_nested_json_and_trailing_text():
    assert read_answer('{"a": {"b": ["It holds.", "It fits."]}, "score": 2}').prose == "It holds.\nIt fits."
    assert read_answer('{"explanation": "It holds.", "score": 2} And so').cut


def test_ends_open_marks():
    assert not ends_open("") and not ends_open("It holds.)") and ends_open("It holds (and")
