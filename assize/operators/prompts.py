"""Judge prompts as one concatenation of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.hashing import pick
from assize.operators.pairing import with_ordinal
from assize.operators.rubrics import KEYS, check_mode

#: The judge prompt's format.
OPENING = "Evaluate the response based on the given task, input, response, and evaluation rubric.  \nProvide a fair and detailed assessment following the rubric."
OPENING_TWO = "Evaluate the response based on the given task, input, two responses, and evaluation rubric.  \nProvide a fair and detailed assessment following the rubric."
OUTPUT = "Return a JSON response in the following format:"
#: Names of the rubric's lines by key.
LINE_NAMES = {"response_1": "Response 1", "response_2": "Response 2"}
#: Allowed answers of each mode.
ANSWERS = {"pointwise": '{"type": "integer", "minimum": 1, "maximum": 5}', "pairwise": '{"enum": ["Response 1", "Response 2"]}', "binary": '{"type": "boolean"}'}


def answer_schema(mode: str) -> str:
    """The JSON schema that a prompt asks for: an explanation and a score, nothing else."""
    return '{"type": "object", "additionalProperties": false, "required": ["explanation", "score"], "properties": {"explanation": {"type": "string"}, "score": ' + ANSWERS[check_mode(mode)] + "}}"


def render(mode: str, task: Column, input: Column, response: Column, scoring: Column, second: Column | None = None) -> Column:
    """The prompt of one row; a null part is rendered as an empty text."""
    check_mode(mode)
    if mode == "pairwise" and second is None:
        raise ValueError("a pairwise prompt needs a second response")
    safe = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts: list[tuple[str, Column]] = [("TASK", safe(task)), ("INPUT", safe(input))]
    parts += [("RESPONSE 1", safe(response)), ("RESPONSE 2", safe(second))] if mode == "pairwise" else [("RESPONSE", safe(response))]
    lines = [F.concat(F.lit(f"{LINE_NAMES.get(k, k)}: "), safe(F.try_element_at(scoring, F.lit(k)))) for k in KEYS[mode]]
    parts += [("EVALUATION RUBRIC", F.concat_ws("\n", *lines)), ("OUTPUT FORMAT", F.lit(f"{OUTPUT}\n\n{answer_schema(mode)}"))]
    blocks = [F.concat(F.lit(f"### {name}\n"), body) for name, body in parts]
    return F.concat_ws("\n\n", F.lit(OPENING_TWO if mode == "pairwise" else OPENING), *blocks, F.lit("### EVALUATION"))


def prompt_rows(df: DataFrame, rubric: Column, mode: str, input: str, response: str, second: str | None = None, *, key: str = "id", ordinal: str | None = None, seed: int = 0) -> DataFrame:
    """Adds ``prompt`` to each row, with one variant of ``rubric`` picked by a hash of the key.

    ``rubric`` is an array of {description, scoring}. In pairwise mode the two responses change places on odd ordinals;
    the ordinal is the row's place in the order of ``key`` unless a column gives it.
    """
    if mode == "pairwise" and ordinal is None:
        df, ordinal = with_ordinal(df, key, "_ordinal"), "_ordinal"
    picked = F.get(rubric, pick(F.col(key), seed, F.size(rubric)))
    a, b = F.col(response), F.col(second) if second else None
    if mode == "pairwise":
        odd = (F.pmod(F.col(ordinal), F.lit(2)) == 1) & b.isNotNull()
        a, b = F.when(odd, b).otherwise(a), F.when(odd, a).otherwise(b)
    out = df.withColumn("prompt", render(mode, picked["description"], F.col(input), a, picked["scoring"], b))
    return out.drop("_ordinal")


def fixed_prompt(mode: str, rubric: Column, input: Column, response: Column, second: Column | None = None, index: int = 0) -> Column:
    """A prompt with one fixed variant of the rubric for all rows."""
    r = F.get(rubric, F.lit(index))
    return render(mode, r["description"], input, response, r["scoring"], second)


def own_rubric_prompt(criteria: Column, instruction: Column, response: Column, levels: list[Column]) -> Column:
    """A pointwise prompt whose rubric is in the row's own columns: the criteria and a description for each of the five levels."""
    scoring = F.map_from_arrays(F.array(*[F.lit(k) for k in KEYS["pointwise"]]), F.array(*levels))
    return render("pointwise", criteria, instruction, response, scoring)


def as_chat(prompt: Column, role: str = "user") -> Column:
    """A prompt as a chat of one message."""
    return F.array(F.struct(F.lit(role).alias("role"), prompt.alias("content")))


def position_label(ordinal: Column) -> Column:
    """Which place the chosen response stands at: first on even ordinals."""
    return F.when(F.pmod(ordinal, F.lit(2)) == 0, "Response 1").otherwise("Response 2")


#: What is asked for; parameters, so that a project can word them with its own examples.
WRONG_ANSWER = "Name a believable answer to this question that is wrong. Use one of those listed if it serves."
FIX_ANSWER = "Cut the wrong answer below down to the bare term or phrase."
NEW_RUBRIC = "Describe what an answer to this task must look like to get each score from 1 to 5."
NAME_CLUSTERS = "Give every cluster a short name of its own. Answer with the names alone, separated by commas, lowest cluster first."
#: Formats of the blocks in these prompts.
TASK_BLOCK = "### Task\n"
QUESTION, CORRECT, WRONG_HEAD, WRONG, ANSWER = "Question: ", "\nCorrect Answer: ", "Wrong Answers:\n", "\nNegative Answer: ", "Response:"
CLUSTER_HEAD = "Cluster %s examples:\n"


def wrong_answer_prompt(question: Column, correct: Column, wrong: Column, instruction: str = WRONG_ANSWER) -> Column:
    """Asks for a wrong answer; the list of known wrong ones is left out where it is null or empty."""
    known = F.concat(F.lit(WRONG_HEAD), F.array_join(F.transform(wrong, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))
    return F.concat(F.lit(f"{instruction}\n\n{TASK_BLOCK}{QUESTION}"), question, F.lit(CORRECT), correct, F.lit("\n"), F.when(F.size(wrong) > 0, known).otherwise(F.lit("")), F.lit(ANSWER))


def fix_answer_prompt(question: Column, correct: Column, wrong: Column, instruction: str = FIX_ANSWER) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n{TASK_BLOCK}{QUESTION}"), question, F.lit(CORRECT), correct, F.lit(WRONG), wrong, F.lit("\n" + ANSWER))


def rubric_request(task: Column, examples: Column, fewshot: Column, instruction: str = NEW_RUBRIC) -> Column:
    """Asks for a pointwise rubric, given few-shot items (a text, may be empty) and example rubrics (a text)."""
    return F.concat_ws("\n", F.lit(f"{instruction}\n\n{TASK_BLOCK}"), task, fewshot, examples, F.lit("\n### Rubric"))


def cluster_naming_prompt(examples: DataFrame, instruction: str = NAME_CLUSTERS) -> DataFrame:
    """One row (prompt) from the few examples (cluster, rank, text) nearest to each of the clusters."""
    line = F.concat(F.lit("- "), F.coalesce("text", F.lit("")))
    each = examples.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("xs"))
    block = F.concat(F.format_string(CLUSTER_HEAD, F.col("cluster").cast("string")), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"))
    all_ = each.select("cluster", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("cluster", "block"))).alias("bs"))
    return all_.select(F.concat(F.array_join(F.transform("bs", lambda x: x["block"]), "\n\n"), F.lit(f"\n\n{instruction}")).alias("prompt"))
