"""Pieces of prompts, options and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assize.functions.binding import bind

#: The span between a prompt's task and its response, and the mark before options.
TASK_INPUT = r"(?s)### TASK\s+(.*?)\s+### RESPONSE"
OPTIONS_MARK = "Options:\n"
LABELS = ["(A)", "(B)", "(C)", "(D)"]
#: Formats of instructions, few-shot lines, numbered examples and training text.
INSTRUCTION = "Instruction: %s\nQuery: %s"
EMBEDDED = "Instruct: %s\nQuery: "
FEWSHOT_HEAD = "Below are some examples:\n"
FEWSHOT_LINE = "Question: %s Answer: %s\n"
EXAMPLE_HEAD = "Example %s:\n"
THINK = "<think>%s</think>%s"


def task_and_input(prompt: Column) -> Column:
    """The text from after TASK up to RESPONSE; null where the prompt has no such span."""
    return F.nullif(F.regexp_extract(prompt, TASK_INPUT, 1), F.lit(""))


def embedding_text(prompt: Column, instruction: str) -> Column:
    """What is embedded for a prompt: an instruction and the task with its input as the query."""
    return F.concat(F.lit(EMBEDDED % instruction), task_and_input(prompt))


def instruct(task: Column, query: Column) -> Column:
    return F.format_string(INSTRUCTION, task, query)


def letter(i: Column) -> Column:
    """0 -> A."""
    return F.char(i + 65)


def letter_index(c: Column) -> Column:
    """A or (A) -> 0."""
    return F.ascii(F.translate(c, "()", "")) - 65


def options_part(text: Column) -> Column:
    """What follows the options mark; null where there is none."""
    at = F.instr(text, OPTIONS_MARK)
    return F.when(at > 0, F.substr(text, at + len(OPTIONS_MARK)))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_options(text: Column) -> Column:
    """The options of "(A) x (B) y": letters in order from A, up to the first that is missing; trimmed."""
    letters = F.array(*[F.lit(f"({chr(65 + i)})") for i in range(26)])

    def cut(at: Column) -> Column:
        def option(p: Column, i: Column) -> Column:
            following = F.coalesce(F.get(at, i + 1), F.lit(0))
            # as in a find from the front, a following letter that stands before its predecessor leaves an empty option
            return _strip(F.when(following > 0, F.substr(text, p + 3, F.greatest(following - p - 3, F.lit(0)))).otherwise(F.substr(text, p + 3)))

        missing = F.array_position(at, F.lit(0))
        present = F.when(missing > 0, F.slice(at, F.lit(1), (missing - 1).cast("int"))).otherwise(at)
        return F.transform(present, option)

    return F.when(text.isNotNull(), bind(F.transform(letters, lambda x: F.position(x, text)), cut))


def join_options(options: Column) -> Column:
    """(A) x, a line each."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("("), letter(i), F.lit(") "), x)), "\n")


def label_options(options: Column) -> Column:
    """As ``join_options``, for at most four options: a fifth has no label and makes the result null."""
    return F.when(F.size(options) <= len(LABELS), join_options(options))


def option_text(options: Column, target: Column) -> Column:
    """The parsed option that a letter names; options may hold brackets themselves."""
    return F.get(options, letter_index(target))


def camel(snake: Column) -> Column:
    return F.array_join(F.transform(F.split(snake, "_"), lambda x: F.initcap(x)), "")


def comma_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def id_domain(id: Column) -> Column:
    """Domain of an id like domain-sub/n-i-j."""
    return F.split_part(F.split_part(id, F.lit("/"), F.lit(1)), F.lit("-"), F.lit(1))


def id_origin(id: Column) -> Column:
    """An id without its last two parts."""
    return F.regexp_replace(id, r"-[^-]*-[^-]*$", "")


def id_cell(id: Column) -> tuple[Column, Column]:
    """The last two parts of an id as ints; null where they aren't."""
    parts = F.split(id, "-")
    return F.try_element_at(parts, F.lit(-2)).try_cast("int"), F.try_element_at(parts, F.lit(-1)).try_cast("int")


def think_text(trace: Column, response: Column) -> Column:
    """Training text of a trace and its response; a null adds nothing."""
    return F.format_string(THINK, F.coalesce(trace, F.lit("")), F.coalesce(response, F.lit("")))


def fewshot_block(examples: Column) -> Column:
    """Examples (input, target) as lines under a heading; empty without examples."""
    lines = F.array_join(F.transform(examples, lambda e: F.format_string(FEWSHOT_LINE, e["input"], e["target"])), "")
    return F.when(F.size(examples) > 0, F.concat(F.lit(FEWSHOT_HEAD), lines)).otherwise(F.lit(""))


def example_block(samples: Column, title: str = "Examples") -> Column:
    """Numbered JSON examples under a title."""
    parts = F.transform(samples, lambda s, i: F.concat(F.format_string(EXAMPLE_HEAD, (i + 1).cast("string")), F.to_json(s, {"pretty": "true"})))
    return F.array_join(F.concat(F.array(F.lit(title)), parts), "\n")


def word_count(text: Column) -> Column:
    """Blank-separated tokens, a stand-in for a tokenizer's count."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
