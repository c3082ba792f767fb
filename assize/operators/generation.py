"""Pipelines around model calls: what is asked, and how answers become rows again. The client is always passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.text import comma_list, example_block, fewshot_block
from assize.operators.completion import complete, seeded
from assize.operators.prompts import fix_answer_prompt, rubric_request, wrong_answer_prompt
from assize.operators.rubrics import KEYS, check_mode, normalise_keys, retrieve_top_k

#: What a score may be in each mode, as a pattern over its text.
SCORES = {"pointwise": "^[1-5]$", "pairwise": "^Response [12]$", "binary": "(?i)^(true|false)$"}


def closed_answer(text: Column, mode: str) -> Column:
    """explanation and score of an answer that is one JSON object with just these two keys and an allowed score; else null."""
    keys = F.array_sort(F.json_object_keys(text))
    score, explanation = F.get_json_object(text, "$.score"), F.get_json_object(text, "$.explanation")
    fits = (keys == F.array(F.lit("explanation"), F.lit("score"))) & score.rlike(SCORES[check_mode(mode)]) & explanation.isNotNull()
    return F.when(fits, F.struct(explanation.alias("explanation"), score.alias("score")))


def closed_rubric(text: Column, mode: str) -> Column:
    """description and scoring of a rubric in JSON whose scoring has just the mode's keys (score_1 or 1 alike); else null."""
    parsed = F.from_json(text, "description string, scoring map<string,string>")
    scoring = normalise_keys(parsed["scoring"])
    fits = (F.array_sort(F.map_keys(scoring)) == F.array(*map(F.lit, sorted(KEYS[check_mode(mode)])))) & parsed["description"].isNotNull()
    return F.when(fits, F.struct(parsed["description"].alias("description"), scoring.alias("scoring")))


def rubric_prompts(tasks: DataFrame, known: DataFrame, k: int = 5, seeds: int = 5) -> DataFrame:
    """(id, seed, prompt): a request for a rubric for each task and seed, with the k known rubrics most like the task.

    ``tasks`` (id, task, embedding, and examples: an array of input and target, may be empty) are stated, ``known`` has id,
    description, scoring, embedding. k = 0 gives requests without examples.
    """
    near = retrieve_top_k(tasks, known, k).join(known.select(F.col("id").alias("item_id"), "description", "scoring"), "item_id")
    samples = near.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "description", F.to_json("scoring").alias("scoring")))).alias("xs"))  # k rows each
    shown = F.transform(F.coalesce("xs", F.array().cast("array<struct<rank:int,description:string,scoring:string>>")), lambda x: F.struct(x["description"].alias("description"), F.from_json(x["scoring"], "map<string,string>").alias("scoring")))
    block = example_block(shown, "### Rubrics of other tasks")
    p = tasks.join(samples, "id", "left").withColumn("prompt", rubric_request(F.col("task"), block, fewshot_block(F.col("examples"))))
    return seeded(p.select("id", "prompt"), seeds)


def label_clusters(assigned: DataFrame, names: Column, cluster: str = "cluster") -> DataFrame:
    """Adds ``category``: the cluster's name in a comma-separated answer, in the order of the clusters; null beyond its end."""
    return assigned.withColumn("category", F.get(comma_list(names), F.col(cluster).cast("int")))


def negative_answers(df: DataFrame, make_client: Callable, settle: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Adds ``negative_answer``: a wrong answer is asked for with the known wrong ones, then cut down to a phrase by a second call.

    ``df`` has ID, question, golden_answer and wrong_answers; ``settle`` must write what it is given, since calls aren't
    repeatable. Rows whose call fails have null, or are dropped under that policy.
    """
    key = F.col("ID").cast("string").alias("id")
    first = settle(complete(df.select(key, wrong_answer_prompt(F.col("question"), F.col("golden_answer"), F.col("wrong_answers")).alias("prompt")), make_client, **options))
    j = df.withColumn("_id", F.col("ID").cast("string")).join(first.select(F.col("id").alias("_id"), F.col("response").alias("_first")), "_id")
    ask = j.where("_first is not null").select(F.col("_id").alias("id"), fix_answer_prompt(F.col("question"), F.col("golden_answer"), F.col("_first")).alias("prompt"))
    second = settle(complete(ask, make_client, **options))
    how = "inner" if options.get("policy") == "drop" else "left"
    return j.join(second.select(F.col("id").alias("_id"), F.col("response").alias("negative_answer")), "_id", how).drop("_id", "_first")
