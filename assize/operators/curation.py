"""Filtering and finishing reasoning traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.scoring import extract_score, matches
from assize.functions.text import think_text, word_count
from assize.operators.pairing import lookup


def agreeing_traces(traces: DataFrame, response: str = "r1_response", truth: str = "actual_score") -> DataFrame:
    """Stage 1: rows whose response's score is the actual one; a missing score agrees with a missing truth."""
    return traces.where(extract_score(F.col(response)).eqNullSafe(F.col(truth).cast("string")))


def seed_counts(responses: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """(key, n_correct) over the seeds' responses (key, seed, response), each (key, seed) once; keys without truth count 0 unless the score is missing too."""
    r = responses.dropDuplicates([key, "seed"]).withColumn("answer", extract_score(F.col("response")))
    j = r.join(truth.select(key, F.col("score").cast("string").alias("_truth")), key, "left")
    return j.groupBy(key).agg(F.count_if(F.col("answer").eqNullSafe(F.col("_truth"))).alias("n_correct"))


def keep_by_count(rows: DataFrame, counts: DataFrame, keep: Callable[[Column], Column] = lambda n: n == 5, key: str = "id") -> DataFrame:
    """Stage 2: rows whose number of correct seeds passes ``keep``; by default all five must be correct."""
    return rows.join(counts.where(keep(F.col("n_correct"))).select(key), key, "left_semi")


def long_traces(traces: DataFrame, limit: int = 4096, text: str = "r1_raw_sft", size: Callable[[Column], Column] = word_count) -> DataFrame:
    """Rows whose text is longer than ``limit``; by default in blank-separated words, which stand in for tokens."""
    return traces.where(size(F.col(text)) > limit)


def merge_summaries(traces: DataFrame, summaries: DataFrame, key: str = "id") -> DataFrame:
    """Adds the summarised trace (the whole one where there is no summary) and the training text with it, for all rows."""
    base = traces.drop("r1_reasoning_trace_summarized", "r1_raw_sft_summarized")
    out = lookup(base, summaries, key, "response", F.col("r1_reasoning_trace"), "r1_reasoning_trace_summarized")
    return out.withColumn("r1_raw_sft_summarized", think_text(F.col("r1_reasoning_trace_summarized"), F.col("r1_response")))


#: What a summary is asked for; a parameter.
SHORTEN = "Make this reasoning shorter. Leave out what is said twice or leads nowhere, keep its voice and the order of its steps, and write nothing else."


def summary_request(trace: Column, instruction: str = SHORTEN) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n"), trace)


def training_rows(traces: DataFrame, text: str = "r1_raw_sft_summarized") -> DataFrame:
    """(prompt, response) as a trainer takes them."""
    return traces.select("prompt", F.col(text).alias("response"))
