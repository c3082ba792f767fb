"""The tables of the project's domain as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.plans.lineage import settle
from assize.sources.tables import canonical, table


def answer_values(spark: SparkSession, d: str, source: bool = False) -> DataFrame:
    """field_name, record_id, value of the three answer fields; with ``source`` the canonical one of the prompt."""
    t, j = table(spark, d, "traces"), table(spark, d, "judge_responses")
    src = [canonical(F.col("source")).alias("source")] if source else []
    if source:
        p = table(spark, d, "prompts").groupBy("id").agg(F.max("source").alias("source"))
        j = j.join(p, "id", "left")
    a = [t.select(F.lit(f).alias("field_name"), F.col("id").alias("record_id"), F.col(f).alias("value"), *src) for f in ("r1_response", "r1_reasoning_trace_summarized")]
    return a[0].unionByName(a[1]).unionByName(j.select(F.lit("response").alias("field_name"), F.col("resp_id").alias("record_id"), F.col("response").alias("value"), *src))


def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    """field_name, record_id, key, task, input, lang, response of both answer fields with their prompts."""
    from assize.llm.pairs import sections

    t, j, p = table(spark, d, "traces"), table(spark, d, "judge_responses"), table(spark, d, "prompts")
    task, inp = sections(F.col("prompt"))
    lang = canonical(F.col("lang")).alias("lang")
    a = t.select(F.lit("r1_response").alias("field_name"), F.col("id").alias("record_id"), F.col("id").alias("key"), task.alias("task"), inp.alias("input"), lang, F.col("r1_response").alias("response"))
    # a table of its own: only a join right after its exchanges can be split at run time where one prompt has very many answers
    p = settle(p.select(F.col("id").alias("key"), task.alias("task"), inp.alias("input"), lang).dropDuplicates(["key"]), "asked")
    j = j.select(F.lit("response").alias("field_name"), F.col("resp_id").alias("record_id"), F.col("id").alias("key"), "response")
    b = j.join(p, "key", "left").select("field_name", "record_id", "key", "task", "input", "lang", "response")
    return a.unionByName(b)
