"""Benchmark tables into judge prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.hashing import pick_from
from assize.functions.text import LABELS, OPTIONS_MARK, label_options
from assize.operators.prompts import fixed_prompt, own_rubric_prompt, position_label, prompt_rows

#: Score columns of the summary benchmark.
SUMMARY_METRICS = ["coherence", "consistency", "fluency", "relevance"]


def style_pairs(df: DataFrame) -> DataFrame:
    """(id, prompt, chosen[], rejected[]) into a row for each of the chosen times the rejected: id-i-j, input, chosen, rejected."""
    a = df.select("id", F.col("prompt").alias("input"), F.posexplode("chosen").alias("i", "chosen"), "rejected")
    b = a.select("id", "input", "i", "chosen", F.posexplode("rejected").alias("j", "rejected"))
    return b.select(F.concat_ws("-", F.col("id").cast("string"), F.col("i").cast("string"), F.col("j").cast("string")).alias("id"), "input", "chosen", "rejected")


def pairwise_prompts(df: DataFrame, rubric: Column, key: str = "id", seed: int = 0) -> DataFrame:
    """(key, input, chosen, rejected) with prompt and score: the chosen one stands first on even ordinals in the order of the key."""
    from assize.operators.pairing import with_ordinal

    d = with_ordinal(df, key, "ordinal")
    return prompt_rows(d, rubric, "pairwise", "input", "chosen", "rejected", key=key, ordinal="ordinal", seed=seed).withColumn("score", position_label(F.col("ordinal"))).drop("ordinal")


def choice_rows(df: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """(key, question, choices[], answer, subject) into a true and a false row: id, input, response, score, choices, subject.

    The false row's response is a hashed pick among the wrong options, null where there is none.
    """
    labels = F.array(*[F.lit(x) for x in LABELS])
    right = F.get(labels, F.col("answer"))
    present = F.slice(labels, F.lit(1), F.size("choices"))
    wrong = pick_from(F.array_remove(present, right), F.col(key), seed)
    input = F.concat(F.col("question"), F.lit("\n" + OPTIONS_MARK), label_options(F.col("choices")))
    two = F.explode(F.array(F.struct(F.lit("true").alias("score"), right.alias("response")), F.struct(F.lit("false").alias("score"), wrong.alias("response"))))
    x = df.select(F.col(key).alias("_key"), input.alias("input"), "choices", "subject", two.alias("s"))
    return x.select(F.concat(F.col("_key").cast("string"), F.lit("-"), F.col("s.score")).alias("id"), "input", "s.response", "s.score", "choices", "subject")


def choice_prompts(df: DataFrame, rubric: Column, key: str = "id", seed: int = 0) -> DataFrame:
    rows = choice_rows(df, key, seed)
    return rows.withColumn("prompt", fixed_prompt("binary", rubric, F.col("input"), F.col("response")))


def golden_rows(df: DataFrame) -> DataFrame:
    """(ID, question, golden_answer, negative_answer) into a true and a false row: ID, input, response, score."""
    two = F.explode(F.array(F.struct(F.lit("true").alias("score"), F.col("golden_answer").alias("response")), F.struct(F.lit("false").alias("score"), F.col("negative_answer").alias("response"))))
    x = df.select("ID", F.col("question").alias("input"), two.alias("s"))
    return x.select(F.concat(F.col("ID").cast("string"), F.lit("-"), F.col("s.score")).alias("ID"), "input", "s.response", "s.score")


def golden_prompts(tables: list[DataFrame], rubric: Column, seed: int = 0) -> DataFrame:
    rows = golden_rows(tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(golden_rows(t))
    return prompt_rows(rows, rubric, "binary", "input", "response", key="ID", seed=seed)


def unpivot_metrics(df: DataFrame, metrics: list[str] | None = None, prefix: str = "expert_") -> DataFrame:
    """A row for each metric: id, input (source), response (hyp), metric, score."""
    metrics = SUMMARY_METRICS if metrics is None else metrics
    m = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(prefix + k).cast("double").alias("score")) for k in metrics]))
    return df.select("id", F.col("source").alias("input"), F.col("hyp").alias("response"), m.alias("m")).select("id", "input", "response", "m.metric", "m.score")


def summary_prompts(df: DataFrame, rubrics: dict[str, Column], seed: int = 0) -> dict[str, DataFrame]:
    """A pointwise prompt table for each metric."""
    long = unpivot_metrics(df, list(rubrics))
    return {m: prompt_rows(long.where(F.col("metric") == m).drop("metric"), r, "pointwise", "input", "response", seed=seed) for m, r in rubrics.items()}


def article_prompts(df: DataFrame, rubrics: dict[str, Column], binary: str = "faithfulness", seed: int = 0) -> DataFrame:
    """(article, summary and a score for each metric) into one table with split, id, score, prompt.

    The id restarts in every split, in the order of article and summary, so that (split, id) is the key.
    """
    from assize.operators.pairing import with_ordinal

    base = with_ordinal(df.withColumn("_key", F.concat_ws("\u0001", F.coalesce("article", F.lit("")), F.coalesce("summary", F.lit("")))), "_key", "id").drop("_key")
    out = None
    for m, r in rubrics.items():
        part = prompt_rows(base.select("id", "article", "summary", F.col(m).cast("string").alias("score")), r, "binary" if m == binary else "pointwise", "article", "summary", seed=seed)
        part = part.select(F.lit(m).alias("split"), "id", "article", "summary", "score", "prompt")
        out = part if out is None else out.unionByName(part)
    return out


def feedback_prompts(df: DataFrame) -> DataFrame:
    """Rows that bring their own rubric: id, score, prompt and what isn't part of the rubric."""
    levels = [F.col(f"orig_score{i}_description") for i in range(1, 6)]
    out = df.withColumn("prompt", own_rubric_prompt(F.col("orig_criteria"), F.col("orig_instruction"), F.col("orig_response"), levels))
    out = out.withColumnRenamed("orig_score", "score").withColumnRenamed("__index_level_0__", "id")
    return out.drop(*[f"orig_score{i}_description" for i in range(1, 6)], "input", "instruction", "messages")


def by_role(messages: Column, role: str) -> Column:
    """Of two messages the first where its role fits, else the second's content."""
    return F.when(F.get(messages, F.lit(0))["role"] == role, F.get(messages, F.lit(0))["content"]).otherwise(F.get(messages, F.lit(1))["content"])


def other_role(messages: Column, role: str) -> Column:
    return F.when(F.get(messages, F.lit(0))["role"] == role, F.get(messages, F.lit(1))["content"]).otherwise(F.get(messages, F.lit(0))["content"])


def preference_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, chosen[], rejected[], source), each a user's message and an answer in either order, into key, input, chosen, rejected, source."""
    return df.select(key, by_role(F.col("chosen"), "user").alias("input"), other_role(F.col("chosen"), "user").alias("chosen"), other_role(F.col("rejected"), "user").alias("rejected"), "source")


def task_prompts(df: DataFrame, rubric: Column, answers: dict[str, str], key: str = "id", seed: int = 0) -> DataFrame:
    """A row for each answer column that is there: (key-name, input, response, score) with a binary prompt; null answers give no row.

    ``answers`` maps a column to "true" or "false".
    """
    have = [c for c in answers if c in df.columns]
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("response"), F.lit(answers[c]).alias("score")) for c in have]))
    rows = df.select(F.col(key).alias("_key"), "input", x.alias("s")).where(F.col("s.response").isNotNull())
    rows = rows.select(F.concat(F.col("_key").cast("string"), F.lit("-"), F.col("s.name")).alias("id"), "input", "s.response", "s.score")
    return prompt_rows(rows, rubric, "binary", "input", "response", seed=seed)
