"""Views that the queries share: answers once each, truth, and benchmark-shaped tables made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.hashing import pick
from assize.plans.lineage import settle
from assize.sources.tables import canonical, table

MODELS = ["gavel-4b", "gavel-8b", "gavel-14b", "gavel-14b-lora", "tribune-mini", "assay-r"]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_responses").select("resp_id", "id", "model_id", "rubric_id", "response", "reasoning_content", "attempt").dropDuplicates(["resp_id"])


def truth(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "traces").select("id", F.col("actual_score").alias("score"), canonical(F.col("source")).alias("source"), F.col("rubric_id").alias("truth_rubric"))
    return t.dropDuplicates(["id"])


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prompts").dropDuplicates(["id"])


def traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "traces").dropDuplicates(["id"])


def judged(spark: SparkSession, d: str, mode: str | None = None, integer: bool = False) -> DataFrame:
    """Answers with their truth, of one evaluation mode."""
    from assize.operators.pairing import pair_by_key, parse_predictions

    p = parse_predictions(predictions(spark, d), integer=integer).select("resp_id", "id", "model_id", "rubric_id", "answer", "parse_failed")
    if mode:
        p = p.join(table(spark, d, "rubrics").where(F.col("eval_mode") == mode).select("rubric_id"), "rubric_id", "left_semi")
    # a table of its own: only a join right after its exchanges can be split at run time where one prompt has very many answers
    return pair_by_key(p, settle(truth(spark, d), "truth"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Domains as sections of sources, with a hashed weight, and one section without any member."""
    s = table(spark, d, "sources").select(F.col("domain").alias("section"), F.col("source").alias("subset"), (pick(F.col("source"), 7, 100) + 1).cast("double").alias("weight"))
    return s.unionByName(spark.createDataFrame([("void", "no such source", 1.0)], "section string, subset string, weight double"))


def style_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every document in nine cells; hits grow with i - j."""
    x = table(spark, d, "documents").select(F.coalesce(canonical(F.col("lang")), F.lit("und")).alias("l"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    cell = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"))
    hit = pick(cell, 9, 10) < F.col("i") - F.col("j") + 5
    return x.select(F.concat("l", F.lit("-sub/"), cell).alias("id"), F.when(hit, "Response 1").otherwise("Response 2").alias("answer"), F.lit("response 1").alias("score"))


def choice_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question of four options for each part."""
    k = F.col("p_partkey")
    options = F.array(*[F.concat_ws(" ", c, pick(k, 20 + i, 50).cast("string")) for i, c in enumerate(("p_brand", "p_type", "p_name", "p_brand"))])
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("question"), options.alias("choices"), pick(k, 5, 4).alias("answer"), F.col("p_brand").alias("subject"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Per prompt each model's answer and whether it is the truth."""
    from assize.functions.scoring import extract_score

    p = predictions(spark, d).join(settle(truth(spark, d), "truth"), "id").select("id", "model_id", extract_score(F.col("response")).alias("a"), "score")
    g = p.groupBy("id").pivot("model_id", MODELS).agg(F.min("a").alias("answer"), F.max(F.coalesce(F.col("a") == F.col("score"), F.lit(False))).alias("judge"))
    return g.select("id", *[F.col(f"`{m}_answer`").alias(f"answer_{m}") for m in MODELS], *[F.col(f"`{m}_judge`").alias(f"judge_{m}") for m in MODELS])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("int").alias("label"))
